"""Reading, searching, listing and editing files: over DataFrames of (path, content), and on disk."""

from __future__ import annotations

import os
import re
import tempfile
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lumigraph.functions.text import file_glob, let, lines_of
from lumigraph.schema import Graph
from lumigraph.sources.repo import IGNORED_DIRS

READ_LINES, MULTI_READ_LINES, SEARCH_RESULTS, SEARCH_CONTEXT, LIST_DEPTH = 500, 2000, 50, 2, 3


def _range(total: Column, start: Column, end: Column) -> tuple[Column, Column]:
    """First and last line (1-based, both included) of what is asked for, within the file; 0 and 0 in an empty one."""
    first = F.least(F.greatest(F.coalesce(start, F.lit(1)), F.lit(1)), total)
    last = F.least(F.greatest(F.coalesce(end, total), first), total)
    return F.when(total == 0, 0).otherwise(first), F.when(total == 0, 0).otherwise(last)


def read_ranges(files: DataFrame, requests: DataFrame, max_lines: Column) -> DataFrame:
    """requests (path, start_line, end_line, ...) joined to files (path, content): the lines of each, max_lines at most.

    Adds total_lines, start_line, end_line, returned_lines, truncated and content.
    """
    found = requests.join(files.select("path", lines_of(F.col("content")).alias("lines")), "path").withColumn("total", F.size("lines"))
    first, last = _range(F.col("total"), F.col("start_line"), F.col("end_line"))
    found = found.withColumn("first", first).withColumn("asked", F.when(F.col("total") == 0, 0).otherwise(last - F.col("first") + 1))
    found = found.withColumn("taken", F.least(F.col("asked"), max_lines).cast("int"))
    content = F.when(F.col("taken") > 0, F.array_join(F.slice("lines", F.greatest("first", F.lit(1)), F.col("taken")), "\n")).otherwise("")
    kept = [c for c in requests.columns if c not in ("start_line", "end_line")]
    return found.select(*kept, content.alias("content"), F.col("total").cast("bigint").alias("total_lines"), F.col("first").cast("bigint").alias("start_line"), F.greatest(F.col("first") + F.col("taken") - 1, F.lit(0)).cast("bigint").alias("end_line"), F.col("taken").cast("bigint").alias("returned_lines"), (F.col("taken") < F.col("asked")).alias("truncated"))


def read_file(files: DataFrame, path: str, start_line: int | None = None, end_line: int | None = None, max_lines: int = READ_LINES) -> DataFrame:
    wanted = files.where(F.col("path") == path)
    lang = F.col("lang") if "lang" in files.columns else F.regexp_extract("path", r"\.([^./]+)$", 1)
    requests = wanted.select("path", lang.alias("language"), F.lit(start_line).cast("int").alias("start_line"), F.lit(end_line).cast("int").alias("end_line"))
    return read_ranges(wanted, requests, F.lit(max_lines))


def allocate_budgets(asked: list[int], most: int) -> list[int]:
    """How many lines each of several requests gets of a shared number.

    All of them if they fit; else each its share rounded down, but one line at least while there are
    any, then what is over goes back from the first on, or what is left goes to the first that have room.
    """
    total = sum(asked)
    if total <= most:
        return list(asked)
    out, given = [], 0
    for n in asked:
        out.append(min(n, max(n * most // total, int(most > given))) if n else 0)
        given += out[-1]
    for i, n in enumerate(asked):
        step = max(0, min(n - out[i], most - given)) if given <= most else -int(out[i] > 0)
        out[i] += step
        given += step
    return out


def multi_read(files: DataFrame, requests: list[tuple[str, int | None, int | None]], max_total_lines: int = MULTI_READ_LINES) -> DataFrame:
    """(request, path, ...) of several ranges that share a number of lines; requests are a caller's, so a short list."""
    spark = files.sparkSession
    asked = spark.createDataFrame([(i, *r) for i, r in enumerate(requests)], "request int, path string, start_line int, end_line int")
    wanted = files.join(F.broadcast(asked.select("path").distinct()), "path", "left_semi")
    full = read_ranges(wanted, asked, F.lit(2**31 - 1)).select("request", "returned_lines")
    sizes = {r.request: r.returned_lines for r in full.collect()}
    order = sorted(sizes)
    budgets = allocate_budgets([sizes[i] for i in order], max_total_lines)
    shares = spark.createDataFrame(list(zip(order, budgets, strict=True)), "request int, budget int")
    return read_ranges(wanted, asked.join(F.broadcast(shares), "request"), F.col("budget")).drop("budget").orderBy("request")


def symbol_source(graph: Graph, files: DataFrame, name: str, context_lines: int = 2, max_definitions: int = 10, max_total_lines: int = 400) -> DataFrame:
    """The source of a name's first definitions, with lines around them, under a shared number of lines."""
    from lumigraph.operators.graph import symbol_definitions

    found = symbol_definitions(graph, name).limit(max(1, max_definitions)).collect()
    around = [(r.file_path, max(1, r.line - context_lines), max(r.end_line or r.line, r.line) + context_lines) for r in found]
    about = files.sparkSession.createDataFrame([(i, r.symbol_name, r.qualname, r.kind, r.line, r.end_line) for i, r in enumerate(found)], "request int, symbol_name string, qualname string, kind string, line bigint, definition_end bigint")
    return multi_read(files, around, max_total_lines).join(F.broadcast(about), "request").orderBy("request")


def outline(entities: DataFrame, paths: list[str] | None = None, max_depth: int | None = None) -> DataFrame:
    """(file_path, name, qualname, kind, line, end_line) of the symbols that files define, no deeper than max_depth."""
    found = entities.where("entity_type = 'symbol'")
    if paths is not None:
        found = found.where(F.col("file_path").isin(*paths))
    if max_depth is not None:
        found = found.where(F.size(F.split("qualname", "::")) - 1 <= max_depth)
    return found.select("file_path", "name", "qualname", "kind", "line", "end_line").orderBy("file_path", "line", "qualname")


def multi_outline(files: DataFrame, entities: DataFrame, paths: list[str], max_depth: int | None = None) -> DataFrame:
    """(file_path, entries, note): a row for each path that is a file; note says where there is no outline."""
    own = outline(entities, paths, max_depth).groupBy("file_path").agg(F.count(F.lit(1)).alias("entries"))
    found = files.where(F.col("path").isin(*paths)).select(F.col("path").alias("file_path"), "lang").join(own, "file_path", "left")
    return found.select("file_path", F.coalesce("entries", F.lit(0)).cast("bigint").alias("entries"), F.when(F.col("lang").isNull(), "outline is not supported for this file type").alias("note"))


def search_files(files: DataFrame, pattern: str, is_regex: bool = False, glob: str | None = None, context_lines: int = SEARCH_CONTEXT, max_results: int = SEARCH_RESULTS) -> DataFrame:
    """(file, line, content, context_before, context_after) of matching lines, by file and line, max_results (1 at least) of them.

    A hit takes its context with it from the row of its file, not the file. Files without a match are
    dropped before their lines are told apart.
    """
    test = (lambda c: c.rlike(pattern)) if is_regex else (lambda c: F.contains(c, F.lit(pattern)))
    if glob is not None:
        files = files.where(file_glob(F.col("path"), glob))
    if not is_regex:
        files = files.where(test(F.col("content")))
    numbered = lambda lines: F.filter(F.transform(lines, lambda x, i: F.struct((i + 1).alias("line"), x.alias("content"))), lambda x: test(x["content"]))
    before = lambda lines, n: F.slice(lines, F.greatest(n - context_lines, F.lit(1)), F.least(n - 1, F.lit(context_lines)))
    around = lambda lines, x: F.struct(x["line"].cast("bigint").alias("line"), x["content"].alias("content"), before(lines, x["line"]).alias("context_before"), F.slice(lines, x["line"] + 1, F.lit(context_lines)).alias("context_after"))
    hits = let(lines_of(F.col("content")), lambda lines: F.transform(numbered(lines), lambda x: around(lines, x)))
    found = files.select(F.col("path").alias("file"), F.explode(hits).alias("hit")).select("file", "hit.*")
    return found.orderBy("file", "line").limit(max(1, max_results))


def search_summary(rows: DataFrame, max_results: int = SEARCH_RESULTS) -> DataFrame:
    """(total_matches, truncated) of what search_files returned; a full page counts as truncated."""
    return rows.agg(F.count(F.lit(1)).alias("total_matches")).withColumn("truncated", F.col("total_matches") >= max(1, max_results))


def list_directory(files: DataFrame, directory: str = "", recursive: bool = False, max_depth: int = LIST_DEPTH, glob: str | None = None) -> DataFrame:
    """(path, type, size_bytes) of what is in a directory of files (path, size_bytes): directories and files, by path.

    The glob is matched against files' paths and does not drop directories. Ignored directories are left out.
    """
    inside = files if not directory else files.where(F.startswith("path", F.lit(f"{directory}/")))
    rest = F.col("path") if not directory else F.substr("path", F.lit(len(directory) + 2))
    inside = inside.select("path", "size_bytes", F.split(rest, "/").alias("parts")).where(~F.arrays_overlap("parts", F.array(*map(F.lit, IGNORED_DIRS))))
    depth = max(1, max_depth) if recursive else 1
    prefix = f"{directory}/" if directory else ""
    own = inside.where(F.size("parts") <= depth).select("path", F.lit("file").alias("type"), "size_bytes")
    if glob is not None:
        own = own.where(file_glob(F.col("path"), glob))
    levels = F.sequence(F.lit(1), F.least(F.size("parts") - 1, F.lit(depth)))
    folders = inside.where(F.size("parts") > 1).select(F.explode(F.transform(levels, lambda k: F.concat(F.lit(prefix), F.array_join(F.slice("parts", F.lit(1), k), "/")))).alias("path")).distinct()
    return own.unionByName(folders.select("path", F.lit("directory").alias("type"), F.lit(None).cast("bigint").alias("size_bytes"))).orderBy("path")


def edit_texts(files: DataFrame, old_text: str, new_text: str, replace_all: bool = False) -> DataFrame:
    """(path, occurrences_found, replacements_applied, content, error): one edit on the content of every file.

    Occurrences do not overlap. Without replace_all the text must stand there exactly once; where an edit
    can't be made, error says why and the content is as it was.
    """
    if not old_text:
        raise ValueError("old_text must not be empty")
    found = files.select("path", "content", ((F.length("content") - F.length(F.replace("content", F.lit(old_text), F.lit("")))) / len(old_text)).cast("bigint").alias("n"))
    error = F.when(F.col("n") == 0, "old_text not found in file")
    if not replace_all:
        error = error.when(F.col("n") > 1, F.concat(F.lit("old_text matches "), F.col("n").cast("string"), F.lit(" times; must match exactly once")))
    applied = F.when(error.isNotNull(), 0).otherwise(F.col("n"))
    return found.select("path", F.col("n").alias("occurrences_found"), applied.cast("bigint").alias("replacements_applied"), F.when(error.isNull(), F.replace("content", F.lit(old_text), F.lit(new_text))).otherwise(F.col("content")).alias("content"), error.alias("error"))


# On disk: what follows works on one repository folder, on the driver.


class EditError(ValueError):
    """An edit, patch or path that can't be carried out."""


def sandboxed(root: str, path: str, new: bool = False) -> str:
    """The real place of a path that must be inside root; with new only its folder must be there."""
    base, full = os.path.realpath(root), os.path.realpath(os.path.join(root, path))
    if full != base and not full.startswith(base + os.sep):
        raise EditError(f"path is outside the repository: {path}")
    if not (new or os.path.exists(full)):
        raise EditError(f"path does not exist: {path}")
    return full


def _write(path: str, text: str) -> None:
    """Beside the file first, then in its place at once."""
    handle, name = tempfile.mkstemp(dir=os.path.dirname(path))
    with os.fdopen(handle, "w", encoding="utf-8", newline="") as f:
        f.write(text)
    os.chmod(name, os.stat(path).st_mode & 0o777 if os.path.exists(path) else 0o644)
    os.replace(name, path)


def _read(path: str) -> str:
    with open(path, encoding="utf-8", newline="") as f:
        return f.read()


def write_file(root: str, path: str, content: str, create_dirs: bool = True) -> dict:
    full = sandboxed(root, path, new=True)
    created = not os.path.exists(full)
    if create_dirs:
        os.makedirs(os.path.dirname(full), exist_ok=True)
    elif not os.path.isdir(os.path.dirname(full)):
        raise EditError(f"parent directory does not exist: {path}")
    _write(full, content)
    return {"path": path, "bytes_written": len(content.encode()), "created": created}


def edit_text(text: str, old: str, new: str, replace_all: bool = False) -> tuple[str, int]:
    """The edited text and how often old stood in it."""
    if not old:
        raise EditError("old_text must not be empty")
    n = text.count(old)
    if not n:
        raise EditError("old_text not found in file")
    if n > 1 and not replace_all:
        raise EditError(f"old_text matches {n} times; must match exactly once")
    return text.replace(old, new), n


def diff_preview(before: str, after: str, old: str) -> str:
    """Two lines on either side of the first place of old, before and after."""
    at = before.find(old)
    if at < 0:
        return ""
    line = before.count("\n", 0, at) + 1
    cut = lambda text: "\n".join(re.sub(r"\r?\n\Z", "", text).split("\n")[max(line - 2, 1) - 1 : line + 2])
    return f"--- old\n{cut(before)}\n+++ new\n{cut(after)}"


def batch_edit(root: str, edits: list[dict], dry_run: bool = False) -> dict:
    """Edits (path, old_text, new_text, replace_all) in turn; nothing is written unless every one can be made."""
    texts, results = {}, []
    for e in edits:
        full = sandboxed(root, e["path"])
        before = texts[full] if full in texts else _read(full)
        after, n = edit_text(before, e["old_text"], e["new_text"], e.get("replace_all", False))
        texts[full] = after
        results.append({"path": e["path"], "occurrences_found": n, "replacements_applied": n, "diff_preview": diff_preview(before, after, e["old_text"])})
    if not dry_run:
        for full, text in texts.items():
            _write(full, text)
    return {"results": results, "files_changed": len(texts), "total_replacements": sum(r["replacements_applied"] for r in results), "dry_run": dry_run}


@dataclass
class Hunk:
    """old_lines at start_line (1-based) become new_lines; without old_lines it inserts before that line."""

    start_line: int
    old_lines: list[str] = field(default_factory=list)
    new_lines: list[str] = field(default_factory=list)


def shown(lines: list[str], most: int = 5) -> str:
    """The first lines, quoted, and how many more there are."""
    return repr("\n".join(lines[:most])) + (f" and {len(lines) - most} more lines" if len(lines) > most else "")


def hunk_preview(h: Hunk) -> str:
    """A hunk as a diff shows it."""
    return "\n".join([f"@@ {h.start_line},{len(h.old_lines)} +{len(h.new_lines)} @@", *[f"-{x}" for x in h.old_lines], *[f"+{x}" for x in h.new_lines]])


def patch_text(text: str, hunks: list[Hunk]) -> str:
    """Applies hunks in order of their lines, which count in the text as it was."""
    ends = text.endswith("\n")
    lines = text.split("\n")[: -1 if ends else None] if text else []
    moved = 0
    for h in sorted(hunks, key=lambda h: h.start_line):
        at = h.start_line - 1 + moved
        if at < 0 or at + len(h.old_lines) > len(lines):
            raise EditError(f"patch hunk at line {h.start_line} is outside the file")
        if lines[at : at + len(h.old_lines)] != h.old_lines:
            raise EditError(f"patch hunk at line {h.start_line} did not match file contents: expected {shown(h.old_lines)}, found {shown(lines[at : at + len(h.old_lines)])}")
        lines[at : at + len(h.old_lines)] = h.new_lines
        moved += len(h.new_lines) - len(h.old_lines)
    return "\n".join(lines) + ("\n" if ends and lines else "")


def apply_patch(root: str, patches: list[tuple[str, list[Hunk]]], dry_run: bool = False) -> dict:
    """Patches of several files; nothing is written unless every hunk fits."""
    texts: dict[str, str] = {}
    for path, hunks in patches:
        full = sandboxed(root, path)
        texts[full] = patch_text(texts[full] if full in texts else _read(full), hunks)
    if not dry_run:
        for full, text in texts.items():
            _write(full, text)
    return {"files_changed": len(texts), "hunks_applied": sum(len(h) for _, h in patches), "previews": [{"path": p, "diff_preview": "\n".join(map(hunk_preview, sorted(hs, key=lambda h: h.start_line)))} for p, hs in patches], "dry_run": dry_run}


def move_file(root: str, source: str, target: str) -> dict:
    a, b = sandboxed(root, source), sandboxed(root, target, new=True)
    if not os.path.isfile(a):
        raise EditError(f"not a file: {source}")
    os.makedirs(os.path.dirname(b), exist_ok=True)
    os.replace(a, b)
    return {"from": source, "to": target}


def delete_file(root: str, path: str) -> dict:
    full = sandboxed(root, path)
    if not os.path.isfile(full):
        raise EditError(f"not a file: {path}")
    os.remove(full)
    return {"path": path, "deleted": True}
