"""Column functions over text: globs, tokens, k-grams, winnowed fingerprints, fuzzy ratios, paths."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

K_GRAM, WINNOW_WINDOW = 5, 4
_TOKEN = re.compile(rb"[a-z0-9_]+")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value worked out once a row, however often body names it within lambdas."""
    return F.element_at(F.transform(F.array(value), body), 1)


def ascii_lower(text: Column) -> Column:
    return F.translate(text, _UPPER, _LOWER)


def glob_regex(pattern: str) -> str:
    """A path glob of queries as a Java pattern: * crosses /, ? is one character, [..] and [^..] are classes.

    A ] right after the opening bracket stands for itself; an unclosed class matches nothing. Backslashes in
    the pattern are slashes.
    """
    out, i, pattern = "", 0, pattern.replace("\\", "/")
    while i < len(pattern):
        c = pattern[i]
        if c == "*":
            out += ".*"
        elif c == "?":
            out += "."
        elif c == "[":
            j = i + 1
            no = pattern[j : j + 1] == "^"
            j += no
            end = pattern.find("]", j + 1)
            if end < 0:
                return r"(?!)"
            out += "[" + "^" * no + re.sub(r"([\\\[\]^&~])", r"\\\1", pattern[j:end]) + "]"
            i = end
        else:
            out += re.escape(c)
        i += 1
    return f"(?s)^{out}\\z"


def path_glob(path: Column, pattern: str) -> Column:
    return path.rlike(glob_regex(pattern))


def file_glob_regex(pattern: str) -> str:
    """The plainer glob of file operations: only * and ? are special, neither crosses a line."""
    return "^" + "".join(".*" if c == "*" else "." if c == "?" else re.escape(c) for c in pattern) + "\\z"


def file_glob(path: Column, pattern: str) -> Column:
    return path.rlike(file_glob_regex(pattern))


def like_any(columns: list[Column], needles: list[str]) -> Column:
    """Whether any column holds any needle as a LIKE pattern (% and _ are wildcards), A-Z and a-z alike."""
    found = [ascii_lower(F.coalesce(c, F.lit(""))).like(f"%{n.translate(str.maketrans(_UPPER, _LOWER))}%".replace("\\", "\\\\")) for n in needles for c in columns]
    out = found[0]
    for x in found[1:]:
        out = out | x
    return out


def normalize_path(path: Column) -> Column:
    return F.trim(F.replace(path, F.lit("\\"), F.lit("/")))


def parent_dir(path: Column) -> Column:
    """What stands before the last slash; of a path without one the empty string."""
    return F.regexp_extract(path, r"(?s)^(.*)/[^/]*$", 1)


def code_tokens(content: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(content), F.lit("[a-z0-9_]+"), F.lit(0))


def query_tokens(query: str) -> list[str]:
    return [t.lower() for t in re.findall(r"[A-Za-z0-9:/]+", query)]


def hash64(text: Column) -> Column:
    """The first eight bytes of SHA-256, big-endian, as a signed number."""
    return F.conv(F.substring(F.sha2(text.cast("binary"), 256), 1, 16), 16, -10).cast("bigint")


def winnow(text: str, k: int = K_GRAM, window: int = WINNOW_WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(hashes, places) of a text's fingerprints, see winnowed()."""
    tokens = _TOKEN.findall(text.encode().lower())
    n = len(tokens) - k + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    sha = hashlib.sha256
    grams = np.frombuffer(b"".join([sha(b" ".join(tokens[i : i + k])).digest()[:8] for i in range(n)]), ">i8").astype(np.int64)
    if n <= window:
        return grams, np.arange(n)
    # the least of later windows is never further left, so equal ones stand beside one another
    least = np.lib.stride_tricks.sliding_window_view(grams, window).argmin(axis=1) + np.arange(n - window + 1)
    places = least[np.diff(least, prepend=-1) != 0]
    return grams[places], places


def winnowed(content: Column, k: int = K_GRAM, window: int = WINNOW_WINDOW) -> Column:
    """array<struct<fp_hash, span_start, span_end>>: of every window of k-gram hashes the least, leftmost if equal, once.

    Fewer tokens than k give none; as few k-grams as a window or fewer give all of them; null stays null.
    A file's fingerprints come from its row alone, in Arrow batches, and need no shuffle.
    """

    def run(texts: pa.Array) -> pa.Array:
        found = [None if t is None else winnow(t, k, window) for t in texts.to_pylist()]
        sizes = np.array([0 if f is None else len(f[0]) for f in found], np.int64)
        hashes, places = (np.concatenate([np.zeros(0, np.int64), *[f[j] for f in found if f is not None]]) for j in (0, 1))
        spans = pa.StructArray.from_arrays([pa.array(hashes), pa.array(places), pa.array(places + k)], ["fp_hash", "span_start", "span_end"])
        return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), spans, mask=pa.array([f is None for f in found]))

    # annotated by value, as annotations here are text that the function's module can't resolve in a worker
    run.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<struct<fp_hash:bigint,span_start:bigint,span_end:bigint>>")(content)


def subsequence_ratio(query: str, text: Column) -> Column:
    """1 if the text's letters and digits hold the query's in a row, else the share of the query's that a greedy reading meets in order."""
    letters = re.sub(r"[^A-Za-z0-9]", "", query).lower()
    if not letters:
        return F.lit(0.0)
    bare = F.regexp_replace(ascii_lower(F.coalesce(text, F.lit(""))), "[^a-z0-9]", "")
    wanted = F.lit(letters)
    met = F.aggregate(F.split(bare, ""), F.lit(0), lambda n, c: n + ((n < len(letters)) & (c == F.substr(wanted, n + 1, F.lit(1)))).cast("int"))
    return F.when(F.length(bare) == 0, 0.0).when(F.contains(bare, wanted), 1.0).otherwise(met / F.lit(float(len(letters))))


def lines_of(content: Column) -> Column:
    """Lines as readers count them: \\n or \\r\\n ends one, and nothing follows a last line end."""
    bare = F.regexp_replace(content, r"\r?\n\z", "")
    return F.when(F.length(content) == 0, F.array().cast("array<string>")).otherwise(F.split(bare, r"\r?\n"))
