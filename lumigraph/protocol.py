"""The tools over a line of JSON-RPC: one object in, one object out.

Requests come one to a line or behind Content-Length headers, and are answered in the same way.
"""

from __future__ import annotations

import dataclasses
import datetime
import json
import os
from collections.abc import Callable
from typing import Any, BinaryIO

from pyspark.sql import DataFrame, Row, SparkSession

from lumigraph.operators import clones, discover, files, graph, index
from lumigraph.plans import paging, selectors
from lumigraph.sources.repo import STATE_DIR, scan

PROTOCOL = "2024-11-05"  # what is spoken where a client names none
_TEXT, _NUMBER, _SHARE, _FLAG = ({"type": t} for t in ("string", "integer", "number", "boolean"))
_LIST = lambda item: {"type": "array", "items": item}
_OBJECT = lambda needed, **known: {"type": "object", "properties": known, "required": needed}
_RANGE = _OBJECT(["path"], path=_TEXT, start_line=_NUMBER, end_line=_NUMBER)
_EDIT = _OBJECT(["path", "old_text", "new_text"], path=_TEXT, old_text=_TEXT, new_text=_TEXT, replace_all=_FLAG)
_HUNK = _OBJECT(["start_line"], start_line=_NUMBER, old_lines=_LIST(_TEXT), new_lines=_LIST(_TEXT))
_REFERENCES = {"name": _TEXT, "file_glob": _TEXT, "language": _TEXT, "max_age_hours": _NUMBER, "dedup": _FLAG, "order": _TEXT, "limit": _NUMBER, "offset": _NUMBER, "top_files": _NUMBER}
# What each tool does, the parameters that it needs, and all that it knows (verbosity comes with every one).
DESCRIBED = {
    "index_repository": ("Bring the index up to date with the repository, or build it anew.", [], {"full": _FLAG}),
    "symbol_definitions": ("Where a name is defined.", ["name"], {"name": _TEXT}),
    "symbol_references": ("What refers to a name, scored, with pages and the files that refer most.", ["name"], {"edge_type": _TEXT} | _REFERENCES),
    "symbol_callers": ("What calls a name.", ["name"], _REFERENCES),
    "symbol_source": ("The source of a name's definitions.", ["name"], {"name": _TEXT, "context_lines": _NUMBER, "max_definitions": _NUMBER, "max_total_lines": _NUMBER}),
    "dependency_path": ("A shortest path between two selectors.", ["from", "to"], {"from": _TEXT, "to": _TEXT, "max_depth": _NUMBER}),
    "minimal_slice": ("What is around a place of a file in the graph.", ["file"], {"file": _TEXT, "line": _NUMBER, "depth": _NUMBER, "max_neighbors": _NUMBER, "dedup": _FLAG, "suppress_repeats": _FLAG, "name_cap": _NUMBER, "prefer_project": _FLAG}),
    "clone_matches": ("Files that share code with a file.", ["file"], {"file": _TEXT, "min_similarity": _SHARE, "limit": _NUMBER, "offset": _NUMBER}),
    "selector_discover": ("Selectors that fit a query.", [], {"query": _TEXT, "entity_type": _TEXT, "file_glob": _TEXT, "limit": _NUMBER, "fuzzy": _FLAG}),
    "read_file": ("Lines of a file.", ["path"], {"path": _TEXT, "start_line": _NUMBER, "end_line": _NUMBER, "max_lines": _NUMBER}),
    "multi_read": ("Lines of several files under one budget.", ["files"], {"files": _LIST(_RANGE), "max_total_lines": _NUMBER}),
    "file_outline": ("The symbols that a file defines.", ["path"], {"path": _TEXT, "max_depth": _NUMBER}),
    "multi_outline": ("How many symbols several files define.", ["paths"], {"paths": _LIST(_TEXT), "max_depth": _NUMBER}),
    "search_files": ("Lines that hold a text or match a pattern.", ["pattern"], {"pattern": _TEXT, "is_regex": _FLAG, "file_glob": _TEXT, "context_lines": _NUMBER, "max_results": _NUMBER}),
    "list_directory": ("What is in a directory.", [], {"path": _TEXT, "recursive": _FLAG, "max_depth": _NUMBER, "file_glob": _TEXT}),
    "write_file": ("Write a file.", ["path"], {"path": _TEXT, "content": _TEXT, "create_dirs": _FLAG}),
    "edit_file": ("Replace a text of a file.", ["path", "old_text", "new_text"], _EDIT["properties"] | {"dry_run": _FLAG}),
    "batch_edit": ("Replace texts of several files, all or none.", ["edits"], {"edits": _LIST(_EDIT), "dry_run": _FLAG}),
    "apply_patch": ("Apply hunks to several files, all or none.", ["patches"], {"patches": _LIST(_OBJECT(["path", "hunks"], path=_TEXT, hunks=_LIST(_HUNK))), "dry_run": _FLAG}),
    "move_file": ("Move a file.", ["from", "to"], {"from": _TEXT, "to": _TEXT}),
    "delete_file": ("Delete a file.", ["path"], {"path": _TEXT}),
}
UNKNOWN_METHOD, BAD_PARAMETERS = -32601, -32602
HIDDEN_IF_COMPACT = ("why", "meta_json", "diagnostics")
_NEEDED = object()


class BadParameter(ValueError):
    """A parameter that is missing or of the wrong kind."""


def parameter(args: dict, name: str, kind: type | tuple, default: Any = _NEEDED) -> Any:
    value = args.get(name)
    if value is None and default is not _NEEDED and (name not in args or kind is str or name == "line"):
        return default
    if not isinstance(value, kind) or (isinstance(value, bool) and kind is not bool) or (kind is int and value < 0) or (value == "" and default is _NEEDED):
        raise BadParameter(f"parameter {name} is missing or not of the right type")
    return value


def plain(value: Any) -> Any:
    """Rows, dates and nested values as JSON has them; columns without a value are left out."""
    if isinstance(value, Row):
        return {k: plain(v) for k, v in value.asDict().items() if v is not None}
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S")
    if isinstance(value, dict):
        return {k: plain(v) for k, v in value.items()}
    return [plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def compact(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: compact(v) for k, v in value.items() if k not in HIDDEN_IF_COMPACT}
    return [compact(v) for v in value] if isinstance(value, list) else value


class Tools:
    """The tools by name; each takes a dictionary of parameters. Answers are pages, so small."""

    def __init__(self, spark: SparkSession, root: str, state: str | None = None, clock: Callable[[], datetime.datetime] | None = None):
        self.spark, self.root, self.state = spark, root, state or os.path.join(root, STATE_DIR)
        self.clock = clock or (lambda: datetime.datetime.now(datetime.UTC).replace(tzinfo=None))
        self.tools = {n.removeprefix("tool_"): getattr(self, n) for n in dir(self) if n.startswith("tool_")}

    def _graph(self):
        return index.Snapshots(self.spark, self.state).read()

    def _files(self) -> DataFrame:
        return scan(self.spark, self.root)[0]

    def call(self, name: str, args: dict) -> dict:
        """The answer; verbosity compact (the default) leaves out reasons, debug adds freshness."""
        verbosity = parameter(args, "verbosity", str, "compact")
        if verbosity not in ("compact", "normal", "debug"):
            raise BadParameter("verbosity must be compact, normal or debug")
        out = plain(self.tools[name](args))
        if verbosity == "debug":
            out["diagnostics"] = {"freshness": plain(graph.freshness_info(self._graph().files, self.clock()).first())}
        return compact(out) if verbosity == "compact" else out

    def tool_index_repository(self, a):
        return index.index_repository(self.spark, self.root, self.state, parameter(a, "full", bool, False))

    def tool_symbol_definitions(self, a):
        return {"rows": graph.symbol_definitions(self._graph(), parameter(a, "name", str)).collect()}

    def _references(self, a, edge_type):
        g, name = self._graph(), parameter(a, "name", str)
        options = {"edge_type": edge_type, "file_glob": parameter(a, "file_glob", str, None), "language": parameter(a, "language", str, None), "max_age_hours": parameter(a, "max_age_hours", int, None), "dedup": parameter(a, "dedup", bool, True), "now": self.clock()}
        limit, offset = parameter(a, "limit", int, 200), parameter(a, "offset", int, 0)
        rows = graph.symbol_references(g, name, parameter(a, "order", str, "score_desc"), limit, offset, **options)
        found = paging.pagination(graph.references(g, name, **options), limit, offset)
        return {"rows": rows.collect(), "pagination": found.first(), "top_files": graph.top_reference_files(rows, parameter(a, "top_files", int, 10)).collect()}

    def tool_symbol_references(self, a):
        return self._references(a, parameter(a, "edge_type", str, None))

    def tool_symbol_callers(self, a):
        return self._references(a, "calls")

    def tool_symbol_source(self, a):
        sizes = {k: parameter(a, k, int, d) for k, d in (("context_lines", 2), ("max_definitions", 10), ("max_total_lines", 400))}
        return {"rows": files.symbol_source(self._graph(), self._files(), parameter(a, "name", str), **sizes).collect()}

    def tool_dependency_path(self, a):
        g, ends = self._graph(), [parameter(a, k, str) for k in ("from", "to")]
        hops = graph.dependency_path(g, *ends, parameter(a, "max_depth", int, 8)).collect()
        return {"found": bool(hops), "hops": hops, "diagnostics": [selectors.describe_selector(g, e).first() for e in ends]}

    def tool_minimal_slice(self, a):
        g, path, line = self._graph(), parameter(a, "file", str), parameter(a, "line", int, None)
        options = {"depth": parameter(a, "depth", int, 2), "max_neighbors": parameter(a, "max_neighbors", int, 40), "dedup": parameter(a, "dedup", bool, True), "suppress_repeats": parameter(a, "suppress_repeats", bool, True), "name_cap": parameter(a, "name_cap", int, 1), "prefer_project": parameter(a, "prefer_project", bool, True)}
        start = graph.anchor(g, path, line).first()
        return {"anchor": start, "neighbors": graph.minimal_slice(g, path, line, **options).collect() if start else []}

    def tool_clone_matches(self, a):
        prints, path, least = self._graph().fingerprints, parameter(a, "file", str), float(parameter(a, "min_similarity", (int, float), clones.MIN_SIMILARITY))
        limit, offset = parameter(a, "limit", int, clones.LIMIT), parameter(a, "offset", int, 0)
        rows = clones.clone_candidates(prints, path).where(f"similarity >= {least!r}")
        return {"rows": clones.clone_matches(prints, path, least, limit, offset).collect(), "hotspots": clones.clone_hotspots(prints, path, least).collect(), "pagination": paging.pagination(rows, limit, offset).first(), "analysis": clones.clone_analysis(prints, path, least).first()}

    def tool_selector_discover(self, a):
        options = {"entity_type": parameter(a, "entity_type", str, None), "file_glob": parameter(a, "file_glob", str, None), "limit": parameter(a, "limit", int, 20), "fuzzy": parameter(a, "fuzzy", bool, True)}
        return {"rows": discover.discover_selectors(self._graph().entities, parameter(a, "query", str, None), **options).collect()}

    def tool_read_file(self, a):
        row = files.read_file(self._files(), parameter(a, "path", str), parameter(a, "start_line", int, None), parameter(a, "end_line", int, None), parameter(a, "max_lines", int, files.READ_LINES)).first()
        if row is None:
            raise files.EditError(f"path does not exist: {a['path']}")
        return row.asDict()

    def tool_multi_read(self, a):
        wanted = [(parameter(r, "path", str), parameter(r, "start_line", int, None), parameter(r, "end_line", int, None)) for r in parameter(a, "files", list)]
        rows = files.multi_read(self._files(), wanted, parameter(a, "max_total_lines", int, files.MULTI_READ_LINES)).collect()
        return {"results": rows, "total_lines_returned": sum(r.returned_lines for r in rows)}

    def tool_file_outline(self, a):
        return {"entries": files.outline(self._graph().entities, [parameter(a, "path", str)], parameter(a, "max_depth", int, None)).collect()}

    def tool_multi_outline(self, a):
        g = self._graph()
        rows = files.multi_outline(g.files, g.entities, parameter(a, "paths", list), parameter(a, "max_depth", int, None)).collect()
        return {"files": rows, "total_entries": sum(r.entries for r in rows), "unsupported": sum(r.note is not None for r in rows)}

    def tool_search_files(self, a):
        most = parameter(a, "max_results", int, files.SEARCH_RESULTS)
        rows = files.search_files(self._files(), parameter(a, "pattern", str), parameter(a, "is_regex", bool, False), parameter(a, "file_glob", str, None), parameter(a, "context_lines", int, files.SEARCH_CONTEXT), most).collect()
        return {"matches": rows, "total_matches": len(rows), "truncated": len(rows) >= max(1, most)}

    def tool_list_directory(self, a):
        rows = files.list_directory(self._files(), parameter(a, "path", str, None) or "", parameter(a, "recursive", bool, False), parameter(a, "max_depth", int, files.LIST_DEPTH), parameter(a, "file_glob", str, None))
        return {"entries": rows.collect()}

    def tool_write_file(self, a):
        return files.write_file(self.root, parameter(a, "path", str), parameter(a, "content", str, ""), parameter(a, "create_dirs", bool, True))

    def tool_edit_file(self, a):
        return files.batch_edit(self.root, [a], parameter(a, "dry_run", bool, False))

    def tool_batch_edit(self, a):
        return files.batch_edit(self.root, parameter(a, "edits", list), parameter(a, "dry_run", bool, False))

    def tool_apply_patch(self, a):
        known = {f.name for f in dataclasses.fields(files.Hunk)}
        patches = [(parameter(p, "path", str), [files.Hunk(**{k: v for k, v in h.items() if k in known}) for h in parameter(p, "hunks", list)]) for p in parameter(a, "patches", list)]
        return files.apply_patch(self.root, patches, parameter(a, "dry_run", bool, False))

    def tool_move_file(self, a):
        return files.move_file(self.root, parameter(a, "from", str), parameter(a, "to", str))

    def tool_delete_file(self, a):
        return files.delete_file(self.root, parameter(a, "path", str))


def answer(tools: Tools, request: dict) -> dict | None:
    """The reply to a request; none to one without an id."""
    if "id" not in request:
        return None
    method, params = request.get("method"), request.get("params") or {}
    reply = {"jsonrpc": "2.0", "id": request["id"]}
    error = lambda code, text: reply | {"error": {"code": code, "message": text}}
    if method == "initialize":
        asked = params.get("protocolVersion")
        return reply | {"result": {"protocolVersion": asked if isinstance(asked, str) else PROTOCOL, "capabilities": {"tools": {"listChanged": False}}, "serverInfo": {"name": "lumigraph", "version": "0.1"}}}
    if method == "ping":
        return reply | {"result": {}}
    if method == "tools/list":
        return reply | {"result": {"tools": [{"name": n, "description": d, "inputSchema": _OBJECT(needed, **known, verbosity={"type": "string", "enum": ["compact", "normal", "debug"]})} for n, (d, needed, known) in sorted(DESCRIBED.items())]}}
    if method != "tools/call":
        return error(UNKNOWN_METHOD, f"unknown method {method}")
    if params.get("name") not in tools.tools:
        return error(BAD_PARAMETERS, f"unknown tool {params.get('name')}")
    try:
        found, failed = tools.call(params["name"], params.get("arguments") or {}), False
    except BadParameter as e:
        return error(BAD_PARAMETERS, str(e))
    except Exception as e:  # what goes wrong inside a tool is its answer, and the server goes on
        found, failed = {"error": str(e)}, True
    return reply | {"result": {"content": [{"type": "text", "text": json.dumps(found, ensure_ascii=False)}], "isError": failed}}


def read_frame(source: BinaryIO) -> tuple[bytes, bool] | None:
    """(body, whether it came behind headers); none at the end."""
    while line := source.readline():
        if line.lower().startswith(b"content-length:"):
            size = int(line.split(b":")[1])
            while source.readline().strip():
                pass
            return source.read(size), True
        if line.strip():
            return line.strip(), False
    return None


def serve(tools: Tools, source: BinaryIO, target: BinaryIO) -> None:
    while frame := read_frame(source):
        body, headed = frame
        try:
            reply = answer(tools, json.loads(body))
        except ValueError:
            reply = {"jsonrpc": "2.0", "id": None, "error": {"code": -32700, "message": "not JSON"}}
        if reply is not None:
            data = json.dumps(reply, ensure_ascii=False).encode()
            target.write(b"Content-Length: %d\r\n\r\n%s" % (len(data), data) if headed else data + b"\n")
            target.flush()
