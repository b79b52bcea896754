"""Definitions, references and imports of source files.

Python goes by its own parser, HTML, JSON, TOML and YAML by readers of their own. Other languages go by
lexical rules: comments and strings are blanked, then patterns tell definitions, calls, other names and
imports apart, and braces tell where a definition ends. The latter is approximate; kinds are named as
syntax trees name them.
"""

from __future__ import annotations

import ast
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import DataFrame

DEFINITION = "name string, qualname string, kind string, line bigint, col bigint, end_line bigint, end_col bigint"
REFERENCE = "name string, edge_type string, line bigint, col bigint, end_line bigint, end_col bigint"
IMPORT = "module string, line bigint, col bigint"
EXTRACTED = f"path string, lang string, definitions array<struct<{DEFINITION.replace(' ', ':').replace(',:', ',')}>>, references array<struct<{REFERENCE.replace(' ', ':').replace(',:', ',')}>>, imports array<struct<{IMPORT.replace(' ', ':').replace(',:', ',')}>>, error string"

_ID = r"[A-Za-z_$][\w$]*"
_COMMON = "if else for while do switch case return break continue new try catch finally throw class struct enum in of is as import from package using namespace const let var val fn func function def end then match where when yield await async this self super null nil None true false True False and or not static public private protected void int float double bool char string let mut pub use mod impl trait type interface extends implements".split()


@dataclass
class Rules:
    """patterns: (kind, regex whose group 1 is the name). imports: regex whose group 1 is the module."""

    patterns: list[tuple[str, str]]
    imports: str | None = None
    comments: str = r"//[^\n]*|/\*.*?\*/"
    strings: str = r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'"
    calls: str = rf"({_ID})\s*\("
    names: str | None = rf"({_ID})"
    ends: str = "braces"


_JS = [("function_declaration", rf"\bfunction\s*\*?\s+({_ID})"), ("class_declaration", rf"\bclass\s+({_ID})"), ("method_definition", rf"^[ \t]+(?:static\s+|async\s+|get\s+|set\s+)*({_ID})\s*\([^;{{}}]*\)\s*\{{"), ("variable_declarator", rf"\b(?:const|let|var)\s+({_ID})\s*=\s*(?:async\s*)?(?:\([^()]*\)|{_ID})\s*=>")]
_TS = [*_JS, ("interface_declaration", rf"\binterface\s+({_ID})"), ("type_alias_declaration", rf"\btype\s+({_ID})\s*[=<]"), ("enum_declaration", rf"\benum\s+({_ID})")]
_JS_IMPORT = r"^\s*import\b[^\n;]*?['\"]([^'\"\n]+)['\"]"
_C = [("function_definition", rf"^[\w\s*&<>:,~]*?\b({_ID})\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{"), ("struct_specifier", rf"\bstruct\s+({_ID})\s*\{{"), ("enum_specifier", rf"\benum\s+(?:class\s+)?({_ID})\s*\{{")]
_TYPES = lambda kinds: [(f"{k}_declaration", rf"\b{k}\s+({_ID})") for k in kinds]
_METHOD = rf"^[ \t]+(?:[\w<>\[\],?]+\s+)+({_ID})\s*\([^;{{}}]*\)\s*(?:throws\s+[\w,\s]+)?\{{"
_HASH = r"#[^\n]*"

RULES = {
    "rust": Rules([("function_item", rf"\bfn\s+({_ID})"), ("struct_item", rf"\bstruct\s+({_ID})"), ("enum_item", rf"\benum\s+({_ID})"), ("trait_item", rf"\btrait\s+({_ID})"), ("impl_item", rf"\bimpl(?:<[^>]*>)?\s+(?:[\w:<>]+\s+for\s+)?({_ID})"), ("mod_item", rf"\bmod\s+({_ID})"), ("const_item", rf"\bconst\s+({_ID})"), ("type_item", rf"\btype\s+({_ID})"), ("macro_definition", rf"\bmacro_rules!\s+({_ID})")], r"^\s*(?:pub\s+)?use\s+([^;]+);", strings=r"\"(?:\\.|[^\"\\])*\"|'(?:\\.|[^'\\\n])'", calls=rf"({_ID})!?\s*\("),
    "javascript": Rules(_JS, _JS_IMPORT, strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "typescript": Rules(_TS, _JS_IMPORT, strings=r"\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'|`(?:\\.|[^`\\])*`"),
    "go": Rules([("function_declaration", rf"^func\s+({_ID})"), ("method_declaration", rf"^func\s+\([^)]*\)\s*({_ID})"), ("type_spec", rf"^type\s+({_ID})")], r"^\s*(?:import\s+)?(?:\w+\s+)?\"([^\"\n]+)\"\s*$", strings=r"\"(?:\\.|[^\"\\\n])*\"|`[^`]*`|'(?:\\.|[^'\\\n])*'"),
    "java": Rules([*_TYPES(["class", "interface", "enum"]), ("method_declaration", _METHOD), ("constructor_declaration", rf"^[ \t]+(?:public|protected|private)\s+({_ID})\s*\([^;{{}}]*\)\s*\{{")], r"^\s*import\s+(?:static\s+)?([\w.*]+)\s*;"),
    "c": Rules(_C, r"^\s*#\s*include\s*[<\"]([^>\"\n]+)"),
    "cpp": Rules([*_C, ("class_specifier", rf"\bclass\s+({_ID})"), ("namespace_definition", rf"\bnamespace\s+({_ID})")], r"^\s*#\s*include\s*[<\"]([^>\"\n]+)"),
    "csharp": Rules([*_TYPES(["class", "struct", "interface", "enum"]), ("method_declaration", _METHOD)], r"^\s*using\s+(?:static\s+)?([\w.]+)\s*;"),
    "ruby": Rules([("method", rf"\bdef\s+({_ID}[?!]?)"), ("singleton_method", rf"\bdef\s+self\.({_ID}[?!]?)"), ("class", r"\bclass\s+([A-Z]\w*)"), ("module", r"\bmodule\s+([A-Z]\w*)")], r"^\s*require(?:_relative)?\s*\(?['\"]([^'\"\n]+)", comments=_HASH, ends="end"),
    "bash": Rules([("function_definition", r"^\s*(?:function\s+)?([\w-]+)\s*\(\)"), ("function_definition", r"^\s*function\s+([\w-]+)")], r"^\s*(?:source|\.)\s+([^\s;]+)", comments=r"(?<!\S)#[^\n]*", calls=r"(?m)^\s*([A-Za-z_][\w-]*)(?=\s|$)", names=r"\$\{?([A-Za-z_]\w*)", strings=r"'[^']*'"),
    "scala": Rules([("function_definition", rf"\bdef\s+({_ID})"), ("class_definition", rf"\bclass\s+({_ID})"), ("trait_definition", rf"\btrait\s+({_ID})"), ("object_definition", rf"\bobject\s+({_ID})"), ("enum_definition", rf"\benum\s+({_ID})"), ("type_definition", rf"\btype\s+({_ID})"), ("val_definition", rf"\bval\s+({_ID})"), ("var_definition", rf"\bvar\s+({_ID})"), ("package_clause", r"^package\s+([\w.]+)")], r"^\s*import\s+([^\n;]+)"),
    "kotlin": Rules([("function_declaration", rf"\bfun\s+(?:[\w<>]+\.)?({_ID})"), ("class_declaration", rf"\b(?:class|interface)\s+({_ID})"), ("object_declaration", rf"\bobject\s+({_ID})"), ("type_alias", rf"\btypealias\s+({_ID})")], r"^\s*import\s+([\w.*]+)"),
    "swift": Rules([("function_declaration", rf"\bfunc\s+({_ID})"), ("class_declaration", rf"\b(?:class|struct|enum|extension)\s+({_ID})"), ("protocol_declaration", rf"\bprotocol\s+({_ID})"), ("property_declaration", rf"\b(?:let|var)\s+({_ID})")], r"^\s*import\s+([\w.]+)"),
    "lua": Rules([("function_declaration", r"\bfunction\s+([A-Za-z_][\w.:]*)"), ("variable_declaration", rf"\b({_ID})\s*=\s*function\b")], comments=r"--\[\[.*?\]\]|--[^\n]*", ends="end"),
    "elixir": Rules([("call", r"\bdefmodule\s+([\w.]+)"), ("call", rf"\bdefp?\s+({_ID}[?!]?)"), ("call", rf"\bdefmacrop?\s+({_ID}[?!]?)")], comments=_HASH, ends="end"),
    "haskell": Rules([("signature", r"^([a-z_][\w']*)\s*::"), ("function", r"^([a-z_][\w']*)(?:\s+[^=\n:|]+)?\s*="), ("data_type", r"^data\s+([A-Z][\w']*)"), ("newtype", r"^newtype\s+([A-Z][\w']*)"), ("type_synomym", r"^type\s+([A-Z][\w']*)"), ("class", r"^class\s+(?:[^=\n]*=>\s*)?([A-Z][\w']*)")], r"^import\s+(?:qualified\s+)?([\w.]+)", comments=r"\{-.*?-\}|--[^\n]*", calls=r"(?!)", ends="line"),
    "css": Rules([("class_selector", r"\.(-?[A-Za-z_][\w-]*)(?=[^{}:;]*\{)"), ("id_selector", r"#(-?[A-Za-z_][\w-]*)(?=[^{}:;]*\{)"), ("tag_name", r"(?:^|[\s,>+~}])([A-Za-z][\w-]*)(?=[^{};]*\{)")], r"^\s*@import\s+(?:url\()?['\"]?([^'\")\s;]+)", comments=r"/\*.*?\*/", calls=r"(?!)", names=r"(?<=[{;])\s*([\w-]+)\s*:"),
}
RULES["tsx"] = RULES["typescript"]
# for files that Python's own parser refuses
RULES["python"] = Rules(
    [("function_definition", r"^[ \t]*(?:async[ \t]+)?def[ \t]+([A-Za-z_]\w*)[ \t]*\([^()]*(?:\([^()]*\)[^()]*)*\)[^:\n]*:"), ("class_definition", r"^[ \t]*class[ \t]+([A-Za-z_]\w*)[^:\n]*:")],
    imports=r"^[ \t]*(?:from|import)[ \t]+(\.*[\w.]*)",
    comments=r"#[^\n]*",
    strings=r"\"\"\"(?:\\.|[^\\])*?\"\"\"|'''(?:\\.|[^\\])*?'''|\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*'",
    ends="indent",
)


@dataclass
class Found:
    """What a file holds; lines and columns count from 1, columns in bytes, ends are exclusive."""

    definitions: list[dict] = field(default_factory=list)
    references: list[dict] = field(default_factory=list)
    imports: list[dict] = field(default_factory=list)
    error: str | None = None


class _Places:
    def __init__(self, text: str):
        self.text, self.starts = text, [0, *[m.end() for m in re.finditer("\n", text)]]

    def at(self, offset: int) -> tuple[int, int]:
        import bisect

        line = bisect.bisect_right(self.starts, offset)
        return line, len(self.text[self.starts[line - 1] : offset].encode()) + 1

    def span(self, a: int, b: int) -> dict:
        (line, col), (end_line, end_col) = self.at(a), self.at(b)
        return {"line": line, "col": col, "end_line": end_line, "end_col": end_col}


def _qualify(definitions: list[dict]) -> list[dict]:
    """Names by the definitions around them, once each."""
    out, around, seen = [], [], set()
    start, end = (lambda d: (d["line"], d["col"])), (lambda d: (d["end_line"], d["end_col"]))
    for d in sorted(definitions, key=lambda d: (start(d), tuple(-x for x in end(d)))):
        while around and not (start(around[-1]) <= start(d) and end(d) <= end(around[-1]) and (start(d), end(d)) != (start(around[-1]), end(around[-1]))):
            around.pop()
        d["qualname"] = "::".join([*[a["name"] for a in around], d["name"]])
        around.append(d)
        key = (d["qualname"], d["kind"], d["line"], d["col"])
        if key not in seen:
            seen.add(key)
            out.append(d)
    return out


def _once(rows: list[dict], *keys: str) -> list[dict]:
    return list({tuple(r[k] for k in keys): r for r in reversed(rows)}.values())[::-1]


def _blank(m: re.Match) -> str:
    return re.sub(r"[^\n]", " ", m[0])


def _close(text: str, at: int, how: str) -> int:
    """Where a definition that starts at a place ends."""
    line = text.find("\n", at)
    line = len(text) if line < 0 else line
    if how == "indent":  # before the first line that is no deeper than the definition's own
        first = text.rfind("\n", 0, at) + 1
        depth = len(text[first:at]) - len(text[first:at].lstrip())
        after = re.compile(rf"^[ \t]{{0,{depth}}}[^ \t\n]", re.M).search(text, line + 1)
        return len(text[: after.start() if after else len(text)].rstrip())
    if how == "end":
        depth = 0
        for m in re.finditer(r"\b(?:def|class|module|function|if|unless|case|while|do|begin|fn)\b|\bend\b", text[at:]):
            depth += -1 if m[0] == "end" else 1
            if depth <= 0:
                return at + m.end()
        return line
    semi, brace = text.find(";", at), text.find("{", at)
    if how == "line" or brace < 0 or 0 <= semi < brace:
        return min(x for x in (semi + 1 if semi >= 0 else line, line))
    depth = 0
    for m in re.finditer(r"[{}]", text[brace:]):
        depth += 1 if m[0] == "{" else -1
        if not depth:
            return brace + m.end()
    return len(text)


def lexical(lang: str, text: str) -> Found:
    rules, out = RULES[lang], Found()
    places = _Places(text)
    uncommented = re.sub(rf"({rules.strings})|({rules.comments})", lambda m: m[0] if m[1] else _blank(m), text, flags=re.S)
    bare = re.sub(rules.strings, _blank, uncommented, flags=re.S)
    named = set()
    for kind, pattern in rules.patterns:
        for m in re.finditer(pattern, bare, re.M):
            if m[1] in ("if", "for", "while", "switch", "return", "catch", "else") and lang != "css":
                continue
            named.add(m.start(1))
            first = m.start() + len(m[0]) - len(m[0].lstrip())
            out.definitions.append({"name": m[1], "kind": kind, **places.span(first, max(m.end(1), _close(bare, m.end(1), rules.ends)))})
    inside = []
    if rules.imports:
        for m in re.finditer(rules.imports, uncommented, re.M):
            inside.append(m.span())
            at = places.at(m.start() + len(m[0]) - len(m[0].lstrip()))
            out.imports.append({"module": re.sub(r"\s+", " ", m[1]).strip(), "line": at[0], "col": at[1]})
    called = set()
    for pattern, kind in ((rules.calls, "calls"), (rules.names, "references")):
        for m in re.finditer(pattern, bare, re.M) if pattern else ():
            at = m.start(1)
            if at in named or at in called or m[1] in _COMMON or any(a <= at < b for a, b in inside):
                continue
            called.add(at)
            out.references.append({"name": m[1], "edge_type": kind, **places.span(*m.span(1))})
    return out


def python(text: str) -> Found:
    out, places = Found(), text.split("\n")
    tree = ast.parse(text)
    callees = set()

    def span(node) -> dict:
        return {"line": node.lineno, "col": node.col_offset + 1, "end_line": node.end_lineno, "end_col": node.end_col_offset + 1}

    for node in ast.walk(tree):
        if isinstance(node, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
            kind = "class_definition" if isinstance(node, ast.ClassDef) else "function_definition"
            out.definitions.append({"name": node.name, "kind": kind, **span(node)})
        elif isinstance(node, ast.Call):
            f = node.func
            name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
            callees.add(id(f))
            if name:
                own = span(f)
                if isinstance(f, ast.Attribute):
                    own |= {"line": f.end_lineno, "col": f.end_col_offset + 1 - len(name.encode())}
                out.references.append({"name": name, "edge_type": "calls", **own})
        elif isinstance(node, (ast.Import, ast.ImportFrom)):
            names = [a.name for a in node.names] if isinstance(node, ast.Import) else ["." * node.level + (node.module or "")]
            out.imports += [{"module": n, "line": node.lineno, "col": node.col_offset + 1} for n in names]
    for node in ast.walk(tree):
        if isinstance(node, ast.Name) and id(node) not in callees and places:
            out.references.append({"name": node.id, "edge_type": "references", **span(node)})
    return out


class _Html(HTMLParser):
    VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())

    def __init__(self, text: str):
        super().__init__()
        self.out, self.open, self.places = Found(), [], _Places(text)
        self.feed(text)
        self.close()
        for d in self.open:
            d |= self._end(len(text))

    def _offset(self) -> int:
        line, col = self.getpos()
        return self.places.starts[line - 1] + col

    def _end(self, at: int) -> dict:
        line, col = self.places.at(at)
        return {"end_line": line, "end_col": col}

    def handle_starttag(self, tag, attrs):
        at, raw = self._offset(), self.get_starttag_text()
        kind = {"script": "script_element", "style": "style_element"}.get(tag, "element")
        line, col = self.places.at(at)
        d = {"name": tag, "kind": kind, "line": line, "col": col, **self._end(at + len(raw))}
        self.out.definitions.append(d)
        if tag not in self.VOID:
            self.open.append(d)
        for m in re.finditer(r"\s([^\s\"'<>/=]+)(?:\s*=\s*(?:\"[^\"]*\"|'[^']*'|[^\s\"'=<>`]+))?", raw[len(tag) + 1 :]):
            a = at + len(tag) + 1 + m.start(1)
            self.out.references.append({"name": m[1], "edge_type": "references", **self.places.span(a, a + len(m[1]))})

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if self.open and tag not in self.VOID:
            self.open.pop()

    def handle_endtag(self, tag):
        if any(d["name"] == tag for d in self.open):
            at = self.places.text.find(">", self._offset())
            while self.open:
                d = self.open.pop()
                d |= self._end(at + 1 if at >= 0 else len(self.places.text))
                if d["name"] == tag:
                    break


def html(text: str) -> Found:
    return _Html(text).out


def _keys(text: str, pattern: str, kind: str) -> Found:
    places = _Places(text)
    return Found([{"name": m[1].strip("\"'"), "kind": kind, **places.span(*m.span(1))} for m in re.finditer(pattern, text, re.M)])


def json_keys(text: str) -> Found:
    return _keys(text, r"(\"(?:\\.|[^\"\\])*\")(?=\s*:)", "pair")


def toml(text: str) -> Found:
    out = Found()
    for kind, pattern in (("table_array_element", r"^\s*\[\[\s*([^\]\n]+?)\s*\]\]"), ("table", r"^\s*\[(?!\[)\s*([^\]\n]+?)\s*\]"), ("pair", r"^\s*([\w.\"'-]+)\s*=")):
        out.definitions += _keys(text, pattern, kind).definitions
    return out


def yaml(text: str) -> Found:
    return _keys(text, r"^\s*(?:-\s+)*([^\s#:\-\"'][^:#\n]*?|\"[^\"\n]*\"|'[^'\n]*')(?=\s*:(?:\s|$))", "block_mapping_pair")


READERS = {"python": python, "html": html, "json": json_keys, "toml": toml, "yaml": yaml}


def extract_one(lang: str | None, text: str) -> Found:
    """Unknown languages hold nothing. Where a file can't be parsed, error says why; Python then goes by lexical rules."""
    if lang not in READERS and lang not in RULES:
        return Found()
    try:
        out = READERS[lang](text) if lang in READERS else lexical(lang, text)
    except (SyntaxError, ValueError, RecursionError) as e:
        out = lexical(lang, text) if lang in RULES else Found()
        out.error = f"{type(e).__name__}: {e}"
    out.definitions = _qualify(out.definitions)
    out.references = _once([r for r in out.references if r["name"] not in ("self", "super")], "name", "edge_type", "line", "col")
    out.imports = _once([i for i in out.imports if i["module"]], "module", "line", "col")
    return out


def extract(files: DataFrame) -> DataFrame:
    """(path, lang, definitions, references, imports, error) of files (path, lang, content): one row each, no shuffle."""

    def run(frames):
        for frame in frames:
            found = [extract_one(lang, text or "") for lang, text in zip(frame["lang"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "lang": frame["lang"], "definitions": [f.definitions for f in found], "references": [f.references for f in found], "imports": [f.imports for f in found], "error": [f.error for f in found]})

    return files.select("path", "lang", "content").mapInPandas(run, EXTRACTED)
