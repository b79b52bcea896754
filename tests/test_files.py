import json
import os

import pytest

from lumigraph.operators import files
from lumigraph.operators.files import EditError, Hunk
from lumigraph.operators.graph import dependency_path, symbol_definitions, symbol_references
from lumigraph.operators.index import Snapshots, index_repository
from lumigraph.sources.extract import extract_one
from lumigraph.sources.repo import find_root


@pytest.fixture
def texts(spark):
    rows = [("src/a.txt", "one\ntwo foo\nthree\nfoo foo\n"), ("b.md", "foo"), ("src/deep/c.txt", ""), ("node_modules/x.txt", "foo")]
    return spark.createDataFrame([(p, t, len(t)) for p, t in rows], "path string, content string, size_bytes bigint")


def test_read(texts):
    row = files.read_file(texts, "src/a.txt", 2, 3).first()
    assert (row.content, row.total_lines, row.start_line, row.end_line, row.truncated, row.language) == ("two foo\nthree", 4, 2, 3, False, "txt")
    row = files.read_file(texts, "src/a.txt", 3, 99, max_lines=1).first()
    assert (row.content, row.end_line, row.returned_lines, row.truncated) == ("three", 3, 1, True)
    assert files.read_file(texts, "src/a.txt", 50, 60).first().start_line == 4
    assert tuple(files.read_file(texts, "src/deep/c.txt").first())[2:] == ("", 0, 0, 0, 0, False)
    rows = files.multi_read(texts, [("src/a.txt", None, None), ("b.md", None, None)], max_total_lines=3).collect()
    assert [r.returned_lines for r in rows] == [2, 1] and rows[0].truncated


@pytest.mark.parametrize(("asked", "most", "want"), [([5, 5], 10, [5, 5]), ([10, 10], 10, [5, 5]), ([100, 1], 10, [9, 1]), ([1, 1, 1], 2, [1, 1, 0]), ([7, 7, 7], 10, [4, 3, 3]), ([0, 9], 3, [0, 3]), ([], 5, []), ([3], 0, [0])])
def test_budgets(asked, most, want):
    assert files.allocate_budgets(asked, most) == want and sum(want) <= max(most, 0)


def test_search_and_list(texts):
    rows = files.search_files(texts, "foo").collect()
    assert [(r.file, r.line) for r in rows] == [("b.md", 1), ("node_modules/x.txt", 1), ("src/a.txt", 2), ("src/a.txt", 4)]
    assert rows[2].context_before == ["one"] and rows[2].context_after == ["three", "foo foo"]
    assert files.search_files(texts, "t.o", is_regex=True, glob="src/*").count() == 1 and files.search_files(texts, "t.o").isEmpty()
    assert files.search_summary(files.search_files(texts, "foo", max_results=4), 4).first().truncated
    assert [(r.path, r.type) for r in files.list_directory(texts, recursive=True).collect()] == [("b.md", "file"), ("src", "directory"), ("src/a.txt", "file"), ("src/deep", "directory"), ("src/deep/c.txt", "file")]
    assert [r.path for r in files.list_directory(texts, "src").collect()] == ["src/a.txt", "src/deep"]


def test_edit_columns(texts):
    got = {r.path: r for r in files.edit_texts(texts, "foo", "x").collect()}
    assert got["b.md"].content == "x" and got["src/a.txt"].error.startswith("old_text matches 3") and got["src/deep/c.txt"].error == "old_text not found in file"
    assert {r.path: r.replacements_applied for r in files.edit_texts(texts, "foo", "", True).collect()}["src/a.txt"] == 3


def test_edits_on_disk(tmp_path):
    root = str(tmp_path)
    assert files.write_file(root, "d/a.txt", "a\nb\nc\n")["created"]
    files.write_file(root, "b.txt", "x")
    with pytest.raises(EditError, match="outside"):
        files.write_file(root, "../z", "")
    with pytest.raises(EditError, match="not found"):
        files.batch_edit(root, [{"path": "d/a.txt", "old_text": "b", "new_text": "B"}, {"path": "b.txt", "old_text": "nope", "new_text": ""}])
    assert (tmp_path / "d/a.txt").read_text() == "a\nb\nc\n"
    done = files.batch_edit(root, [{"path": "d/a.txt", "old_text": "b", "new_text": "B"}, {"path": "d/a.txt", "old_text": "B\n", "new_text": ""}])
    assert (tmp_path / "d/a.txt").read_text() == "a\nc\n" and done["files_changed"] == 1 and done["total_replacements"] == 2
    assert files.diff_preview("a\nb\nc\nd\ne", "a\nX\nc\nd\ne", "b") == "--- old\na\nb\nc\nd\n+++ new\na\nX\nc\nd"
    files.apply_patch(root, [("d/a.txt", [Hunk(2, ["c"], ["C", "D"]), Hunk(1, [], ["0"])])])
    assert (tmp_path / "d/a.txt").read_text() == "0\na\nC\nD\n"
    for bad in (Hunk(9, ["x"], []), Hunk(1, ["zzz"], []), Hunk(0, [], [])):
        with pytest.raises(EditError):
            files.apply_patch(root, [("d/a.txt", [bad])])
    files.move_file(root, "b.txt", "e/f.txt")
    files.delete_file(root, "e/f.txt")
    with pytest.raises(EditError):
        files.delete_file(root, "e/f.txt")


def test_index_cycle(spark, tmp_path):
    root = tmp_path / "repo"
    for p, t in {".git/x": "", "src/main.rs": "mod storage;\nuse crate::storage::open;\nfn main() { open(); }\n", "src/storage.rs": "pub fn open() {}\n", "a.py": "from foo import f\ndef g():\n    return f()\n", "foo.py": "def f():\n    pass\n", "node_modules/x.js": "f()", "Cargo.toml": "[package]\nname = 'x'\n", "README": "no"}.items():
        (root / p).parent.mkdir(parents=True, exist_ok=True)
        (root / p).write_text(t)
    (root / "bad.py").write_bytes(b"\xff\xfe")
    state = str(tmp_path / "state")
    first = index_repository(spark, str(root), state)
    assert (first["indexed_files"], first["skipped_files"], first["parse_failures"]) == (5, 0, 1)
    g = Snapshots(spark, state).read()
    assert [(r.file_path, r.line) for r in symbol_definitions(g, "open").collect()] == [("src/storage.rs", 1)]
    assert [(r.file_path, r.edge_type) for r in symbol_references(g, "f").collect()] == [("a.py", "calls")]
    assert [r.entity_name for r in dependency_path(g, "file:src/main.rs", "file:src/storage.rs").collect()] == ["src/main.rs", "src/storage.rs"]
    assert {r.dst_key for r in g.edges.where("edge_type = 'depends_on'").collect()} == {"file:foo.py", "file:src/storage.rs"}
    assert g.entities.where("entity_type = 'entrypoint'").isEmpty() and g.entities.where("entity_type = 'config'").count() == 1
    os.remove(root / "a.py")
    (root / "foo.py").write_text("def h():\n    pass\n")
    second = index_repository(spark, str(root), state)
    assert (second["indexed_files"], second["skipped_files"], second["removed_files"]) == (1, 3, 1)
    g = Snapshots(spark, state).read()
    assert symbol_definitions(g, "f").isEmpty() and symbol_definitions(g, "h").count() == 1 and g.files.count() == 4
    assert g.entities.where("key = 'symbol_name:python:f'").isEmpty()
    assert index_repository(spark, str(root), state, full=True)["indexed_files"] == 4
    assert find_root(str(root / "src")) == str(root)
    json.dumps(second)


@pytest.mark.parametrize(("lang", "text", "names", "calls", "modules"), [
    ("rust", "use crate::a;\nstruct S;\nimpl S { fn new() { go(); } }", {"S", "S::new"}, {"go"}, {"crate::a"}),
    ("python", "import os\nclass A:\n    def f(self):\n        g()", {"A", "A::f"}, {"g"}, {"os"}),
    ("javascript", "import x from 'y';\nfunction a() { b(); }\nconst q = (x) => x;", {"a", "q"}, {"b"}, {"y"}),
    ("typescript", "interface I {}\ntype T = string;\nenum E { A }", {"I", "T", "E"}, set(), set()),
    ("go", 'package m\nimport "fmt"\nfunc Main() { Run() }\ntype T struct {}', {"Main", "T"}, {"Run"}, {"fmt"}),
    ("java", "import a.B;\npublic class X {\n  public int f(int a) { return g(a); }\n}", {"X", "X::f"}, {"g"}, {"a.B"}),
    ("c", "#include <stdio.h>\nint main(void) { puts(1); }\nstruct P { int x; };", {"main", "P"}, {"puts"}, {"stdio.h"}),
    ("ruby", "require 'x'\nclass A\n  def b\n    c(1)\n  end\nend", {"A", "A::b"}, {"c"}, {"x"}),
    ("kotlin", "import a.b\nclass K {\n  fun f() { g() }\n}", {"K", "K::f"}, {"g"}, {"a.b"}),
    ("html", "<html><p id=x>y</p></html>", {"html", "html::p"}, set(), set()),
    ("json", '{"a": {"b": 1}}', {"a", "b"}, set(), set()),
    ("toml", "[t]\nk = 1", {"t", "k"}, set(), set()),
    ("yaml", "a:\n  b: 1", {"a", "b"}, set(), set()),
    ("css", ".x { color: red }", {"x"}, set(), set()),
    ("python", "def broken(", set(), set(), set()),
    (None, "anything", set(), set(), set()),
])
def test_extractors(lang, text, names, calls, modules):
    found = extract_one(lang, text)
    assert {d["qualname"] for d in found.definitions} >= names and bool(found.definitions) == bool(names)
    assert {r["name"] for r in found.references if r["edge_type"] == "calls"} >= calls
    assert {i["module"] for i in found.imports} == modules


def test_patches_show_what_they_do_and_what_they_miss(tmp_path):
    (tmp_path / "a.txt").write_text("one\ntwo\nthree\n")
    out = files.apply_patch(str(tmp_path), [("a.txt", [files.Hunk(2, ["two"], ["zwei", "2"])])], dry_run=True)
    assert out["previews"] == [{"path": "a.txt", "diff_preview": "@@ 2,1 +2 @@\n-two\n+zwei\n+2"}]
    with pytest.raises(files.EditError, match="expected 'deux', found 'two'"):
        files.apply_patch(str(tmp_path), [("a.txt", [files.Hunk(2, ["deux"], [])])])


def test_python_that_does_not_parse_is_still_read():
    from lumigraph.sources.extract import extract_one

    found = extract_one("python", "import os\nfrom a.b import c\nclass A:\n    def f(self):\n        print 'def no(): x'\n\n    def g(self):\n        return h(1)\n\ndef top():\n    pass\n")
    assert found.error.startswith("SyntaxError")
    assert [(d["qualname"], d["kind"], d["line"], d["end_line"]) for d in found.definitions] == [("A", "class_definition", 3, 8), ("A::f", "function_definition", 4, 5), ("A::g", "function_definition", 7, 8), ("top", "function_definition", 10, 11)]
    assert [i["module"] for i in found.imports] == ["os", "a.b"] and ("h", "calls") in {(r["name"], r["edge_type"]) for r in found.references}
    assert extract_one("python", "x = 1\n").error is None
