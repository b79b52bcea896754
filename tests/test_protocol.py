import io
import json

import pytest

from lumigraph.protocol import Tools, answer, compact, parameter, serve


@pytest.fixture(scope="module")
def tools(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    (root / "a.py").write_text("def f():\n    return g()\n\ndef g():\n    return 1\n")
    return Tools(spark, str(root), str(tmp_path_factory.mktemp("state")))


def call(tools, tool, /, **arguments):
    reply = answer(tools, {"id": 1, "method": "tools/call", "params": {"name": tool, "arguments": arguments}})
    return reply.get("error") or (json.loads(reply["result"]["content"][0]["text"]), reply["result"]["isError"])


def test_requests(tools):
    assert answer(tools, {"method": "ping"}) is None and answer(tools, {"id": 1, "method": "ping"})["result"] == {}
    assert answer(tools, {"id": 1, "method": "x"})["error"]["code"] == -32601
    assert len(answer(tools, {"id": 1, "method": "tools/list"})["result"]["tools"]) == 21
    assert call(tools, "none")["code"] == -32602 and call(tools, "symbol_definitions")["code"] == -32602
    assert call(tools, "symbol_references", name="g", limit="x")["code"] == -32602


def test_tools(tools):
    assert call(tools, "index_repository")[0]["indexed_files"] == 1
    found, failed = call(tools, "symbol_references", name="g", verbosity="normal")
    assert not failed and [(r["line"], r["edge_type"], r["score"]) for r in found["rows"]] == [(2, "calls", 2.35)] and "why" in found["rows"][0]
    assert "why" not in call(tools, "symbol_callers", name="g")[0]["rows"][0]
    assert call(tools, "symbol_source", name="g", context_lines=0)[0]["rows"][0]["content"] == "def g():\n    return 1"
    assert call(tools, "read_file", path="a.py", start_line=4, end_line=4)[0]["content"] == "def g():"
    assert call(tools, "search_files", pattern="return")[0]["total_matches"] == 2
    assert call(tools, "minimal_slice", file="a.py", line=1)[0]["anchor"]["name"] == "f"
    assert call(tools, "delete_file", path="zzz")[1]
    call(tools, "write_file", path="b.txt", content="x")
    assert call(tools, "edit_file", path="b.txt", old_text="x", new_text="y")[0]["total_replacements"] == 1
    assert call(tools, "apply_patch", patches=[{"path": "b.txt", "hunks": [{"start_line": 1, "old_lines": ["y"], "new_lines": ["z"]}]}])[0]["hunks_applied"] == 1


def test_frames(tools):
    ping = json.dumps({"id": 7, "method": "ping"}).encode()
    out = io.BytesIO()
    serve(tools, io.BytesIO(ping + b"\nnot json\nContent-Length: %d\r\n\r\n%s" % (len(ping), ping)), out)
    lines = out.getvalue().split(b"\n", 2)
    assert json.loads(lines[0])["id"] == 7 and json.loads(lines[1])["error"]["code"] == -32700 and lines[2].startswith(b"Content-Length: ")
    assert compact({"why": 1, "a": [{"meta_json": 2, "b": 3}]}) == {"a": [{"b": 3}]}
    assert parameter({"line": None}, "line", int, 5) == 5
    with pytest.raises(ValueError, match="limit"):
        parameter({"limit": None}, "limit", int, 5)


def test_every_tool_is_described(tools):
    told = answer(tools, {"id": 1, "method": "tools/list"})["result"]["tools"]
    assert {t["name"] for t in told} == set(tools.tools) and all(t["description"] and t["inputSchema"]["type"] == "object" for t in told)
    for t in told:  # a needed parameter that is missing is refused by name
        for name in t["inputSchema"]["required"]:
            assert name in t["inputSchema"]["properties"]
    assert answer(tools, {"id": 1, "method": "initialize"})["result"]["protocolVersion"]
    assert answer(tools, {"id": 1, "method": "initialize", "params": {"protocolVersion": "2025-01-01"}})["result"]["protocolVersion"] == "2025-01-01"


def test_text_output():
    from lumigraph.__main__ import as_text

    assert as_text({"rows": [{"name": "f", "score": 1.346, "similarity": 0.5}], "found": True, "page": {"total": 2}}) == "rows:\nf\t1.35\t0.500\nfound: True\npage: total=2"
