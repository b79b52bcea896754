import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumigraph.llm.chat import format_chats
from lumigraph.llm.common import ascii_lower, connected_components
from lumigraph.llm.line_dedup import dedup_lines
from lumigraph.llm.mixing import mix, source_targets, word_count

SPACE = " \t\n\x0b\x0c\r"


def low(s):
    return "".join(c.lower() if c.isascii() else c for c in s)


def test_ascii_lower_on_every_letter(spark):
    points = spark.range(0x110000).where("id < 55296 or id > 57343").select("id", F.decode(F.unhex(F.lpad(F.hex("id"), 8, "0")), "UTF-32").alias("c"))
    wrong = points.where(ascii_lower(F.col("c")) != F.translate("c", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    assert wrong.isEmpty()


def plain_lines(rows, least=20, docs=3):
    keys = {}
    for k, (i, t) in enumerate(rows):
        for x in (t or "").split("\n"):
            if len(low(x).strip(SPACE)) >= least and i is not None:
                keys.setdefault(low(x).strip(SPACE), set()).add((k, i))
    home = {k: max(i for _, i in v) for k, v in keys.items() if len(v) >= docs}
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if i is None or i >= home.get(low(x).strip(SPACE), -1)]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_line_dedup(make_docs, odd_rows):
    rng = random.Random(1)
    pool = [f"Line number {k} of the common pool{' ' * (k % 3)}" for k in range(12)] + ["short", "", "É" * 25, "é" * 25]
    rows = odd_rows + [(100 + i, "\n".join(rng.choice(pool) for _ in range(rng.randint(0, 6)))) for i in range(40)] + [(None, pool[0])]
    got = sorted(map(tuple, dedup_lines(make_docs(rows)).collect()), key=repr)
    assert got == plain_lines(rows)
    assert dedup_lines(make_docs([])).count() == 0


@pytest.mark.parametrize(("text", "n"), [(None, 0), ("", 0), (" \t\n", 0), ("a", 1), (" a\x0bb ", 2), ("a b", 1), ("a  b\r\nc", 3)])
def test_word_count(spark, text, n):
    assert spark.createDataFrame([(text,)], "x string").select(word_count(F.col("x"))).first()[0] == n


@pytest.mark.parametrize("sizes", [[100, 100, 100], [10, 1000, 5], [0, 7, 7], [1], [0, 0], [5, 50, 500, 5000, 1]])
def test_targets(spark, sizes):
    rows = spark.createDataFrame([(f"s{i}", n) for i, n in enumerate(sizes)], "source string, source_size bigint")
    got = [r.target for r in source_targets(rows).orderBy("sid").collect()]
    weights, want, full = [i % 3 + 1 for i in range(len(sizes))], [0.0] * len(sizes), set()
    while True:  # share, fill up, share the excess again
        rest = sum(sizes) - sum(3 * sizes[i] for i in full)
        free = [i for i in range(len(sizes)) if i not in full]
        of = sum(weights[i] for i in free)
        new = {i for i in free if rest * weights[i] / of >= 3 * sizes[i]}
        if not new:
            break
        full |= new
    for i in range(len(sizes)):
        want[i] = 3.0 * sizes[i] if i in full else rest * weights[i] / of
    assert got == pytest.approx(want)


def test_mix(make_docs, odd_rows):
    rng = random.Random(2)
    rows = [(i, " ".join("w" * rng.randint(0, 40)), rng.choice(["a", "b", "c", None])) for i in range(400)] + [(1000 + i, t, "z") for i, (_, t) in enumerate(odd_rows)]
    rows += [rows[0]]
    out = mix(make_docs(rows)).collect()
    assert len(out) == len(rows) and sorted(map(tuple, out)) == sorted(map(tuple, mix(make_docs(rows)).collect()))
    by = {}
    source = {r[0]: r[2] for r in rows}
    for r in out:
        assert r.taken == r.size * r.copies <= 3 * r.size
        by.setdefault(source[r.doc_id], []).append(r)
    for rs in by.values():
        assert sum(r.size for r in rs) == rs[0].source_size
        assert abs(sum(r.taken for r in rs) - rs[0].target) <= max(r.size for r in rs)
    assert sum(rs[0].target for rs in by.values()) == pytest.approx(sum(r.size for r in out))
    assert mix(make_docs([])).count() == 0


def test_chat(spark):
    rng = random.Random(3)
    convs = {}
    for c in range(60):
        base = convs[rng.choice(list(convs))] if convs and rng.random() < 0.6 else []
        convs[c] = base[: rng.randint(0, len(base))] + [(rng.choice(["user", "bot", None]), rng.choice(["hi", "yes", "", None])) for _ in range(rng.randint(0, 2))]
    rows = [(c, t, role, text, "x", "y") for c, turns in convs.items() for t, (role, text) in enumerate(turns)] + [(None, 0, "user", "lost", "x", "y")]
    schema = "conv_id bigint, turn bigint, role string, text string, pos string, n string"
    got = {r.conv_id: (r.n_turns, r.rendered) for r in format_chats(spark.createDataFrame(rows, schema)).collect()}
    full = {c: t for c, t in convs.items() if t}
    want = {}
    for c, t in full.items():
        if not any(len(u) > len(t) and u[: len(t)] == t for u in full.values()) and c == min(k for k, u in full.items() if u == t):
            want[c] = (len(t), "".join(f"<|{r or 'unknown' if r is None else r}|>\n{x or ''}<|end|>\n" for r, x in t))
    assert got == want
    assert format_chats(spark.createDataFrame([], schema)).count() == 0


def test_components(spark):
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(60)] + [(200, k) for k in range(201, 240)] + [(rng.randint(300, 400), rng.randint(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "src bigint, dst bigint")).collect()}
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]}
    assert connected_components(spark.createDataFrame([], "src bigint, dst bigint")).count() == 0


def test_hashes_of_kept_text(make_docs):
    text = "a\nb"
    assert hashlib.sha256(text.encode()).hexdigest() == dedup_lines(make_docs([(1, text)])).select(F.sha2(F.col("kept_text").cast("binary"), 256)).first()[0]


def test_lines_of_repeated_ids_count_once(make_docs):
    line = "a line that is shared by several rows"
    assert sorted(map(tuple, dedup_lines(make_docs([(1, line), (2, line), (2, line + "\nx")])).collect())) == [(1, 1, 0, line), (2, 1, 0, line), (2, 2, 0, line + "\nx")]
    got = sorted(map(tuple, dedup_lines(make_docs([(1, line), (2, line), (2, f"x\n{line}\n{line}\ny"), (3, line)])).collect()))
    assert got == [(1, 1, 1, ""), (2, 1, 1, ""), (2, 4, 2, "x\ny"), (3, 1, 0, line)]


@pytest.mark.parametrize("most", [0, 100_000])
def test_very_many_common_lines(make_docs, monkeypatch, most):
    """Linear in the lines, by both ways to meet the common ones."""
    monkeypatch.setattr("lumigraph.llm.line_dedup.MOST_SENT", most)
    lines = [f"common line number {k} of them" for k in range(100_000)]
    rows = [(i, "\n".join([f"own {i}", *lines, "end"])) for i in range(3)]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept_text) for r in dedup_lines(make_docs(rows)).collect()}
    assert got == {0: (100_002, 100_000, "own 0\nend"), 1: (100_002, 100_000, "own 1\nend"), 2: (100_002, 0, rows[2][1])}
