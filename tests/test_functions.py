import hashlib
import random

import pytest
from pyspark.sql import functions as F

from lumigraph.functions.scores import edge_score, project_local
from lumigraph.functions.text import file_glob, lines_of, parent_dir, path_glob, subsequence_ratio, winnowed


def one(spark, text, column):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x")).alias("y")).first().y


@pytest.mark.parametrize(("pattern", "text", "path", "file"), [("*", "a/b", True, True), ("a?c", "abc", True, True), ("[ab]", "a", True, False), ("[^ab]", "c", True, False), ("[ab]", "[ab]", False, True), ("a\\*", "a/b", True, False), ("[a", "[a", False, True), ("A", "a", False, False), ("a.b", "axb", False, False)])
def test_globs(spark, pattern, text, path, file):
    assert one(spark, text, lambda c: path_glob(c, pattern)) is path
    assert one(spark, text, lambda c: file_glob(c, pattern)) is file


def winnow(text, k=5, w=4):
    import re

    t = re.findall("[a-z0-9_]+", "".join(c.lower() if c.isascii() else c for c in text))
    h = [int.from_bytes(hashlib.sha256(" ".join(t[i : i + k]).encode()).digest()[:8], "big", signed=True) for i in range(len(t) - k + 1)]
    if len(h) <= w:
        return {(x, i) for i, x in enumerate(h)}
    return {min((x, j) for j, x in enumerate(h[i : i + w], i)) for i in range(len(h) - w + 1)}


def test_winnowing_against_the_rule(spark):
    rng = random.Random(3)
    texts = ["", "one two", "a b c d e", "a b c d e f g h", "fn x() { y }", "É a B c D e F"] + [" ".join(rng.choice("abc") for _ in range(rng.randint(5, 60))) for _ in range(30)]
    for text, row in zip(texts, spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(winnowed(F.col("t")).alias("f")).collect(), strict=True):
        got = [(x.fp_hash, x.span_start) for x in row.f]
        assert len(got) == len(set(got)) and set(got) == winnow(text)
        assert all(x.span_end == x.span_start + 5 for x in row.f)


def ratio(q, t):
    q, t = ("".join(c for c in x.lower() if c.isascii() and c.isalnum()) for x in (q, t))
    if not q or not t:
        return 0.0
    if q in t:
        return 1.0
    n = 0
    for c in t:
        n += n < len(q) and c == q[n]
    return n / len(q)


@pytest.mark.parametrize(("query", "text"), [("abc", "xaxbxc"), ("abc", "ABC"), ("a-b", "zab"), ("abc", "cba"), ("", "a"), ("--", "a"), ("abc", ""), ("aab", "ab")])
def test_fuzzy_ratio(spark, query, text):
    assert one(spark, text, lambda c: subsequence_ratio(query, c)) == pytest.approx(ratio(query, text))


@pytest.mark.parametrize(("path", "parent"), [("a/b/c", "a/b"), ("a", ""), ("a/", "a"), ("", "")])
def test_parent(spark, path, parent):
    assert one(spark, path, parent_dir) == parent


@pytest.mark.parametrize(("text", "lines"), [("", []), ("a", ["a"]), ("a\n", ["a"]), ("a\r\nb", ["a", "b"]), ("a\n\n", ["a", ""]), ("\n", [""])])
def test_lines(spark, text, lines):
    assert one(spark, text, lines_of) == lines


def test_scores(spark):
    rows = [("calls", "outgoing", 1, "symbol_name", "parse"), ("references", "incoming", 2, "symbol_name", "Ok"), ("other", "incoming", 9, "file", "x"), ("names", "incoming", 1, "symbol_name", "str")]
    got = spark.createDataFrame(rows, "e string, d string, n int, t string, name string").select(edge_score(F.col("e"), F.col("d"), F.col("n"), F.col("t"), F.col("name"), True).alias("s"), project_local(F.col("name")).alias("p")).collect()
    assert [round(r.s, 6) for r in got] == [3.05, 0.0, 0.0, 0.8] and [r.p for r in got] == [True, False, False, False]
