import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lumigraph.llm import fingerprints as fingerprint_module
from lumigraph.llm import decontamination, near_dup
from lumigraph.llm.decontamination import align, drop_contaminated, find_contamination
from lumigraph.llm.fingerprints import compare_edits, fingerprint_documents, fingerprints, likeness, pack, unpack
from lumigraph.llm.near_dup import drop_near_duplicates, near_duplicates


def brute(rows, size, num=80, den=100):
    sets = {}
    for i, t in rows:
        w = (t or "").encode().lower().split()
        k = min(size, len(w))
        sets[i] = {tuple(w[a : a + k]) for a in range(len(w) - k + 1)} if k else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for n, a in enumerate(ids):
        for b in ids[:n]:
            if sets[a] and sets[b] and den * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in sets}


def edited(rng, words, n):
    out = list(words)
    for _ in range(n):
        k, what = rng.randrange(len(out)), rng.random()
        if what < 0.6:
            out[k] = f"e{rng.randint(0, 30)}"
        elif what < 0.8:
            del out[k]
        else:
            out.insert(k, f"i{rng.randint(0, 30)}")
    return out


@pytest.mark.parametrize("size", [2, 5])
def test_near_duplicates_against_brute_force(make_docs, odd_rows, size):
    """A large group of copies, some linked by way of others alone, and smaller ones."""
    rng = random.Random(size)
    rows = [r for r in dict(odd_rows).items()]
    for g, n in enumerate((120, 25, 25, 3)):
        base = [f"w{rng.randint(0, 400)}" for _ in range(rng.randint(60, 140))]
        made = [base]
        for _ in range(n):
            made.append(edited(rng, rng.choice(made) if g == 1 else base, rng.randint(0, 14 if size == 2 else 5)))
        rows += [(100 + 500 * g + k, " ".join(w)) for k, w in enumerate(made)]
    rows += [(5000 + i, " ".join(f"w{rng.randint(0, 400)}" for _ in range(rng.randint(1, 30)))) for i in range(60)]
    rng.shuffle(rows)
    want = brute(rows, size)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(rows), size).collect()}
    assert got == want and len({c for _, c, _ in want.values()}) < len(rows) - 30


def test_near_duplicates_edge_cases(make_docs, odd_rows):
    rows = [*odd_rows, (None, "One line of text that is long enough")]
    got = sorted(map(tuple, near_duplicates(make_docs(rows), 2).collect()), key=repr)
    want = brute(odd_rows, 2)
    assert got == sorted([(i, *want[i]) for i, _ in odd_rows] + [(None, 7, None, True)], key=repr)
    assert near_duplicates(make_docs([]), 2).count() == 0


def test_estimate_is_near_similarity(spark):
    rng = np.random.RandomState(0)
    rows = []
    for share in (0.3, 0.6, 0.8, 0.95):
        a = np.unique(rng.randint(0, 1 << 62, 2000).astype(np.uint64))
        b = np.unique(np.concatenate([a[: int(len(a) * share)], rng.randint(0, 1 << 62, int(len(a) * (1 - share))).astype(np.uint64)]))
        low = [near_dup.minima(x) for x in (a, b)]
        same = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        rows.append((float(same), float((low[0] == low[1]).mean())))
    assert all(abs(a - b) < 0.12 for a, b in rows)


def test_fingerprints(make_docs, odd_rows):
    rng = random.Random(1)
    rows = [*odd_rows, *[(10 + i, "".join(rng.choice("abcdefgh é\n") for _ in range(rng.randint(1, 3000)))) for i in range(30)], (None, "lost")]
    got = compare_edits(make_docs(rows)).collect()
    order = sorted(((i, t or "") for i, t in rows if i is not None))
    want = []
    for k, (i, t) in enumerate(order):
        n, nxt = len(t) // 4, order[(k + 1) % len(order)][1]
        want.append((i, len(t), t[: len(t) - n] + nxt[:n]))
    assert sorted((r.doc_id, r.n_chars, r.edited_text) for r in got) == sorted(want)
    long = [r for r in got if 400 < r.n_chars < 10_000]
    assert all(0.4 < r.near_edited <= 1 for r in long) and sum(r.near_next for r in long) / len(long) < 0.1
    texts, of = {i: t for i, t in order}, {}
    for r in got:
        of.setdefault(texts[r.doc_id], set()).add(r.fingerprint)
    assert all(len(x) == 1 for x in of.values())
    assert {r.doc_id: r.fingerprint for r in fingerprint_documents(make_docs(odd_rows)).collect()}[1] == of[texts[1]].pop()
    one = compare_edits(make_docs([(3, "abcdefgh")])).first()
    assert one.edited_text == "abcdefab" and one.near_next == 1.0
    assert compare_edits(make_docs([])).count() == 0


def test_chunks_follow_content():
    rng = random.Random(2)
    text = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(20_000)).encode()
    a, b, none = fingerprints([text, b"inserted at the start " + text, b""])
    assert likeness(a, b) > 0.95 and likeness(a, none) == 0 and likeness(none, none) == 1
    assert np.array_equal(unpack(pack(a)), a) and pack(none) == ""
    assert np.array_equal(a, fingerprints([b"before", text])[1])


def plain_alignment(a, b):
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i, x in enumerate(a, 1):
        for j, y in enumerate(b, 1):
            h[i, j] = max(0, h[i - 1, j - 1] + (2 if x == y else -1), h[i - 1, j] - 1, h[i, j - 1] - 1)
    return h.max()


def test_alignment():
    rng = np.random.RandomState(0)
    items, windows = rng.randint(1, 5, (20, 8)), rng.randint(1, 5, (20, 15))
    items[3, 5:] = -1
    windows[4, 9:] = -2
    got, _ = align(items, windows)
    assert got.tolist() == [plain_alignment([x for x in a if x > 0], [x for x in b if x > 0]) for a, b in zip(items, windows, strict=True)]


def test_contamination(spark, make_docs):
    rng = random.Random(3)
    items = {i: [f"v{rng.randint(0, 3000)}" for _ in range(rng.randint(14, 50))] for i in range(20)}
    noise = lambda n: [f"v{rng.randint(0, 3000)}" for _ in range(n)]
    rows, want = [], set()
    for d in range(200):
        words = noise(rng.randint(5, 300))
        if d % 4 == 0:
            i = 0 if d % 8 else rng.randrange(20)  # one item is in very many documents
            copy = [w if rng.random() > 0.12 else "changed" for w in items[i]]
            words[len(words) // 2 : len(words) // 2] = [w.upper() + "," for w in copy] if d % 3 else copy
            want.add((d, i))
        rows.append((d, " ".join(words)))
    rows += [(900, None), (901, ""), (902, " ".join(items[3])), (902, " ".join(items[3])), (903, " ".join(noise(30_000) + items[4]))]
    bench = spark.createDataFrame([(i, " ".join(w), "x") for i, w in items.items()] + [(50, None, "x"), (51, "", "x"), (None, "v1", "x"), (3, "a", "x")], "item_id bigint, text string, t string")
    got = find_contamination(make_docs(rows), bench).collect()
    assert {(r.doc_id, r.item_id) for r in got} == want | {(902, 3), (903, 4)}
    assert sum(r.doc_id == 902 for r in got) == 2 and all(r.score == 1.0 for r in got if r.doc_id >= 900)
    assert find_contamination(make_docs(rows), bench.where("false")).count() == 0 and find_contamination(make_docs([]), bench).count() == 0


@pytest.mark.parametrize("least", [0.5, 0.8])
def test_contamination_against_alignment_of_all_pairs(spark, make_docs, least):
    rng = random.Random(8)
    common = lambda n: [f"c{rng.randint(0, 30)}" for _ in range(n)]
    items = [common(12) for _ in range(12)] + [common(n) for n in (1, 2, 3, 5, 25)]
    for k, words in enumerate(items[:12]):
        for j in (3, 6, 9):
            words[j] = f"rare{k}x{j}"
    rows = []
    for d in range(240):
        item = items[d % len(items)]
        way = d % 4
        if way == 0:
            copy = ["new" if w.startswith("rare") else w for w in item]  # the rare words are replaced
        elif way == 1:
            copy = [x for w in item for x in ((w, "new") if rng.random() < 0.9 else (w,))]  # hardly two words are left together
        elif way == 2:
            copy = [w for w in item if rng.random() < 0.8]
        else:
            copy = []
        rows.append((d, " ".join(common(rng.randint(0, 60)) + copy + common(rng.randint(0, 60)))))
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)], "item_id bigint, text string")
    want = {}
    number = {w: k for k, w in enumerate(sorted({w for _, t in rows for w in t.split()} | {w for x in items for w in x}))}
    for d, text in rows:
        for i, item in enumerate(items):
            score, _ = align(np.array([[number[w] for w in item]]), np.array([[number[w] for w in text.split()] or [-2]]))
            if (share := int(score[0]) / (2 * len(item))) >= least:
                want[d, i] = share
    got = find_contamination(make_docs(rows), bench, min_score=least).collect()
    assert len(got) == len(want) and {(r.doc_id, r.item_id): r.score for r in got} == want


def test_contamination_by_each_text_of_an_item(spark, make_docs):
    one, two = ([f"{c}{k}" for k in range(20)] for c in "ab")
    bench = spark.createDataFrame([(7, " ".join(one)), (7, " ".join(two)), (7, " ".join(two)), (7, None)], "item_id bigint, text string")
    rows = [(1, "x " + " ".join(one)), (2, " ".join(two)), (3, " ".join(one[:15] + two)), (4, "x y z")]
    got = find_contamination(make_docs(rows), bench).collect()
    assert sorted((r.doc_id, r.item_id, r.score, r.end_word) for r in got) == [(1, 7, 1.0, 21), (2, 7, 1.0, 20), (3, 7, 1.0, 35)]


def test_contaminated_rows_go_by_their_own_text(spark, make_docs):
    item = [f"b{k}" for k in range(20)]
    bench = spark.createDataFrame([("first", " ".join(item)), ("second", "x y")], "item_id string, text string")
    rows = [(None, " ".join(item)), (1, "clean words of one " + " ".join(item)), (1, "clean words"), (2, None), (3, ""), (4, "clean"), (4, "clean")]
    docs = make_docs(rows)
    out = drop_contaminated(docs, bench)
    assert out.columns == docs.columns and sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, "clean words"), (2, None), (3, ""), (4, "clean"), (4, "clean")], key=repr)
    assert drop_contaminated(docs, bench.where("false")).count() == len(rows) and drop_contaminated(make_docs([]), bench).count() == 0
    got = find_contamination(docs.withColumn("doc_id", F.concat(F.lit("d"), F.col("doc_id"))), bench).collect()
    assert sorted((r.doc_id or "", r.item_id, r.score) for r in got) == [("", "first", 1.0), ("d1", "first", 1.0)]


def test_blocks_of_the_benchmark(spark, make_docs, monkeypatch):
    """Several blocks find what one finds."""
    rng = random.Random(9)
    items = [[f"i{k}w{rng.randint(0, 40)}" for _ in range(15)] for k in range(12)]
    bench = spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id bigint, text string")
    docs = make_docs([(d, " ".join(["z"] * 5 + items[d % 12][: 8 + d % 8] + ["y"] * 5)) for d in range(60)])
    one = sorted(map(tuple, find_contamination(docs, bench).collect()))
    left = sorted(r.doc_id for r in drop_contaminated(docs, bench).collect())
    monkeypatch.setattr("lumigraph.llm.decontamination.MOST_BLOCK_BYTES", 200)
    assert sorted(map(tuple, find_contamination(docs, bench).collect())) == one and len(one) >= 50
    assert sorted(r.doc_id for r in drop_contaminated(docs, bench).collect()) == left == sorted({r[0] for r in [(d,) for d in range(60)]} - {r[0] for r in one})


def test_runs_are_counted_over_all_documents(spark, make_docs, monkeypatch):
    """Seeds go by how often an item's words stand in every text, none left out and no run across two texts."""
    seen = []
    make = decontamination._Seeds.__init__
    monkeypatch.setattr(decontamination._Seeds, "__init__", lambda self, items, counts: seen.append((items, counts)) or make(self, items, counts))
    words, rng = [f"w{k}" for k in range(8)], random.Random(2)
    rows = [(d, " ".join(rng.choice([*words, "x", "y", "..."]) for _ in range(rng.randint(0, 12)))) for d in range(200)] + [(None, "w0 W1, w2"), (7, None), (8, "w7"), (9, "w0")]
    bench = spark.createDataFrame([(1, " ".join(words))], "item_id bigint, text string")
    for least, size in ((0.5, 1), (0.9, 2)):
        find_contamination(make_docs(rows), bench, min_score=least)
        items, counts = seen.pop()
        number = items.known
        texts = [[w for w in ((t or "").lower().replace(",", "").split()) if w != "..."] for _, t in rows]
        want = {}
        for t in texts:
            for a in range(len(t) - size + 1):
                if all(w in number for w in t[a : a + size]):
                    code = sum(number[w] * (len(number) + 1) ** (size - 1 - k) for k, w in enumerate(t[a : a + size]))
                    want[code] = want.get(code, 0) + 1
        assert items.bounds[0][0] == size and counts.tolist() == [want.get(c, 0) for c in items.codes.tolist()] and counts.min() > 0


def test_one_row_of_each_group_stays(make_docs):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(1, text), (1, text), (2, text), (3, text + " more"), (4, "other words"), (4, "different words here"), (None, text), (5, None), (5, None)]
    out = drop_near_duplicates(make_docs(rows))
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(1, text), (4, "other words"), (4, "different words here"), (None, text), (5, None)], key=repr)
    assert drop_near_duplicates(make_docs([])).count() == 0


@pytest.mark.parametrize(("name", "value"), [("CROWD", 0), ("CROWD", 1 << 30), ("SLACK", 2.0)])
def test_near_duplicates_are_the_same_by_every_way(make_docs, monkeypatch, name, value):
    """Whether members meet directly or by differences, and whether signatures pass over pairs, the links are those of brute force."""
    monkeypatch.setattr(near_dup, name, value)
    rng = random.Random(11)
    rows = []
    for g, n in enumerate((60, 40, 5)):
        made = [[f"w{rng.randint(0, 300)}" for _ in range(90)]]
        for _ in range(n):
            made.append(edited(rng, rng.choice(made) if g else made[0], rng.randint(0, 9)))
        rows += [(500 * g + k, " ".join(w)) for k, w in enumerate(made)]
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in near_duplicates(make_docs(rows), 2).collect()}
    assert got == brute(rows, 2)


def test_packed_estimate_is_near_similarity(spark):
    rng, rows = np.random.RandomState(1), []
    for share in (0.0, 0.3, 0.6, 0.8, 0.95, 1.0):
        words = [f"w{k}" for k in rng.permutation(100_000)[:3000]]
        other = words[: int(len(words) * share)] + [f"v{k}" for k in range(int(len(words) * (1 - share)))]
        sets = [{tuple(x[i : i + 2]) for i in range(len(x) - 1)} for x in (words, other)]
        rows += [(len(rows), " ".join(words)), (len(rows) + 1, " ".join(other)), len(sets[0] & sets[1]) / len(sets[0] | sets[1])]
    same, texts = rows[2::3], [(k, rows[i][1]) for k, i in enumerate(i for i in range(len(rows)) if i % 3 < 2)]
    docs = spark.createDataFrame(texts, "id bigint, x string").select("id", F.col("x").cast("binary").alias("t"), F.xxhash64("x").alias("h"))
    sigs = near_dup.signatures(docs, 2)
    a, b = sigs.select((F.col("id") / 2).alias("g"), F.col("sig").alias("a")).where("id % 2 = 0"), sigs.select(((F.col("id") - 1) / 2).alias("g"), F.col("sig").alias("b")).where("id % 2 = 1")
    got = [r.e for r in a.join(b, "g").orderBy("g").select(near_dup.estimate(F.col("a"), F.col("b")).alias("e")).collect()]
    assert got == pytest.approx(same, abs=0.13)


def plain_fingerprint(data: bytes) -> set[tuple[int, bytes]]:
    """Chunks one after the other, by the definition: (length, chunk)."""
    out, at = set(), 0
    while at < len(data):
        end = min(len(data), at + fingerprint_module.MOST)
        for k in range(at + fingerprint_module.LEAST, end):
            h = 0
            for j in range(min(fingerprint_module.WINDOW, k)):  # of the text alone
                h = (h + (int(fingerprint_module._GEAR[data[k - 1 - j]]) << j)) & 0xFFFFFFFF
            bits = fingerprint_module.HARD if k - at < fingerprint_module.NORMAL else fingerprint_module.EASY
            if (h >> 16) & ((1 << bits) - 1) == 0:
                end = k
                break
        out.add((end - at, data[at:end]))
        at = end
    return out


def test_fingerprints_against_a_plain_chunker(make_docs, odd_rows):
    rng = random.Random(12)
    rows = [r for r in odd_rows if len(r[1] or "") < 10_000][:6] + [(50 + i, "".join(rng.choice("abc dé\n") for _ in range(rng.choice([0, 1, 7, 8, 15, 16, 31, 32, 127, 128, 129, 700])))) for i in range(40)]
    texts = [(t or "").encode() for _, t in rows]
    joined = fingerprints(texts)
    for text, own in zip(texts, joined, strict=True):
        plain = plain_fingerprint(text)
        assert len(own) == len(plain) and int((own & np.uint64(0xFF)).sum()) + len(own) == sum(n for n, _ in plain)
        assert np.array_equal(own, fingerprints([text])[0])
    order = sorted((i, t or "") for i, t in rows)
    near = {}
    for k, (i, t) in enumerate(order):
        n, nxt = len(t) // 4, order[(k + 1) % len(order)][1]
        sets = [plain_fingerprint(x.encode()) for x in (t, t[: len(t) - n] + nxt[:n], nxt)]
        weight = lambda s: sum(n for n, _ in s)
        like = lambda a, b: weight(a & b) / min(weight(a), weight(b)) if min(weight(a), weight(b)) else float(len(a) == len(b))
        near.setdefault(i, []).append((round(like(sets[0], sets[1]), 9), round(like(sets[0], sets[2]), 9)))
    got = {}
    for r in compare_edits(make_docs(rows)).collect():
        got.setdefault(r.doc_id, []).append((round(r.near_edited, 9), round(r.near_next, 9)))
    assert {i: sorted(x) for i, x in got.items()} == {i: sorted(x) for i, x in near.items()}


def test_ids_that_are_no_numbers(spark):
    docs = spark.createDataFrame([("a", "some words"), ("7", "other words"), (None, "x")], "doc_id string, text string")
    assert [r.doc_id for r in compare_edits(docs).collect()] == [7]
    assert {r.doc_id: r.component_id for r in near_duplicates(docs, 2).collect()} == {"a": "a", "7": "7", None: None}
