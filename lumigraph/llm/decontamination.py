"""Benchmark decontamination: seeds that no pair can do without, then Smith-Waterman alignment of words."""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from lumigraph.llm.common import slices
from lumigraph.llm.tokens import STRETCH, stretches
from lumigraph.llm.words import coded_words

SEED_WORDS = 2
MATCH, MISMATCH, GAP = 2, -1, -1
MOST_BLOCK_BYTES = 32 << 20
# Cells of one round of alignments; bounds memory whatever the number of candidates.
_CELLS = 4_000_000
_EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def bare_word(word: str) -> str:
    return word.lower().strip(_EDGES)


def bounds(n: int, size: int, least: float) -> tuple[int, int, int, int]:
    """(words in a run, runs, matches, words of the text) of an item of n words: what any alignment that reaches the share least holds and spans.

    With m matches and e mismatches and gaps, 2m - e >= 2n * least. So m >= n * least and e <= 2n * (1 - least);
    the matches lie in at most e + 1 unbroken stretches, which hold m - (k - 1)(e + 1) runs of k words at least,
    the fewest where m = n; and the text's words are n + e at most. Runs are of size words, or of fewer
    where this leaves none of them.
    """
    matches = max(1, -int(-(n * least - 1e-9) // 1))
    errors = max(0, int(MATCH * n * (1 - least) / -GAP + 1e-9))
    for k in range(min(size, n), 1, -1):
        if (runs := n - (k - 1) * (errors + 1)) > 0:
            return k, runs, matches, n + errors
    return 1, matches, matches, n + errors


class _Items:
    """The items of one block in numbers: words, and the runs of them that seeds are chosen from."""

    def __init__(self, rows: list[tuple], size: int, least: float):
        self.distinct_ids = list(dict.fromkeys(r[0] for r in rows))  # rows come sorted by id
        place = {x: k for k, x in enumerate(self.distinct_ids)}
        self.numbered = [place[r[0]] for r in rows]
        self.known: dict[str, int] = {}
        self.words = []
        for _, text in rows:
            words = [bare_word(w.decode()) for w in (text or "").encode().split()]
            self.words.append(np.array([self.known.setdefault(w, len(self.known) + 1) for w in words if w], np.int64))
        self.bounds = [bounds(len(w), size, least) if len(w) else (0, 0, 0, 0) for w in self.words]
        runs = [self._codes(w, k) for w, (k, *_) in zip(self.words, self.bounds, strict=True)]
        self.codes = np.unique(np.concatenate([np.zeros(0, np.int64), *runs]))
        self.runs = [np.searchsorted(self.codes, r) for r in runs]
        self.single = np.full(len(self.known) + 1, -1, np.int64)  # a word's place among the codes of single words
        alone = np.flatnonzero(self.codes <= len(self.known))
        self.single[self.codes[alone]] = alone
        self.masks: list[dict[int, int]] = [{} for _ in self.words]  # for each word of an item the bits of its places
        for own, words in zip(self.masks, self.words, strict=True):
            for j, w in enumerate(words.tolist()):
                own[w] = own.get(w, 0) | 1 << j

    def _codes(self, words: np.ndarray, size: int) -> np.ndarray:
        """A number for each run of size words."""
        base = len(self.known) + 1
        if size == 0:
            return np.zeros(0, np.int64)
        out = words[: len(words) - size + 1].copy()
        for k in range(1, size):
            out = out * base + words[k : len(words) - size + 1 + k]
        return out

    def numbers(self, texts: list[bytes]) -> list[np.ndarray]:
        """The words of each text as the items' numbers, 0 for words that no item has."""
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for rows, pieces in stretches(texts):
            codes, bounds, distinct = coded_words(pieces)
            bare = [bare_word(w) for w in distinct]
            found = np.fromiter(map(self.known.get, bare, repeat(0)), np.int64, len(bare))
            found[[i for i, w in enumerate(bare) if not w]] = -1
            found = found[codes]
            for i, a, b in zip(rows.tolist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                own = found[a:b]
                out[i].append(own[own >= 0])
        return [x[0] if len(x) == 1 else np.concatenate(x) for x in out]

    def hits(self, words: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions, runs) of the items' runs among a text's words."""
        at, found = [], []
        for k in sorted({k for k, *_ in self.bounds if k}):
            n = len(words) - k + 1
            if n <= 0:
                continue
            if k == 1:
                i = self.single[words]
                p = np.flatnonzero(i >= 0)
                at.append(p)
                found.append(i[p])
                continue
            clear = words[:n] > 0
            for j in range(1, k):
                clear &= words[j : j + n] > 0
            p = np.flatnonzero(clear)
            if not len(p):
                continue
            base = len(self.known) + 1
            code = words[p]
            for j in range(1, k):
                code = code * base + words[p + j]
            i = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            ok = self.codes[i] == code
            at.append(p[ok])
            found.append(i[ok])
        return (np.concatenate(at), np.concatenate(found)) if at else (np.zeros(0, np.int64),) * 2

    def may_match(self, item: int, words: list[int]) -> bool:
        """Whether the longest common subsequence of an item and words has the matches that the least score needs."""
        masks, n = self.masks[item], len(self.words[item])
        found = [masks[w] for w in words if w in masks]
        if len(found) < self.bounds[item][2]:
            return False
        full = (1 << n) - 1
        left = full
        for m in found:
            both = left & m
            left = (left + both | left - both) & full
        return n - left.bit_count() >= self.bounds[item][2]


def align(items: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best Smith-Waterman scores of rows of items against rows of windows, and where in the window they end.

    Item words are padded with -1, window words with -2. Gaps cost alike however long, so a row's gaps
    along the window are a running maximum.
    """
    n, width = windows.shape
    ramp = np.arange(width + 1, dtype=np.int32) * -GAP
    above = np.zeros((n, width + 1), np.int32)
    best, end = np.zeros(n, np.int32), np.zeros(n, np.int64)
    for j in range(items.shape[1]):
        now = np.zeros((n, width + 1), np.int32)
        step = np.where(windows == items[:, j : j + 1], MATCH, MISMATCH)
        now[:, 1:] = np.maximum(0, np.maximum(above[:, :-1] + step, above[:, 1:] + GAP))
        now = np.maximum.accumulate(now + ramp, axis=1) - ramp
        now[items[:, j] < 0] = 0
        top = now.argmax(axis=1)
        score = now[np.arange(n), top]
        better = score > best
        best[better], end[better] = score[better], top[better]
        above = now
    return best, end


def _run_counts(docs: DataFrame, shared) -> DataFrame:
    """(run, n): how often each run stands in all of these documents. A task sends a row for each run at most."""

    def run(batches):
        items, total, apart = shared.value, None, np.zeros(1, np.int64)  # no run goes from one text into the next
        for _, (texts,) in slices(batches, STRETCH, 0):
            total = np.zeros(len(items.codes), np.int64) if total is None else total
            words = [x for own in items.numbers(texts) for x in (own, apart)]
            total += np.bincount(items.hits(np.concatenate(words))[1], minlength=len(total))
        runs = np.flatnonzero(total) if total is not None else np.zeros(0, np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(runs), pa.array(total[runs] if len(runs) else runs)], ["run", "n"])

    return docs.select("t").mapInArrow(run, "run bigint, n bigint").groupBy("run").agg(F.sum("n").alias("n"))


class _Seeds:
    """For each run the items that it is a seed of; and how many seeds a stretch needs for an item.

    A pair that reaches the least score holds some number r of an item's runs. Any of these runs but r - j
    are j of them, so the rarest but r - j are the seeds, and j of them have to stand near one another.
    """

    def __init__(self, items: _Items, counts: np.ndarray):
        self.need = np.array([1 + r // 4 for _, r, _, _ in items.bounds], np.int64)
        self.span = np.array([s for *_, s in items.bounds], np.int64)
        pairs = [np.zeros((2, 0), np.int64)]
        for i, (runs, (_, r, _, _)) in enumerate(zip(items.runs, items.bounds, strict=True)):
            if len(runs):
                rare = runs[np.lexsort((runs, counts[runs]))][: len(runs) - r + self.need[i]]
                pairs.append(np.stack([u := np.unique(rare), np.full(len(u), i)]))
        run, item = np.concatenate(pairs, axis=1)
        order = np.argsort(run, kind="stable")
        self.items, self.size = item[order], np.bincount(run, minlength=len(items.codes))
        self.start = np.cumsum(self.size) - self.size

    def places(self, at: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(items, positions), in order: where as many of an item's seeds follow as it needs, within its span."""
        size = self.size[found]
        column = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
        item, p = self.items[np.repeat(self.start[found], size) + column], np.repeat(at, size)
        key = np.sort(item << 40 | p)
        item, p = key >> 40, key & ((1 << 40) - 1)
        last = np.arange(len(key)) + self.need[item] - 1
        i = np.flatnonzero(last < len(key))
        last = last[i]
        i = i[(item[last] == item[i]) & (p[last] - p[i] < self.span[item[i]])]
        return item[i], p[i]


def _windows(at: np.ndarray, n_words: int, reach: int) -> list[tuple[int, int]]:
    """Stretches of a text around places, joined where they touch and cut to overlapping ones of a few reaches."""
    out, most = [], 8 * reach
    for p in at:
        lo, hi = max(0, p - reach), min(n_words, p + reach)
        if out and lo <= out[-1][1]:
            out[-1][1] = max(out[-1][1], hi)
        else:
            out.append([lo, hi])
    return [(a, min(b, a + most)) for lo, b in out for a in range(lo, max(lo + 1, b - 2 * reach), most - 2 * reach)]


def _score(batches, items: _Items, seeds: _Seeds, least: float, text_at: int):
    """(rows, {(row, number of the item's id): (score, end)}) of slices of the batches, whose texts are binary; aligns some millions of cells at a time."""

    def flush(work: list[tuple]):
        work.sort(key=lambda w: len(w[2]))  # so rows of one round are about as wide
        for k in range(0, len(work), 128):
            yield from aligned(work[k : k + 128])

    def aligned(work: list[tuple]):
        length, width = max(len(items.words[w[1]]) for w in work), max(len(w[2]) for w in work)
        a, b = np.full((len(work), length), -1, np.int32), np.full((len(work), width), -2, np.int32)
        for i, (_, item, words, _, _) in enumerate(work):
            a[i, : len(items.words[item])] = items.words[item]
            b[i, : len(words)] = words
        score, end = align(a, b)
        for (doc, item, _, lo, _), s, e in zip(work, score.tolist(), end.tolist(), strict=True):
            share = s / (MATCH * len(items.words[item]))
            if share >= least:
                yield doc, item, share, lo + e

    def rows(texts):
        work, cells = [], 0
        for i, words in enumerate(items.numbers(texts)):
            item_at, at = seeds.places(*items.hits(words))
            edges = np.flatnonzero(np.diff(item_at, prepend=-1))
            plain = words.tolist() if len(edges) else []
            for item, ps in zip(item_at[edges].tolist(), np.split(at, edges[1:]) if len(edges) else [], strict=True):
                n = len(items.words[item])
                for lo, hi in _windows(ps.tolist(), len(words), int(seeds.span[item]) + 1):
                    if not items.may_match(item, plain[lo:hi]):
                        continue
                    work.append((i, item, words[lo:hi], lo, hi))
                    cells += n * (hi - lo)
                    if cells > _CELLS:
                        yield from flush(work)
                        work, cells = [], 0
        if work:
            yield from flush(work)

    for batch, (texts,) in slices(batches, STRETCH, text_at):
        best: dict[tuple[int, int], tuple[float, int]] = {}  # by document and item id, whichever of its texts
        for doc, item, share, end in rows([t or b"" for t in texts]):
            key = doc, items.numbered[item]
            if key not in best or (-share, end) < (-best[key][0], best[key][1]):
                best[key] = (share, end)
        yield batch, best


def _blocks(spark, docs: DataFrame, benchmark: DataFrame, seed_words: int, min_score: float, item_col: str, item_text_col: str):
    """(items, seeds) of each block of the benchmark, as broadcasts; all of docs (t as binary) tell how rare runs are."""
    items = benchmark.select(F.col(item_col).alias("i"), F.col(item_text_col).alias("x")).where("i is not null").distinct()
    total = items.agg(F.sum(F.octet_length("x"))).first()[0] or 0
    blocks = -(-total // MOST_BLOCK_BYTES) or 1
    for k in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == k).sort("i", "x").collect()
        block = _Items([(r.i, r.x) for r in rows], seed_words, min_score)
        if not len(block.codes):
            continue
        shared = spark.sparkContext.broadcast(block)
        counts = np.zeros(len(block.codes), np.int64)
        for r in _run_counts(docs, shared).collect():
            counts[r.run] = r.n
        yield shared, spark.sparkContext.broadcast(_Seeds(block, counts))


def find_contamination(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, min_score: float = 0.5, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """(id, item_id, score, end_word): the documents that hold a copy, edited or not, of a benchmark item.

    Words are split at ASCII white space, lower-cased, ASCII punctuation at their ends left out. Words are
    aligned with the item; score is the best local alignment's, as a share of the item's with itself (1: the
    whole item, word for word); end_word counts the document's words up to its end. All pairs of min_score
    or more are returned, once each: only stretches are aligned that hold as many of an item's seeds as
    min_score makes sure of. Seeds are the rarer of its runs of seed_words words, or of fewer words where
    min_score makes sure of no such run (of single words at 0.5). Which runs are rarer is counted over all
    documents; it decides how much is aligned, not what is found.

    Null and empty texts and items, and items without words, give no rows, nor do items without id;
    documents without id come back with a null id. Repeated documents give repeated rows; of items that
    repeat an id every distinct text is looked for, and the best score counts. Other columns are ignored.

    The benchmark is the stated query set: it goes to the executors in blocks of bounded size, one after
    the other, and every document is read twice against each block, first to count its runs, without a
    shuffle of texts. A task of the first reading sends a row for each of the block's runs at most.
    """
    spark = docs.sparkSession
    docs = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    item_type = benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, item_id {item_type.simpleString()}, score double, end_word bigint"
    item_arrow = to_arrow_type(item_type)
    out = spark.createDataFrame([], schema)
    for shared, seeds in _blocks(spark, docs, benchmark, seed_words, min_score, item_col, item_text_col):

        def run(batches, shared=shared, seeds=seeds):
            items = shared.value
            for batch, best in _score(batches, items, seeds.value, min_score, 1):
                keys = sorted(best)
                columns = [pa.array([items.distinct_ids[k] for _, k in keys], item_arrow), pa.array([best[k][0] for k in keys], pa.float64()), pa.array([best[k][1] for k in keys], pa.int64())]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array([i for i, _ in keys], pa.int64())), *columns], [id_col, "item_id", "score", "end_word"])

        out = out.unionByName(docs.mapInArrow(run, schema))
    return out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, seed_words: int = SEED_WORDS, min_score: float = 0.5, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs, all columns as they are, whose text holds no item as find_contamination() finds them.

    Each row is judged by its own text, whatever its id, null or repeated. Two passes for each block of the
    benchmark, without a join or a shuffle of texts."""
    spark, schema, at = docs.sparkSession, docs.schema, docs.columns.index(text_col)
    texts = docs.select(F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    for shared, seeds in _blocks(spark, texts, benchmark, seed_words, min_score, item_col, item_text_col):

        def run(batches, shared=shared, seeds=seeds):
            binary = (b.set_column(at, b.schema.field(at).name, b.column(at).cast(pa.binary())) for b in batches)
            for part, best in _score(binary, shared.value, seeds.value, min_score, at):
                gone = np.zeros(part.num_rows, bool)
                gone[[i for i, _ in best]] = True
                part = part.filter(pa.array(~gone))
                yield part.set_column(at, part.schema.field(at).name, part.column(at).cast(pa.string()))

        docs = docs.mapInArrow(run, schema)
    return docs
