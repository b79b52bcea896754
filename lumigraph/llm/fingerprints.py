"""Document fingerprints: digests of content-defined chunks, compared by the length that they share."""

from __future__ import annotations

import base64
import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.llm.common import slices

LEAST, NORMAL, MOST = 8, 32, 128
WINDOW = 16  # bytes that a boundary depends on
HARD, EASY = 6, 4  # bits that must be zero before and after NORMAL bytes
DIGEST, SIZE = 6, 1  # bytes of a chunk's digest and of its length
_GEAR = np.random.RandomState(0).randint(0, 1 << 32, 256, dtype=np.uint64).astype(np.uint32)
# Bytes of texts that are chunked at once.
_BATCH = 4 << 20


def gear(data: np.ndarray) -> np.ndarray:
    """The gear hash after each byte: each earlier byte's number, shifted once for every byte since, WINDOW bytes back."""
    h, step = _GEAR[data], 1
    while step < WINDOW:
        h[step:] += h[:-step] << np.uint32(step)
        step *= 2
    return h >> np.uint32(32 - 16)  # upper bits alone, to which all of the window has spread


def chunk_ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, end) of all chunks, in order; ends count from the start of the joined texts.

    Normalised chunking: from LEAST bytes on a chunk ends where HARD bits of the hash are zero, from NORMAL
    bytes on where EASY bits are, and at MOST bytes or the text's end in any case. All texts go forward
    together, a chunk a step.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    stops = np.cumsum(sizes)
    starts = stops - sizes
    data = np.frombuffer(b"".join(texts), np.uint8)
    h = gear(data) if len(data) else np.zeros(0, np.uint32)
    # the first bytes of a text see bytes of the text before it, but LEAST and the window keep them apart only in part
    for k in range(min(WINDOW - 1, len(data))):
        at = starts[sizes > k] + k
        own = np.zeros(len(at), np.uint32)
        for j in range(k + 1):
            own += _GEAR[data[at - j]] << np.uint32(j)
        h[at] = own >> np.uint32(32 - 16)
    low = np.flatnonzero((h & np.uint32((1 << EASY) - 1)) == 0)
    far = np.iinfo(np.int64).max
    easy, hard = np.append(low, far), np.append(low[(h[low] & np.uint32((1 << HARD) - 1)) == 0], far)
    at, active, out_text, out_end = starts.copy(), np.flatnonzero(sizes > 0), [], []
    while len(active):
        a = at[active]
        first, second = hard[np.searchsorted(hard, a + LEAST - 1)], easy[np.searchsorted(easy, a + NORMAL - 1)]
        end = np.where(first < a + NORMAL - 1, first, np.minimum(second, a + MOST - 1)) + 1
        end = np.minimum(end, stops[active])
        out_text.append(active)
        out_end.append(end)
        at[active] = end
        active = active[end < stops[active]]
    if not out_text:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    text, end = np.concatenate(out_text), np.concatenate(out_end)
    order = np.argsort(end, kind="stable")
    return text[order], end[order]


def fingerprints(texts: list[bytes]) -> list[np.ndarray]:
    """For each text its chunks' digests, once each and in order; the low byte is the chunk's length less one."""
    text, end = chunk_ends(texts)
    data, starts = b"".join(texts), np.concatenate([[0], end]).astype(np.int64)[:-1]
    keys = np.array([xxhash.xxh3_64_intdigest(data[a:b]) for a, b in zip(starts.tolist(), end.tolist(), strict=True)], np.uint64)
    keys = (keys >> np.uint64(64 - 8 * DIGEST) << np.uint64(8)) | (end - starts - 1).astype(np.uint64)
    cuts = np.searchsorted(text, np.arange(len(texts) + 1))
    return [np.unique(keys[a:b]) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


def pack(fingerprint: np.ndarray) -> str:
    """Base64 of the digests as DIGEST + SIZE bytes each, big-endian."""
    return base64.b64encode(fingerprint.astype(">u8").view(np.uint8).reshape(-1, 8)[:, 8 - DIGEST - SIZE :].tobytes()).decode()


def unpack(text: str) -> np.ndarray:
    raw = np.frombuffer(base64.b64decode(text), np.uint8).reshape(-1, DIGEST + SIZE)
    return np.hstack([np.zeros((len(raw), 8 - DIGEST - SIZE), np.uint8), raw]).copy().view(">u8").ravel().astype(np.uint64)


def _weight(fingerprint: np.ndarray) -> int:
    return int((fingerprint & np.uint64(0xFF)).sum()) + len(fingerprint)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    """Containment of the smaller in the larger: the bytes of chunks that both have, as a share of the smaller's.

    Of two empty texts 1, of an empty and another one 0."""
    least = min(_weight(a), _weight(b))
    if not least:
        return float(len(a) == len(b))
    return _weight(np.intersect1d(a, b, assume_unique=True)) / least


def fingerprint_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fingerprint), a row for each row of docs; a null text is the empty one, whose fingerprint is empty."""
    docs = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))

    def run(batches):
        for own, (texts,) in slices(batches, _BATCH, 1):
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(map(pack, fingerprints(texts)), pa.string())], [id_col, "fingerprint"])

    return docs.mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, fingerprint string")


def with_next(docs: DataFrame, parts: int | None = None) -> DataFrame:
    """(part, id, t, only) of docs (id, t): sorted by id and text within a part, parts in ascending order of id.

    Each part ends with the row that comes after it, marked by only = True: the next part's first, after
    the last part the first of all. Parts are ranges of ids with about as many rows each; their bounds and
    first ids are all that the driver sees.
    """
    spark = docs.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    bounds = sorted(set(docs.select("id").approxQuantile("id", [k / parts for k in range(1, parts)], 0.1 / parts))) if parts > 1 else []
    cut = F.lit(0)
    if bounds:
        # the number of bounds below the id: by every step-th of them first, then within the step
        step, below = math.isqrt(len(bounds)) + 1, lambda xs: F.size(F.filter(xs, lambda b: b < F.col("id")))
        every, coarse = (F.array(*[F.lit(int(b)) for b in x]).cast("array<bigint>") for x in (bounds, bounds[step - 1 :: step]))
        steps = below(coarse) * step
        cut = steps + below(F.slice(every, steps + 1, step))
    placed = docs.select(cut.cast("int").alias("part"), "id", "t")
    firsts = {r.part: r.id for r in placed.groupBy("part").agg(F.min("id").alias("id")).collect()}
    order = sorted(firsts)
    ahead = {order[k - 1]: firsts[p] for k, p in enumerate(order)}  # the part before the first is the last
    copies = spark.createDataFrame([(p, i) for p, i in ahead.items()], "part int, id bigint")
    after = docs.join(F.broadcast(copies), "id").select("part", "id", "t", F.lit(True).alias("only"))
    both = placed.select("part", "id", "t", F.lit(False).alias("only")).unionByName(after)
    return both.repartitionById(len(bounds) + 1, F.col("part")).sortWithinPartitions("part", "only", "id", "t")


def compare_edits(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_chars, edited_text, fingerprint, edited_fingerprint, near_edited, near_next), a row for each row of docs.

    The edited text has the last quarter (rounded down) of its code points replaced by the first as many,
    or all, of the next document in ascending order of id (after the last: the first; alone: itself). A null
    text is the empty one. Rows of one id go by their texts. Rows without an integer id (null, or a string
    that is none) are left out, as they have no place in the order. Other columns are ignored; the empty table gives no rows.

    Texts are shuffled once, to ranges of ids, and then streamed in order; a task holds one stretch of
    texts and the row that follows it.
    """
    docs = docs.select(F.col(id_col).try_cast("long").alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("t")).where("id is not null")
    schema = "id bigint, n_chars bigint, edited_text string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def compare(ids: list, texts: list[str], following: tuple):
        """Rows of ids; following is the row after them, whose fingerprint is made here too."""
        afters = [*texts[1:], following[1]]
        edited = [t[: len(t) - len(t) // 4] + u[: len(t) // 4] for t, u in zip(texts, afters, strict=True)]
        made = fingerprints([t.encode() for t in [*texts, following[1], *edited]])
        own, new = made[: len(texts) + 1], made[len(texts) + 1 :]
        columns = [ids, list(map(len, texts)), edited, list(map(pack, own[:-1])), list(map(pack, new)), [likeness(a, b) for a, b in zip(own, new, strict=False)], [likeness(a, b) for a, b in zip(own, own[1:], strict=False)]]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, _TYPES, strict=True)], _NAMES)

    def run(batches):
        ids, texts, size, part, closed = [], [], 0, None, True
        for batch in batches:
            for p, i, t, only in zip(*[batch.column(k).to_pylist() for k in range(4)], strict=True):
                if p != part:
                    part, closed = p, False
                if only:
                    if not closed and ids:
                        yield compare(ids, texts, (i, t))
                    ids, texts, size, closed = [], [], 0, True
                    continue
                if size >= _BATCH // 2:
                    yield compare(ids, texts, (i, t))
                    ids, texts, size = [], [], 0
                ids.append(i)
                texts.append(t)
                size += len(t)

    return with_next(docs).mapInArrow(run, schema).withColumnRenamed("id", id_col)


_NAMES = ["id", "n_chars", "edited_text", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
