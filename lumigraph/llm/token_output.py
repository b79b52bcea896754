"""Token-ID output: documents' token ids in rANS blocks, written in order of id and read back in parallel."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lumigraph.llm import rans
from lumigraph.llm.common import discard, materialize, relieve, slices
from lumigraph.llm.tokens import STRETCH, vocabulary

#: A block is closed after the document that brings it to this many ids.
BLOCK_IDS = 1 << 20
_WIDTH = 4


def _binary(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    """A binary value for each of sizes, cut from flat."""
    offsets = np.concatenate([[0], np.cumsum(sizes * flat.itemsize)]).astype(np.int64)
    out = pa.Array.from_buffers(pa.large_binary(), len(sizes), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(flat))])
    return out.cast(pa.binary()) if offsets[-1] < 1 << 31 else pa.array(out.to_pylist(), pa.binary())


def _tokenized(docs: DataFrame, vocabulary_path: str, end_id: int | None, id_col: str, text_col: str, width: int, counted: bool) -> DataFrame:
    docs = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    names = [id_col, "n_tokens", "ids", "counts"]

    def run(batches):
        vocab, total, kind = vocabulary(vocabulary_path), np.zeros(0, np.int64), f"<u{width}"
        for own, (texts,) in slices(batches, STRETCH, 1):
            flat, sizes = vocab.ids(texts)
            if end_id is not None:
                flat, sizes = np.insert(flat.astype(kind), np.cumsum(sizes), end_id), sizes + 1
            flat = flat.astype(kind, copy=False)
            if counted:
                one = np.bincount(flat, minlength=len(total))
                one[: len(total)] += total
                total = one
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(sizes, pa.int64()), _binary(flat, sizes), pa.nulls(len(own), pa.binary())], names)
        if counted and len(total):
            yield pa.RecordBatch.from_arrays([pa.nulls(1, own.column(0).type), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([zlib.compress(total.tobytes(), 1)], pa.binary())], names)

    return docs.mapInArrow(run, f"`{id_col}` {id_type}, n_tokens bigint, ids binary, counts binary")


def tokenize(docs: DataFrame, vocabulary_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", width: int = _WIDTH) -> DataFrame:
    """(id, n_tokens, ids): ids are little-endian integers of width bytes; end_id follows each document's own."""
    return _tokenized(docs, vocabulary_path, end_id, id_col, text_col, width, False).drop("counts")


def _histogram(counts: DataFrame) -> list:
    """(id, count) over all tokens, from each task's counts. As many rows as the vocabulary has ids at most, so the driver may hold them."""

    def run(batches):
        total = np.zeros(0, np.int64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                one = np.frombuffer(zlib.decompress(x), np.int64).copy()
                one, total = (one, total) if len(one) >= len(total) else (total, one)
                one[: len(total)] += total
                total = one
        ids = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(total[ids], pa.int64())], ["token", "n"])

    return counts.mapInArrow(run, "token bigint, n bigint").groupBy("token").agg(F.sum("n").alias("n")).collect()


def write_tokens(docs: DataFrame, path: str, vocabulary_path: str, end_id: int | None = 1, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Writes the token ids of all texts, in ascending order of id, to path/model and path/blocks.

    path/model holds the frequencies that all blocks share, counted over every token. path/blocks holds a
    row for each block: shard, block (from 0 in each shard), before (tokens of the shard before it),
    n_tokens, doc_ids, n_ids (the length of each document), payload (see rans). Shards are ranges of ids in
    ascending order. Blocks hold whole documents and are independent. Spark's committer writes both, so a
    task that runs twice leaves one copy.

    A null text is the empty one, of end_id alone. A null id goes first. Rows of one id stay beside one
    another, in order of their token bytes. Other columns are ignored. The empty table gives no blocks.

    The texts are tokenized once; each task counts the ids that it writes in the same pass, in a row of its
    own beside theirs. Only ids are shuffled, by ranges of document ids. A task holds one block.
    """
    spark = docs.sparkSession
    width = 2 if _vocabulary_size(vocabulary_path, end_id) <= 1 << 16 else _WIDTH
    written = materialize(_tokenized(docs, vocabulary_path, end_id, id_col, text_col, width, True), "token-ids")
    counts = _histogram(written.where("counts is not null").select("counts"))
    tokens = written.where("counts is null").select(id_col, "ids")
    model = rans.Model.fit(np.array([r[0] for r in counts], np.uint32), np.array([r[1] for r in counts]))
    spark.createDataFrame([(bytearray(model.to_bytes()),)], "model binary").coalesce(1).write.parquet(f"{path}/model")
    shared = spark.sparkContext.broadcast(model.to_bytes())
    id_type = tokens.schema[id_col].dataType.simpleString()
    names = ["shard", "block", "before", "n_tokens", "doc_ids", "n_ids", "payload"]

    def run(batches):
        own, shard, block, before = None, TaskContext.get().partitionId(), 0, 0
        ids, held, n = [], [], 0

        def close():
            flat = np.frombuffer(b"".join(held), f"<u{width}")
            columns = [pa.array([x]) for x in (shard, block, before, len(flat))]
            lists = [pa.ListArray.from_arrays([0, len(held)], pa.concat_arrays(ids)), pa.array([[len(x) // width for x in held]], pa.list_(pa.int64()))]
            return pa.RecordBatch.from_arrays([*columns, *lists, pa.array([rans.encode(flat, own)], pa.binary())], names)

        for batch in batches:
            own = own or rans.Model.from_bytes(shared.value)
            for i, x in enumerate(batch.column(1).to_pylist()):
                ids.append(batch.column(0).slice(i, 1))
                held.append(x)
                n += len(x) // width
                if n >= block_ids:
                    yield close()
                    relieve()
                    block, before, ids, held, n = block + 1, before + n, [], [], 0
        if held:
            yield close()

    in_order = tokens.select(id_col, "ids").repartitionByRange(F.col(id_col).asc_nulls_first()).sortWithinPartitions(F.col(id_col).asc_nulls_first(), "ids")
    in_order.mapInArrow(run, f"shard bigint, block bigint, before bigint, n_tokens bigint, doc_ids array<{id_type}>, n_ids array<bigint>, payload binary").write.parquet(f"{path}/blocks")
    discard(written)


def _vocabulary_size(path: str, end_id: int | None) -> int:
    return max(vocabulary(path).size, (end_id or 0) + 1)


def read_tokens(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """(id, start, n_tokens, ids) of each document in the files: ids are little-endian unsigned 32-bit integers.

    start counts the ids of all documents before it. Each block is decoded by itself and checked against
    its checksums. What precedes a shard is a running sum over one row per shard, of which there are as
    many as there were write tasks; so that table may be broadcast.
    """
    blocks = spark.read.parquet(f"{path}/blocks")
    id_type = blocks.schema["doc_ids"].dataType.elementType.simpleString()
    shared = spark.sparkContext.broadcast(bytes(spark.read.parquet(f"{path}/model").first()[0]))
    shards = blocks.groupBy("shard").agg(F.sum("n_tokens").alias("n")).select("shard", (F.sum("n").over(Window.orderBy("shard")) - F.col("n")).alias("first"))
    placed = blocks.join(F.broadcast(shards), "shard").select((F.col("first") + F.col("before")).alias("start"), "doc_ids", "n_ids", "payload")
    made = {}

    def run(batches):
        for batch in batches:
            if "model" not in made:
                made["model"] = rans.Model.from_bytes(shared.value)
            for i in range(batch.num_rows):
                n = np.array(batch.column(2)[i].as_py(), np.int64)
                ids = _binary(rans.decode(batch.column(3)[i].as_py(), made["model"]).astype("<u4"), n)
                yield pa.RecordBatch.from_arrays([batch.column(1)[i].values, pa.array(batch.column(0)[i].as_py() + np.cumsum(n) - n, pa.int64()), pa.array(n), ids], [id_col, "start", "n_tokens", "ids"])

    return placed.mapInArrow(run, f"`{id_col}` {id_type}, start bigint, n_tokens bigint, ids binary")
