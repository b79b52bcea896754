"""Token counts without token ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.llm.common import materialize, slices
from lumigraph.llm.tokens import STRETCH, pre_tokens, stretches, vocabulary

#: So many of the most frequent pre-tokens, of LONGEST bytes at most, are sent to every task: 20 MB. The rest is joined.
MOST_SENT, LONGEST = 1 << 18, 64


def _pieces(docs: DataFrame, vocabulary_path: str) -> DataFrame:
    """(piece, n, k): each distinct pre-token, how often the texts hold it, and its number of tokens, counted once."""

    def cut(batches):
        for _, (texts,) in slices(batches, STRETCH, 1):
            for _, held in stretches(texts):
                codes, _, distinct = pre_tokens(held)
                yield pa.RecordBatch.from_arrays([distinct, pa.array(np.bincount(codes, minlength=len(distinct)), pa.int64())], ["piece", "n"])

    def size(batches):
        vocab = vocabulary(vocabulary_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(vocab.sizes(batch.column(0).to_pylist()), pa.int64())], ["piece", "n", "k"])

    found = docs.mapInArrow(cut, "piece string, n bigint").groupBy("piece").agg(F.sum("n").alias("n"))
    return found.mapInArrow(size, "piece string, n bigint, k bigint")


def _frequent(pieces: DataFrame) -> pa.Table:
    """(piece, k) of the most frequent pieces: those from a power of two on, the least that leaves MOST_SENT at most."""
    short = pieces.where(F.octet_length("piece") <= LONGEST)
    level = F.floor(F.log2("n"))
    total, least = 0, 64
    for r in short.groupBy(level.alias("level")).count().orderBy(F.col("level").desc()).collect():
        total += r["count"]
        if total > MOST_SENT:
            break
        least = r.level
    return short.where(level >= least).select("piece", "k").toArrow()


def count_tokens(docs: DataFrame, vocabulary_path: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit), a row for each row of docs.

    n_tokens is what the library for vocabulary_path (tokenizers for .json, sentencepiece for .model)
    gives without begin, end or added special tokens, truncation or padding. A null text counts as the
    empty one. Repeated rows give repeated rows; other columns are ignored; the empty table gives no rows.

    Pieces are counted once for each distinct pre-token of all texts, in a table that grows with them. The
    most frequent pre-tokens, of which there are MOST_SENT at most, go to every task and are summed where
    the text is read; a row goes out for each other pre-token of a document, is joined to the table, and
    the sums come back to the documents. No ids are made. A pre-token that very many documents hold is one
    of the frequent ones, so no key of the join is hot.

    Vocabularies whose pre-tokens white space doesn't part count each text whole, in one scan.
    """
    docs = docs.select(F.col(id_col).alias(id_col), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    id_type = docs.schema[id_col].dataType.simpleString()
    if not vocabulary(vocabulary_path).separates:
        return _whole(docs, vocabulary_path, id_col, id_type).withColumn("over_limit", F.col("n_tokens") > limit)
    pieces = materialize(_pieces(docs, vocabulary_path), "pieces")
    sent = _frequent(pieces)
    shared = docs.sparkSession.sparkContext.broadcast((sent["piece"].combine_chunks(), np.asarray(sent["k"]).astype(np.int64)))
    rest_type = pa.struct([("piece", pa.string()), ("n", pa.int32())])

    def count(batches):
        known, sizes = shared.value
        row = TaskContext.get().partitionId() << 40
        for own, (texts,) in slices(batches, STRETCH, 1):
            total, of, lacking, times = np.zeros(len(texts), np.int64), [np.zeros(0, np.int64)], [pa.array([], pa.string())], [np.zeros(0, np.int64)]
            for where, held in stretches(texts):  # of a very long text several pieces
                codes, bounds, distinct = pre_tokens(held)
                at = np.asarray(pc.fill_null(pc.index_in(distinct, value_set=known.cast(distinct.type)), -1)).astype(np.int64)
                per = np.where(at >= 0, np.append(sizes, 0)[at], 0)[codes]
                np.add.at(total, where, np.diff(np.concatenate([[0], np.cumsum(per)])[bounds]))
                left = np.flatnonzero(at[codes] < 0)
                # the other pre-tokens of each piece of text, once each
                pairs, n = np.unique((np.searchsorted(bounds, left, "right") - 1) * max(1, len(distinct)) + codes[left], return_counts=True)
                of.append(where[pairs // max(1, len(distinct))])
                lacking.append(distinct.take(pa.array(pairs % max(1, len(distinct)))).cast(pa.string()))
                times.append(n)
            rest = pa.StructArray.from_arrays([pa.concat_arrays(lacking), pa.array(np.concatenate(times), pa.int32())], fields=list(rest_type))
            lists = pa.ListArray.from_arrays(pa.array(np.searchsorted(np.concatenate(of), np.arange(len(texts) + 1)), pa.int32()), rest)
            rows = row + np.arange(len(texts))
            row += len(texts)
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(rows), pa.array(list(map(len, texts)), pa.int64()), pa.array(total, pa.int64()), lists], [id_col, "row", "n_bytes", "known", "rest"])

    counted = materialize(docs.mapInArrow(count, f"`{id_col}` {id_type}, row bigint, n_bytes bigint, known bigint, rest array<struct<piece:string,n:int>>"), "counted")
    rest = counted.select("row", F.inline("rest")).withColumnRenamed("n", "times")
    sums = rest.join(pieces.select("piece", "k"), "piece").groupBy("row").agg(F.sum(F.col("times") * F.col("k")).alias("more"))
    out = counted.select(id_col, F.col("row").alias("own_row"), "n_bytes", "known").join(sums, F.col("own_row") == F.col("row"), "left")
    return out.select(id_col, "n_bytes", (F.col("known") + F.coalesce("more", F.lit(0))).alias("n_tokens")).withColumn("over_limit", F.col("n_tokens") > limit)


def _whole(docs: DataFrame, vocabulary_path: str, id_col: str, id_type: str) -> DataFrame:
    def run(batches):
        vocab = vocabulary(vocabulary_path)
        for own, (texts,) in slices(batches, STRETCH, 1):
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(list(map(len, texts)), pa.int64()), pa.array(vocab.counts(texts), pa.int64())], [id_col, "n_bytes", "n_tokens"])

    return docs.mapInArrow(run, f"`{id_col}` {id_type}, n_bytes bigint, n_tokens bigint")
