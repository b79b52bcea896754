"""From raw documents to token files: toxic documents go, one of each group of near copies stays, documents that
hold benchmark items go, sources are mixed to their targets, and what is left is written as token ids.

A stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the
columns of documents; the last returns, per document of the mix, what the token files hold.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumigraph.llm.common import materialize, read_table
from lumigraph.llm.decontamination import drop_contaminated
from lumigraph.llm.mixing import mix
from lumigraph.llm.near_dup import drop_near_duplicates
from lumigraph.llm.queries import token_digests
from lumigraph.llm.toxicity import drop_toxic


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row goes or stays by its own text: null and empty texts, null and repeated ids, repeated rows alike.
    Without labels, or with labels of one class, all stay. The empty table stays empty."""
    return drop_toxic(docs, read_table(spark, sf_dir, "labels"))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the row with the least id stays; a row that repeats its id and text stays once,
    rows of one id with different texts each stay. Rows without id or without words are in no group and stay."""
    return drop_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each row goes or stays by its own text, whatever its id. Null and empty texts, and all where the benchmark is empty, stay."""
    return drop_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document stands as often as the mix takes it; one that it does not take goes. Rows of one id, and those
    without id, share their fate; a text without words adds nothing to a size. A null source is a source."""
    copies = mix(docs).select(F.col("doc_id").alias("mixed"), "copies").groupBy("mixed").agg(F.max("copies").alias("copies")).where("copies > 0")
    times = copies.select("mixed", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("time"))
    return docs.join(times, docs["doc_id"].eqNullSafe(times["mixed"])).select(*[docs[c] for c in docs.columns])


def token_output(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each row of docs, in ascending order of id, null first; rows of one id by their tokens. A null text is the empty one."""
    return token_digests(docs)


STAGES = [
    ("toxicity", toxicity),
    ("near_dedup", near_dedup),
    ("decontamination", decontamination),
    ("mixing", mixing),
    ("token_output", token_output),
]

# Scores, kernels and tokenizers have no SQL; tests hold each stage and the whole against plain versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, name)
    return docs
