"""Clones: files that share winnowed fingerprints."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.functions.text import parent_dir, winnowed
from lumigraph.plans.paging import page

MIN_SIMILARITY, LIMIT = 0.02, 50


def fingerprint_files(files: DataFrame) -> DataFrame:
    """(file_path, fp_hash, span_start, span_end) of files (path, content); no shuffle."""
    return files.select(F.col("path").alias("file_path"), F.inline(winnowed(F.col("content"))))


def _distinct(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.select("file_path", "fp_hash").distinct()


def clone_candidates(fingerprints: DataFrame, file_path: str) -> DataFrame:
    """(other_file, shared_fingerprints, similarity) of every file that shares a fingerprint with one file.

    similarity is the number shared over the larger of both files' numbers of distinct fingerprints.
    """
    own = _distinct(fingerprints.where(F.col("file_path") == file_path)).select("fp_hash")
    self_count = own.agg(F.count(F.lit(1)).alias("self_count"))
    # one pass over all files: those hashes that the file has are counted beside the total
    marked = _distinct(fingerprints).join(own.withColumn("own", F.lit(1)), "fp_hash", "left")
    others = marked.where(F.col("file_path") != file_path).groupBy(F.col("file_path").alias("other_file")).agg(F.count("own").alias("shared_fingerprints"), F.count(F.lit(1)).alias("total"))
    scored = others.where("shared_fingerprints > 0").join(F.broadcast(self_count))
    return scored.select("other_file", "shared_fingerprints", (F.col("shared_fingerprints") / F.greatest("self_count", "total")).alias("similarity"))


def clone_order() -> list:
    return [F.desc("similarity"), F.desc("shared_fingerprints"), F.col("other_file")]


def clone_matches(fingerprints: DataFrame, file_path: str, min_similarity: float = MIN_SIMILARITY, limit: int = LIMIT, offset: int = 0) -> DataFrame:
    return page(clone_candidates(fingerprints, file_path).where(F.col("similarity") >= min_similarity), clone_order(), limit, offset)


def clone_analysis(fingerprints: DataFrame, file_path: str, min_similarity: float = MIN_SIMILARITY) -> DataFrame:
    """One row that tells why there are as many clones as there are."""
    own = _distinct(fingerprints.where(F.col("file_path") == file_path)).agg(F.count(F.lit(1)).alias("self_fingerprint_count"))
    found = clone_candidates(fingerprints, file_path).agg(
        F.count(F.lit(1)).alias("candidate_files"),
        F.count_if(F.col("similarity") >= min_similarity).alias("surviving_candidates"),
        F.max("similarity").alias("max_candidate_similarity"),
    )
    out = own.join(F.broadcast(found)).withColumn("filtered_by_threshold", F.col("candidate_files") - F.col("surviving_candidates"))
    # The reasons' wording
    too_low = f"all clone candidates were filtered by min_similarity={min_similarity:.3f}; try lowering the threshold"
    reason = F.when(F.col("surviving_candidates") > 0, F.lit(None).cast("string")).when(F.col("candidate_files") == 0, "no overlapping fingerprints with other files").otherwise(too_low)
    return out.withColumn("suggested_min_similarity", F.greatest(F.col("max_candidate_similarity") * 0.9, F.lit(0.0))).withColumn("empty_reason", reason)


def clone_hotspots(fingerprints: DataFrame, file_path: str, min_similarity: float = MIN_SIMILARITY, limit: int = LIMIT, offset: int = 0) -> DataFrame:
    """(directory, files, avg_similarity, max_similarity) over all clones of a file, not a page of them."""
    found = clone_candidates(fingerprints, file_path).where(F.col("similarity") >= min_similarity)
    spots = found.groupBy(parent_dir(F.col("other_file")).alias("directory")).agg(F.count(F.lit(1)).alias("files"), F.avg("similarity").alias("avg_similarity"), F.max("similarity").alias("max_similarity"))
    return page(spots, [F.desc("avg_similarity"), F.desc("files"), F.col("directory")], limit, offset)


def _sets(fingerprints: DataFrame) -> DataFrame:
    return fingerprints.groupBy("file_path").agg(F.sort_array(F.collect_set("fp_hash")).alias("hashes"))


def clone_members(fingerprints: DataFrame) -> DataFrame:
    """(file_path, representative, members), a row for each file: the least path of all files of its fingerprint set, and how many those are.

    All members of a set are clones of similarity 1 of one another, and each has every link that clone_pairs
    gives the representative; so both tables together hold every pair of files without a row for each.
    """
    sets = _sets(fingerprints)
    reps = sets.groupBy("hashes").agg(F.min("file_path").alias("representative"), F.count(F.lit(1)).alias("members"))
    return sets.join(reps, "hashes").select("file_path", "representative", "members")


def clone_pairs(fingerprints: DataFrame, min_similarity: float) -> DataFrame:
    """(file_a, file_b, shared, similarity) of all pairs of files with different fingerprint sets, file_a < file_b.

    Files of one fingerprint set stand for one another: the least path of them is compared, so copies do
    not multiply; clone_members tells which files each stands for. Only hashes among a file's rarest are joined: a pair that reaches min_similarity shares
    one of the first n - ceil(n * min_similarity) + 1 in an order that all files agree on.
    """
    sets = _sets(fingerprints).groupBy("hashes").agg(F.min("file_path").alias("file"))
    each = sets.select("file", F.size("hashes").alias("n"), F.explode("hashes").alias("h"))
    common = each.groupBy("h").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    ranked = each.join(common, "h").groupBy("file", "n").agg(F.sort_array(F.collect_list(F.struct("df", "h"))).alias("xs"))
    # hashes of one file alone come first in the order and can't be shared, so they use up a part of the prefix
    room = F.col("n") - F.ceil(F.col("n") * min_similarity) + 1 - (F.col("n") - F.size("xs"))
    heads = ranked.where(room > 0).select("file", "n", F.explode(F.slice("xs", F.lit(1), F.least(room, F.size("xs")).cast("int"))["h"]).alias("h"))
    a, b = (heads.select(F.col("file").alias(f"file_{x}"), F.col("n").alias(f"n_{x}"), "h") for x in "ab")
    near = (F.col("file_a") < F.col("file_b")) & (F.least("n_a", "n_b") >= F.greatest("n_a", "n_b") * min_similarity)
    pairs = a.join(b, "h").where(near).select("file_a", "n_a", "file_b", "n_b").distinct()
    one, two = (sets.select(F.col("file").alias(f"file_{x}"), F.col("hashes").alias(f"hashes_{x}")) for x in "ab")
    full = pairs.join(one, "file_a").join(two, "file_b").withColumn("shared", F.size(F.array_intersect("hashes_a", "hashes_b")).cast("bigint"))
    return full.withColumn("similarity", F.col("shared") / F.greatest("n_a", "n_b")).where(F.col("similarity") >= min_similarity).select("file_a", "file_b", "shared", "similarity")
