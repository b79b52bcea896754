"""Finding selectors from parts of names."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.functions.scores import FETCH_ORDER, RESULT_ORDER, discovery_score, type_rank
from lumigraph.functions.text import like_any, path_glob, query_tokens


def discover_selectors(entities: DataFrame, query: str | None = None, entity_type: str | None = None, file_glob: str | None = None, limit: int = 20, fuzzy: bool = True) -> DataFrame:
    """(entity_type, key, name, file_path, line, score): entities for a query, best first.

    Candidates are fetched in a fixed order up to a limit, then scored; without fuzzy the query does not
    narrow the fetch, only the score. A fuzzy query that nothing matches is scored against a wider fetch.
    """
    text = (query or "").strip().translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    tokens, limit = query_tokens(query or ""), max(1, limit)
    scope = entities
    if entity_type is not None:
        scope = scope.where(F.col("entity_type") == entity_type)
    if file_glob is not None:
        scope = scope.where(F.col("file_path").isNull() | path_glob(F.col("file_path"), file_glob))

    def fetch(rows: DataFrame, most: int) -> DataFrame:
        return rows.select("entity_type", "key", "name", "file_path", "line").orderBy(type_rank(F.col("entity_type"), *FETCH_ORDER), "key").limit(most)

    found = scope
    if fuzzy and text:
        found = scope.where(like_any([F.col("key"), F.col("name"), F.col("file_path")], tokens or [text]))
    found = fetch(found, min(8 * limit, 2000))
    if fuzzy and text and found.isEmpty():
        found = fetch(scope, min(200 * limit, 20_000))
    score = discovery_score(F.col("entity_type"), F.col("key"), F.col("name"), F.col("file_path"), text, tokens, fuzzy)
    return found.withColumn("score", score).orderBy(F.desc("score"), type_rank(F.col("entity_type"), *RESULT_ORDER), "key").limit(limit)
