"""Scores of references, related edges and discovered selectors."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lumigraph.functions.text import ascii_lower, subsequence_ratio

# Weights of edge types, and names of little or no signal.
EDGE_WEIGHTS = {"calls": 2.5, "depends_on": 2.2, "imports": 2.0, "defines": 1.8, "references": 1.2, "names": 0.8, "contains": 0.6}
LOW_SIGNAL_NAMES = ("Ok", "Err", "Some", "None", "Result", "Option", "String", "Vec", "Box", "Self", "self")
STANDARD_NAMES = ("string", "str", "vec", "box", "result", "option", "path", "pathbuf", "hashmap", "hashset", "usize", "u64", "i64", "bool")
SAME_FILE_BONUS = 0.35


def reference_score(edge_type: Column, defined_here: Column) -> Column:
    return F.when(edge_type == "calls", 2.0).otherwise(1.0) + F.when(defined_here, SAME_FILE_BONUS).otherwise(0.0)


def reference_why(edge_type: Column, defined_here: Column) -> Column:
    return F.concat(F.lit("edge_type="), edge_type, F.when(defined_here, ",same_file_as_definition").otherwise(""))


def low_signal(name: Column) -> Column:
    return name.isin(*LOW_SIGNAL_NAMES)


def project_local(name: Column) -> Column:
    return ~low_signal(name) & (F.octet_length(name) > 2) & ~ascii_lower(name).isin(*STANDARD_NAMES)


def edge_score(edge_type: Column, direction: Column, depth: Column, entity_type: Column, name: Column, prefer_project: bool) -> Column:
    weight = F.lit(1.0)
    for kind, value in EDGE_WEIGHTS.items():
        weight = F.when(edge_type == kind, value).otherwise(weight)
    of_name = F.when(low_signal(name), -1.3).otherwise(F.when(project_local(name), 0.35).otherwise(0.0) if prefer_project else F.lit(0.0))
    score = weight + F.when(direction == "outgoing", 0.2).otherwise(0.0) - (depth.cast("double") - 1.0) * 0.25 + F.when(entity_type == "symbol_name", of_name).otherwise(0.0)
    return F.greatest(F.lit(0.0), score)


def type_rank(entity_type: Column, order: tuple[str, ...], other: int) -> Column:
    """Position in order; other for types that it does not name. Three orders are in use, on purpose."""
    rank = F.lit(other)
    for i, kind in enumerate(order):
        rank = F.when(entity_type == kind, i).otherwise(rank)
    return rank


RESULT_ORDER = (("symbol", "symbol_name", "file", "module"), 9)
FETCH_ORDER = (("file", "symbol_name", "symbol", "module"), 9)
LOOKUP_ORDER = (("symbol", "symbol_name", "file"), 3)


def discovery_score(entity_type: Column, key: Column, name: Column, path: Column, query: str, tokens: list[str], fuzzy: bool) -> Column:
    """query is trimmed and lower-cased; the empty one ranks by type alone."""
    rank = type_rank(entity_type, *RESULT_ORDER)
    if not query:
        return (F.lit(10) - rank).cast("double")
    key, name, path = ascii_lower(key), ascii_lower(name), ascii_lower(F.replace(F.coalesce(path, F.lit("")), F.lit("\\"), F.lit("/")))
    q = F.lit(query)
    worth = [(name == q, 120.0), (key == q, 120.0), (F.startswith(name, q), 70.0), (F.startswith(key, q), 60.0), (F.contains(name, q), 50.0), (F.contains(key, q), 40.0), (F.contains(path, q), 32.0)]
    for t in tokens:
        worth += [(F.contains(name, F.lit(t)), 10.0), (F.contains(key, F.lit(t)), 8.0), (F.contains(path, F.lit(t)), 6.0)]
    score = F.lit(0.0)
    for test, value in worth:
        score = score + F.when(test, value).otherwise(0.0)
    if fuzzy:
        score = score + F.greatest(*[subsequence_ratio(query, x) for x in (name, key, path)]) * 25.0
    return score + F.greatest(F.lit(10) - rank, F.lit(0)).cast("double") * 0.2
