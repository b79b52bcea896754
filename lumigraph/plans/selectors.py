"""Selectors: what callers write to name an entity."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumigraph.functions.scores import LOOKUP_ORDER, RESULT_ORDER, type_rank
from lumigraph.schema import Graph

LOOKUP_LIMIT = 32


@dataclass(frozen=True)
class Selector:
    """kind is auto, file, symbol_name, name or key."""

    kind: str
    value: str
    lang: str | None = None


def parse_selector(text: str) -> Selector:
    """file:<path>, symbol_name:<lang>:<name>, symbol:<name>, key:<key>, module:... (a key), else auto. Empty parts are errors."""
    text = text.strip()
    if not text:
        raise ValueError("a selector must not be empty")
    head, _, rest = text.partition(":")
    rest = rest.strip()
    if head in ("file", "symbol_name", "symbol", "key", "module") and ":" in text and not rest:
        raise ValueError(f"{head}: needs a value")
    if head == "file" and rest:
        return Selector("file", rest.replace("\\", "/"))
    if head == "symbol_name" and rest:
        lang, mark, name = rest.partition(":")
        if not (mark and lang.strip() and name.strip()):
            raise ValueError("symbol_name: needs <lang>:<name>")
        return Selector("symbol_name", name.strip(), lang.strip())
    if head == "symbol" and rest:
        return Selector("name", rest)
    if head == "key" and rest:
        return Selector("key", rest)
    if head == "module" and rest:
        return Selector("key", text)
    return Selector("auto", text)


def _by_name(entities: DataFrame, name: str) -> DataFrame:
    return entities.where(F.col("name") == name).orderBy(type_rank(F.col("entity_type"), *LOOKUP_ORDER), "file_path", "line", "key").limit(LOOKUP_LIMIT)


def resolve_selector(graph: Graph, text: str) -> DataFrame:
    """The one entity that a selector names, or none: of several candidates the first by type, then key."""
    selector, entities = parse_selector(text), graph.entities
    if selector.kind == "file":
        found = entities.where(F.col("key") == f"file:{selector.value}")
    elif selector.kind == "symbol_name":
        found = entities.where(F.col("key") == f"symbol_name:{selector.lang}:{selector.value}")
    elif selector.kind == "key":
        found = entities.where(F.col("key") == selector.value)
    elif selector.kind == "name":
        found = _by_name(entities, selector.value)
    else:
        path = selector.value.replace("\\", "/")
        found = entities.where(F.col("key").isin(selector.value, f"file:{path}")).unionByName(_by_name(entities, selector.value)).dropDuplicates(["key"])
    return found.orderBy(type_rank(F.col("entity_type"), *RESULT_ORDER), "key").limit(1)


def describe_selector(graph: Graph, text: str) -> DataFrame:
    """One row: selector, parsed_as, matched, selected_key."""
    kind = {"name": "symbol"}.get(parse_selector(text).kind, parse_selector(text).kind)
    found = resolve_selector(graph, text).agg(F.first("key").alias("selected_key"))
    return found.select(F.lit(text).alias("selector"), F.lit(kind).alias("parsed_as"), F.col("selected_key").isNotNull().alias("matched"), "selected_key")
