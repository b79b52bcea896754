"""The tables of a code graph, and the frame that holds them together."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

FILES = "path string, lang string, content_hash string, size_bytes bigint, indexed_at timestamp"
ENTITIES = "entity_type string, key string, name string, lang string, file_path string, line bigint, col bigint, end_line bigint, end_col bigint, kind string, qualname string"
EDGES = "src_key string, dst_key string, edge_type string, file_path string, line bigint, col bigint, end_line bigint, end_col bigint"
FINGERPRINTS = "file_path string, fp_hash bigint, span_start bigint, span_end bigint"
SCHEMA_VERSION = "1"

# Entity types and edge types of the graph.
ENTITY_TYPES = ("file", "symbol", "symbol_name", "module", "config", "entrypoint")
EDGE_TYPES = ("defines", "names", "calls", "references", "imports", "resolves_to", "depends_on", "contains")


@dataclass
class Graph:
    """files, entities, edges and fingerprints as DataFrames. Entities are named by key; edges join keys.

    errors (path, error) are those that parsing the files just met, where it did."""

    files: DataFrame
    entities: DataFrame
    edges: DataFrame
    fingerprints: DataFrame | None = None
    errors: DataFrame | None = None
