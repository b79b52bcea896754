"""Repositories on disk or in an object store as DataFrames of files."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

STATE_DIR = ".lumigraph"
# Folders that are never read, files that are read whatever their extension, and languages by extension.
IGNORED_DIRS = (".git", "target", "node_modules", "dist", "build", "venv", ".venv", "__pycache__", ".mypy_cache", ".pytest_cache", STATE_DIR)
CONFIG_FILES = {
    "Cargo.toml": "rust", "pyproject.toml": "python", "setup.cfg": "python", "requirements.txt": "python", "Pipfile": "python", "package.json": "javascript", "tsconfig.json": "typescript",
    "go.mod": "go", "build.gradle": "kotlin", "build.gradle.kts": "kotlin", "pom.xml": "java", "Gemfile": "ruby", "composer.json": "json", "renv.lock": "json",
}
EXTENSIONS = {
    "bash": "sh bash zsh", "c": "c h", "cpp": "cpp cc cxx hpp hxx hh", "csharp": "cs", "css": "css", "elixir": "ex exs", "go": "go", "haskell": "hs lhs", "html": "html htm", "java": "java", "javascript": "js jsx mjs cjs", "json": "json",
    "kotlin": "kt kts", "lua": "lua", "python": "py pyi", "ruby": "rb", "rust": "rs", "scala": "scala sc", "swift": "swift", "toml": "toml", "tsx": "tsx", "typescript": "ts mts cts", "yaml": "yml yaml",
}
CONFIG_ENDINGS = ("cargo.toml", "pyproject.toml", "setup.cfg", "package.json")
ENTRYPOINT_ENDINGS = ("/src/main.rs", "/src/lib.rs", "/__main__.py")


def _lookup(key: Column, pairs: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for pair in pairs.items() for x in pair]), key)


def language_of(path: Column) -> Column:
    """By extension, whatever its case; null where none is known."""
    by = {e: lang for lang, es in EXTENSIONS.items() for e in es.split()}
    return _lookup(F.lower(F.regexp_extract(path, r"[^/]\.([^./]+)$", 1)), by)


def file_language(path: Column) -> Column:
    """As a file to index: by its whole name if that is a known configuration file, else by extension."""
    return F.coalesce(_lookup(F.regexp_extract(path, r"([^/]*)$", 1), CONFIG_FILES), language_of(path))


def special_type(path: Column) -> Column:
    """config, entrypoint or null, by how the path ends."""
    low = F.lower(F.replace(path, F.lit("\\"), F.lit("/")))
    ends = lambda names: F.greatest(*[F.endswith(low, F.lit(n)) for n in names])
    return F.when(ends(CONFIG_ENDINGS), "config").when(ends(ENTRYPOINT_ENDINGS), "entrypoint")


def ignored(path: Column) -> Column:
    """Whether any folder of a path within a repository is an ignored one."""
    return F.exists(F.slice(F.split(path, "/"), F.lit(1), F.greatest(F.size(F.split(path, "/")) - 1, F.lit(0))), lambda p: p.isin(*IGNORED_DIRS))


def find_root(start: str) -> str:
    """The nearest folder upward that holds .git, else start."""
    at = os.path.realpath(start)
    while not os.path.exists(os.path.join(at, ".git")):
        if os.path.dirname(at) == at:
            return os.path.realpath(start)
        at = os.path.dirname(at)
    return at


def scan(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(files, errors) of a repository: files (path, lang, content_hash, size_bytes, indexed_at, content), errors (path, error).

    Executors list and read; ignored folders and unknown kinds are dropped before content is read from the
    row. A file that is not UTF-8 is an error.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    plain = os.path.realpath(root) if "://" not in root and os.path.exists(root) else root
    bare = F.regexp_replace("path", r"^[a-z0-9+.-]+:/+", "/")
    prefix = ("/" + plain.split("://", 1)[1].split("/", 1)[-1] if "://" in plain and not plain.startswith("file") else plain.removeprefix("file://")).rstrip("/") + "/"
    rows = raw.select(F.regexp_replace(bare, f"^.*?{_quoted(prefix)}", "").alias("path"), "content", "length", "modificationTime")
    rows = rows.withColumn("lang", file_language(F.col("path"))).where(F.col("lang").isNotNull() & ~ignored(F.col("path")))
    good = F.is_valid_utf8(F.col("content").cast("string"))
    files = rows.where(good).select("path", "lang", F.sha2("content", 256).alias("content_hash"), F.col("length").alias("size_bytes"), F.current_timestamp().alias("indexed_at"), F.col("content").cast("string").alias("content"))
    return files, rows.where(~good).select("path", F.lit("content is not valid UTF-8").alias("error"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"
