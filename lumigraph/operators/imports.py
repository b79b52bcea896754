"""Where imports lead: candidate paths in order of preference, then the first that exists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lumigraph.functions.text import let, parent_dir


def import_candidates(lang: Column, module: Column, path: Column) -> Column:
    """array<string> of paths that a module may be, best first; empty for languages that are not resolved.

    Python: a/b.py, then a/b/__init__.py. Rust: without braces, renamings and leading crate, self or super,
    the longest prefix first, each as src/<prefix>.rs and src/<prefix>/mod.rs; at last a sibling file of the
    module's last part.
    """
    bare = F.regexp_replace(F.trim(module), r"^\{+|\}+$", "")
    python = F.replace(bare, F.lit("."), F.lit("/"))
    none = F.array().cast("array<string>")
    python_paths = F.when(python == "", none).otherwise(F.array(F.concat(python, F.lit(".py")), F.concat(python, F.lit("/__init__.py"))))
    stem = F.regexp_replace(F.trim(F.regexp_extract(F.regexp_extract(bare, r"(?s)^([^{]*)", 1), r"(?s)^(.*?)(?: as |$)", 1)), r"(::)+$", "")
    parts = F.filter(F.transform(F.split(stem, "::"), F.trim), lambda p: p != "")
    # leading crate, self and super: what follows the first part that is none of them
    named = lambda ps: F.transform(ps, lambda p: ~p.isin("crate", "self", "super"))
    own = let(parts, lambda ps: F.slice(ps, F.when(F.exists(named(ps), lambda x: x), F.array_position(named(ps), True)).otherwise(F.size(ps) + 1).cast("int"), F.size(ps) + 1))
    paths = let(own, lambda ps: F.flatten(F.transform(F.sequence(F.size(ps), F.lit(1), F.lit(-1)), lambda k: let(F.concat(F.lit("src/"), F.array_join(F.slice(ps, F.lit(1), k), "/")), lambda p: F.array(F.concat(p, F.lit(".rs")), F.concat(p, F.lit("/mod.rs")))))))
    folder = parent_dir(path)
    sibling = F.concat(F.when(folder == "", "").otherwise(F.concat(folder, F.lit("/"))), F.element_at(F.split(bare, "::"), -1), F.lit(".rs"))
    rust = F.concat(F.when(F.size(own) == 0, none).otherwise(paths), F.array(sibling))
    return F.when(bare == "", none).when(lang == "python", python_paths).when(lang == "rust", rust).otherwise(none)


def resolve_imports(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(path, lang, module, resolved) of imports (path, lang, module): the first candidate that is a file."""
    tried = imports.select("path", "lang", "module").distinct().select("path", "lang", "module", F.posexplode(import_candidates(F.col("lang"), F.col("module"), F.col("path"))).alias("rank", "resolved"))
    found = tried.join(files.select(F.col("path").alias("resolved")), "resolved")
    return found.groupBy("path", "lang", "module").agg(F.min_by("resolved", "rank").alias("resolved"))
