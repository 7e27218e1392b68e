"""Expressions over run names, paths, embedding keys and language codes."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

STAMP = r"^\d{8}_\d{6}_"


def run_label(name: Column) -> Column:
    """Run name without its leading time stamp."""
    return F.regexp_replace(name, STAMP, "")


def method_of_run(name: Column) -> Column:
    return F.element_at(F.split(run_label(name), "_"), 1)


def fold_of_path(path: Column) -> Column:
    """Digit of the `fold<d>` path segment, null without one."""
    return F.regexp_extract(path, r"/fold(\d)/", 1).try_cast("int")


def source_label(source: Column) -> Column:
    """Groups named by role: `<backbone>_high` reads `high-perf`."""
    return F.when(source.endswith("_high"), F.lit("high-perf")).otherwise(source)


def table_path(path: Column) -> Column:
    """Path of a table: part files stand for their folder, `key=` prefixes drop out."""
    return F.regexp_replace(F.regexp_replace(path, r"/part-[^/]*$", ""), r"/[^/=]+=", "/")


def table_folder(path: Column) -> Column:
    """Name of the directory that holds a table."""
    return F.element_at(F.split(path, "/"), -2)


def grid_of(folder: Column) -> Column:
    """`grid` of a `grid.source` folder name."""
    return F.regexp_extract(folder, r"^(.*)\.[^.]+$", 1)


def source_of(folder: Column) -> Column:
    """`source` of a `grid.source` folder name: the last dotted part."""
    return F.element_at(F.split(folder, r"\."), -1)


def embedding_key(repo: Column, group: Column, lang: Column, layer: Column) -> Column:
    return F.concat_ws("@", repo, group, lang, layer)


def lang_of_key(key: Column) -> Column:
    """Language part of `repo@group@lang@layer`: the last part but one."""
    return F.element_at(F.split(key, "@"), -2)


def layer_of_key(key: Column) -> Column:
    return F.element_at(F.split(key, "@"), -1).try_cast("int")


def has_method(key: Column, method: str) -> Column:
    return F.lower(key).contains(f"peft-{method}-")


def script_of(label: Column) -> Column:
    """Four-letter suffix after the last underscore, else the label itself."""
    suffix = F.regexp_extract(label, r"_(\p{L}{4})$", 1)
    return F.when(suffix != "", suffix).otherwise(label)


def vocabulary_script(lang: Column, latin_apart: bool = True) -> Column:
    """Part after the first underscore; Latin languages may stay apart; UNK without one."""
    script = F.regexp_extract(lang, r"(?s)^[^_]*_(.*)$", 1)
    apart = F.lit(latin_apart) & (script == "Latn")
    return F.when(~lang.contains("_"), F.lit("UNK")).when(apart, lang).otherwise(script)
