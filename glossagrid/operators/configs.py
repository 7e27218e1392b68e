"""Run configurations: nested documents to key/value rows, drift, variants, coverage.

A value is JSON text, so `"1"`, `1` and `true` stay apart; a key that is not there
has no row, which is written <absent> in reports.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping, Sequence
from decimal import Decimal
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..constants import (
    CONFIG_DEFAULTS, CONFIG_IGNORED, CONFIG_RENAMES, CONFIG_SECTIONS, LENGTH_GROUPING_KEY, PACKED_ARGS_KEY,
)
from ..functions.joins import match_keys
from ..session import settle, spread
from .ranking import position

ABSENT = "<absent>"


def _unquoted(value: Column) -> Column:
    return F.when(value.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"])


class _Number(str):
    """A number as the document writes it."""


def _scientific(value: float) -> str:
    """A double as Java writes it."""
    if value == 0 or 1e-3 <= abs(value) < 1e7:
        return repr(value) if "e" not in repr(value) else format(Decimal(repr(value)), "f")
    scaled = Decimal(repr(value)).normalize()
    sign, figures, _ = scaled.as_tuple()
    whole = "".join(map(str, figures))
    return f"{'-' * sign}{whole[0]}.{whole[1:] or '0'}E{scaled.adjusted()}"


def _number(text: str, alone: bool) -> str:
    """Decimals without needless zeros; alone, one without fraction keeps its point, so 0.0 and 0 stay apart."""
    if len(text) < 19 and text.isdigit():
        return str(int(text))
    figures = sum(c.isdigit() for c in text)
    if "e" in text or "E" in text or "." in text and figures > 38 or figures > 39:
        return _scientific(float(text))
    if "." not in text:
        return str(int(text))
    plain = format(Decimal(text), "f").rstrip("0").rstrip(".")
    plain = "0" if plain in ("-0", "") else plain
    return plain + ".0" if alone and "." not in plain else plain


_CONSTANTS = {True: "true", False: "false", None: "null"}
_text = json.JSONEncoder(ensure_ascii=False).encode


def _json(value, alone: bool = False) -> str:
    """Compact JSON text with sorted keys."""
    kind = type(value)
    if kind is str:
        return _text(value)
    if kind is _Number:
        return _number(value, alone)
    if kind is dict:
        return "{" + ",".join(f"{_json(k)}:{_json(value[k])}" for k in sorted(value)) + "}"
    if kind is list:
        return "[" + ",".join(map(_json, value)) + "]"
    return _text(value) if kind is float else _CONSTANTS[value]


def _unique(pairs: list) -> dict:
    found = dict(pairs)
    if len(found) < len(pairs):
        raise ValueError("a document names a key twice")
    return found


def _parser() -> Callable[[str], object]:
    """Reads JSON text; one serves many documents, as json.loads with options makes a new one each time."""
    return json.JSONDecoder(parse_int=_Number, parse_float=_Number, object_pairs_hook=_unique).decode


def _walk(text: str | None, depth: int | None, sections: Sequence[str] | None, parse: Callable | None = None) -> list[dict]:
    """The entries of one document: maps open into theirs, all else is a value."""
    if text is None:
        return [] if sections is not None else [{"key": "", "value": None}]
    out, stack = [], [("", (parse or _parser())(text), 0)]
    while stack:
        key, value, level = stack.pop()
        if isinstance(value, dict) and value:
            if depth is not None and level >= depth:
                raise ValueError(f"document nested too deep at {key}")
            stack += [(f"{key}.{k}" if key else k, v, level + 1) for k, v in value.items() if level or sections is None or k in sections]
        elif level or sections is None:
            out.append({"key": key, "value": _json(value, True)})
    return out


def flatten_documents(docs: DataFrame, *, ids: Sequence[str], document: str = "doc", depth: int | None = None,
                      sections: Sequence[str] | None = None) -> DataFrame:
    """(ids, key, value) rows of nested JSON documents; keys are dotted paths.

    Lists and empty maps are values. Each document is walked once, to any depth; maps nested deeper than a
    given `depth` fail the job, as does a key that a map names twice. With `sections` other
    top-level keys are left out. A null document is one row without key and value.
    """
    chosen = None if sections is None else list(sections)

    @F.arrow_udf("array<struct<key:string,value:string>>")
    def walk(texts: pa.Array) -> pa.Array:
        parse = _parser()
        found = [_walk(t, depth, chosen, parse) for t in texts.to_pylist()]
        ends = pa.array([0, *accumulate(map(len, found))], pa.int32())
        columns = [pa.array([e[c] for entries in found for e in entries], pa.string()) for c in ("key", "value")]
        return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays(columns, ["key", "value"]))

    spread_docs = spread(docs.select(*ids, F.col(document).alias("_doc")))
    return spread_docs.select(*ids, F.explode(walk("_doc")).alias("e")).select(*ids, "e.key", "e.value")


def _prefix(*names: str) -> str:
    """Pattern of keys that are one of the names or lie below one."""
    return r"^(?:" + "|".join(n.replace(".", r"\.") for n in names) + r")(?=\.|$)"


def config_view(flat: DataFrame, *, ids: Sequence[str]) -> DataFrame:
    """Flattened rows in today's terms: known sections, new names, unpacked arguments."""
    key, value = F.col("key"), F.col("value")
    rows = flat.where(key.rlike(_prefix(*CONFIG_SECTIONS)))
    renamed = key
    for old, new in CONFIG_RENAMES.items():
        renamed = F.regexp_replace(renamed, _prefix(old), new)
    renamed = F.when(key.rlike(_prefix(*CONFIG_RENAMES)), renamed).otherwise(key)
    rows = rows.withColumn("key", renamed).where(~key.rlike(_prefix(*CONFIG_IGNORED)))
    old, new = LENGTH_GROUPING_KEY
    unset = value.isin("false", "null", "0", "0.0", '""')
    rows = rows.withColumns({
        "value": F.when((key == "mode") & value.startswith('"'), F.lower(value))
        .when((key == old) & unset, F.lit("null")).when(key == old, F.lit('"group_by_length"')).otherwise(value),
        "key": F.when(key == old, F.lit(new)).otherwise(key)})
    # "k=v, k=v" text becomes one row per key.
    packed = (key == PACKED_ARGS_KEY) & value.startswith('"')
    part = F.transform(F.split(_unquoted(value), ","), lambda p: F.split(F.trim(p), "="))
    word = {"None": "null", "True": "true", "False": "false"}
    words = F.create_map(*[F.lit(x) for pair in word.items() for x in pair])
    opened = F.transform(part, lambda p: F.struct(
        F.concat(key, F.lit("."), p[0]).alias("key"),
        F.coalesce(F.try_element_at(words, p[1]), p[1].cast("double").cast("string")).alias("value")))
    kept = F.array(F.struct(key.alias("key"), value.alias("value")))
    return rows.select(*ids, F.explode(F.when(packed, opened).otherwise(kept)).alias("e")).select(*ids, "e.*")


def same_value(key: Column, a: Column, b: Column) -> Column:
    """Whether two values mean the same: numbers by size, booleans by identity,
    an absent key as null, and for listed keys as the library default."""
    boolean = a.isin("true", "false") | b.isin("true", "false")
    number_a = F.coalesce(_unquoted(a), a).try_cast("double")
    number_b = F.coalesce(_unquoted(b), b).try_cast("double")
    plain = F.when(number_a.isNotNull() & number_b.isNotNull(), number_a == number_b).otherwise(a == b)
    lone = F.coalesce(a, b)
    default = F.lit(False)
    for name, value in CONFIG_DEFAULTS.items():
        default = default | ((key == name) & (lone == value))
    return F.when(a.isNull() | b.isNull(), (lone == "null") | default).when(boolean, a == b).otherwise(plain)


def config_diff(ran: DataFrame, unit: DataFrame, *, ids: Sequence[str] = ("run",)) -> DataFrame:
    """Keys where a run differs from its unit, with the value that ran."""
    both = ran.withColumnRenamed("value", "ran").join(
        unit.withColumnRenamed("value", "unit"), [*ids, "key"], "full_outer")
    differs = ~same_value(F.col("key"), F.col("ran"), F.col("unit"))
    return both.where(differs).select(*ids, "key", F.coalesce("ran", F.lit(ABSENT)).alias("ran"))


def overlay(layers: Sequence[DataFrame], *, ids: Sequence[str] = ("run",)) -> DataFrame:
    """Key/value rows laid over each other; the first layer that has a key wins.

    A value of <absent> sets the key to null.
    """
    ranked = [f.select(*ids, "key", F.struct(F.lit(i).alias("i"), F.col("value").alias("v")).alias("e"))
              for i, f in enumerate(layers)]
    rows = ranked[0]
    for f in ranked[1:]:
        rows = rows.unionByName(f)
    top = F.min("e")["v"]
    return rows.groupBy(*ids, "key").agg(F.when(top == ABSENT, "null").otherwise(top).alias("value"))


def config_variants(runs: DataFrame, drift: DataFrame, *, run: str = "run", method: str = "method",
                    fold: str = "fold") -> DataFrame:
    """Recipes per method: runs with equal drift, numbered by first appearance.

    `most_common` marks the recipe that never-run entries take.
    """
    # The keys in which one run differs.
    signed = signatures(drift, run)
    recipes = runs.join(signed, run, "left").withColumn("signature", F.coalesce("signature", F.lit("")))
    variants = recipes.groupBy(method, "signature").agg(
        F.min(run).alias("first_run"), F.count(F.lit(1)).alias("n_runs"),
        F.array_join(F.array_sort(F.collect_set(fold)), ",").alias("folds"))
    numbered = position(settle(variants), ["first_run"], group=[method], rank="_v")
    top = numbered.groupBy(method).agg(F.max_by("_v", F.struct("n_runs", -F.col("_v"))).alias("_top"))
    return numbered.join(top, method).select(
        method, (F.col("_v") + 1).alias("variant"), "first_run", "n_runs", "folds",
        (F.col("_v") == F.col("_top")).alias("most_common"))


def signatures(drift: DataFrame, run: str = "run") -> DataFrame:
    """One digest per run of the keys and values in which it differs."""
    pairs = F.array_sort(F.collect_list(F.struct("key", "ran")))
    return drift.groupBy(run).agg(F.sha2(F.to_json(pairs), 256).alias("signature"))


def config_selfcheck(ran: DataFrame, unit: DataFrame, overrides: DataFrame, snapshot: DataFrame, *,
                     ids: Sequence[str] = ("run",)) -> DataFrame:
    """Keys in which unit + snapshot + overrides still differ from the recorded run."""
    rebuilt = overlay([overrides, snapshot.withColumnRenamed("ran", "value"), unit], ids=ids)
    return config_diff(ran, rebuilt, ids=ids)


def expand_matrix(matrix: DataFrame, dispatched: DataFrame, *, fold: str = "fold", pinned: str = "pinned_fold") -> DataFrame:
    """Expected cells: every entry on every dispatched (source, fold), but entries
    pinned to a fold only there.

    What was dispatched is one small set, so it travels as one array.
    """
    columns = dispatched.columns
    places = dispatched.agg(F.collect_set(F.struct(*columns))).scalar()
    fits = F.filter(F.col("_places"), lambda p: F.col(pinned).isNull() | (p[fold] == F.col(pinned)))
    return matrix.withColumn("_places", places).withColumn("_p", F.explode(fits)).select(
        *[c for c in matrix.columns if c != pinned], "_p.*")


def axes_product(rows: DataFrame, axes: Sequence[str]) -> DataFrame:
    """All combinations of the values seen on each axis (each a short list)."""
    sets = rows.agg(*[F.collect_set(a).alias(a) for a in axes])
    for i, a in enumerate(axes):
        sets = sets.withColumn(a, F.explode(a))
        if i < len(axes) - 1:
            # One row so far: the product is opened on all cores.
            sets = sets.repartition(rows.sparkSession.sparkContext.defaultParallelism, *axes[:i + 1])
    return sets


def grid_coverage(expected: DataFrame, runs: DataFrame, *, cell: Sequence[str], recipe: str = "recipe",
                  method: str = "method") -> DataFrame:
    """Cells that are missing, extra, or ran with several recipes.

    A missing cell is offered the most common recipe of its method.
    """
    # Runs are counted once per cell and recipe; both summaries start from there.
    per_recipe = runs.groupBy(*cell, recipe).agg(F.count(F.lit(1)).alias("k"))
    ran = per_recipe.groupBy(*cell).agg(F.sum("k").alias("n_runs"), F.count(recipe).alias("n_recipes"))
    counts = per_recipe.groupBy(method, recipe).agg(F.sum("k").alias("k"))
    usual = counts.groupBy(method).agg(F.max_by(recipe, F.struct("k", recipe)).alias("usual_recipe"))
    # Unfolded runs have a null fold, which matches a null fold.
    both = match_keys(expected.select(*cell).distinct().withColumn("_e", F.lit(True)), ran, cell, "full_outer")
    status = (
        F.when(F.col("n_runs").isNull(), "missing").when(F.col("_e").isNull(), "extra")
        .when(F.col("n_recipes") > 1, "several_recipes"))
    found = both.withColumn("status", status).where(F.col("status").isNotNull())
    return found.join(usual, method, "left").select(
        *cell, "status", F.coalesce("n_runs", F.lit(0)).alias("n_runs"),
        F.when(F.col("status") == "missing", F.col("usual_recipe")).alias("usual_recipe"))


def join_tracking(runs: DataFrame, log: DataFrame, *, key: str = "uuid4", order: Sequence[str] = ("path",)) -> DataFrame:
    """Runs with the first log record of their id; unmatched runs carry a problem."""
    fields = [c for c in log.columns if c != key]
    first = log.groupBy(key).agg(F.min_by(F.struct(*fields), F.struct(*order)).alias("_log"))
    joined = runs.join(first, key, "left")
    return joined.select(*runs.columns, "_log.*", F.when(
        F.col("_log").isNull(), F.lit("no tracking record")).alias("problem"))


def overrides_rows(entries: DataFrame, *, ids: Sequence[str] = ("run",), overrides: str = "overrides") -> DataFrame:
    """Entry overrides (map of dotted key to JSON text) as key/value rows."""
    return entries.select(*ids, F.explode(overrides).alias("key", "value"))


def encode(values: Mapping[str, Column]) -> Column:
    """Columns as one JSON document; null columns leave their key out."""
    return F.to_json(F.struct(*[c.alias(k) for k, c in values.items()]))
