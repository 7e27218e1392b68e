"""Language groups as (group, lang, ord) rows, and filters by language set."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from ..constants import SEEN_GROUP_OF_BACKBONE, SOURCE_GROUPS
from ..functions.checks import DataProblem, refuse

Langs = Iterable[str] | DataFrame


def published_groups(spark: SparkSession) -> DataFrame:
    """The stated source groups; add measured ones with `unionByName`."""
    rows = [(g, lang, i) for g, langs in SOURCE_GROUPS.items() for i, lang in enumerate(langs)]
    return spark.createDataFrame(rows, "group string, lang string, ord int")


def present(groups: DataFrame, name: str) -> DataFrame:
    """Languages of a group that must exist: an absent or empty one would mark every language unseen."""
    found = langs_of(groups, name)
    if found.isEmpty():
        raise DataProblem(f"group {name!r} has no languages; add it to the groups (see groups_from_dimension)")
    return found


def langs_of(groups: DataFrame, name: str) -> DataFrame:
    return groups.where(F.col("group") == name).select("lang").distinct()


def seen_langs_of(groups: DataFrame, backbone: str) -> DataFrame:
    """Languages a backbone saw in pretraining; an unknown backbone or an absent group is an error."""
    if backbone not in SEEN_GROUP_OF_BACKBONE:
        raise DataProblem(f"backbone {backbone!r} has no group of seen languages, only {sorted(SEEN_GROUP_OF_BACKBONE)} have")
    return present(groups, SEEN_GROUP_OF_BACKBONE[backbone])


def low_langs_of(low_groups: DataFrame, backbone: str) -> DataFrame:
    """Low-performing languages of a backbone; empty where none are listed."""
    return langs_of(low_groups, backbone)


def groups_from_dimension(dimension: DataFrame, names: Mapping[str, str] | None = None) -> DataFrame:
    """Groups a language dimension (code, class, xlmr, low_perf) implies.

    `names` renames them, for example {"seen": "xlmr_seen"} for the backbone they hold for.
    """
    names = names or {}
    tests = {
        names.get("class5", "class5"): F.col("class") == 5,
        names.get("seen", "seen"): F.col("xlmr") == 1,
        names.get("low_perf", "low_perf"): F.col("low_perf") == 1,
    }
    implied = F.array(*[F.when(ok, F.lit(name)) for name, ok in tests.items()])
    rows = dimension.select(
        F.explode(F.filter(implied, lambda g: g.isNotNull())).alias("group"), F.col("code").alias("lang"))
    # A group holds language codes, so its size is bounded by the dimension.
    order = W.partitionBy("group").orderBy("lang")
    return rows.select("group", "lang", (F.row_number().over(order) - 1).alias("ord"))


def dimension_summary(dimension: DataFrame) -> DataFrame:
    """Language counts by class, family and region, and of each implied group."""
    tall = dimension.select("code", F.expr(
        "stack(3, 'class', cast(class as string), 'family', family, 'region', region)"
    ).alias("axis", "value"))
    implied = groups_from_dimension(dimension).select(
        F.col("lang").alias("code"), F.lit("group").alias("axis"), F.col("group").alias("value"))
    return tall.unionByName(implied).where(F.col("value").isNotNull()).groupBy("axis", "value").agg(
        F.count(F.lit(1)).alias("n_langs"))


def _in(column: Column, langs: Iterable[str]) -> Column:
    return column.isin(sorted(set(langs)))


def restrict_langs(df: DataFrame, langs: Langs, column: str = "target_lang") -> DataFrame:
    """Rows whose language is in the set."""
    if isinstance(langs, DataFrame):
        return df.join(langs.select(F.col("lang").alias(column)), column, "left_semi")
    return df.where(_in(F.col(column), langs))


def exclude_langs(df: DataFrame, langs: Langs | None, column: str = "target_lang") -> DataFrame:
    """Rows whose language is not in the set."""
    if langs is None:
        return df
    if isinstance(langs, DataFrame):
        return df.join(langs.select(F.col("lang").alias(column)), column, "left_anti")
    return df.where(~_in(F.col(column), langs))


def known_languages(df: DataFrame, dimension: DataFrame, column: str = "lang", strict: bool = True) -> DataFrame:
    """Rows of known codes; `.zip` codes drop out, any other unknown code is an error."""
    known = dimension.select(F.col("code").alias(column))
    if strict:
        unknown = df.select(column).distinct().where(~F.col(column).endswith(".zip")).join(
            known, column, "left_anti")
        refuse(unknown, "codes not in the language dimension")
    return df.join(known, column, "left_semi")


def source_sizes(groups: DataFrame) -> DataFrame:
    return groups.groupBy(F.col("group").alias("source_group")).agg(F.count(F.lit(1)).alias("n_sources"))


def group_algebra(groups: DataFrame, left: str, right: str) -> DataFrame:
    """Intersection and both differences of two groups, as (part, lang)."""
    side = groups.where(F.col("group").isin(left, right)).groupBy("lang").agg(
        F.max(F.col("group") == left).alias("in_left"), F.max(F.col("group") == right).alias("in_right"))
    part = (
        F.when(F.col("in_left") & F.col("in_right"), "both")
        .when(F.col("in_left"), "left_only").otherwise("right_only")
    )
    return side.select(part.alias("part"), "lang")


def group_problems(groups: DataFrame, disjoint: Iterable[tuple[str, str]] = (), code_pattern: str = r"^[a-z]{3}_[A-Z][a-z]{3}$") -> DataFrame:
    """Duplicate members, malformed codes and members shared by groups that must be disjoint."""
    doubled = groups.groupBy("group", "lang").count().where("count > 1").select(
        F.lit("duplicate").alias("problem"), "group", "lang")
    odd = groups.where(~F.col("lang").rlike(code_pattern)).select(F.lit("code").alias("problem"), "group", "lang")
    found = doubled.unionByName(odd)
    for left, right in disjoint:
        shared = group_algebra(groups, left, right).where("part = 'both'").select(
            F.lit("overlap").alias("problem"), F.lit(f"{left}&{right}").alias("group"), "lang")
        found = found.unionByName(shared)
    return found.distinct()
