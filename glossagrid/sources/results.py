"""Per-run result files (CSV with a header) to one table, bound by column name."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..constants import LEGACY_RENAMES, RESULT_FILES, RESULT_RENAMES, VALIDATION_FILES
from ..functions.checks import DataProblem, need_columns, null_if_nan, sure
from ..functions.names import grid_of, method_of_run, source_of, table_folder, table_path
from ..session import lookup_side, settle

REQUIRED = ("method", "seed", "target_lang", "accuracy", "n")
ZERO_SHOT_REQUIRED = ("target_lang", "accuracy", "n")
MEASURES = {"seed": "int", "fold": "int", "accuracy": "double", "n": "bigint", "best_val_acc": "double"}


def _decoded(path: Column) -> Column:
    # file_path is URL-encoded, but keeps plus signs as they are
    return F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B")))


def _fields(record: Column) -> Column:
    """Names of a header record; commas inside quotes belong to the name, a doubled quote is one."""
    each = F.regexp_extract_all(F.concat(record, F.lit(",")), F.lit(r'("(?:[^"]|"")*"|[^,]*),'), F.lit(1))
    quoted = r'^"([\s\S]*)"$'
    return F.transform(each, lambda c: F.replace(F.regexp_replace(F.trim(c), quoted, "$1"), F.lit('""'), F.lit('"')))


def read_by_header(spark: SparkSession, path: str, patterns: Sequence[str] = RESULT_FILES) -> DataFrame:
    """All rows of the matching files as text columns, plus path, block and line.

    Spark binds CSV columns by position, so records are read once into numbered
    cells and each file's first record then names them; there is no limit on the number of
    layouts. Quoted line breaks belong to their cell: a file is one run and is
    read by one task. A record with a value beyond its header fails the job. (path, block, line) is the order of rows: later path, later row.
    """
    # Hadoop globs accept alternatives in braces.
    pattern = patterns[0] if len(patterns) == 1 else "{" + ",".join(patterns) + "}"
    options = {"recursiveFileLookup": "true", "pathGlobFilter": pattern}
    first = spark.read.options(**options).text(path).where(F.col("_metadata.file_block_start") == 0).select(
        "value", _decoded(F.col("_metadata.file_path")).alias("path"), F.monotonically_increasing_id().alias("line"))
    first = first.groupBy("path").agg(F.min_by("value", "line").alias("value"))
    named = settle(first.select("path", _fields(F.col("value")).alias("header")))
    widest = named.agg(F.max(F.size("header"))).first()[0]
    if widest is None:
        raise DataProblem(f"nothing named {' / '.join(patterns)} lies under {path}")
    # One column per name over all files; a name a file lacks is null there.
    everything = [r[0] for r in named.select(F.posexplode("header").alias("at", "name")).groupBy("name").agg(
        F.min("at").alias("at")).orderBy("at", "name").select("name").collect()]

    # A cell more than the widest header shows records that are too long.
    schema = ", ".join(f"c{i} string" for i in range(widest + 1))
    cells = spark.read.options(**options).option("multiLine", "true").option("escape", '"').schema(schema).csv(path).select(
        F.array(*[f"c{i}" for i in range(widest + 1)]).alias("cells"), _decoded(F.col("_metadata.file_path")).alias("path"),
        F.lit(0).cast("bigint").alias("block")).withColumn("line", F.monotonically_increasing_id())
    rows = cells.join(lookup_side(named), "path")
    beyond = F.exists(F.slice("cells", F.size("header") + 1, widest + 1), lambda c: c.isNotNull())
    too_long = F.concat(F.lit("a record has values beyond the header of "), F.col("path"))
    rows = rows.withColumn("cells", sure(F.col("cells"), ~beyond, too_long, "array<string>"))
    own = F.slice("cells", F.lit(1), F.size("header"))
    is_header = F.transform(own, lambda c: F.trim(F.coalesce(c, F.lit("")))) == F.col("header")
    rows = rows.where(~is_header & F.exists("cells", lambda c: c.isNotNull()))
    bound = F.map_from_arrays(F.array_distinct("header"), F.transform(
        F.array_distinct("header"), lambda n: F.get(F.col("cells"), F.array_position(F.col("header"), n).cast("int") - 1)))
    held = rows.select(bound.alias("_r"), "path", "block", "line")
    return held.select(*[F.try_element_at("_r", F.lit(n)).alias(n) for n in everything], "path", "block", "line")


def normalize(rows: DataFrame, backbone: str | None = None, required: Sequence[str] = REQUIRED,
              renames: Mapping[str, str] = RESULT_RENAMES) -> DataFrame:
    """Column names, types and missing values of result rows made uniform.

    Legacy rows name their source group differently and carry the method only in
    the run name. Where no file carries a backbone all rows take `backbone`, and
    without one the call fails; rows of files that lack what others carry keep null.
    """
    if "src_tag" in rows.columns:
        new = LEGACY_RENAMES["src_tag"]
        old = F.col("src_tag")
        rows = rows.withColumn(new, F.coalesce(new, old) if new in rows.columns else old).drop("src_tag")
    for old, new in renames.items():
        if old in rows.columns:
            value = F.coalesce(new, old) if new in rows.columns else F.col(old)
            rows = rows.withColumn(new, value).drop(old)
    if "run_name" in rows.columns:
        from_name = method_of_run(F.col("run_name"))
        rows = rows.withColumn("method", F.coalesce("method", from_name) if "method" in rows.columns else from_name)
    if "llm" not in rows.columns:
        if backbone is None:
            raise DataProblem("rows carry no `llm` column and no backbone was given")
        rows = rows.withColumn("llm", F.lit(backbone))
    need_columns(rows, required, "result rows")
    typed = {}
    for name, kind in MEASURES.items():
        if name in rows.columns:
            # seeds and counts may be written as 10.0 where a file has empty cells
            number = F.col(name).try_cast("double") if kind != "double" else F.col(name).try_cast(kind)
            typed[name] = null_if_nan(number).cast(kind)
    return rows.withColumns(typed)


def collect_results(spark: SparkSession, path: str, *, patterns: Sequence[str] = RESULT_FILES,
                    backbone: str | None = None, required: Sequence[str] = REQUIRED) -> DataFrame:
    """Every run's result rows under a directory, one row per language."""
    return normalize(read_by_header(spark, path, patterns), backbone, required)


def collect_validation(spark: SparkSession, path: str, *, patterns: Sequence[str] = VALIDATION_FILES) -> DataFrame:
    """Every run's validation rows; `accuracy` becomes `best_val_acc`."""
    rows = read_by_header(spark, path, patterns)
    if "best_val_acc" not in rows.columns and "accuracy" in rows.columns:
        rows = rows.withColumnRenamed("accuracy", "best_val_acc")
    typed = {n: null_if_nan(F.col(n).try_cast("double")).cast(k) for n, k in MEASURES.items() if n in rows.columns}
    return rows.withColumns(typed)


def scan_tables(spark: SparkSession, root: str, *, grids: Sequence[str] | None = None,
                table: str = "lang_table.csv", strict: bool = True) -> DataFrame:
    """Per-source tables from `grid.source` folders with both parts as columns.

    A table is a file or a folder of part files. `.zero` folders hold baselines and
    are skipped; a source in two grids is an error.
    """
    rows = read_by_header(spark, root, (table, "part-*.csv")).withColumn("path", table_path(F.col("path")))
    rows = rows.where(F.col("path").endswith(f"/{table}"))
    folder = table_folder(F.col("path"))
    rows = rows.withColumn("grid", grid_of(folder)).withColumn("source_group", source_of(folder))
    rows = rows.where((F.col("source_group") != "zero") & (F.col("grid") != ""))
    if grids is not None:
        rows = rows.where(F.col("grid").isin(list(grids)))
    if strict:
        found = ambiguous_sources(rows).limit(20).collect()
        if found:
            raise DataProblem(f"source groups in several grids: {[tuple(r) for r in found]}")
    numeric = [c for c in rows.columns if c.endswith(("_acc", "_std"))]
    counts = [c for c in ("seen", "n_seeds", "n_items") if c in rows.columns]
    return rows.withColumns({
        **{c: null_if_nan(F.col(c).try_cast("double")) for c in numeric},
        **{c: F.col(c).try_cast("double").cast("bigint") for c in counts}}).drop("block", "line")


def ambiguous_sources(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source_group").agg(F.array_sort(F.collect_set("grid")).alias("grids")).where(
        F.size("grids") > 1)


def metrics_table(documents: DataFrame, document: str = "metrics", *, prefix: str = "belebele_", suffix: str = ",none",
                  metrics: Sequence[str] | None = None, keep: Sequence[str] = ()) -> DataFrame:
    """Nested `{task: {metric: value}}` JSON to one row per task with metric columns."""
    nested = F.from_json(document, "map<string, map<string, string>>")
    tall = documents.select(*keep, F.explode(nested).alias("task", "values")).select(
        *keep, "task", F.explode("values").alias("metric", "value"))
    tall = tall.withColumn("metric", F.replace("metric", F.lit(suffix), F.lit(""))).withColumn(
        "language", F.replace("task", F.lit(prefix), F.lit("")))
    wide = tall.groupBy(*keep, "language", "task")
    pivoted = wide.pivot("metric", list(metrics)) if metrics is not None else wide.pivot("metric")
    return pivoted.agg(F.first(F.col("value").try_cast("double"))).orderBy(*keep, "language")


def save_metrics(table: DataFrame, path: str) -> None:
    """A metric table as CSV and JSON files."""
    table.write.mode("overwrite").option("header", "true").csv(f"{path}/csv")
    table.write.mode("overwrite").json(f"{path}/json")


def union_results(frames: Sequence[DataFrame]) -> DataFrame:
    """Frames appended by column name; columns a frame lacks are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)
