"""Raw benchmark records to prompt records."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, functions as F

from ..constants import TOPIC_LABELS
from ..functions import text as X
from ..functions.checks import DataProblem, sure
from .ranking import position


def reframe_mcqa(records: DataFrame, keep: Sequence[str] = ("lang", "link", "question_number")) -> DataFrame:
    """Multiple-choice records to `text`, `answer_label` and the kept columns.

    A record whose answer number is not 1 to 4 gets a null label, one with a null
    field a null text (see `bad_prompts`).
    """
    answers = [F.col(f"mc_answer{i}") for i in range(1, 5)]
    return records.select(
        *keep, X.mcqa_prompt(F.col("flores_passage"), F.col("question"), answers).alias("text"),
        X.mcqa_label(F.col("correct_answer_num")).alias("answer_label"))


def bad_labels(prompts: DataFrame) -> DataFrame:
    return prompts.where(F.col("answer_label").isNull())


def bad_prompts(prompts: DataFrame) -> DataFrame:
    """Prompts that lack a field of their text or a label, to be listed and left out."""
    return prompts.where(F.col("text").isNull() | F.col("answer_label").isNull())


def reframe_cloze(records: DataFrame, *, seed, item: str = "item", keep: Sequence[str] = ("lang",)) -> DataFrame:
    """Cloze records under two drawn letters; the same seed gives the same letters."""
    letters = X.drawn_letters(seed, F.col(item))
    sentences = [F.col(f"input_sentence_{i}") for i in range(1, 5)]
    endings = [F.col("sentence_quiz1"), F.col("sentence_quiz2")]
    return records.withColumn("_letters", letters).select(
        *keep, item, X.cloze_prompt(sentences, endings, F.col("_letters")).alias("text"),
        X.letter_at(F.col("answer_right_ending").cast("int"), F.col("_letters")).alias("answer_label"))


def question_ids(records: DataFrame, *, group: Sequence[str] = ("lang", "split"),
                 order: Sequence[str] = ("link", "question_number")) -> DataFrame:
    """0-based `question_id` by item order inside language and split."""
    return position(records, order, group=group, rank="question_id")


def chat_wrap(prompts: DataFrame, layout: str) -> DataFrame:
    """`text` rewritten for a chat layout; other columns as they are."""
    return prompts.withColumn("text", X.chat_text(F.col("text"), layout))


def label_topics(records: DataFrame, labels: Sequence[str] = TOPIC_LABELS) -> DataFrame:
    """`category` to its label id and `text` to `inputs`; an unknown category fails the job."""
    place = F.array_position(F.array(*[F.lit(x) for x in labels]), F.col("category"))
    message = F.concat(F.lit("unknown category "), F.coalesce(F.col("category"), F.lit("null")))
    label = sure((place - 1).cast("int"), F.coalesce(place, F.lit(0)) > 0, message, "int")
    rest = [c for c in records.columns if c not in ("category", "text")]
    return records.select(*rest, label.alias("labels"), F.col("text").alias("inputs"))


def remap_splits(rows: DataFrame, renames: Mapping[str, str], *, by: Sequence[str] = (), strict: bool = True) -> DataFrame:
    """Rename splits by a map; unmapped splits drop out, swaps are allowed.

    Every split named in the map must exist (per value of `by`).
    """
    if strict:
        present = rows.groupBy(*by).agg(F.collect_set("split").alias("_s"))
        wanted = F.array(*[F.lit(s) for s in renames])
        bad = present.select(*by, F.array_except(wanted, "_s").alias("missing")).where(F.size("missing") > 0)
        found = bad.limit(20).collect()
        if found or (not by and present.where(F.size("_s") > 0).isEmpty()):
            raise DataProblem(f"splits named in the map are absent: {[tuple(r) for r in found] or sorted(renames)}")
    new = F.create_map(*[F.lit(x) for pair in renames.items() for x in pair])
    return rows.where(F.col("split").isin(list(renames))).withColumn("split", F.try_element_at(new, F.col("split")))
