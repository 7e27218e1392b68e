"""Prompt texts as column expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from ..constants import ANSWER_CUE, ANSWER_LETTERS, CHAT_LAYOUTS
from .checks import sure
from .draws import digest

# Every character that counts as blank at the ends of a question.
BLANK = r"[\t-\r\x1c-\x20\x85\xa0  -     　]+"


def strip(text: Column) -> Column:
    """Without blanks of any script at both ends."""
    return F.regexp_replace(text, rf"\A{BLANK}|{BLANK}\z", "")


def letter_at(number: Column, letters: Column) -> Column:
    """Letter of a 1-based number; null when there is none."""
    return F.when(number >= 1, F.try_element_at(letters, number))


def _joined(mark: str, *parts: Column) -> Column:
    """Parts with a mark between them; null if any part is."""
    return F.concat(parts[0], *[x for part in parts[1:] for x in (F.lit(mark), part)])


def mcqa_prompt(passage: Column, question: Column, answers: list[Column]) -> Column:
    lines = [F.concat(F.lit("P: "), passage), F.concat(F.lit("Q: "), strip(question))]
    lines += [F.concat(F.lit(f"{letter}: "), a) for letter, a in zip(ANSWER_LETTERS, answers)]
    return _joined("\n", *lines, F.lit(ANSWER_CUE))


def mcqa_label(correct: Column) -> Column:
    return letter_at(correct.cast("int"), F.array(*[F.lit(x) for x in ANSWER_LETTERS]))


def drawn_letters(seed, item: Column) -> Column:
    """Two of the four letters, without replacement, in drawn order."""
    keyed = F.array(*[F.struct(digest(seed, item, F.lit(x)).alias("d"), F.lit(x).alias("x")) for x in ANSWER_LETTERS])
    return F.transform(F.slice(F.array_sort(keyed), 1, 2), lambda s: s["x"])


def cloze_prompt(sentences: list[Column], endings: list[Column], letters: Column) -> Column:
    choices = [F.concat(F.element_at(letters, i + 1), F.lit(": "), e) for i, e in enumerate(endings)]
    return F.concat(_joined("\n", *sentences), F.lit("\n\n"), _joined("\n", *choices, F.lit(ANSWER_CUE)))


def chat_text(text: Column, layout: str) -> Column:
    """A prompt as user turn with an opened model turn.

    In prefill layouts the answer cue moves into the model turn; a prompt that
    does not end in it fails the job.
    """
    opening, closing, prefill = CHAT_LAYOUTS[layout]
    body = text
    if prefill:
        cut = F.regexp_replace(F.substring(text, F.lit(1), F.length(text) - len(ANSWER_CUE)), r"\n+\z", "")
        body = sure(cut, text.endswith(ANSWER_CUE),
                    F.concat(F.lit("prompt does not end in the answer cue: "), F.right(text, F.lit(40))), "string")
    return F.concat(F.lit(opening), body, F.lit(closing))
