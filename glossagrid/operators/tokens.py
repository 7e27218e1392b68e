"""Token lengths, vocabulary by script, and tokenizers as column expressions."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..functions.names import vocabulary_script
from .ranking import head_of_groups, position

Tokenizer = Callable[[Column], Column]


def pattern_tokenizer(pattern: str = r"\S+") -> Tokenizer:
    """Tokens are the matches of a pattern; runs inside the JVM."""
    return lambda text: F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def encoder_tokenizer(encode: Callable[[list[str]], list[list[int]]]) -> Tokenizer:
    """Any batch encoder (texts to id lists), run over Arrow batches.

    The encoder travels with the function, so its vocabulary is its own size bound.
    """
    @F.pandas_udf(T.ArrayType(T.IntegerType()))
    def ids(texts: pd.Series) -> pd.Series:
        return pd.Series(encode(texts.fillna("").tolist()), index=texts.index)
    return ids


def tokenize(rows: DataFrame, tokenizer: Tokenizer, *, text: str = "text", specials: int = 2,
             max_length: int | None = None, truncate: bool = False, share: float | None = None,
             seed=0, ids: Sequence[str] = ()) -> DataFrame:
    """Add `tokens` and `length` (with `specials` added tokens).

    `truncate` cuts to `max_length`; without it the limit only classifies
    (`too_long`). `share` keeps that fraction of the rows, drawn by digest of `ids`.
    """
    if share is not None:
        from ..functions.draws import draw_unit
        rows = rows.where(draw_unit(seed, *ids) < share)
    tokens = tokenizer(F.col(text))
    if truncate and max_length is not None:
        tokens = F.slice(tokens, 1, max_length - specials)
    out = rows.withColumn("tokens", tokens).withColumn("length", F.size("tokens") + specials)
    if max_length is not None:
        out = out.withColumn("too_long", F.col("length") > max_length)
    return out


def length_stats(rows: DataFrame, by: Sequence[str] = ("lang",), *, max_length: int = 1024, exact: bool = True) -> DataFrame:
    """Length statistics per language.

    Exact percentiles keep one counter per distinct length; `exact=False` takes
    the approximate ones.
    """
    points = {"p50": 0.5, "p90": 0.9, "p95": 0.95, "p99": 0.99}
    if exact:
        cuts = F.percentile("length", [*points.values()])
    else:
        cuts = F.percentile_approx("length", [*points.values()], 10_000)
    stats = rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.min("length").alias("min_length"), F.avg("length").alias("mean_length"),
        cuts.alias("_cuts"), F.max("length").alias("max_length"),
        F.count_if(F.col("length") > max_length).alias("n_too_long"))
    return stats.select(*by, "n", "min_length", "mean_length",
                        *[F.col("_cuts")[i].cast("double").alias(p) for i, p in enumerate(points)],
                        "max_length", "n_too_long")


def sort_by_length(rows: DataFrame, tie: Sequence[str], rank: str = "length_rank") -> DataFrame:
    """Rows laid out by token length, with their rank."""
    return position(rows, ["length", *tie], rank=rank)


def vocabulary_by_script(rows: DataFrame, tokenizer: Tokenizer, *, lang: str = "lang", text: str = "text",
                         latin_apart: bool = True, max_texts: int | None = None,
                         max_tokens: int | None = None, order: Sequence[str] = ()) -> DataFrame:
    """(token, group): the script that owns a token, `Mixed` where several use it.

    Optional limits of the preview: the first `max_texts` texts per language by
    `order`, and `max_tokens` per text.
    """
    if max_texts is not None:
        rows = head_of_groups(rows, order, max_texts, group=[lang])
    tokens = tokenizer(F.col(text))
    if max_tokens is not None:
        tokens = F.slice(tokens, 1, max_tokens)
    script = vocabulary_script(F.col(lang), latin_apart)
    used = rows.select(script.alias("script"), F.explode(tokens).alias("token"))
    # One script if the least is the greatest; texts without a script are one of their own. One shuffle, summed up before it.
    one = (F.min("script") == F.max("script")) & (F.count("script") == F.count(F.lit(1))) | (F.count("script") == 0)
    return used.groupBy("token").agg(F.when(one, F.min("script")).otherwise("Mixed").alias("group"))


def lookup_embeddings(vocabulary: DataFrame, embeddings: DataFrame, *, token: str = "token_id", skip_mixed: bool = False) -> DataFrame:
    """Embedding rows of the tokens of each group; groups without tokens give none."""
    wanted = vocabulary.where(F.col("group") != "Mixed") if skip_mixed else vocabulary
    return wanted.join(embeddings, token)
