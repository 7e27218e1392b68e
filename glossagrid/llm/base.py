"""What the operators of this package share: tables, folds, words and the tokenizer."""

from __future__ import annotations

import os
from array import array
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..session import scratch_path

END_ID = 1
CACHED_WORDS = 400_000
ROWS_AT_ONCE = 500


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo n; a null id counts as empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % n


def whole(text: Column) -> Column:
    """The text; null counts as empty."""
    return F.coalesce(text.cast("string"), F.lit(""))


def unsigned(ids: Column) -> Column:
    """crc32 of a binary column; null for null."""
    return F.crc32(ids)


class Rounds:
    """Tables of an iteration in the shared folder; those no round needs any more can go."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def settle(self, df: DataFrame) -> DataFrame:
        """Like session.settle."""
        self.paths.append(scratch_path(self.spark, "round"))
        df.write.option("compression", "zstd").parquet(self.paths[-1])
        return self.spark.read.schema(df.schema).parquet(self.paths[-1])

    def drop(self, keep: int) -> None:
        """Delete all but the last `keep` tables."""
        for path in self.paths[:len(self.paths) - keep]:
            place = self.spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(self.spark._jsc.hadoopConfiguration()).delete(place, True)
        del self.paths[:len(self.paths) - keep]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def slices(batches: Iterator) -> Iterator:
    """Arrow batches in pieces of few rows, so that only these are Python objects at a time."""
    for batch in batches:
        for at in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(at, ROWS_AT_ONCE)


def byte_letters() -> dict[int, str]:
    """The characters that byte-level models use for bytes: printable ones as they are, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(others)}


class WordIds(dict):
    """Ids of blank-free words as little-endian unsigned 32-bit bytes, filled on demand.

    The tokenizer never joins characters over a blank, so a text's ids are its
    words' ids in a row. The memory is bounded: a full cache starts anew.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self._model, self._bytes = self.tokenizer.model.tokenize, byte_letters()

    def __missing__(self, word: str) -> bytes:
        # ASCII letters fold alone, and letters never join a closing mark: such words are known ones or new pieces.
        letters, mark = (word[:-1], word[-1]) if word[-1:] in (".", ",") else (word, "")
        if not letters.isalpha():
            packed = self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        elif mark:
            packed = self[letters] + self[mark]
        elif not word.isascii():
            packed = self._letters(word)
        elif word.islower():
            packed = self._packed([x.id for x in self._model(word)])
        else:
            packed = self[word.lower()]
        if len(word) <= 64:
            self[word] = packed
        return packed

    @staticmethod
    def _packed(ids: list[int]) -> bytes:
        return array("I", ids).tobytes()

    def _letters(self, word: str) -> bytes:
        """Latin-1 letters are in normal form and fold alone: one piece for the model."""
        try:
            word.encode("latin-1")
        except UnicodeEncodeError:
            return self._packed(self.tokenizer.encode(word, add_special_tokens=False).ids)
        return self._packed([x.id for x in self._model(word.lower().encode().decode("latin-1").translate(self._bytes))])

    def encode(self, text: str) -> bytes:
        if len(self) > CACHED_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.replace("\n", " ").split(" ")))


class WordHashes(dict):
    """64-bit hashes of words as bytes; a full cache starts anew."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        found = xxhash.xxh64_intdigest(word)
        if len(word) <= 64:
            self[word] = found
        return found

    def of(self, text: str | None) -> np.ndarray:
        """Hashes of the text's words: ASCII letters lower-cased, split at ASCII blanks."""
        if len(self) > CACHED_WORDS:
            self.clear()
        words = (text or "").encode().lower().split()
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))
