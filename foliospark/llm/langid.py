"""Language ID by rank-order n-gram profiles.

A profile is the list of a language's most frequent character n-grams (one to three
characters, words padded with a space) by rank. A document's own most frequent n-grams,
of its whole text, are ranked likewise; the distance to a language is the sum over them
of how far each is out of place, an n-gram that the profile lacks counting as the
largest displacement. The nearest language wins.
"""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import lean, new_column, ship

#: N-grams of a language profile, and of a document.
PROFILE_SIZE = 400
DOCUMENT_SIZE = 300
#: Labelled rows of each language that profiles are learned from, in expectation.
TRAIN_ROWS = 4000
#: Languages that a model may hold: it is broadcast, at some 5 KB a language.
MAX_LANGUAGES = 2000
_SPACE = 32
_BITS = 21


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For every code point 2 if it is a letter, 1 if it is a mark, else 0."""
    kinds = {"L": 2, "M": 1}
    return np.fromiter(
        (kinds.get(unicodedata.category(chr(i))[0], 0) for i in range(sys.maxunicode + 1)), np.int8, sys.maxunicode + 1
    )


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of a text, packed 21 bits a character, ascending, with their counts.

    The text is lower-cased; runs of other than letters and marks are one space, at both
    ends too; n-grams that hold a space between two characters, or nothing else, are left
    out. No letters: empty, whatever marks there are.
    """
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    kind = _letters()[codes] if len(codes) else np.empty(0, np.int8)
    if not (kind == 2).any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    c = np.where(kind > 0, codes, _SPACE)
    c = np.concatenate(([_SPACE], c, [_SPACE]))
    c = c[np.concatenate(([True], (c[1:] != _SPACE) | (c[:-1] != _SPACE)))]
    one, two = c, c[:-1] << _BITS | c[1:]
    three = two[:-1] << _BITS | c[2:]
    grams = np.concatenate((one[one != _SPACE], two, three[c[1:-1] != _SPACE]))
    grams.sort()
    first = np.flatnonzero(np.concatenate(([True], grams[1:] != grams[:-1])))
    return grams[first], np.diff(np.concatenate((first, [len(grams)])))


def top_ngrams(text: str, size: int = DOCUMENT_SIZE) -> np.ndarray:
    """The most frequent n-grams of a text by falling count, ties by packed value."""
    grams, counts = ngrams(text)
    return grams[np.argsort(-counts, kind="stable")[:size]]


class Profiles:
    """Language profiles as one table of n-grams by language, holding ranks."""

    def __init__(self, ranked: dict[str, list[int]], size: int = PROFILE_SIZE):
        self.languages = sorted(ranked)
        self.size = size
        self.grams = np.array(sorted({g for grams in ranked.values() for g in grams}), np.int64)
        self.ranks = np.full((len(self.grams) + 1, len(self.languages)), -1, np.int64)
        for j, lang in enumerate(self.languages):
            for rank, g in enumerate(ranked[lang]):
                self.ranks[np.searchsorted(self.grams, g), j] = rank

    def distances(self, top: np.ndarray) -> np.ndarray:
        """Out-of-place distance to each language, from 0 to ``size`` an n-gram on average."""
        at = np.searchsorted(self.grams, top)
        at[at == len(self.grams)] = 0
        known = self.grams[at] == top
        ranks = np.where(known[:, None], self.ranks[at], -1)
        away = np.minimum(np.abs(ranks - np.arange(len(top))[:, None]), self.size)
        return np.where(ranks < 0, self.size, away).sum(axis=0) / len(top)

    def predict(self, text: str, size: int = DOCUMENT_SIZE) -> tuple[str, float]:
        """The nearest language (ties: the first by name) and 1 less the distance's share."""
        top = top_ngrams(text, size) if self.languages else ()
        if not len(top):
            return "und", 0.0
        d = self.distances(top)
        best = int(np.argmin(d))
        return self.languages[best], float(1 - d[best] / self.size)


def fit(
    rows: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang",
    train_rows: int = TRAIN_ROWS, size: int = PROFILE_SIZE,
) -> Profiles:
    """Learn a profile of each language from labelled rows.

    Of each language about ``train_rows`` rows are used, chosen by a hash of key and text,
    so that the cost is bounded whatever the corpus, copies included; fewer are used whole. Null labels and
    texts teach nothing. Counts are summed before the shuffle and again in it.
    """
    spark = rows.sparkSession
    ship(spark)
    known = rows.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.col(key).alias("key")).where(
        F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sizes = known.groupBy("lang").agg(F.count("*").alias("n"))
    shares = {r["lang"]: train_rows / r["n"] for r in sizes.limit(MAX_LANGUAGES + 1).collect()}
    if len(shares) > MAX_LANGUAGES:
        raise ValueError(f"over {MAX_LANGUAGES} languages: the model would not be small enough to broadcast")
    if not shares:
        return Profiles({}, size)
    unit = F.pmod(F.xxhash64("key", "text"), F.lit(1 << 20)) / (1 << 20)
    share = F.element_at(F.create_map(*[F.lit(x) for kv in shares.items() for x in kv]), F.col("lang"))
    sample = known.where(unit < share)

    @lean
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            by: dict[str, list] = {}
            for language, t in zip(b.column("lang"), b.column("text")):
                by.setdefault(language.as_py(), []).append(ngrams(t.as_py()))
            for language, found in by.items():
                grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
                counts = np.bincount(at, np.concatenate([c for _, c in found]), len(grams)).astype(np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([language] * len(grams), pa.string()), pa.array(grams), pa.array(counts)],
                    names=["lang", "gram", "n"],
                )

    counted = sample.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    best = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= size)
    ranked: dict[str, list[int]] = {language: [] for language in shares}
    for r in top.orderBy("lang", "rank").collect():  # size rows a language
        ranked[r["lang"]].append(r["gram"])
    return Profiles({k: v for k, v in ranked.items() if v}, size)


def with_language(docs: DataFrame, out: str, profiles: Profiles, *, text: str = "text") -> DataFrame:
    """``docs`` with the column ``out``: ``struct<lang_pred, score>`` of each whole text.

    Null texts and texts without letters are ``und`` with score 0, as is everything
    under a model without languages.
    """
    ship(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(profiles)  # bounded by MAX_LANGUAGES

    @F.arrow_udf("struct<lang_pred:string,score:double>")
    @lean
    def predict(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            found = [model.value.predict(t.as_py() or "") for t in batch]
            yield pa.StructArray.from_arrays(
                [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["lang_pred", "score"],
            )

    return docs.withColumn(new_column(docs, out), predict.asNondeterministic()(F.col(text)))


def held_out(key: Column) -> Column:
    """Whether a row is kept from learning: CRC-32 of its key as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", lang: str = "lang", train_rows: int = TRAIN_ROWS
) -> DataFrame:
    """Learn from the rows not held out, predict all: ``doc_id, held_out, lang_pred, score``.

    Predictions see the text only. Other columns are not read; repeated rows each give a
    row; null keys are not held out; an empty table gives an empty result.
    """
    rows = docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text"), F.col(lang).alias("lang"))
    rows = rows.withColumn("held_out", held_out(F.col("doc_id")))
    profiles = fit(rows.where(~F.col("held_out")), train_rows=train_rows)
    marked = with_language(rows.drop("lang"), "_p", profiles)
    return marked.select("doc_id", "held_out", "_p.*")
