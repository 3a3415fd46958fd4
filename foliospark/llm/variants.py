"""Spelling variants of words, by a symmetric-delete join.

Every word emits itself and its distinct single deletions. Two words at distance one share
exactly one of these keys: the shorter word if one letter is missing, else what is left of
both without the letter that differs. So one equi-join finds every near pair once, and the
exact distance tells them from words that are two replacements apart. Near words are counted
and the most frequent one taken by an aggregation; variants are led to the last form of
their chain by joins that double the distance looked ahead.

A key of k letters is shared by at most (k + 1) words for each letter of the alphabet, and
they are words of the vocabulary, not occurrences: no key grows with the corpus.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize, release

#: Letters of a run, as a class of a regular expression.
LETTERS = "A-Za-zÀ-ÿ"
#: Code points up to which a word emits deletions; longer words emit halves, as deletions take the square of their length.
LONG = 64


def lowered(word: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    plain = F.octet_length(word) == F.length(word)  # of words of ASCII letters there is a faster way
    return F.when(plain, F.lower(word)).otherwise(F.translate(word, string.ascii_uppercase, string.ascii_lowercase))


def misspelled(word: Column, key: Column, every: int) -> Column:
    """``word`` without one letter where the CRC-32 of ``key:word`` is a multiple of ``every``; the letter follows from it too.

    A null key counts as an empty one. The same key and word always give the same result.
    """
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), word).cast("binary"))
    at = F.pmod(h, F.length(word)).cast("int")
    less = F.concat(F.substring(word, F.lit(1), at), F.substring(word, at + 2, F.length(word)))
    return F.when(F.pmod(h, F.lit(every)) == 0, less).otherwise(word)


def word_counts(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", least_length: int = 6, least_count: int = 5, misspell_every: int | None = None
) -> DataFrame:
    """``word, n``: words of at least ``least_length`` code points and ``least_count`` occurrences in whole texts.

    A word is a maximal run of letters with A-Z in lower case, passed through
    :func:`misspelled` if ``misspell_every`` is set. Null texts have none. Occurrences are
    counted before the shuffle, so a very frequent word is no hot key.
    """
    # runs that are too short stay so without a letter: they are not taken out of the text at all
    runs = F.regexp_extract_all(F.col(text), F.lit(f"[{LETTERS}]{{{least_length},}}"), F.lit(0))
    found = docs.select(F.col(key).alias("key"), F.explode(runs).alias("run")).select("key", lowered(F.col("run")).alias("word"))
    if misspell_every:
        found = found.select(misspelled(F.col("word"), F.col("key"), misspell_every).alias("word"))
    return found.groupBy("word").agg(F.count("*").alias("n")).where((F.col("n") >= least_count) & (F.length("word") >= least_length))


def _keys(words: DataFrame) -> DataFrame:
    """``kind, key, word, n, size``: kind 0 are a word and its deletions, the others halves of long words.

    Of two near words of which the longer has M letters, M > LONG, either the first M div 2
    letters are equal or the last M - M div 2. A word takes part for M its own length and
    one more; kind is 2M for the first letters and 2M + 1 for the last.
    """
    size = F.length("word")
    w = words.select("word", "n", size.alias("size"))
    one = lambda kind, key: F.struct(kind.cast("long").alias("kind"), key.alias("key"))
    short = w.where(F.col("size") <= LONG)
    at = F.sequence(F.lit(1), F.col("size"))
    cut = F.transform(at, lambda i: F.concat(F.substring("word", F.lit(1), i - 1), F.substring(F.col("word"), i + 1, F.col("size"))))
    deleted = F.transform(F.array_distinct(cut), lambda k: one(F.lit(0), k))
    out = short.select("word", "n", "size", F.explode(F.concat(F.array(one(F.lit(0), F.col("word"))), deleted)).alias("k"))
    halves = []
    for more in (0, 1):
        m = F.col("size") + more
        c = F.floor(m / 2).cast("int")
        halves += [one(2 * m, F.substring(F.col("word"), F.lit(1), c)), one(2 * m + 1, F.substring(F.col("word"), F.col("size") - m + c + 1, m - c))]
    long = w.where(F.col("size") >= LONG).select("word", "n", "size", F.explode(F.array(*halves)).alias("k"))
    return out.unionByName(long).select("k.kind", "k.key", "word", "n", "size")


def near_pairs(words: DataFrame) -> DataFrame:
    """``word, n, near, near_n``: all pairs of words at distance one, in both directions, each once.

    ``words`` has distinct non-null ``word`` and ``n``. The distance counts inserted,
    deleted and replaced code points.
    """
    keys = _keys(words)
    a, b = keys.alias("a"), keys.alias("b")
    longer = F.greatest("a.size", "b.size")
    half = F.floor(longer / 2).cast("int")
    heads = lambda c: F.substring(F.col(f"{c}.word"), F.lit(1), half)
    # long words meet in the half that is equal; in the last one only if the first differs
    once = (F.col("a.kind") == 0) | (
        (longer > LONG) & (F.floor(F.col("a.kind") / 2) == longer) & ((F.col("a.kind") % 2 == 0) | (heads("a") != heads("b")))
    )
    met = a.join(b, (F.col("a.kind") == F.col("b.kind")) & (F.col("a.key") == F.col("b.key")) & (F.col("a.word") < F.col("b.word")) & once
                 & (F.levenshtein(F.col("a.word"), F.col("b.word"), 1) == 1))
    way = lambda x, y: F.struct(F.col(f"{x}.word").alias("word"), F.col(f"{x}.n").alias("n"), F.col(f"{y}.word").alias("near"), F.col(f"{y}.n").alias("near_n"))
    return met.select(F.explode(F.array(way("a", "b"), way("b", "a"))).alias("p")).select("p.*")


def roots(links: DataFrame) -> DataFrame:
    """``word, root`` for every row ``word, form`` of ``links``: the last form that forms lead to.

    Every word has one form and no chain of forms returns to itself. Each round joins the
    table with itself, which doubles the steps that a row has made.
    """
    led = materialize(links.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = led.select(F.col("word").alias("root"), F.col("root").alias("further"))
        if led.join(ahead, "root", "left_semi").isEmpty():
            return led
        led, last = materialize(led.join(ahead, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots"), led
        release(last)


def group_variants(words: DataFrame, *, factor: int = 5) -> DataFrame:
    """One row per word: ``word, form, root, n, n_near, form_n``.

    ``words`` has distinct words with their occurrences ``n``. Words at distance one are
    near. A word's form is its near word of largest ``n`` (ties: the smallest in code-point
    order) if that is at least ``factor`` times (2 or more) its own, else null; ``root`` is
    where forms lead from the word, itself if it has none; ``n_near`` counts near words.
    Words of more than ``LONG`` letters meet by their halves, with the same result.
    No words, no rows; rows of a null word are left out; other columns are not read.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more")
    words = materialize(words.where("word is not null").select("word", "n"), "words")
    best = F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("form")))
    seen = near_pairs(words).groupBy("word", "n").agg(F.count("*").alias("n_near"), best.alias("best"))
    enough = -F.col("best.less") >= factor * F.col("n")
    formed = materialize(
        seen.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"), F.when(enough, -F.col("best.less")).alias("form_n")), "forms"
    )
    led = roots(formed.where("form is not null").select("word", "form"))
    out = words.join(formed, "word", "left").join(led, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "form_n")
