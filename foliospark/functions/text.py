"""Scalar text functions as Column expressions; all run inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..model import GREEK, NON_CHAPTER_KEYWORDS, POLLUTION_KEYWORDS, STOPWORDS

_SPACE = r"(?U)\s+"
#: The same characters named one by one, which Java compares faster.
SPACES = r"[\t-\r \x85\u00A0\u1680\u2000-\u200A\u2028\u2029\u202F\u205F\u3000]+"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def whitespace_tokens(text: Column | str) -> Column:
    """Lower-cased words between white space; punctuation stays. Null text: null."""
    return F.array_remove(F.split(F.lower(col(text)), SPACES), "")


def word_tokens(text: Column | str) -> Column:
    """Lower-cased runs of a-z longer than two letters that are no stopwords."""
    words = F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z]+)"), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(STOPWORDS))


def long_words(text: Column | str) -> Column:
    """As :func:`word_tokens` with the stopwords."""
    return F.regexp_extract_all(F.lower(col(text)), F.lit("([a-z]{3,})"), F.lit(1))


def strip(text: Column | str) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(col(text), r"(?U)^\s+|\s+$", "")


def collapse(text: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(col(text), _SPACE, " "))


def term_id(text: Column | str) -> Column:
    """A concept's identity: stripped, in lower case."""
    return F.lower(strip(text))


def slug(title: Column | str) -> Column:
    """Lower case, spaces to underscores."""
    return F.replace(F.lower(col(title)), F.lit(" "), F.lit("_"))


def chunk_id(book: Column | str, page: Column | str, group: Column | str, sub: Column | str) -> Column:
    """``<slug>_p<page>_g<group>_c<sub>``."""
    part = lambda mark, c: F.concat(F.lit(mark), col(c).cast("string"))
    return F.concat(slug(book), part("_p", page), part("_g", group), part("_c", sub))


def _holds_any(text: Column, keywords: list[str]) -> Column:
    found = F.lit(False)
    for k in keywords:
        found = found | F.contains(text, F.lit(k))
    return found


def is_real_chapter(title: Column | str, *, whole_words: bool = False) -> Column:
    """No keyword of front or back matter occurs in the title.

    By default keywords match inside words ("Discovery" holds "cover"), as readers of
    existing libraries expect; ``whole_words`` anchors them at the start of a word.
    """
    low = term_id(title)
    if whole_words:
        return ~low.rlike(r"\b(" + "|".join(NON_CHAPTER_KEYWORDS) + ")")
    return ~_holds_any(low, NON_CHAPTER_KEYWORDS)


def is_polluted(chapter: Column | str) -> Column:
    """A result's chapter looks like front or back matter; null is not polluted."""
    return F.coalesce(_holds_any(F.lower(col(chapter)), POLLUTION_KEYWORDS), F.lit(False))


def leading_number(title: Column | str) -> Column:
    """The first number of a dotted number that opens the title and is followed by white space; else null."""
    found = F.regexp_extract(F.concat(col(title), F.lit(" ")), r"^(\d+)(?:\.\d+)*\s", 1)
    return F.when(found != "", found)


def contains_ci(text: Column | str, keyword: Column | str) -> Column:
    """Literal substring, whatever the case."""
    return F.contains(F.lower(col(text)), F.lower(keyword if isinstance(keyword, Column) else F.lit(keyword)))


def snippet(text: Column | str, keyword: Column, before: int = 40, after: int = 60) -> Column:
    """The first hit with ``before`` characters before its start and ``after`` from it on."""
    at = F.position(F.lower(keyword), F.lower(col(text)))
    start = F.greatest(F.lit(1), at - before)
    return F.when(at > 0, F.substring(col(text), start, at + after - start))


def fence_stripped(raw: Column | str) -> Column:
    """A model's answer without a leading ```` ```json ```` and a trailing fence."""
    return F.regexp_replace(F.regexp_replace(strip(raw), r"^```json\s*", ""), r"\s*```$", "")


def judge_score(answer: Column | str) -> Column:
    """The first 0 or 1, with decimals if any, in a judge's answer; null where there is none."""
    found = F.regexp_extract(col(answer), r"([01](?:\.\d+)?)", 1)
    return F.when(found != "", found.cast("double"))


def html_escaped(text: Column | str) -> Column:
    """Safe in HTML text and attributes; null is empty."""
    out = F.coalesce(col(text), F.lit(""))
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        out = F.replace(out, F.lit(raw), F.lit(safe))
    return out


def list_key(ids: Column) -> Column:
    """MD5 of the sorted ids, pipe-joined: the key of a cached batch."""
    return F.md5(F.concat_ws("|", F.array_sort(ids)))


def connections(n: Column) -> Column:
    """``1 connection``, ``2 connections``."""
    return F.concat(n.cast("string"), F.lit(" connection"), F.when(n != 1, "s").otherwise(""))


def context_block(chapter: Column, section: Column, page: Column, text: Column) -> Column:
    """A labelled excerpt that a model can cite."""
    label = F.concat(F.lit("["), F.coalesce(chapter, F.lit("None")), F.lit(" | "), F.coalesce(section, F.lit("None")), F.lit(" | p."), page.cast("string"), F.lit("]"))
    return F.concat(label, F.lit("\n"), text)


def strip_citations(text: Column | str) -> Column:
    """Without parenthesised citations that end in a page number."""
    return F.regexp_replace(col(text), r"(?U)\s*\([^()]*p\.\d+\)", "")


def latex_to_spoken(text: Column | str) -> Column:
    """Common LaTeX as spoken English; the order of the steps matters.

    Fractions and sums first, then letters, powers, indices, symbols, and what is left
    of delimiters and commands. An equals sign within a sum's lower bound is spelled out
    by the general step, which gives the same words. The noncharacters U+FDD0 and U+FDD1,
    which no text should hold, mark powers meanwhile and are dropped from the text before.
    """
    steps = [
        ("[\ufdd0\ufdd1]", ""),
        (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", "$1 over $2 "),
        (r"\\sum_\{([^{}]*)\}\^\{([^{}]*)\}", "the sum from $1 to $2 of"),
        *[(rf"(?U)\\{g}\b", g) for g in GREEK],
        # one pass marks every power, so that what one leaves is not taken for another's base
        (r"(?U)(\w+)\^(?:\{([^{}]*)\}|(\w+))", "$1\ufdd0$2$3\ufdd1"),
        ("\ufdd02\ufdd1", " squared"),
        ("\ufdd03\ufdd1", " cubed"),
        ("\ufdd0([^\ufdd0\ufdd1]*)\ufdd1", " to the power of $1"),
        (r"(?U)(\w+)_(?:\{([^{}]*)\}|(\w+))", "$1 sub $2$3"),
        (r"\\times|\\cdot", "times"),
        (r"\\leq", "less than or equal to"),
        (r"\\geq", "greater than or equal to"),
        (r"\\neq", "not equal to"),
        ("=", " equals "),
        (r"\$\$|\$", ""),
        (r"\\([a-zA-Z]+)", "$1"),
    ]
    out = col(text)
    for pattern, words in steps:
        out = F.regexp_replace(out, pattern, words)
    return out


def speech_text(text: Column | str) -> Column:
    """Ready to be read out: no citations, LaTeX in words, single spaces."""
    return collapse(latex_to_spoken(strip_citations(text)))


#: Ends of a candidate that are none of a sentence, for Java's and Python's regular expressions: one pattern instead of four searches.
NOT_AN_END = r"(?i:\bp\.\s*\d*$|\be\.g\.$|\bi\.e\.$)|\b\d+\.$"


def is_sentence_end(candidate: Column | str) -> Column:
    """The text does not end in a page mark, "e.g.", "i.e." or a number and a full stop."""
    return ~col(candidate).rlike("(?U)" + NOT_AN_END)
