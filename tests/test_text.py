"""Scalar functions, against results worked out by hand."""

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as X


def one(spark, expression, *values):
    row = spark.createDataFrame([values], ", ".join(f"c{i} string" for i in range(len(values))))
    return row.select(expression(*[F.col(f"c{i}") for i in range(len(values))]).alias("r")).first()["r"]


@pytest.mark.parametrize(
    "text, spoken",
    [
        ("Backpropagation minimizes the error function (Chapter 6, Section 6.3, p.112).", "Backpropagation minimizes the error function."),
        ("The equation is $E = mc^2$ according to the text.", "The equation is E equals mc squared according to the text."),
        (r"It is $\frac{1}{n}\sum_{i=1}^{n} x_i$.", "It is 1 over n the sum from i equals 1 to n of x sub i."),
        (r"Given $\alpha \leq \beta$, the gradient $\nabla_\theta L$ converges.", "Given alpha less than or equal to beta, the gradient nabla sub theta L converges."),
        (r"x^{3} y^{k+1} z^23 a_{ij} \cdot b \neq c", "x cubed y to the power of k+1 z to the power of 23 a sub ij times b not equal to c"),
        ("a^2^3 b^{2}^n x^y^2", "a squared^3 b squared^n x to the power of y^2"),  # a power is no base
        ("e^{2}3 2^22 q^{}", "e squared3 2 to the power of 22 q to the power of"),
        ("", ""),
        (None, None),
    ],
)
def test_speech(spark, text, spoken):
    assert one(spark, X.speech_text, text) == spoken


@pytest.mark.parametrize("answer, score", [("0.85", 0.85), ("1", 1.0), ("10", 1.0), ("1.5", 1.5), ("20%", 0.0), (".9", None), ("none", None), (None, None)])
def test_judge_score(spark, answer, score):
    assert one(spark, X.judge_score, answer) == score


@pytest.mark.parametrize("title, number", [("3.1 A", "3"), ("3 A", "3"), ("3. A", None), ("Chapter 3", None), ("3", "3"), ("", None)])
def test_leading_number(spark, title, number):
    assert one(spark, X.leading_number, title) == number


@pytest.mark.parametrize("title, real, by_words", [("Indexing", False, False), ("Discovery", False, True), (" Preface ", False, False), ("3 Networks", True, True)])
def test_real_chapter(spark, title, real, by_words):
    assert one(spark, X.is_real_chapter, title) is real
    assert one(spark, lambda c: X.is_real_chapter(c, whole_words=True), title) is by_words


@pytest.mark.parametrize(
    "text, ends",
    [("See p. 3", False), ("and e.g.", False), ("and i.e.", False), ("in 1998.", False), ("It is done.", True), ("Why?", True), ("E.G.", False)],
)
def test_sentence_end(spark, text, ends):
    assert one(spark, X.is_sentence_end, text) is ends


def test_tokens(spark):
    assert one(spark, X.whitespace_tokens, "A b  The\tend. ") == ["a", "b", "the", "end."]
    assert one(spark, X.whitespace_tokens, "  ") == []
    assert one(spark, X.word_tokens, "The Catété of it 3rd runs, used") == ["cat", "runs"]


def test_snippet_is_literal_and_cut_at_the_start(spark):
    text = "50%_off " + "x" * 100
    assert one(spark, lambda t, k: X.snippet(t, k), text, "%_OFF") == text[:62]
    assert one(spark, lambda t, k: X.contains_ci(t, k), text, "5%") is False
    long = "y" * 100 + "Key" + "z" * 100
    assert one(spark, lambda t, k: X.snippet(t, k), long, "kEY") == long[60:160]


def test_escape_fence_and_ids(spark):
    assert one(spark, X.html_escaped, """<a b="c">'&""") == "&lt;a b=&quot;c&quot;&gt;&#x27;&amp;"
    assert one(spark, X.html_escaped, None) == ""
    assert one(spark, X.fence_stripped, '```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, lambda b: X.chunk_id(b, F.lit(3), F.lit(1), F.lit(0)), "My Book") == "my_book_p3_g1_c0"
    assert one(spark, lambda a: X.connections(F.length(a)), "x") == "1 connection"
    assert one(spark, lambda a: X.connections(F.length(a)), "xx") == "2 connections"
