"""Properties of the splitter."""

import re

from hypothesis import given, settings
from hypothesis import strategies as st

from foliospark.operators.chunking import split_text

words = st.lists(st.text("abcdefgh.", min_size=1, max_size=30), max_size=120)


@settings(max_examples=80, deadline=None)
@given(words, st.integers(40, 120))
def test_no_word_is_lost_and_no_chunk_too_long(parts, size):
    text = " ".join(f"{w}{i}" for i, w in enumerate(parts))  # distinct words, so that a chunk is found in one place only
    chunks = split_text(text, size, 15)
    assert all(len(c) <= size for c in chunks)
    at = 0
    for c in chunks:  # each chunk continues within, or right behind, the one before
        found = text.find(c, max(0, at - 16 - 31))
        assert 0 <= found <= at + 1
        at = found + len(c)
    assert text.strip() == "" or at == len(text.rstrip())


def test_overlap_and_levels():
    text = "a" * 30 + " " + "b" * 30 + " " + "c" * 30
    assert split_text(text, 65, 35) == ["a" * 30 + " " + "b" * 30, "b" * 30 + " " + "c" * 30]
    assert split_text("x" * 25, 10, 0) == ["x" * 10, "x" * 10, "x" * 5]
    assert split_text("one\n\ntwo", 100, 0) == ["one\n\ntwo"]
    assert split_text("one\n\ntwo", 5, 0) == ["one", "two"]
    assert split_text("", 10, 2) == [] and split_text("   ", 10, 2) == []
    assert re.sub(r"\s", "", "".join(split_text("a b " * 30, 20, 0))) == "ab" * 30
