"""Packing, ranked lexical search and spelling variants against plain versions."""

import collections
import math
import random
import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import lexical, packing, queries, variants
from foliospark.llm.common import materialize

from . import brute
from .conftest import DOCUMENTS

JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


# --- op11 ----------------------------------------------------------------------------------


def check_packing(rows, texts, capacity, end_id=2):
    """``rows`` of all documents against the ids of the library; ``texts`` are (key, text)."""
    library, want = Tokenizer.from_file(JSON), collections.Counter()
    for key, text in texts:
        ids = library.encode(text or "", add_special_tokens=False).ids + [end_id]
        first = (len(ids) - 1) % capacity + 1
        cuts = [0, *range(first, len(ids), capacity), len(ids)]
        for piece, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[key, piece, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())] += 1
    assert collections.Counter((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def best_fit_decreasing(lengths, capacity):
    room = []
    for n in sorted(lengths, reverse=True):
        fits = [i for i, r in enumerate(room) if r >= n]
        if fits:
            room[min(fits, key=lambda i: room[i])] -= n
        else:
            room.append(capacity - n)
    return len(room)


def test_op11(spark, sf_dir, docs):
    rows = queries.op11_swap_packing(spark, sf_dir).collect()
    n = check_packing(rows, [(r["doc_id"], r["text"]) for r in docs.collect()], 1024)
    assert -(-sum(r["length"] for r in rows) // 1024) <= n <= best_fit_decreasing([r["length"] for r in rows], 1024)


def test_op11_odd(spark, odd_docs, no_docs):
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    rows = packing.pack_documents(odd_docs, JSON, PATTERN, capacity=64).collect()
    check_packing(rows, texts, 64)
    assert packing.pack_documents(no_docs, JSON, PATTERN).count() == 0
    special = spark.createDataFrame([(1, "a <|endoftext|> b", "en", "s", 1)], DOCUMENTS)
    check_packing(packing.pack_documents(special, JSON, PATTERN).collect(), [(1, "a <|endoftext|> b")], 1024)


def test_packing_levels_and_clashes(spark):
    """Groups of 500 leave underfull bins that later levels fill; other columns stay, taken names are refused."""
    random.seed(3)
    lengths = [random.randint(1, 64) for _ in range(1500)]
    pieces = materialize(spark.createDataFrame([(i, n, f"x{i}") for i, n in enumerate(lengths)], "row long, length long, other string"), "pieces")
    rows = packing.pack(pieces, capacity=64, group=500).collect()
    assert sorted((r["row"], r["length"], r["other"]) for r in rows) == [(i, n, f"x{i}") for i, n in sorted(enumerate(lengths), key=lambda p: p[0])]
    by = collections.defaultdict(list)
    for r in rows:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for own in by.values():
        assert [a for a, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))] and sum(n for _, n in own) <= 64
    one = len({r["sequence_id"] for r in packing.pack(pieces, capacity=64, group=500, levels=1).collect()})
    assert len(by) < one and len(by) <= 1.02 * best_fit_decreasing(lengths, 64)
    with pytest.raises(ValueError):
        packing.pack(pieces.withColumn("Offset", F.lit(1)))


def test_sequences_hold_the_ids(spark, docs):
    few = docs.limit(30)
    cut = packing.pieces(few, JSON, PATTERN, end_id=2, capacity=256, with_ids=True)
    found = packing.sequences(packing.pack(cut, capacity=256)).collect()
    library, got = Tokenizer.from_file(JSON), collections.Counter()
    for r in found:
        ids = np.frombuffer(r["ids"], "<u4")
        assert len(ids) <= 256 and len(r["doc_ids"]) == len(r["starts"])
        for d, a, b in zip(r["doc_ids"], r["starts"], [*r["starts"][1:], len(ids)]):
            got[d] += b - a
    assert got == {r["doc_id"]: len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1 for r in few.collect()}


def packed(lengths, capacity):
    bins = packing.Bins(lengths, capacity)
    bins.best_fit(list(range(len(lengths))))
    return bins


@pytest.mark.parametrize("low, high", [(300, 500), (200, 450), (340, 343), (513, 1000), (400, 400), (1, 1023)])
def test_search_empties_bins(low, high):
    random.seed(low)
    lengths = [random.randint(low, high) for _ in range(2000)]
    bins = packed(lengths, 1024)
    before, squares = sum(f > 0 for f in bins.fill), sum(f * f for f in bins.fill)
    bins.improve(packing.EFFORT * len(lengths))
    after = sum(f > 0 for f in bins.fill)
    assert after == before - bins.emptied and sum(f * f for f in bins.fill) >= squares and max(bins.fill) <= 1024
    assert sorted(i for own in bins.items for some in own.values() for i in some) == list(range(len(lengths)))
    if (low, high) in ((300, 500), (200, 450), (340, 343)):
        assert bins.emptied > 0


@given(st.lists(st.integers(1, 30), max_size=60), st.integers(30, 40))
@settings(max_examples=60, deadline=None)
def test_search_keeps_every_item(lengths, capacity):
    bins = packed(lengths, capacity)
    before = sum(f > 0 for f in bins.fill)
    bins.improve(10_000)
    place, offset = bins.places()
    assert len(set(place.tolist())) <= before and -(-sum(lengths) // capacity) <= len(set(place.tolist())) or not lengths
    for b in set(place.tolist()):
        own = sorted((int(offset[i]), lengths[i]) for i in range(len(lengths)) if place[i] == b)
        assert [a for a, _ in own] == [sum(n for _, n in own[:i]) for i in range(len(own))] and sum(n for _, n in own) <= capacity


# --- op12 ----------------------------------------------------------------------------------

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def ranked(docs, items, k=50):
    """``(item, rank, doc, score)``; documents and items are (key, text)."""
    counts = [(key, collections.Counter(TERM.findall(brute.low(t)))) for key, t in docs]
    counts = [(key, c) for key, c in counts if c]
    n_docs, n_terms = len(counts), sum(sum(c.values()) for _, c in counts)
    df = collections.Counter(t for _, c in counts for t in c)
    for item, text in items:
        asked = {t: math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) for t in set(TERM.findall(brute.low(text))) if df[t]}
        found = []
        for key, c in counts:
            m = 100 - 50 + (50 * sum(c.values()) * n_docs) // n_terms
            score = sum(w * (1000000000 * c[t] // (1000 * c[t] + 20 * m)) for t, w in asked.items() if t in c)
            if score > 0:
                found.append((-score, key is not None, key or 0, key))
        for rank, (score, _, _, key) in enumerate(sorted(found)[:k], 1):
            yield item, rank, key, -score


def rows_of(df):
    return sorted((tuple(r) for r in df.select("item_id", "rank", "doc_id", "score").collect()), key=str)


def test_op12(spark, sf_dir, docs):
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet").select("item_id", "text").collect()
    want = ranked([(r["doc_id"], r["text"]) for r in docs.collect()], items)
    assert rows_of(queries.op12_threshold_search(spark, sf_dir)) == sorted(want, key=str)


@pytest.mark.parametrize("segment_terms, turn", [(50, 1), (100_000, 64)])
def test_op12_odd(spark, odd_docs, no_docs, monkeypatch, segment_terms, turn):
    """Ties, repeated rows, null ids, many segments, blocks of one query, repeated and null items."""
    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    more = [(100 + i, f"cat {'dog ' * (i % 5)} été{i % 7}") for i in range(200)]
    all_docs = odd_docs.select("doc_id", "text", F.lit(1).alias("rank"), F.lit(2).alias("item_id")).union(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "1", "2"))
    items = [("a", "Cat dog ÉTÉ été3 the THE"), ("a", "cat dog"), (None, "words here"), ("b", None), ("c", "!!"), ("d", "unknownword"), ("e", "alpha delta x 😀")]
    table = spark.createDataFrame([(*i, "clash") for i in items], "item_id string, text string, score string")
    index = lexical.build_index(all_docs, segment_terms=segment_terms)
    best = lexical.Segment.best
    monkeypatch.setattr(lexical, "TURN", turn)
    monkeypatch.setattr(lexical.Segment, "best", lambda self, terms, k, floor: best(self, terms, k, floor, turn=turn))
    want = sorted(ranked(texts + more, items, 7), key=str)
    for block_bytes in (1, 1 << 20):
        assert rows_of(lexical.search(index, table, k=7, block_bytes=block_bytes, first=2)) == want
    index.release()
    assert lexical.rank_documents(no_docs, table).count() == 0
    assert lexical.rank_documents(all_docs, table.limit(0)).count() == 0


def test_threshold_stops_early_and_keeps_ties():
    import pyarrow as pa

    seg = lexical._Counts()
    for i in range(4000):
        seg.add(i, "rare " * (1 + (i % 997 == 5)) * (i % 50 == 5) + "common " * (1 + i % 3) + f"w{i}")
    row = seg.row(pa.int64())
    sizes, starts, numbers, counts = (np.frombuffer(row.column(c)[0].as_py(), t) for c, t in (("sizes", "<i8"), ("starts", "<i4"), ("numbers", "<i4"), ("counts", "<i4")))
    doc = np.repeat(np.arange(len(sizes), dtype="<i4"), np.diff(starts))
    impacts = lexical.impact(counts.astype(np.int64), lexical.length_factor(sizes, 4000, int(sizes.sum()))[doc]).astype("<i4")
    order = np.lexsort((doc, -impacts, numbers))
    names = ["keys", "terms", "dfs", "starts", "numbers", "impacts", "docs", "sorted"]
    columns = [row.column(c) for c in names[:5]] + [pa.array([a.tobytes()]) for a in (impacts, doc[order], impacts[order])]
    opened = lexical.Segment(pa.RecordBatch.from_arrays(columns, names=names))
    terms = [(opened.number[t], w) for t, w in ((b"rare", 4000), (b"common", 10))]
    docs, scores = opened.best(terms, 10, 0, turn=8)
    exact = np.bincount(doc, weights=np.select([numbers == terms[0][0], numbers == terms[1][0]], [4000, 10]) * impacts, minlength=4000).astype(np.int64)
    tenth = np.sort(exact)[-10]
    assert sorted(docs.tolist()) == np.flatnonzero(exact >= tenth).tolist() and (exact[docs] == scores).all()
    assert opened.entries < 400 < 4080  # of 4,080 entries of the two lists
    high, _ = opened.best(terms, 10, int(exact.max()), turn=8)
    assert high.tolist() == np.flatnonzero(exact == exact.max()).tolist()


# --- op13 ----------------------------------------------------------------------------------


def counted(docs):
    n = collections.Counter()
    for key, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = brute.low(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: c for w, c in n.items() if len(w) >= 6 and c >= 5}


def near(a, b):
    """Exactly one inserted, deleted or replaced code point."""
    if len(a) > len(b):
        a, b = b, a
    i = 0
    while i < len(a) and a[i] == b[i]:
        i += 1
    return a != b and (a[i + 1 :] == b[i + 1 :] if len(a) == len(b) else len(a) + 1 == len(b) and a[i:] == b[i + 1 :])


def grouped(n):
    close = {w: [] for w in n}
    for w in n:
        for x in n:
            if abs(len(w) - len(x)) < 2 and near(w, x):
                close[w].append(x)
    form = {}
    for w, own in close.items():
        best = min(own, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 5 * n[w] else None
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        yield w, form[w], root, n[w], len(close[w]), n[form[w]] if form[w] else None


def test_op13(spark, sf_dir, docs):
    got = queries.op13_spelling_variants(spark, sf_dir).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got)) == sorted(grouped(counted([(r["doc_id"], r["text"]) for r in docs.collect()])))


def test_op13_odd(spark, odd_docs, no_docs):
    def run(df):
        return variants.group_variants(variants.word_counts(df, misspell_every=199))

    texts = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    letters = "ab" * 20_000  # deletions of it would take 800 MB
    more = [(i, f"Banana banana, BANANA×x ÀÉÎÕÜß bananas {letters} {letters[1:]}") for i in range(300, 306)]
    rows = odd_docs.select("doc_id", "text", F.lit(1).alias("word"), F.lit(2).alias("n")).union(spark.createDataFrame(more, "doc_id long, text string").selectExpr("*", "1", "2"))
    got = run(rows).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(grouped(counted(texts + more)), key=str)
    assert run(no_docs).count() == 0


def test_variants_of_all_lengths(spark):
    """Chains of forms, runs of one letter, words around the length from which halves are used, ties."""
    random.seed(5)
    n = {}
    for size in (6, 7, 12, 63, 64, 65, 66, 90):
        base = "".join(random.choice("aab") for _ in range(size))
        seen = {base}
        for _ in range(25):
            w = random.choice(sorted(seen))
            i = random.randrange(len(w))
            seen.add(random.choice([w[:i] + w[i + 1 :], w[:i] + random.choice("abÿ") + w[i:], w[:i] + random.choice("abc") + w[i + 1 :]]))
        n |= {w: 5 ** random.randrange(1, 9) for w in sorted(seen)}
    n |= {"chaina" + "x" * i: 5 ** (9 - i) for i in range(8)}
    words = spark.createDataFrame([(w, c, "clash") for w, c in n.items()] + [(None, 7, "clash")], "word string, n long, form string")
    got = variants.group_variants(words).select("word", "form", "root", "n", "n_near", "form_n").collect()
    assert sorted(map(tuple, got), key=str) == sorted(grouped(n), key=str)
    with pytest.raises(ValueError):
        variants.group_variants(words, factor=1)
