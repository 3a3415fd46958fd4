"""Registered queries that no SQL expresses, against plain Python over whole tables."""

import collections
import math

import numpy as np
import pytest
import xxhash

from foliospark.operators.chunking import split_text
from foliospark.plans.catalog import ORACLES, QUERIES
from foliospark.streaming.sentences import segment

COMPARED = {"split_chunks", "build_chunks", "sentences", "sentences_sql", "library_nearest_probed", "ask_routed"}


def test_every_query_is_compared():
    assert set(QUERIES) - set(ORACLES) == COMPARED


def test_split_chunks(spark, sf_dir):
    want = [(r["doc_id"], i, c) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect() for i, c in enumerate(split_text(r["text"] or ""))]
    got = [(r["doc_id"], r["sub_index"], r["chunk_text"]) for r in QUERIES["split_chunks"](spark, sf_dir).collect()]
    assert sorted(got) == sorted(want) and all(len(c) <= 800 and c == c.strip() for *_, c in want)


def test_build_chunks(spark, sf_dir):
    groups = sorted(QUERIES["heading_groups"](spark, sf_dir).collect(), key=lambda r: (r["book_title"], r["group_index"]))  # equal to its SQL
    want, at = set(), collections.Counter()
    for g in groups:
        for i, text in enumerate(split_text(g["text"])):
            slug = g["book_title"].lower().replace(" ", "_")
            want.add((f"{slug}_p{g['page_number']}_g{g['group_index']}_c{i}", text, g["book_title"], g["chapter"], g["section"], g["page_number"], i, at[g["book_title"]]))
            at[g["book_title"]] += 1
    assert set(map(tuple, QUERIES["build_chunks"](spark, sf_dir).collect())) == want


def plain_sentences(text):
    """Character by character: an end is a mark before white space or the text's end; a false end is passed over once."""
    out, start, passed, i = [], 0, 0, 0
    while i < len(text):
        if text[i] in ".!?" and (i + 1 == len(text) or text[i + 1].isspace()):
            candidate = text[start : i + 1].strip()
            if not false_end(candidate):
                out.append(candidate)
                start, passed = i + 2, 0
                i += 1
            else:
                passed += 1
                if passed == 2:  # the text waits for more, which never comes
                    break
        i += 1
    return out + ([text[start:].strip()] if text[start:].strip() else [])


def false_end(s):
    low = s.lower()
    last = low.split()[-1] if low.split() else ""
    if last.endswith(("e.g.", "i.e.")) and (len(last) == 4 or not (last[-5].isalnum() or last[-5] == "_")):
        return True
    digits = s[:-1]
    n = len(digits) - len(digits.rstrip("0123456789"))
    if s.endswith(".") and n and (len(digits) == n or not (digits[-n - 1].isalnum() or digits[-n - 1] == "_")):
        return True
    body = low.rstrip("0123456789").rstrip()
    return body.endswith("p.") and (len(body) == 2 or not (body[-3].isalnum() or body[-3] == "_"))


def test_sentences(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").collect()
    want = [(r["conv_id"], r["turn"], i, s) for r in rows for i, s in enumerate(segment([r["text"]]) if r["text"] else [])]
    got = list(map(tuple, QUERIES["sentences"](spark, sf_dir).collect()))
    assert sorted(got) == sorted(want)
    for r in rows:
        assert segment([r["text"] or ""]) == plain_sentences(r["text"] or "")
    for t in ("See p. 3. Yes. No", "e.g. this. i.e. that! ok", "It has 3. Then? p.4. Done. And e.g. more. x", "a.b. c. 12.", "p.", "step 1. go. step 2. 3. stop. never", "Mr. p. No."):
        assert segment([t]) == plain_sentences(t), t


def test_sentences_sql(spark, sf_dir):
    turns = collections.defaultdict(list)
    for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").orderBy("conv_id", "turn").collect():
        turns[r["conv_id"]].append("" if r["text"] is None else r["text"] + " ")
    want = [(c, i, s) for c, pieces in turns.items() for i, s in enumerate(segment(pieces))]
    assert sorted(map(tuple, QUERIES["sentences_sql"](spark, sf_dir).collect())) == sorted(want)


def test_library_nearest_probed(spark, sf_dir):
    """Against the exact search, which equals its SQL: what is found of it, and the order of what is in both."""
    exact, some = (collections.defaultdict(list), collections.defaultdict(list))
    for name, out in (("library_nearest", exact), ("library_nearest_probed", some)):
        for r in QUERIES[name](spark, sf_dir).orderBy("query_id", "rank0").collect():
            out[r["query_id"]].append(r["chunk_id"])
    assert set(some) == set(exact)
    both = {q: collections.Counter(exact[q]) & collections.Counter(some[q]) for q in exact}  # two books may have chunks of one id
    assert sum(n.total() for n in both.values()) >= 0.9 * sum(map(len, exact.values()))
    for q, own in both.items():
        assert [c for c in exact[q] if c in own] == [c for c in some[q] if c in own]


def hashed(text):
    v = np.zeros(64)
    for w in text.lower().split(" "):
        h = xxhash.xxh64_intdigest(w.encode(), 42)
        v[(h - (1 << 64) if h >> 63 else h) % 64] += 1
    return (v / math.sqrt((v * v).sum())).astype(np.float32).astype(float)


def plain_scores(texts):
    """BM25 of a question in every text, counted once for all questions."""
    counts = [collections.Counter((t or "").lower().split()) for t in texts]
    lengths = [c.total() for c in counts]
    n, avg = len(texts), sum(lengths) / len(texts)
    df = collections.Counter(w for c in counts for w in c)
    raw = {w: math.log(n - d + 0.5) - math.log(d + 0.5) for w, d in df.items()}
    mean = sum(raw.values()) / len(raw)
    weight = {w: 0.25 * mean if v < 0 else v for w, v in raw.items()}

    def scores(question):
        words = question.lower().split()
        return [round(sum(weight.get(w, 0) * c[w] * 2.5 / (c[w] + 1.5 * (0.25 + 0.75 * k / avg)) for w in words), 6) for c, k in zip(counts, lengths)]

    return scores


def test_ask_routed(spark, sf_dir):
    table = lambda n: spark.read.parquet(f"{sf_dir}/{n}.parquet").collect()
    docs = sorted(table("documents"), key=lambda r: r["doc_id"])
    vectors = {r["vec_id"]: np.array(r["embedding"], float) for r in table("embeddings")}
    books = {r["query_id"]: r["book_filter"] for r in QUERIES["route_book"](spark, sf_dir).collect()}  # equal to its SQL
    chapters = {}
    for r in docs:
        if r["lang"] not in chapters.setdefault(r["source"], []):
            chapters[r["source"]].append(r["lang"])
    got = collections.defaultdict(list)
    for r in QUERIES["ask_routed"](spark, sf_dir).collect():
        got[r["query_id"]].append(tuple(r))
    scores = plain_scores([r["text"] for r in docs])
    asked = [r for r in table("benchmark") if r["item_id"] in vectors]
    routed = 0
    for q in asked:
        i, book, chapter = q["item_id"], books[q["item_id"]], None
        if book is not None:
            found = sorted((-round(float(vectors[i] @ hashed(c)), 6), n, c) for n, c in enumerate(chapters[book])) if len(vectors[i]) == 64 else []
            if found and -found[0][0] >= 0.25 and (len(found) == 1 or found[1][0] >= 0 or -found[0][0] >= 1.15 * -found[1][0]):
                chapter = found[0][2]
        routed += book is not None
        mine = [n for n, r in enumerate(docs) if (book is None or r["source"] == book) and (chapter is None or r["lang"] == chapter)]
        lexical = scores(q["text"])
        lists = [
            sorted((n for n in mine if docs[n]["doc_id"] in vectors), key=lambda n: (-round(float(vectors[i] @ vectors[docs[n]["doc_id"]]), 6), n))[:20],
            sorted(mine, key=lambda n: (-lexical[n], n))[:20],
        ]
        total, first = collections.Counter(), {}
        for s, ranked in enumerate(lists):
            for rank, n in enumerate(ranked):
                total[n] += 1 / (60 + rank)
                first.setdefault(n, (s, rank))
        name = lambda n: f"{docs[n]['source'].lower().replace(' ', '_')}_p{docs[n]['doc_id']}_g0_c0"
        best = sorted(total, key=lambda n: (-round(total[n], 12), first[n]))[:6]
        want = [(i, p, name(n), pytest.approx(round(total[n], 5)), book, chapter) for p, n in enumerate(best, 1)]
        assert sorted(got[i], key=lambda r: r[1]) == want, i
    assert asked and routed
