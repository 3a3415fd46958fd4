"""The pipeline against a brute-force version of its stages."""

import numpy as np
import public_tokenizers
import pytest
import tiktoken

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from foliospark.llm import langid  # noqa: E402

from . import brute  # noqa: E402

ENGLISH = "the quick brown fox of the hill and the lazy dog that lay in the sun for a day"


def shingles(text, k=5):
    words = brute.low(text).split()
    return {" ".join(words[i : i + k]) for i in range(max(1, len(words) - k + 1))}


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory, docs):
    rng = np.random.default_rng(1)
    words = ENGLISH.split()
    text = lambda n: " ".join(words[i] + str(int(rng.integers(0, 40))) * int(rng.integers(0, 2)) for i in rng.integers(0, len(words), n))
    passage = text(40)
    long = text(300)
    rows = [(i, text(60), "en", f"s{i % 4}") for i in range(20)]
    rows += [(100, long, "en", "s1"), (99, long, "en", "s2"), (101, long + " end", "en", "s3"), (None, long, "en", "s3")]
    rows += [(102, text(100) + " " + passage, "en", "s1"), (103, text(1500) + " " + passage, "en", "s1")]
    rows += [(104, text(30) + " token=live12345", "en", "s1"), *[(105 + i, text(30) + " token=example99", "en", f"s{i}") for i in range(3)]]
    rows += [(110, None, "en", "s1"), (111, "", "en", "s1"), (112, "12 34 %%", "en", "s1"), (113, rows[0][1][:50] + " again", "en", "s2"), (113, rows[1][1][:50] + " more", "en", "s2")]
    rows += [(114, rows[2][1] + " twice", "en", "s1")] * 2
    folder = tmp_path_factory.mktemp("corpus")
    df = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], docs.schema)
    df.write.parquet(f"file://{folder}/documents.parquet")
    spark.createDataFrame([(1, passage), (2, "short one")], "item_id long, text string").write.parquet(f"file://{folder}/benchmark.parquet")
    return f"file://{folder}", rows, passage


def test_stages_take_effect_and_keep_columns(spark, corpus, docs):
    folder, rows, passage = corpus
    seen = {}
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns = docs.columns
    for name, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.materialize(stage(spark, docs, folder), f"test-{name}")
        seen[name] = docs.collect()
        assert docs.columns == columns or name == "byte_bpe"
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["language_id", "simhash_dedup", "decontamination", "secret_scans", "byte_bpe"]

    kept = [r for r in rows if r[1] and langid.ngrams(r[1])[0].size]
    assert sorted(map(str, (r["doc_id"] for r in seen["language_id"]))) == sorted(str(r[0]) for r in kept)

    sets = [shingles(r[1]) for r in kept]
    order = [(r[0] is None, r[0] or 0, i) for i, r in enumerate(kept)]
    least = brute.components(order, lambda i, j: 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]))
    unique = [r for i, r in enumerate(kept) if least[i] == order[i]]
    text = lambda rows: sorted((str(r[0]), r[1]) for r in rows)
    assert text((r["doc_id"], r["text"]) for r in seen["simhash_dedup"]) == text(unique)

    bad = [b for *_, b in brute.contamination([r[1] for r in unique], [(1, passage), (2, "short one")])]
    clean = [r for r, b in zip(unique, bad) if not b]
    assert len(clean) < len(unique) and text((r["doc_id"], r["text"]) for r in seen["decontamination"]) == text(clean)

    scanned = {r["doc_id"]: r for r in seen["secret_scans"]}
    assert "[secret:assign]" in scanned[104]["text"] and "live12345" not in scanned[104]["text"] and "example99" in scanned[105]["text"]
    assert len(seen["secret_scans"]) == len(clean) and all(r["n_chars"] == len(r["text"]) for r in seen["secret_scans"])

    reference = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=brute.ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    want = sorted((str(r["doc_id"]), np.array(reference.encode_ordinary(r["text"]), "<u4").tobytes()) for r in seen["secret_scans"])
    assert sorted((str(r["doc_id"]), bytes(r["ids"])) for r in seen["byte_bpe"]) == want and all(r["exact"] for r in seen["byte_bpe"])


def test_stages_keep_columns_named_like_their_own(spark, corpus):
    folder = corpus[0]
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for clash in ("language", "row_name", "encoded", "key", "text_hash", "kept", "n_words", "segment", "_row_name"):
        docs = docs.selectExpr("*", f"'clash' as {clash}")
    for name, stage in corpus_pipeline.STAGES:
        out = corpus_pipeline.materialize(stage(spark, docs, folder), f"clash-{name}")
        if name != "byte_bpe":
            assert out.columns == docs.columns and {r["row_name"] for r in out.select("row_name").distinct().collect()} == {"clash"}
    assert out.count() == docs.count()


def test_run_gives_the_last_stage(spark, corpus):
    out = corpus_pipeline.run(spark, corpus[0])
    assert {"doc_id", "n_tokens", "ids"} <= set(out.columns) and out.count() > 10


def test_empty_corpus(spark, tmp_path, docs):
    spark.createDataFrame([], docs.schema).write.parquet(f"file://{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"file://{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, f"file://{tmp_path}").count() == 0
