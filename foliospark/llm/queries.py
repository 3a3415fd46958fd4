"""The queries ``opN_<name>``: each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontaminate, langid, lexical, packing, pq_dedup, secret_scan, sharding, simhash, token_rollup, token_store, variants, zip_warc
from .common import materialize, new_path


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All secrets of every document, judged by how many sources hold the same value.

    A source stands for an owner; a source's documents of one language for a repository.
    """
    docs = _table(spark, sf_dir, "documents")
    repo = F.concat_ws("/", "source", "lang")
    return secret_scan.digest(secret_scan.scan_secrets(docs, repo=repo, owner="source"))


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 contiguous shards of near-equal bytes."""
    return sharding.shard_by_bytes(_table(spark, sf_dir, "documents"), shards=16)


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate class of every document."""
    return simhash.near_duplicates(_table(spark, sf_dir, "documents"), words=4, radius=4)


def op4_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Encode and decode every whole text by the 50k rank file."""
    return bpe.round_trip_digests(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    )


def op5_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows of 13 words in every document, by the positional index."""
    return decontaminate.decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op6_zip_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page as a WARC record in a ZIP package, read back by range."""
    out = zip_warc.round_trip(_table(spark, sf_dir, "pages"))
    return out.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids in shards, read back through the perfect hash index."""
    return token_store.round_trip(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
    )


def op8_pq_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links and classes of all vectors at cosine 0.95."""
    return pq_dedup.near_duplicate_vectors(_table(spark, sf_dir, "embeddings"), threshold=0.95)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token totals of the corpus without exact copies, kept up by five batches.

    The first loads all documents counted by one tokenizer version, the second counts
    them by another with estimates of four bytes a token, the third revises these to the
    tokens counted, the fourth deletes all but the first of equal texts, and the fifth is
    the fourth sent again, which changes nothing.
    """
    versions = {v: public_tokenizers.path(f"{v}.tiktoken") for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text", "source", "lang")
    counted = token_rollup.with_token_counts(docs, "n", versions, public_tokenizers.PATTERN)
    body = F.coalesce("text", F.lit(""))
    guess = F.ceil(F.octet_length(body) / 4).cast("long").alias("guess")
    counted = materialize(counted.select("doc_id", "source", "lang", "n", guess, F.sha2(body, 256).alias("sha")), "token-counts")
    rollup = token_rollup.Rollup(spark, new_path(spark, "rollup"))
    by = lambda df, v: df.select("source", "lang", F.lit(v).alias("version"), F.col("n")[v].alias("n_tokens"))
    one, other = versions
    guessed = counted.select("source", "lang", F.lit(other).alias("version"), F.col("guess").alias("old_tokens"), F.col("n")[other].alias("n_tokens"))
    rollup.commit(f"load-{one}", token_rollup.inserts(by(counted, one)))
    rollup.commit(f"load-{other}", token_rollup.inserts(guessed.withColumn("n_tokens", F.col("old_tokens"))))
    rollup.commit(f"recount-{other}", token_rollup.revisions(guessed))
    # all copies less the first of each text: sums alone, no join on a text that may be everywhere
    place = F.struct(F.col("doc_id").isNull().alias("unknown"), "doc_id", "source", "lang")
    first = counted.groupBy("sha").agg(F.min_by(F.struct("source", "lang", "n"), place).alias("f")).select("f.*")
    changes = None
    for v in versions:
        signed = token_rollup.deletes(by(counted, v)).unionByName(token_rollup.inserts(by(first, v)))
        changes = signed if changes is None else changes.unionByName(signed)
    for _ in range(2):
        rollup.commit("exact-copies", changes)
    return rollup.totals()


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document by rank-order profiles."""
    return langid.identify(_table(spark, sf_dir, "documents"))


def op11_swap_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents packed into sequences of 1024 tokens by best fit and swaps."""
    return packing.pack_documents(
        _table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN, end_id=2, capacity=1024
    )


def op12_threshold_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best documents of every benchmark item by the threshold algorithm."""
    return lexical.rank_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), k=50)


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of all documents, of which some are misspelled by rule, led to their frequent forms."""
    words = variants.word_counts(_table(spark, sf_dir, "documents"), least_length=6, least_count=5, misspell_every=199)
    return variants.group_variants(words, factor=5)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scans": op1_secret_scans,
    "op2_sharding": op2_sharding,
    "op3_simhash": op3_simhash,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_decontamination": op5_decontamination,
    "op6_zip_warc": op6_zip_warc,
    "op7_token_store": op7_token_store,
    "op8_pq_dedup": op8_pq_dedup,
    "op9_token_counts": op9_token_counts,
    "op10_language_id": op10_language_id,
    "op11_swap_packing": op11_swap_packing,
    "op12_threshold_search": op12_threshold_search,
    "op13_spelling_variants": op13_spelling_variants,
}

#: SQL has no XXH64, tokenizers or archives: the other operators are tested against
#: brute force, exact round trips and held-out accuracy in tests/llm.
ORACLES: dict[str, str] = {
    "op12_threshold_search": r"""
WITH words AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM documents),
tf AS (SELECT doc_id, term, count(*) AS tf FROM words GROUP BY ALL),
size AS (SELECT doc_id, sum(tf)::BIGINT AS n FROM tf GROUP BY ALL),
corpus AS (SELECT count(*) AS n_docs, sum(n)::BIGINT AS n_terms FROM size),
weight AS (SELECT term, floor(1000 * ln((2 * max(n_docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM tf, corpus GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
scored AS (
  SELECT item_id, doc_id, sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM asked JOIN tf USING (term) JOIN weight USING (term) JOIN size USING (doc_id), corpus
  GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
""",
    "op13_spelling_variants": r"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(4), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) ORDER BY b) AS tab
  FROM range(16) AS halves(b)),
runs AS (
  SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS run, count(*) AS n
  FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-z\x{C0}-\x{FF}]{6,}')) AS run FROM documents) GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(list_reduce(
    list_transform(string_split(regexp_replace(hex(encode(concat(doc_id, ':', run))), '(.)(.)', '\2\1', 'g'), ''), lambda x: strpos('0123456789ABCDEF', x) - 1),
    lambda h, half: xor(h >> 4, tab[1 + (xor(h, half) & 15)]), 4294967295), 4294967295) AS h FROM runs, crc),
counted AS (
  SELECT CASE WHEN h % 199 = 0 THEN concat(substring(run, 1, h % length(run)), substring(run, h % length(run) + 2)) ELSE run END AS word, sum(n)::BIGINT AS n
  FROM hashed GROUP BY 1),
words AS (SELECT word, n FROM counted WHERE n >= 5 AND length(word) >= 6),
cut AS (SELECT word, n, i, concat(substring(word, 1, i - 1), substring(word, i + 1)) AS key FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.key = b.key AND a.i = b.i AND a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN words b ON a.key = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN words b ON a.key = b.word),
best AS (SELECT word, n, count(*) AS n_near, arg_min(near, (-near_n, near)) AS near, max(near_n) AS near_n FROM near GROUP BY word, n),
formed AS (
  SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * w.n THEN near END AS form, CASE WHEN near_n >= 5 * w.n THEN near_n END AS form_n
  FROM words w LEFT JOIN best b ON b.word = w.word),
led AS (
  SELECT word, word AS at FROM formed
  UNION ALL SELECT l.word, f.form FROM led l JOIN formed f ON f.word = l.at WHERE f.form IS NOT NULL),
root AS (SELECT l.word, l.at AS root FROM led l JOIN formed f ON f.word = l.at WHERE f.form IS NULL)
SELECT word, form, root, n, n_near, form_n FROM formed JOIN root USING (word)
""",
}
