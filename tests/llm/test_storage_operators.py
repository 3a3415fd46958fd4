"""Sharding, archives, the token store, vectors, rollups, and the pipeline."""

import base64
import hashlib
import io
import zipfile
import zlib
from urllib.parse import quote

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from foliospark.llm import pq_dedup, queries, sharding, token_rollup, token_store, zip_warc

from . import brute

JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN


# --- op2 -----------------------------------------------------------------------------------


def check_shards(rows, texts, shards):
    """Rows in key order against the law: contiguous, near-equal bytes, gapless slots."""
    assert [r["size"] for r in rows] == [len((t or "").encode()) + 1 for t in texts]
    assert [r["text_crc32"] for r in rows] == [zlib.crc32((t or "").encode()) for t in texts]
    numbers = [r["shard"] for r in rows]
    assert numbers == sorted(numbers) and set(numbers) <= set(range(shards))
    for s in set(numbers):
        assert [r["slot"] for r in rows if r["shard"] == s] == list(range(numbers.count(s)))
    total, largest = sum(r["size"] for r in rows), max(r["size"] for r in rows)
    for s in range(shards):
        assert abs(sum(r["size"] for r in rows if r["shard"] == s) - total / shards) <= largest
    assert all(r["law"] == "bytes" and r["grown_shard"] is None for r in rows)


def test_op2(spark, sf_dir, docs):
    texts = [r["text"] for r in docs.orderBy("doc_id").collect()]
    check_shards(queries.op2_sharding(spark, sf_dir).orderBy("doc_id").collect(), texts, 16)


@pytest.mark.parametrize("ranges", [1, 7])
def test_op2_odd(odd_docs, no_docs, ranges):
    got = sharding.shard_by_bytes(odd_docs, shards=3, ranges=ranges).orderBy("byte_start").collect()
    want = sorted(odd_docs.select("doc_id", "text").collect(), key=lambda r: (r[0] is not None, r[0] or 0, len((r[1] or "").encode()), zlib.crc32((r[1] or "").encode())))
    assert [r["doc_id"] for r in got] == [r["doc_id"] for r in want]
    check_shards(got, [r["text"] for r in want], 3)
    assert sharding.shard_by_bytes(no_docs).count() == 0


def test_op2_runs_no_python(spark, odd_docs, tmp_path, monkeypatch):
    plans = []
    stored = sharding.materialize

    def seen(df, name):
        plans.append(df._jdf.queryExecution().toString())
        return stored(df, name)

    monkeypatch.setattr(sharding, "materialize", seen)
    odd_docs.write.parquet(f"{tmp_path}/docs")
    plans.append(sharding.shard_by_bytes(spark.read.parquet(f"{tmp_path}/docs"))._jdf.queryExecution().toString())
    assert len(plans) == 4 and not any(w in p for p in plans for w in ("Python", "Pandas", "Arrow"))


def test_op2_equal_rows_are_dealt_to_all_ranges(spark, monkeypatch):
    """Rows equal in all but their number, as nulls may be: no range takes them all."""
    rows = spark.range(1000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(None).cast("string").alias("text"))
    parts = []
    stored = sharding.materialize

    def seen(df, name):
        out = stored(df, name)
        if name == "ranged":
            parts.extend(r["count"] for r in out.groupBy("_range").count().collect())
        return out

    monkeypatch.setattr(sharding, "materialize", seen)
    check_shards(sharding.shard_by_bytes(rows, shards=4, ranges=4).orderBy("byte_start").collect(), [None] * 1000, 4)
    assert len(parts) == 4 and max(parts) < 500


# --- op6 -----------------------------------------------------------------------------------


def test_op6(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").collect()
    got = {r["page_id"]: r for r in queries.op6_zip_warc(spark, sf_dir).collect()}
    last = {}
    for p in sorted(pages, key=lambda p: p["page_id"]):
        last[p["html"]] = p["page_id"]
    for p in pages:
        raw, g, largest = (p["html"] or "").encode(), got[p["page_id"]], last[p["html"]]
        assert (g["payload_bytes"], g["payload_digest"]) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode())
        assert (g["record_type"], g["refers_to"]) == (("response", None) if largest == p["page_id"] else ("revisit", largest))


def test_op6_odd(spark):
    rows = [(1, "http://a\nb", "same"), (2, None, "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (None, "u", "lone"), (5, "u", "é😀\r\n\r\nWARC/1.1\r\n" * 50), (6, "u", "x" * 300_000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("uri", F.lit("clash")).withColumn("sha", F.lit("clash"))
    got = sorted(map(str, (tuple(r)[:5] for r in zip_warc.round_trip(df).collect())))
    want = []
    for key, _, html in rows:
        raw = (html or "").encode()
        largest = max((k for k, _, h in rows if (h or "") == (html or "") and k is not None), default=None)
        alone = largest is None or key == largest
        want.append((key, len(raw), zip_warc.digest(raw), "response" if alone else "revisit", None if alone else largest))
    assert got == sorted(map(str, want))
    few = zip_warc.round_trip(df, min_bytes=1)
    assert {r["record_type"] for r in few.where("payload_bytes = 0").collect()} == {"response"}
    assert zip_warc.round_trip(df.limit(0)).count() == 0


def archive(records):
    return [zip_warc.Packed(zip_warc.build_record(str(i), "u", r), "u", zip_warc.digest(r), "response") for i, r in enumerate(records)]


def test_reads_by_range_only(tmp_path):
    path = tmp_path / "a.wacz"
    path.write_bytes(zip_warc.package(archive([b"one", b"two" * 1000, b""])))
    assert [r.payload for r in zip_warc.read_archive(f"file://{path}")] == [b"one", b"two" * 1000, b""]
    assert zip_warc.read_one(f"file://{path}", 1).payload == b"two" * 1000
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None and {i.compress_type for i in z.infolist()} == {zipfile.ZIP_STORED}


def test_zip64(tmp_path, monkeypatch):
    monkeypatch.setattr(zipfile, "ZIP64_LIMIT", 50)
    monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
    raw = zip_warc.package(archive([b"x" * 500, b"y"]))
    assert b"PK\x06\x06" in raw and b"PK\x06\x07" in raw
    path = tmp_path / "big.wacz"
    path.write_bytes(raw)
    assert [r.payload for r in zip_warc.read_archive(f"file://{path}")] == [b"x" * 500, b"y"]


def test_damaged_archives(tmp_path):
    def read(raw):
        (tmp_path / "x").write_bytes(raw)
        return list(zip_warc.read_archive(f"file://{tmp_path}/x"))

    good = zip_warc.package(archive([b"payload"]))
    with pytest.raises(ValueError):
        read(good[:-30])
    with pytest.raises(ValueError):
        read(b"")
    compressed = io.BytesIO()
    with zipfile.ZipFile(compressed, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr(zip_warc.RECORDS, archive([b"p"])[0].raw)
        z.writestr(zip_warc.INDEX, "")
    with pytest.raises(ValueError, match="compressed"):
        read(compressed.getvalue())
    commented = io.BytesIO(good)
    with zipfile.ZipFile(commented, "a") as z:
        z.comment = b"a comment with PK\x05\x06 in it"
    assert read(commented.getvalue())[0].payload == b"payload"


def other_package(path, names, index, how=zipfile.ZIP_STORED):
    with zipfile.ZipFile(path, "w", how) as z:
        for name, raw in names.items():
            z.writestr(name, raw)
        for name, raw in index.items():
            z.writestr(name, raw)
    return f"file://{path}"


def test_reads_packages_of_other_writers(spark, tmp_path):
    one, two = (zip_warc.build_record(k, f"http://{k}.org/", k.encode() * 9) for k in "ab")
    info = zip_warc.zlib.compressobj(6, zip_warc.zlib.DEFLATED, 31)
    info = info.compress(b"WARC/1.0\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>\r\nContent-Length: 4\r\n\r\nx: y\r\n\r\n") + info.flush()
    plain = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: 23\r\n\r\nHTTP/1.1 200 OK\r\n\r\nbody\r\n\r\n"
    cdx = f" CDX N b a m s k r M S V g\norg,a)/ 20200101000000 http://a.org/ text/html 200 X - - {len(one)} {len(info)} rec-1.warc.gz\n"
    cdxj = f'!meta {{}}\norg,b)/ 20200101000000 {{"url": "http://b.org/", "filename": "rec-2.warc.gz", "offset": "0", "length": {len(two)}}}\n'
    more = f'com,c)/ 2020 {{"filename": "rec-3.warc", "offset": "0", "length": "{len(plain)}"}}\nwarcinfo 2020 {{"filename": "rec-1.warc.gz", "offset": 0, "length": {len(info)}}}\n'
    uri = other_package(tmp_path / "o.wacz", {"archive/rec-1.warc.gz": info + one, "archive/rec-2.warc.gz": two, "archive/rec-3.warc": plain, "pages/pages.jsonl": b""}, {"indexes/a.cdx": cdx, "indexes/b.cdxj": cdxj, "indexes/c.cdx.gz": zip_warc.gzip.compress(more.encode())})
    assert [(r.headers["warc-record-id"], r.payload) for r in zip_warc.read_archive(uri)] == [("<urn:uuid:1>", b"x: y"), ("<urn:page:key:a>", b"a" * 9), ("<urn:page:key:b>", b"b" * 9), ("<urn:uuid:2>", b"body")]
    rows = zip_warc.read_archives(spark.createDataFrame([(uri,)], "uri string"), "string").collect()
    assert sorted((str(r["page_id"]), r["payload_bytes"], r["record_type"]) for r in rows) == [("None", 4, "response"), ("a", 9, "response"), ("b", 9, "response")]


@pytest.mark.parametrize("index", ["", "org,a)/ 2020 nothing", 'a 2020 {"filename": "x.warc.gz", "offset": 0, "length": 3}', 'a 2020 {"filename": "a.warc.gz", "offset": 0, "length": 3000}', 'a 2020 {"filename": "a.warc.gz", "offset": 0, "length": 2}'])
def test_broken_packages_are_value_errors(tmp_path, index):
    names = {"archive/a.warc.gz": b"\x1f\x8bzz"} if index else {"data/a.warc.gz": b""}
    with pytest.raises(ValueError):
        list(zip_warc.read_archive(other_package(tmp_path / "b.wacz", names, {"indexes/i.cdxj": index})))


def test_op6_repeated_payloads_meet_at_every_size(spark):
    """A third of all rows hold one payload; the others are pairs and lone ones."""
    n = 900
    rows = [(i, "http://h/", "hot" if i % 3 == 0 else f"pair {i // 6 * 6}" if i % 3 == 1 else f"lone {i}") for i in range(n)]
    last = {}
    for i, _, h in rows:
        last[h] = i
    got = {r["page_id"]: (r["record_type"], r["refers_to"]) for r in zip_warc.round_trip(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {i: ("response", None) if last[h] == i else ("revisit", last[h]) for i, _, h in rows}
    assert zip_warc.surt("http://www.A.org:81/x y?q=1") == "org,a,www:81)/x%20y?q=1" and " " not in zip_warc.surt("no url [") and zip_warc.surt("http://[") == quote("http://[", safe="/:")


# --- op7 -----------------------------------------------------------------------------------


def check_store(got, rows):
    tokenizer = Tokenizer.from_file(JSON)
    ids = lambda t: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 0]
    want = sorted((str(k), len(ids(t)), zlib.crc32(np.array(ids(t), "<u4").tobytes())) for k, t in rows)
    assert sorted((str(r["doc_id"]), r["n_tokens"], r["ids_crc32"]) for r in got) == want
    ordered = sorted(got, key=lambda r: r["start"])
    assert [r["start"] for r in ordered] == np.cumsum([0, *(r["n_tokens"] for r in ordered)])[:-1].tolist()
    keys = [r["doc_id"] for r in ordered]
    assert keys == sorted(keys, key=lambda k: (k is not None, k or 0))


def test_op7(spark, sf_dir, docs):
    check_store(queries.op7_token_store(spark, sf_dir).collect(), [tuple(r) for r in docs.select("doc_id", "text").collect()])


def test_op7_odd(odd_docs, no_docs):
    check_store(token_store.round_trip(odd_docs, JSON, PATTERN).collect(), [tuple(r) for r in odd_docs.select("doc_id", "text").collect()])
    assert token_store.round_trip(no_docs, JSON, PATTERN).count() == 0


def test_op7_added_tokens_are_the_librarys(spark):
    t = "<|endoftext|>"
    texts = [f"a {t} b", t, t * 3, f"{t} it's\n\n {t}  x {t}", f"é😀{t}12 ", "<|endoftext |> <|endoftext", f"a  {t}\t b", " ", ""]
    tokenizer = Tokenizer.from_file(JSON)
    want = {i: [*tokenizer.encode(x, add_special_tokens=False).ids, 0] for i, x in enumerate(texts)}
    assert want[0] == [64, 220, 50256, 275, 0]
    got = token_store.round_trip(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), JSON, PATTERN).collect()
    assert {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in got} == {k: (len(v), zlib.crc32(np.array(v, "<u4").tobytes())) for k, v in want.items()}


def test_keyed_access(spark, docs):
    stored = token_store.write_shards(docs, JSON, PATTERN, ranges=3)
    manifest = stored.orderBy("shard").collect()
    tokenizer = Tokenizer.from_file(JSON)
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    assert len(manifest) == 3 and all(m["first_key"] <= m["last_key"] for m in manifest)
    assert all(a["last_key"] < b["first_key"] and a["first_id"] + a["n_ids"] == b["first_id"] for a, b in zip(manifest, manifest[1:]))
    found = 0
    for m in manifest:
        shard = token_store.Shard(m["uri"])
        first, run = shard.find([token_store.key_bytes(k) for k in texts])
        for k, f, n in zip(texts, first, run):
            one = shard.get(token_store.key_bytes(k))
            assert len(one) == n and (n > 0) == (m["first_key"] <= k <= m["last_key"])
            if n:
                found += 1
                want = [*tokenizer.encode(texts[k], add_special_tokens=False).ids, 0]
                assert shard.ids(int(f)).tolist() == want and one[0].tolist() == want
        strangers = shard.find([b"k-%d" % i for i in range(20_000)])[1]
        assert strangers.sum() <= 1  # a fingerprint of 32 bits
    assert found == len(texts)
    for k in (7, 150):
        assert [x.tolist() for x in token_store.look_up(stored, k)] == [[*tokenizer.encode(texts[k], add_special_tokens=False).ids, 0]]
    assert token_store.look_up(stored, -5) == [] and token_store.look_up(stored, None) == []


def test_keys_over_many_shards(spark, monkeypatch):
    """Small shards; one key holds most rows; nulls are a key too."""
    monkeypatch.setattr(token_store.ShardWriter, "full", lambda self: len(self.keys) >= 10)
    rows = [(None, f"null {i % 3}") for i in range(25)] + [("k", f"text {i % 5}") for i in range(60)] + [(f"x{i}", "a" * i) for i in range(15)]
    df = spark.createDataFrame(rows, "doc_id string, text string")
    check_store(token_store.round_trip(df, JSON, PATTERN).collect(), rows)
    stored = token_store.write_shards(df, JSON, PATTERN)
    assert len(token_store.look_up(stored, None)) == 25 and len(token_store.look_up(stored, "k")) == 60 and len(token_store.look_up(stored, "x3")) == 1 and not token_store.look_up(stored, "x")


def test_a_look_up_reads_no_more_in_a_larger_shard(tmp_path):
    def most(n):
        path = f"{tmp_path}/{n}.ids"
        with open(path, "wb") as out:
            writer = token_store.ShardWriter(out, np.dtype("<u2"))
            for i in range(n):
                writer.add(token_store.key_bytes(i), np.arange(5, dtype="<u2").tobytes())
            writer.close()
        reads = []
        for i in range(0, n, max(1, n // 300)):
            shard = token_store.Shard(f"file://{path}")
            assert shard.get(token_store.key_bytes(i))[0].tolist() == [0, 1, 2, 3, 4]
            reads.append(shard.bytes_read)
            shard.close()
        return sum(reads) / len(reads)

    small, large = most(1000), most(100_000)
    assert large < 2500 and large < 1.05 * small


@pytest.mark.parametrize("n", [0, 1, 2, 1000, 30_000])
def test_perfect_hash(n):
    keys = np.unique(np.random.default_rng(n).integers(0, 1 << 63, n, dtype=np.uint64))
    assert sorted(token_store.PerfectHash.build(keys)(keys).tolist()) == list(range(len(keys)))


# --- op8 -----------------------------------------------------------------------------------


def brute_links(x, threshold):
    ok = np.array([v is not None and len(v) > 0 and all(c is not None and np.isfinite(c) for c in v) and any(v) for v in x])
    linked = np.zeros((len(x), len(x)), bool)
    at = np.flatnonzero(ok)
    m = np.array([x[i] for i in at], float)
    m /= np.sqrt((m * m).sum(1))[:, None]
    linked[np.ix_(at, at)] = m @ m.T >= threshold
    np.fill_diagonal(linked, False)
    return linked


def compare_vectors(got, ids, x):
    linked = brute_links(x, 0.95)
    want = linked.sum(1)
    got = {r["vec_id"]: r for r in got}
    found = np.array([got[i]["n_links"] for i in ids])
    assert (found <= want).all() and found.sum() >= 0.99 * want.sum()
    comps = brute.components(list(ids), lambda i, j: linked[i, j])
    assert [got[i]["component_id"] for i in ids] == comps
    assert all(got[i]["kept"] == (got[i]["component_id"] == i) for i in ids)


def test_op8(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    got = queries.op8_pq_dedup(spark, sf_dir).collect()
    compare_vectors(got, [r["vec_id"] for r in rows], [r["embedding"] for r in rows])


@pytest.mark.parametrize("block", [16, 4096])
def test_op8_hot_groups_and_oddities(spark, block):
    rng = np.random.default_rng(3)
    centre = rng.normal(size=16)
    x = [(centre + 0.06 * rng.normal(size=16)).astype(np.float32).tolist() for _ in range(150)] + [rng.normal(size=16).astype(np.float32).tolist() for _ in range(150)]
    x += [x[0]] * 40 + [x[200]] * 3 + [[2 * float(c) for c in x[201]]]
    x += [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf"), *[0.0] * 15], [None, *[1.0] * 15]]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>").withColumn("cid", F.lit("clash")).withColumn("v", F.lit("clash"))
    got = pq_dedup.near_duplicate_vectors(df, block=block).collect()
    assert len(got) == len(x)
    compare_vectors(got, list(range(len(x))), x)
    assert pq_dedup.near_duplicate_vectors(df.limit(0)).count() == 0
    assert pq_dedup.near_duplicate_vectors(df.where("vec_id >= 344")).count() == 6
    short = spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0]), (None, [0.0, 1.0])], "vec_id long, embedding array<float>")
    assert sorted((str(r["vec_id"]), r["n_links"], r["kept"]) for r in pq_dedup.near_duplicate_vectors(short).collect()) == [("1", 1, True), ("2", 1, False), ("3", 0, True), ("None", 0, False)]


def test_op8_compares_vectors_of_each_length(spark):
    x = [[1.0, 2.0, 3.0], [1.0, 2.0, 3.1], [9.0, -1.0, 0.0], [1.0, 2.0], [2.0, 4.0], [1.0, 2.0], [5.0], [-5.0]]
    got = {r["vec_id"]: (r["n_links"], r["component_id"], r["kept"]) for r in pq_dedup.near_duplicate_vectors(spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<double>")).collect()}
    assert got == {0: (1, 0, True), 1: (1, 0, False), 2: (0, 2, True), 3: (2, 3, True), 4: (2, 3, False), 5: (2, 3, False), 6: (0, 6, True), 7: (0, 7, True)}


def test_op8_repeated_keys_are_vectors_of_their_own(spark):
    x = [(1, [1.0, 0.0]), (1, [1.0, 0.01]), (2, [1.0, 0.0]), (2, [0.0, 1.0])]
    got = sorted(tuple(r) for r in pq_dedup.near_duplicate_vectors(spark.createDataFrame(x, "vec_id long, embedding array<float>")).collect())
    assert got == [(1, 2, 1, True), (1, 2, 1, True), (2, 0, 2, True), (2, 2, 1, False)]


def test_classes_are_those_of_the_pairs():
    rng = np.random.default_rng(5)
    for n in (0, 1, 30, 300):
        a, b = rng.integers(0, 200, n), rng.integers(0, 200, n)
        nodes, roots = pq_dedup.classes(a, b)
        keys = sorted({*a.tolist(), *b.tolist()})
        pairs = {(x, y) for x, y in zip(a.tolist(), b.tolist())}
        want = dict(zip(keys, brute.components(keys, lambda i, j: (keys[i], keys[j]) in pairs or (keys[j], keys[i]) in pairs)))
        assert dict(zip(nodes.tolist(), roots.tolist())) == {k: r for k, r in want.items() if k != r}


def test_op8_two_levels_split_units_and_lists(spark):
    """Many lists, tiny blocks: units of several lists, split lists, several groups of visitors."""
    rng = np.random.default_rng(11)
    centres = rng.normal(size=(40, 12))
    x = [(centres[i % 40] + 0.1 * rng.normal(size=12)).astype(np.float32).tolist() for i in range(800)]
    df = spark.createDataFrame(list(enumerate(x)), "vec_id long, embedding array<float>")
    compare_vectors(pq_dedup.near_duplicate_vectors(df, lists=60, block=12, margin=0.16).collect(), list(range(len(x))), x)
    assert pq_dedup.units_of([5, 5, 30, 0, 4, 4], [1, 1, 1, 1, 1, 2], 12) == ([0, 0, 1, 2, 2, 3], [1, 1, 3, 1, 1, 1])


# --- op9 -----------------------------------------------------------------------------------


def test_op9(spark, sf_dir, docs):
    import tiktoken

    want, seen = {}, set()
    encoders = {v: tiktoken.Encoding(v, pat_str=PATTERN, mergeable_ranks=brute.ranks(public_tokenizers.path(f"{v}.tiktoken")), special_tokens={}) for v in ("byte_bpe_50k", "byte_bpe_multi_50k")}
    for r in docs.orderBy("doc_id").collect():
        if r["text"] not in seen:
            seen.add(r["text"])
            for v, e in encoders.items():
                n, t = want.get((r["source"], r["lang"], v), (0, 0))
                want[r["source"], r["lang"], v] = (n + 1, t + len(e.encode_ordinary(r["text"])))
    got = {(r["source"], r["lang"], r["version"]): (r["n_docs"], r["n_tokens"]) for r in queries.op9_token_counts(spark, sf_dir).collect()}
    assert got == want


def test_rollup_batches_count_once(spark, tmp_path):
    store = token_rollup.Rollup(spark, f"file://{tmp_path}/r")
    rows = lambda *r: spark.createDataFrame(r, "source string, lang string, version string, n_tokens long, old_tokens long")
    totals = lambda: sorted(tuple(map(str, r)) for r in store.totals().collect())
    assert totals() == []
    a, b = ("s", None, "v", 5, 0), ("s", "en", "v", 7, 4)
    assert store.commit("one/1", token_rollup.inserts(rows(a, b, b))) and not store.commit("one/1", token_rollup.inserts(rows(a)))
    assert totals() == [("s", "None", "v", "1", "5"), ("s", "en", "v", "2", "14")]
    store.commit("two", token_rollup.revisions(rows(b)))
    store.commit("three", token_rollup.deletes(rows(a)))
    want = [("s", "en", "v", "2", "17")]
    assert totals() == want and store.compact() and totals() == want
    assert not store.commit("two", token_rollup.deletes(rows(b))) and not store.compact()
    store.commit("four", token_rollup.inserts(rows(a)))
    assert store.compact() and len(totals()) == 2 and not store.commit("four", token_rollup.inserts(rows(a)))
    store.commit("empty", token_rollup.inserts(rows(a).limit(0)))
    assert len(totals()) == 2


def test_of_two_compactions_one_counts(spark, tmp_path):
    one, two = (token_rollup.Rollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    rows = spark.createDataFrame([("s", "en", "v", 5)], "source string, lang string, version string, n_tokens long")
    for name in "ab":
        one.commit(name, token_rollup.inserts(rows))
    seen = two._live()
    two._live = lambda: seen  # has read the same batches before the first commits
    assert one.compact() and not two.compact()
    assert [tuple(r)[3:] for r in one.totals().collect()] == [(2, 10)]
    one.commit("c", token_rollup.inserts(rows))
    assert one.compact() and one._names()[0] == [1, 2] and one.batches() == {"a", "b", "c"}
    assert [tuple(r)[3:] for r in one.totals().collect()] == [(3, 15)] and len(one._live()[1]) == 1
    with pytest.raises(ValueError):
        one.commit("compaction-9", token_rollup.inserts(rows))


def test_op9_odd_rows_through_the_totals(spark, tmp_path, odd_docs, no_docs):
    """Null sources and languages are groups; repeated rows count each; deletes of all leave nothing."""
    counted = odd_docs.select("source", "lang", F.lit("v").alias("version"), F.coalesce(F.length("text"), F.lit(0)).alias("n_tokens"))
    store = token_rollup.Rollup(spark, f"file://{tmp_path}/odd")
    store.commit("none", token_rollup.inserts(counted.limit(0)))
    assert store.totals().count() == 0
    store.commit("a/b c%", token_rollup.inserts(counted))
    want = {}
    for r in counted.collect():
        n, t = want.get((r["source"], r["lang"]), (0, 0))
        want[r["source"], r["lang"]] = (n + 1, t + r["n_tokens"])
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"]) for r in store.totals().collect()} == want and (None, None) in want
    assert not store.commit("a/b c%", token_rollup.inserts(counted)) and store.compact()
    store.commit("gone", token_rollup.deletes(counted))
    assert store.totals().count() == 0


def test_op9_odd(odd_docs, no_docs):
    counted = token_rollup.with_token_counts(odd_docs, "n", {"v": public_tokenizers.path("byte_bpe_50k.tiktoken")}, PATTERN)
    assert {r["doc_id"]: r["n"]["v"] for r in counted.where("doc_id in (2, 3)").collect()} == {2: 0, 3: 0}
    assert token_rollup.with_token_counts(no_docs, "n", {"v": public_tokenizers.path("byte_bpe_50k.tiktoken")}, PATTERN).count() == 0
