"""Token-id shards with a minimal perfect hash index for keyed access.

Keys, text hashes and sizes give ranges of near-equal bytes; then texts are encoded where
they are scanned, the ids, not the texts, are shuffled to their range, and each range is
written to shard files that are closed at a bound: raw ids end to end,
then the places of the documents, then a minimal perfect hash from key to slot with a
stored fingerprint for each key, so that a key that is not there is told apart. The
hash's bits come in blocks that begin with the number of bits before them: a look-up
reads the footer, a block for each level that it passes (under two on average), a slot,
the places and the ids, whatever the size of the shard. A manifest holds every shard's
first and last key, which route a key to its shard, and prefix sums of the token counts,
which give every document its global start. Files are reached through ``pyarrow.fs``.
"""

from __future__ import annotations

import json
import re
import string
import struct
import uuid
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import PieceEncoder
from .common import lean, materialize, new_path, release, ship, shuffle_width
from .sharding import global_offsets
from .zip_warc import open_file, read_range

MAGIC = b"FOLIOIDS"
#: Bytes of a worker's cache of pieces: more than :mod:`.bpe`'s, as a miss costs more here.
CACHE_BYTES = 256 << 20
#: Bytes of ids, and documents, at which a shard is closed.
SHARD_BYTES, SHARD_DOCUMENTS = 256 << 20, 1 << 18
#: Bits a key and level of the perfect hash: more finish sooner, fewer are smaller.
GAMMA = 2.0
#: Words of the hash's bits in a block, after the word that counts the bits before it.
BLOCK_WORDS = 7
#: Bytes that are read at a shard's end at first: the footer is within them but for very many levels.
TAIL_BYTES = 2048
_SLOT = np.dtype([("fingerprint", "<u4"), ("run", "<u4"), ("first", "<u8")])
#: Bytes of ids that a read-back takes from a shard at once.
READ_BYTES = 8 << 20


class LibraryCodec(PieceEncoder):
    """Ids by the tokenizers library: its BPE model encodes each distinct pre-token.

    Pre-tokens are those of the file's own byte-level splitter. Texts are cut at the
    file's added tokens first, as the library does at its default settings.
    """

    def __init__(self, path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(path)
        self.model, self.splitter = whole.model, whole.pre_tokenizer
        super().__init__(pattern, cache_bytes)
        # whether ASCII letters with a space before them are one pre-token
        self.letters = self.pattern.findall(f" {string.ascii_letters}") == [f" {string.ascii_letters}"]
        self.dtype = np.dtype("<u2" if whole.get_vocab_size() <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        added = whole.get_added_tokens_decoder()
        self.added = {t.content: struct.pack(f"<{self.code}", i) for i, t in added.items()}
        longest = sorted(map(re.escape, self.added), key=len, reverse=True)
        self.cut = re.compile(f"({'|'.join(longest)})") if longest else None
        # tokens that take in white space, or stand for whole words only, are left to the library
        plain = not any(t.single_word or t.lstrip or t.rstrip for t in added.values()) and whole.normalizer is None
        self.whole = None if plain else whole

    def _known(self, characters: str) -> set[str]:
        # after a letter or number "'s" is a pre-token of its own, after a symbol it is not
        probe = "".join(f" {c}'s" for c in characters)
        starts = {a for _, (a, b) in self.splitter.pre_tokenize_str(probe) if b - a == 2 and probe[a] == " "}
        return {c for i, c in enumerate(characters) if 4 * i in starts}

    def _encode_piece(self, piece: str) -> bytes:
        if self.letters and piece.isalpha() and piece.isascii():
            return self._encode_mapped(self.shown[32] + piece)
        return super()._encode_piece(piece)

    def _encode_word(self, word: str) -> bytes:
        return self._encode_mapped(self._mapped(word))

    def _encode_mapped(self, mapped: str) -> bytes:
        ids = [t.id for t in self.model.tokenize(mapped)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def encode(self, text: str) -> bytes:
        if not any(t in text for t in self.added):
            return super().encode(text)
        if self.whole is not None:
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()
        parts = self.cut.split(text)  # every other one is an added token
        return b"".join([self.added[p] if i % 2 else super(LibraryCodec, self).encode(p) for i, p in enumerate(parts) if p])


@lru_cache(maxsize=2)
def library_codec(path: str, pattern: str) -> LibraryCodec:
    """One codec a worker."""
    return LibraryCodec(path, pattern)


def key_bytes(key) -> bytes:
    """A key as bytes; null is a key of its own."""
    return b"n" if key is None else b"k" + str(key).encode("utf-8", "surrogatepass")


def _mixed(hashes: np.ndarray, level: int) -> np.ndarray:
    """Another hash of 64-bit hashes for every level."""
    x = hashes + np.uint64((0x9E3779B97F4A7C15 * (level + 1)) % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class PerfectHash:
    """Maps n distinct 64-bit hashes onto 0..n-1.

    Level by level, hashes that fall alone on a bit of the level's array stay there and
    the others go on; a hash's number is the rank of its bit over all levels.
    """

    def __init__(self, sizes: list[int], bits: np.ndarray):
        self.sizes, self.bits = sizes, bits
        self.starts = np.concatenate(([0], np.cumsum(sizes))).astype(np.int64)
        per = np.bitwise_count(bits).astype(np.int64)
        self.before = np.concatenate(([0], np.cumsum(per)))

    @classmethod
    def build(cls, hashes: np.ndarray) -> PerfectHash:
        sizes, levels, rest = [], [], hashes
        while len(rest):
            size = max(64, int(GAMMA * len(rest)) + 63 & ~63)
            at = (_mixed(rest, len(sizes)) % np.uint64(size)).astype(np.int64)
            alone = np.bincount(at, minlength=size) == 1
            sizes.append(size)
            levels.append(np.packbits(alone, bitorder="little").view("<u8"))
            rest = rest[~alone[at]]
            if len(sizes) > 200:
                raise ValueError("two keys have one hash")
        return cls(sizes, np.concatenate(levels) if levels else np.empty(0, "<u8"))

    def __call__(self, hashes: np.ndarray) -> np.ndarray:
        """Numbers of the hashes; -1 where a hash falls on no bit (surely not a member)."""
        out = np.full(len(hashes), -1, np.int64)
        open_ = np.arange(len(hashes))
        for level, size in enumerate(self.sizes):
            if not len(open_):
                break
            bit = (_mixed(hashes[open_], level) % np.uint64(size)).astype(np.int64) + self.starts[level]
            word, low = bit >> 6, (bit & 63).astype(np.uint64)
            held = (self.bits[word] >> low) & np.uint64(1) == 1
            below = np.bitwise_count(self.bits[word] & ((np.uint64(1) << low) - np.uint64(1))).astype(np.int64)
            out[open_[held]] = (self.before[word] + below)[held]
            open_ = open_[~held]
        return out


class ShardWriter:
    """Writes one shard: payload as it comes, then the index."""

    def __init__(self, out, dtype: np.dtype):
        self.out, self.dtype = out, dtype
        self.keys: list[bytes] = []
        self.counts: list[int] = []
        self.size = 0

    def add(self, key: bytes, ids: bytes) -> None:
        """The documents of one key must come one after another."""
        self.out.write(ids)
        self.size += len(ids)
        self.keys.append(key)
        self.counts.append(len(ids) // self.dtype.itemsize)

    def full(self) -> bool:
        return self.size >= SHARD_BYTES or len(self.keys) >= SHARD_DOCUMENTS

    def close(self) -> int:
        """Write places, hash, slots, keys and footer; returns the number of ids."""
        places = np.concatenate(([0], np.cumsum(self.counts))).astype("<u8")
        first = [i for i in range(len(self.keys)) if i == 0 or self.keys[i] != self.keys[i - 1]]
        runs = np.diff([*first, len(self.keys)])
        distinct = [self.keys[i] for i in first]
        seed = 0
        while True:
            hashes = np.array([xxhash.xxh64_intdigest(k, seed) for k in distinct], np.uint64)
            if len(np.unique(hashes)) == len(hashes):
                break
            seed += 1
        table = PerfectHash.build(hashes)
        slots = np.zeros(len(distinct), _SLOT)
        at = table(hashes)
        slots["fingerprint"][at] = [xxhash.xxh32_intdigest(k, 1) for k in distinct]
        slots["run"][at], slots["first"][at] = runs, first
        words = np.zeros(-(-len(table.bits) // BLOCK_WORDS) * BLOCK_WORDS, "<u8")
        words[: len(table.bits)] = table.bits
        blocks = words.reshape(-1, BLOCK_WORDS)
        counted = np.bitwise_count(blocks).sum(1, dtype=np.int64)
        blocks = np.column_stack([(np.cumsum(counted) - counted).astype("<u8"), blocks])
        sections = {
            "places": places.tobytes(), "blocks": blocks.tobytes(), "slots": slots.tobytes(),
            "keys": b"".join(struct.pack("<I", len(k)) + k for k in distinct),
        }
        total, where = int(places[-1]), int(places[-1]) * self.dtype.itemsize
        footer = {"dtype": self.dtype.str, "ids": total, "documents": len(self.keys), "seed": seed, "levels": table.sizes}
        for name, raw in sections.items():
            self.out.write(raw)
            footer[name] = [where, len(raw)]
            where += len(raw)
        raw = json.dumps(footer).encode()
        self.out.write(raw + struct.pack("<Q", len(raw)) + MAGIC)
        return total


class Shard:
    """Reads a shard by range; what :meth:`get` reads does not grow with the shard."""

    def __init__(self, uri: str):
        self.f, size = open_file(uri)
        self.bytes_read = 0
        tail = self._read(max(0, size - TAIL_BYTES), min(size, TAIL_BYTES))
        n, magic = struct.unpack("<Q8s", tail[-16:]) if size >= 16 else (0, b"")
        if magic != MAGIC or n + 16 > size:
            raise ValueError(f"{uri} is not a shard")
        raw = tail[-16 - n : -16] if n + 16 <= len(tail) else self._read(size - 16 - n, n)
        self.footer = json.loads(raw)
        self.dtype = np.dtype(self.footer["dtype"])

    def _read(self, at: int, n: int) -> bytes:
        self.bytes_read += n
        return read_range(self.f, at, n)

    def _part(self, section: str, at: int, n: int) -> bytes:
        return self._read(self.footer[section][0] + at, n)

    def _section(self, section: str) -> bytes:
        return self._read(*self.footer[section])

    @cached_property
    def places(self) -> np.ndarray:
        return np.frombuffer(self._section("places"), "<u8").astype(np.int64)

    @cached_property
    def slots(self) -> np.ndarray:
        return np.frombuffer(self._section("slots"), _SLOT)

    @cached_property
    def hash(self) -> PerfectHash:
        blocks = np.frombuffer(self._section("blocks"), "<u8").reshape(-1, BLOCK_WORDS + 1)
        return PerfectHash(self.footer["levels"], blocks[:, 1:].ravel())

    def keys(self) -> list[bytes]:
        """The distinct keys in order."""
        raw, out, i = self._section("keys"), [], 0
        while i < len(raw):
            n = struct.unpack_from("<I", raw, i)[0]
            out.append(raw[i + 4 : i + 4 + n])
            i += 4 + n
        return out

    def find(self, keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """First document and number of documents of each of many keys; 0 documents if it is not there."""
        seed = self.footer["seed"]
        at = self.hash(np.array([xxhash.xxh64_intdigest(k, seed) for k in keys], np.uint64))
        prints = np.array([xxhash.xxh32_intdigest(k, 1) for k in keys], np.uint32)
        held = at >= 0
        held[held] = self.slots["fingerprint"][at[held]] == prints[held]
        first, run = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
        first[held], run[held] = self.slots["first"][at[held]], self.slots["run"][at[held]]
        return first, run

    def get(self, key: bytes) -> list[np.ndarray]:
        """The ids of a key's documents by a few small reads; empty if it is not there."""
        slot = self._slot(np.array([xxhash.xxh64_intdigest(key, self.footer["seed"])], np.uint64))
        if slot is None:
            return []
        fingerprint, run, first = struct.unpack("<IIQ", self._part("slots", slot * _SLOT.itemsize, _SLOT.itemsize))
        if fingerprint != xxhash.xxh32_intdigest(key, 1):
            return []
        places = np.frombuffer(self._part("places", 8 * first, 8 * (run + 1)), "<u8").astype(np.int64)
        return self._ids(places)

    def _slot(self, hashed: np.ndarray) -> int | None:
        start = 0
        for level, size in enumerate(self.footer["levels"]):
            bit = start + int(_mixed(hashed, level)[0] % np.uint64(size))
            word, low = bit >> 6, bit & 63
            block = np.frombuffer(self._part("blocks", word // BLOCK_WORDS * 8 * (BLOCK_WORDS + 1), 8 * (BLOCK_WORDS + 1)), "<u8")
            words = block[1 : 2 + word % BLOCK_WORDS].copy()
            if int(words[-1]) >> low & 1:
                words[-1] &= np.uint64((1 << low) - 1)
                return int(block[0]) + int(np.bitwise_count(words).sum())
            start += size
        return None

    def _ids(self, places: np.ndarray) -> list[np.ndarray]:
        width = self.dtype.itemsize
        a, b = int(places[0]), int(places[-1])
        return np.split(np.frombuffer(self._read(a * width, (b - a) * width), self.dtype), places[1:-1] - a)

    def ids(self, document: int) -> np.ndarray:
        """The ids of a document, read by range."""
        return self.span(document, document + 1)[0]

    def span(self, low: int, high: int) -> list[np.ndarray]:
        """The ids of consecutive documents in one read."""
        return self._ids(self.places[low : high + 1])

    def close(self) -> None:
        self.f.close()


def look_up(manifest: DataFrame, key) -> list[np.ndarray]:
    """The ids of a key's documents: the manifest's key ranges name the shards to ask."""
    at = F.col("first_key").isNull() if key is None else (F.col("first_key").isNull() | (F.col("first_key") <= F.lit(key))) & (F.col("last_key") >= F.lit(key))
    out = []
    for row in manifest.where(at).orderBy("shard").select("uri").collect():  # one shard, or those that a repeated key fills
        shard = Shard(row["uri"])
        out += shard.get(key_bytes(key))
        shard.close()
    return out


def _place(key, hashed: int, any_: int) -> tuple:
    """A row's place in the order: null keys first."""
    return (0, hashed, any_) if key is None else (1, key, hashed, any_)


def write_shards(
    docs: DataFrame, tokenizer_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0,
    ranges: int | None = None,
) -> DataFrame:
    """Encode into shards in ascending key order; returns the stored manifest.

    A row per shard: ``shard, uri, n_documents, n_ids, first_key, last_key, first_id``, the
    last being the number of ids in the shards before it; shard numbers ascend with the
    keys and may have gaps. Null texts are empty; each document ends with ``end_id``. Null
    keys come first (a shard that begins with one has a null ``first_key``, one that holds
    nothing else a null ``last_key``); documents of one key follow each other in the order
    of their texts' hashes.
    """
    spark = docs.sparkSession
    ship(spark)
    key_type, n_ranges = docs.schema[key].dataType.simpleString(), ranges or shuffle_width(spark)
    # the number only parts identical rows, whose order does not matter
    rows = docs.select(F.col(key).alias("key"), F.xxhash64(text).alias("hash"), F.monotonically_increasing_id().alias("any"), F.col(text).alias("text"))
    narrow = rows.select("key", "hash", "any", (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"))
    narrow = materialize(narrow, "keys")
    placed = global_offsets(narrow, ["key", "hash", "any"], "size", ranges=ranges)
    cut = F.expr(f"cast(cast(byte_start as decimal(28,0)) * cast({n_ranges} as decimal(10,0)) div cast(total_bytes as decimal(28,0)) as int)")
    first = F.struct(F.col("key").isNotNull().alias("known"), "key", "hash", "any")
    bounds = placed.groupBy(cut.alias("part")).agg(F.min(first).alias("first")).select("first.*").collect()  # a row for each range
    bounds = sorted(_place(r["key"], r["hash"], r["any"]) for r in bounds)
    release(narrow)

    @lean
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = library_codec(tokenizer_path, pattern)
        end = np.array([end_id], codec.dtype).tobytes()
        for b in batches:
            part = [max(0, bisect_right(bounds, _place(*p)) - 1) for p in zip(*(b.column(i).to_pylist() for i in range(3)))]
            ids = [codec.encode(t.as_py() or "") + end for t in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part, pa.int32()), pa.array(ids, pa.binary())], names=["key", "hash", "part", "ids"])

    encoded = rows.mapInArrow(encode, f"key {key_type}, hash long, part int, ids binary")
    ranged = encoded.repartitionById(n_ranges, "part").sortWithinPartitions(F.col("key").asc_nulls_first(), "hash").select("key", "ids")
    folder = new_path(spark, "token-ids")
    schema = f"shard long, uri string, n_documents long, n_ids long, first_key {key_type}, last_key {key_type}"

    @lean
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dtype = library_codec(tokenizer_path, pattern).dtype
        writer, out, uri, first, last, n, kind = None, None, "", None, None, 0, None

        def close() -> pa.RecordBatch:
            total = writer.close()
            out.close()
            columns = ((TaskContext.get().partitionId() << 32 | n, pa.int64()), (uri, pa.string()), (len(writer.keys), pa.int64()), (total, pa.int64()), (first, kind), (last, kind))
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in columns], names=["shard", "uri", "n_documents", "n_ids", "first_key", "last_key"])

        for b in batches:
            kind = b.schema.field(0).type
            for k, ids in zip(b.column(0).to_pylist(), b.column(1)):
                if writer is None:
                    system, path = fs.FileSystem.from_uri(folder)
                    system.create_dir(path, recursive=True)
                    name = f"{uuid.uuid4().hex}.ids"
                    out, uri = system.open_output_stream(f"{path}/{name}"), f"{folder}/{name}"
                    writer, first = ShardWriter(out, dtype), k
                writer.add(key_bytes(k), ids.as_py())
                last = k
                if writer.full():
                    yield close()
                    writer, n = None, n + 1
        if writer is not None:
            yield close()

    manifest = materialize(ranged.mapInArrow(write, schema), "shards")
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("first_id", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))  # a row per shard


def read_shards(manifest: DataFrame, key_type: str = "bigint") -> DataFrame:
    """Every document by keyed access: ``doc_id, start, n_tokens, ids_crc32``.

    For each key of a shard the perfect hash gives its documents; their ids are read by
    range, neighbours together. ``ids_crc32`` is over the ids as unsigned 32-bit integers.
    """
    ship(manifest.sparkSession)

    @lean
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for uri, first_id in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                shard = Shard(uri)
                keys = shard.keys()
                first, run = shard.find(keys)
                if (run == 0).any():
                    raise ValueError(f"{uri}: a key is not in the index")
                whose = np.repeat(np.arange(len(keys)), run)
                document = np.concatenate([np.arange(f, f + r) for f, r in zip(first, run)])
                i = 0
                while i < len(document):
                    j = i + 1
                    while j < len(document) and document[j] == document[j - 1] + 1 and (
                        shard.places[document[j] + 1] - shard.places[document[i]]
                    ) * shard.dtype.itemsize <= READ_BYTES:
                        j += 1
                    ids = shard.span(int(document[i]), int(document[j - 1]) + 1)
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([_key(keys[k]) for k in whose[i:j]], pa.string()),
                            pa.array(first_id + shard.places[document[i:j]]),
                            pa.array([len(x) for x in ids], pa.int64()),
                            pa.array([zlib.crc32(x.astype("<u4").tobytes()) for x in ids], pa.int64()),
                        ],
                        names=["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                    i = j
                shard.close()

    dealt = manifest.select("uri", "first_id").repartition(shuffle_width(manifest.sparkSession))
    out = dealt.mapInArrow(read, "doc_id string, start long, n_tokens long, ids_crc32 long")
    return out.withColumn("doc_id", F.col("doc_id").cast(key_type))


def _key(raw: bytes) -> str | None:
    return None if raw == b"n" else raw[1:].decode("utf-8", "surrogatepass")


def round_trip(docs: DataFrame, tokenizer_path: str, pattern: str, *, key: str = "doc_id", text: str = "text", end_id: int = 0) -> DataFrame:
    """Write the shards, read them back: a row per document.

    Repeated rows each give a row, null keys come back null, an empty table gives an
    empty result; other columns are not read.
    """
    manifest = write_shards(docs, tokenizer_path, pattern, key=key, text=text, end_id=end_id)
    return read_shards(manifest, docs.schema[key].dataType.simpleString())
