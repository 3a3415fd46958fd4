"""Byte-level BPE encoding and decoding with a model serialised from the vocabulary.

The rank file is turned into a sentencepiece BPE model directly: every token becomes a
piece of byte-mapped characters scored by its negative rank, normalisation is the
identity, and no piece is learned. Merging by highest score is then merging by lowest
rank, so each pre-token's ids are those of the rank file. Decoding maps ids back to
their bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import lean, new_column, ship

#: Bytes that a worker's cache of pieces takes before it is emptied, and characters of the longest piece in it.
CACHE_BYTES, CACHED_PIECE = 40 << 20, 64
#: Bytes of an entry beside those of its two objects.
ENTRY_BYTES = 70
_LITTLE = sys.byteorder == "little"
#: A character that is no letter, number or white space, and stays so: for private use.
_SYMBOL = chr(0xE000)
#: White space as Unicode has it, which is what ``\s`` stands for in rank files' patterns.
WHITE_SPACE = r"\t-\r\x20\x85\xa0" + "".join(
    map(chr, [0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000])
)
#: A space before something that may be white space: there, text is not cut into pieces.
_UNSAFE = re.compile(r" (?=[\s\x1c-\x1f\x85])")
_CUT = re.compile(r" (?![\s\x1c-\x1f\x85])")


def byte_characters() -> dict[int, str]:
    """A printable character for every byte: itself if printable, else from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


def load_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a file of base64 tokens and ranks."""
    with open(path, "rb") as f:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def _field(number: int, body: bytes | int | float) -> bytes:
    """A protobuf field: bytes length-delimited, float as fixed 32 bits, int as varint."""
    if isinstance(body, bytes):
        return _varint(number << 3 | 2) + _varint(len(body)) + body
    if isinstance(body, float):
        return _varint(number << 3 | 5) + struct.pack("<f", body)
    return _varint(number << 3) + _varint(body % (1 << 64))


def serialize_model(ranks: dict[bytes, int]) -> bytes:
    """A sentencepiece model whose piece ids are the ranks; the unknown piece comes last.

    Ranks must be 0 to n-1 without gaps and hold all 256 bytes.
    """
    tokens = sorted(ranks, key=ranks.__getitem__)
    if [ranks[t] for t in tokens] != list(range(len(tokens))) or any(bytes([b]) not in ranks for b in range(256)):
        raise ValueError("ranks must run from 0 without gaps and hold every byte")
    shown = byte_characters()
    normal, unknown, bpe = 1, 2, 2
    out = [
        _field(1, _field(1, "".join(shown[b] for b in t).encode()) + _field(2, -float(i)) + _field(3, normal))
        for i, t in enumerate(tokens)
    ]
    out.append(_field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, unknown)))
    trainer = _field(3, bpe) + _field(4, len(tokens) + 1) + _field(40, len(tokens)) + b"".join(_field(i, -1) for i in (41, 42, 43))
    normalizer = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join(out) + _field(2, trainer) + _field(3, normalizer)


def pieces_of(text: str) -> list[str]:
    """``text`` cut at single spaces, which are left out, where every pre-token ends.

    A cut is made at a space that something other than white space follows. There a
    pre-token begins whatever stands before, so the pieces can be encoded apart.
    """
    return text.split(" ") if not _UNSAFE.search(text) else _CUT.split(text)


class _Cache(dict):
    """A dict that computes what is missing and keeps it, unless its key is long.

    When half the limit is full, what was kept becomes the older half, from which what is
    asked for again returns; the older half before it goes.
    """

    def __init__(self, compute, limit: int):
        self.compute, self.limit, self.used, self.older = compute, limit, 0, {}

    def __missing__(self, k):
        v = self.older.pop(k, None)
        if v is None:
            v = self.compute(k)
        if len(k) <= CACHED_PIECE:
            size = sys.getsizeof(k) + sys.getsizeof(v) + ENTRY_BYTES
            if 2 * (self.used + size) > self.limit:
                self.older, self.used = dict(self), 0
                self.clear()
            self.used += size
            self[k] = v
        return v


def cuts_at_spaces(pattern: regex.Pattern) -> bool:
    """Whether a pre-token begins at a space that no white space follows, whatever stands before.

    Tried on every two neighbours of these kinds: letters with and without marks, digits,
    symbols, an apostrophe, white space and line ends.
    """
    samples = ["a", "I", "é", "ß", "字", "e\u0301", "7", "\u0663", ".", "'", "'s", "😀", "\ue000", " ", "\n", "\t", "\u3000", "a\n", "- "]
    return all(
        any(m.start() == len(left) for m in pattern.finditer(f"{left} {right}"))
        for left in samples for right in samples if not right[0].isspace()
    )


@lru_cache(maxsize=1)
def recent_characters() -> str:
    """Letters and numbers by :mod:`regex` that Python's own, older tables do not have yet."""
    every = "".join(chr(i) for i in range(sys.maxunicode + 1) if unicodedata.category(chr(i)) == "Cn")
    return "".join(regex.findall(r"[\p{L}\p{N}]", every))


class PieceEncoder:
    """Encodes texts piece by piece; a subclass encodes a pre-token.

    Most pieces are one pre-token with its space. Others are put together from their
    pre-tokens, of which those with a space are pieces themselves. Under a pattern that
    does not cut at spaces the whole text is split into its pre-tokens at once.
    """

    def __init__(self, pattern: str, cache_bytes: int):
        self.pattern = regex.compile(unicode_white_space(pattern))
        self.cuts = cuts_at_spaces(self.pattern)
        self.strange = frozenset(recent_characters()) - self._known(recent_characters())
        self.shown = byte_characters()
        self.pieces = _Cache(self._encode_piece, cache_bytes)
        self.others = _Cache(self._encode_word, cache_bytes // 4)

    def _encode_word(self, word: str) -> bytes:
        raise NotImplementedError

    def _known(self, characters: str) -> set[str]:
        """Which of the characters the library to agree with takes for letters or numbers."""
        raise NotImplementedError

    def _words(self, text: str) -> list[str]:
        """Pre-tokens; letters too new for the library are split as it does, like symbols."""
        if text.isascii() or self.strange.isdisjoint(text):
            return self.pattern.findall(text)
        alike = "".join(_SYMBOL if c in self.strange else c for c in text)
        return [text[m.start() : m.end()] for m in self.pattern.finditer(alike)]

    def _mapped(self, word: str) -> str:
        if word.isascii() and word[1:].isalnum():  # of these only the space has another character
            return word.replace(" ", self.shown[32])
        return word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.shown)

    def _encode_piece(self, piece: str) -> bytes:
        words = self._words(" " + piece)
        return self._encode_word(words[0]) if len(words) == 1 else self._joined(words)

    def _joined(self, words: list[str]) -> bytes:
        pieces, others = self.pieces, self.others
        return b"".join([pieces[w[1:]] if w[0] == " " else others[w] for w in words])

    def encode(self, text: str) -> bytes:
        """The ids of a text, end to end, little-endian."""
        if not self.cuts:
            return b"".join(map(self.others.__getitem__, self._words(text)))
        head, *rest = pieces_of(text)
        return self._joined(self._words(head)) + b"".join(map(self.pieces.__getitem__, rest))


class Codec(PieceEncoder):
    """Encodes texts to ids of 32 bits and back, by the pre-tokens of ``pattern``."""

    def __init__(self, rank_path: str, pattern: str, cache_bytes: int = CACHE_BYTES):
        super().__init__(pattern, cache_bytes)
        ranks = load_ranks(rank_path)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=serialize_model(ranks))
        self.table = [b""] * len(ranks)
        for token, rank in ranks.items():
            self.table[rank] = token

    def _known(self, characters: str) -> set[str]:
        import tiktoken

        one = {bytes([b]): b for b in range(256)}
        letters = tiktoken.Encoding("letters", pat_str=r"\p{L}|\p{N}", mergeable_ranks=one, special_tokens={})
        return set(letters.decode(letters.encode_ordinary(characters)))  # what does not match is left out

    def _encode_word(self, word: str) -> bytes:
        ids = self.model.encode(self._mapped(word))
        return struct.pack(f"<{len(ids)}I", *ids)

    def decode(self, ids: bytes) -> bytes:
        """The bytes of which :meth:`encode` made ``ids``."""
        return b"".join(map(self.table.__getitem__, memoryview(ids).cast("I") if _LITTLE else np.frombuffer(ids, "<u4").tolist()))


def unicode_white_space(pattern: str) -> str:
    """``pattern`` with its white space escapes spelled out, also within classes."""
    out, inside, i = [], False, 0
    while i < len(pattern):
        two = pattern[i : i + 2]
        if two in (r"\s", r"\S") and (two == r"\s" or not inside):
            out.append(WHITE_SPACE if inside else f"[{'^' * (two == r'\S')}{WHITE_SPACE}]")
            i += 2
        elif two[0] == "\\":
            out.append(two)
            i += 2
        else:
            inside = (inside or two[0] == "[") and two[0] != "]"
            out.append(two[0])
            i += 1
    return "".join(out)


@lru_cache(maxsize=2)
def codec(rank_path: str, pattern: str, cache_bytes: int = CACHE_BYTES) -> Codec:
    """One codec a worker."""
    return Codec(rank_path, pattern, cache_bytes)


def with_ids(docs: DataFrame, out: str, rank_path: str, pattern: str, *, text: str = "text") -> DataFrame:
    """``docs`` with the column ``out``: ``struct<ids, n_tokens, exact>`` of each whole text.

    ``ids`` is binary, 4 little-endian bytes an id; ``exact`` says that they decode to the
    text. Null texts are empty. A column named ``out`` in ``docs`` is an error.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("struct<ids:binary,n_tokens:bigint,exact:boolean>")
    @lean
    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(rank_path, pattern)
        for batch in batches:
            texts = [t.as_py() or "" for t in batch]
            ids = [c.encode(t) for t in texts]
            exact = [c.decode(i) == t.encode("utf-8", "surrogatepass") for i, t in zip(ids, texts)]
            yield pa.StructArray.from_arrays(
                [pa.array(ids, pa.binary()), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(exact, pa.bool_())],
                names=["ids", "n_tokens", "exact"],
            )

    return docs.withColumn(new_column(docs, out), encode.asNondeterministic()(F.col(text)))


def round_trip_digests(
    docs: DataFrame, rank_path: str, pattern: str, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """Encode every text, decode its ids: ``doc_id, n_tokens, ids_sha256, decoded_sha256``.

    Null texts are empty (no ids, the hash of nothing). Other columns are not read;
    repeated rows each give a row; an empty table gives an empty result. Texts are
    encoded whole; memory is a batch of texts and two bounded caches.
    """
    ship(docs.sparkSession)

    @F.arrow_udf("struct<n_tokens:bigint,ids_sha256:string,decoded_sha256:string>")
    @lean
    def digests(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        c = codec(rank_path, pattern)
        for batch in batches:
            n, a, b = [], [], []
            for t in batch:
                ids = c.encode(t.as_py() or "")
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest())
                b.append(hashlib.sha256(c.decode(ids)).hexdigest())
            yield pa.StructArray.from_arrays(
                [pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())],
                names=["n_tokens", "ids_sha256", "decoded_sha256"],
            )

    return docs.select(
        F.col(key).alias("doc_id"), digests.asNondeterministic()(F.col(text)).alias("_d")
    ).select("doc_id", "_d.*")
