"""Stored postings with block maxima, and BM25 search that skips blocks.

A *segment* is a bounded batch of chunks and one row: the chunks' ids, places and lengths,
and for every term its postings in chunk order. Chunks of a segment lie in ranges of
one width; a *block* is the postings of one term in one range, stored with its largest
term frequency and the smallest length of its chunks. Both bound what the block can add to
a score under any corpus statistics, so segments stay right when the corpus changes.

A chunk's whole score is computed where its segment lies: queries go out in blocks of
bounded size, a task keeps the best of its chunks for each query, and only these are
shuffled. Ranges are scored in the order of their blocks' summed maxima; those below the
worst score that a query keeps are skipped.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..model import CANDIDATE_DEPTH, STOPWORDS
from ..shipping import ship
from .sizes import spread
from .store import LONG_ROWS, dropped, stored

K1, B, EPSILON = 1.5, 0.75, 0.25
#: Words that a segment holds at about this many, and chunks in a range.
SEGMENT_WORDS, RANGE = 1_000_000, 64
#: Bytes of questions that are searched at once (and broadcast); more go block by block.
BLOCK_BYTES = 4 << 20

SEGMENTS = (
    "n_chunks long, n_words long, width int, chunk_id array<string>, corpus_pos array<long>, book_title array<string>, chapter array<string>, lengths binary, "
    "terms array<string>, dfs array<long>, block_starts binary, block_range binary, block_first binary, "
    "block_tf binary, block_length binary, docs binary, tfs binary"
)
#: A segment's routing words (:func:`functions.text.word_tokens`), how often they occur, and their first places.
WORDS = "words array<string>, word_ns array<long>, word_firsts array<long>"
#: The same for each book of a segment that has chunks of several: rows of ``_BOOKED`` as an Arrow stream, which Spark need not take apart.
BOOK_WORDS = "book_words binary"
_BOOKED = "book_title string, word string, n long, first long"
#: Rows of ``_BOOKED`` that a task gathers before they are merged.
MERGED_WORDS = 2_000_000
#: A place is a position and, in these low bits, the number of words before it in its chunk, or the most that fits.
_AT = (1 << 24) - 1
_NONE = np.iinfo(np.int64).max
_SPACES, _LONG = re.compile(X.SPACES), re.compile("[a-z]{3,}")
#: White space to Python's ``split``, but not to Unicode.
_SEPARATORS = "\x1c\x1d\x1e\x1f"


def segments(chunks: DataFrame, *, by_book: bool = False, words: int = SEGMENT_WORDS, width: int = RANGE, counted: bool = False, booked: bool = False) -> DataFrame:
    """One row of ``SEGMENTS`` for a batch of chunks of about ``words`` words, in ranges of ``width`` chunks.

    ``chunks`` has ``chunk_id, corpus_pos, book_title, chapter, text``; a null text has no
    words. With ``by_book`` a segment has chunks of one book only, if books come one after
    another in their partitions. ``counted`` adds ``WORDS``, ``booked`` ``BOOK_WORDS``. Texts are cut
    into words once, where their segment is made.
    """
    ship(chunks.sparkSession)
    schema = ", ".join([SEGMENTS, *([BOOK_WORDS] if booked else [WORDS] if counted else [])])
    rows = chunks.select(
        "chunk_id", F.col("corpus_pos").cast("long").alias("corpus_pos"), "book_title", "chapter", F.lower("text").alias("text"),
    )

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n, book = [], 0, None
        for b in batches:
            for part, size, own in _parts(_cut(b), words, by_book):
                if held and (n + size > words or own != book):
                    yield _segment(held, width, schema)
                    held, n = [], 0
                held.append(part)
                n, book = n + size, own
        if held:
            yield _segment(held, width, schema)

    return rows.mapInArrow(build, schema)


def tokens(low: str | None) -> list[str]:
    """As :func:`functions.text.whitespace_tokens` of a lower-cased text; none of null."""
    if not low:
        return []
    return [w for w in _SPACES.split(low) if w] if any(c in low for c in _SEPARATORS) else low.split()


def _cut(batch: pa.RecordBatch) -> pa.RecordBatch:
    """A batch with its texts' ``tokens`` instead of them."""
    found = [tokens(t) for t in batch.column("text").to_pylist()]
    offsets = np.zeros(len(found) + 1, np.int32)
    np.cumsum([len(f) for f in found], out=offsets[1:])
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(list(chain.from_iterable(found)), pa.string()))
    return pa.RecordBatch.from_arrays([*batch.columns[:-1], lists], names=[*batch.schema.names[:-1], "tokens"])


def _parts(batch: pa.RecordBatch, words: int, by_book: bool) -> Iterator[tuple[pa.RecordBatch, int, str | None]]:
    """A batch cut where about ``words`` words are full, and between books: the part, its words and its book."""
    sizes = pc.list_value_length(batch.column("tokens")).to_numpy(zero_copy_only=False)
    titles = batch.column("book_title").to_pylist() if by_book else [None] * batch.num_rows
    first, n = 0, 0
    for i in range(batch.num_rows):
        if i > first and (n + sizes[i] > words or titles[i] != titles[first]):
            yield batch.slice(first, i - first), n, titles[first]
            first, n = i, 0
        n += int(sizes[i])
    if batch.num_rows:
        yield batch.slice(first), n, titles[first]


def _segment(batches: list[pa.RecordBatch], width: int, schema: str = SEGMENTS) -> pa.RecordBatch:
    t = pa.Table.from_batches(batches).combine_chunks()
    lists = t.column("tokens").combine_chunks()
    lengths = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype("<i4")
    coded = lists.flatten().dictionary_encode()
    terms, code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
    n = len(lengths)
    pairs, tf = np.unique(code * max(n, 1) + np.repeat(np.arange(n), lengths), return_counts=True)
    term, doc = pairs // max(n, 1), (pairs % max(n, 1)).astype("<i4")
    df = np.bincount(term, minlength=len(terms)).astype(np.int64)
    # a block begins where the term or the range changes
    part = doc // width
    new = np.flatnonzero(np.concatenate(([True], (term[1:] != term[:-1]) | (part[1:] != part[:-1])))) if len(doc) else np.empty(0, np.int64)
    most = np.maximum.reduceat(tf, new) if len(new) else tf
    least = np.minimum.reduceat(lengths[doc], new) if len(new) else tf
    starts = np.searchsorted(term[new], np.arange(len(terms) + 1))
    raw = [starts, part[new], np.concatenate((new, [len(doc)])), most, least]
    one = lambda a: pa.array([a.astype("<i4").tobytes()])
    row = lambda a: pa.ListArray.from_arrays(pa.array([0, len(a)], pa.int32()), a)
    listed = lambda c: row(t.column(c).combine_chunks())
    words = []
    if schema.endswith(BOOK_WORDS):
        words = [pa.array([_streamed(_words(terms, code, lengths, t.column("corpus_pos").combine_chunks(), t.column("book_title").combine_chunks()))])]
    elif schema != SEGMENTS:
        words = [row(w) for w in _words(terms, code, lengths, t.column("corpus_pos").combine_chunks())]
    return pa.RecordBatch.from_arrays(
        [
            pa.array([n], pa.int64()), pa.array([len(code)], pa.int64()), pa.array([width], pa.int32()), *(listed(c) for c in ("chunk_id", "corpus_pos", "book_title", "chapter")), one(lengths),
            row(terms), row(pa.array(df)), *map(one, raw), one(doc), one(tf), *words,
        ],
        names=[f.split()[0] for f in schema.split(", ")],
    )


def _words(terms: pa.Array, code: np.ndarray, lengths: np.ndarray, pos: pa.Array, titles: pa.Array | None = None) -> list[pa.Array]:
    """The columns ``WORDS`` of a segment, whose chunks at ``pos`` have ``lengths`` of the tokens ``code``; with their books' ``titles``, a word for each book, and a fourth column of these; names are coded then.

    No word goes over white space, so the words of every term are looked for once.
    """
    whole = pc.match_substring_regex(terms, "^[a-z]{3,}$")
    rest = np.flatnonzero(pc.and_not(pc.match_substring_regex(terms, "[a-z]{3,}"), whole).to_numpy(zero_copy_only=False))
    found = [_LONG.findall(t) for t in terms.take(pa.array(rest)).to_pylist()]
    held = whole.to_numpy(zero_copy_only=False).astype(np.int64)
    held[rest] = np.fromiter(map(len, found), np.int64, len(found))
    upto = np.concatenate(([0], np.cumsum(held[code])))
    at = upto[:-1] - np.repeat(upto[np.cumsum(lengths, dtype=np.int64) - lengths], lengths)
    known = np.repeat(pos.is_valid().to_numpy(zero_copy_only=False), lengths)
    place = (np.repeat(pos.fill_null(0).to_numpy(zero_copy_only=False), lengths) << 24) + np.minimum(at, _AT)
    books, n_books, token = None, 1, code
    if titles is not None:
        coded = titles.dictionary_encode()
        books, n_books = pa.concat_arrays([coded.dictionary, pa.nulls(1, pa.string())]), len(coded.dictionary) + 1  # the last: none
        token = np.repeat(coded.indices.fill_null(n_books - 1).to_numpy(zero_copy_only=False).astype(np.int64), lengths) * len(terms) + code
    pairs, token = _numbered(token, n_books * len(terms))  # terms of books
    first = np.full(len(pairs), _NONE)
    np.minimum.at(first, token[known], place[known])
    # words of terms: a word's place is its term's, as many words on as stand before it in the term
    own, many = np.flatnonzero(whole.to_numpy(zero_copy_only=False)), held[rest]
    of = np.concatenate((own, np.repeat(rest, many)))
    before = np.concatenate((np.zeros(len(own), np.int64), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)))
    coded = pa.concat_arrays([terms.filter(whole), pa.array(list(chain.from_iterable(found)), pa.string())]).dictionary_encode()
    word, number = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
    # every pair has its term's words
    book, term = np.divmod(pairs, max(len(terms), 1))
    order = np.argsort(of, kind="stable")
    starts = np.searchsorted(of[order], np.arange(len(terms) + 1))
    entry = order[_spans(starts[term], starts[term + 1])]
    pair = np.repeat(np.arange(len(pairs)), held[term])
    own = first[pair]
    own = np.where(own == _NONE, _NONE, (own & ~_AT) + np.minimum((own & _AT) + before[entry], _AT))
    found, at = _numbered(book[pair] * len(word) + number[entry], n_books * len(word))
    firsts = np.full(len(found), _NONE)
    np.minimum.at(firsts, at, own)
    n = np.bincount(at, weights=np.bincount(token, minlength=len(pairs))[pair], minlength=len(found)).astype(np.int64)
    book, number = np.divmod(found, max(len(word), 1))
    kept = pc.invert(pc.is_in(word, value_set=pa.array(STOPWORDS, pa.string()))).take(pa.array(number))
    named = [word.take(pa.array(number))] if books is None else [pa.DictionaryArray.from_arrays(pa.array(i.astype("<i4")), d) for i, d in ((number, word), (book, books))]
    return [c.filter(kept) for c in (named[0], pa.array(n), pa.array(firsts, mask=firsts == _NONE), *named[1:])]


def _numbered(keys: np.ndarray, below: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ones of some keys below a number, in order, and each key's place among them."""
    if below > 8 * len(keys) + (1 << 16):
        return np.unique(keys, return_inverse=True)
    seen = np.zeros(below, bool)
    seen[keys] = True
    return np.flatnonzero(seen), (np.cumsum(seen) - 1)[keys]


def frequencies(index: DataFrame) -> DataFrame:
    """``term, df``: chunks that hold each term, summed over segments."""
    own = index.select(F.explode(F.arrays_zip("terms", "dfs")).alias("t"))
    return own.groupBy(F.col("t.terms").alias("term")).agg(F.sum("t.dfs").alias("df"))


def _streamed(columns: list[pa.Array]) -> bytes:
    """Words, counts, first places and books as rows of ``_BOOKED``, small: Spark's writer copies them several times."""
    word, n, first, book = columns
    rows = pa.RecordBatch.from_arrays([book, word, n, first], names=[f.split()[0] for f in _BOOKED.split(", ")])
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(rows)
    return sink.getvalue().to_pybytes()


def book_words(index: DataFrame) -> DataFrame:
    """``book_title, word, n, first`` of an index that is ``booked``: a book's routing words, how often they occur, and their first places."""
    ship(index.sparkSession)
    return index.select("book_words").mapInArrow(_merged, _BOOKED).groupBy("book_title", "word").agg(F.sum("n").alias("n"), F.min("first").alias("first"))


def _merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of segments' streams; those of about ``MERGED_WORDS`` at once are merged before they are handed over."""
    schema = pa.schema([("book_title", pa.string()), ("word", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
    held, n = [], 0

    def merge(tables: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        found = pa.concat_tables(tables).group_by(["book_title", "word"]).aggregate([("n", "sum"), ("first", "min")])
        yield from found.select(["book_title", "word", "n_sum", "first_min"]).rename_columns(["book_title", "word", "n", "first"]).to_batches(max_chunksize=1 << 16)

    for b in batches:
        for stream in b.column("book_words"):
            held.append(pa.ipc.open_stream(stream.as_buffer()).read_all().cast(schema))
            n += held[-1].num_rows
            if n >= MERGED_WORDS:
                yield from merge(held)
                held, n = [], 0
    if held:
        yield from merge(held)


def totals(index: DataFrame) -> DataFrame:
    """One row: ``n_docs, n_words`` of all chunks."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("long")
    return index.agg(total("n_chunks").alias("n_docs"), total("n_words").alias("n_words"))


def weighted(df: DataFrame, n_docs: int) -> DataFrame:
    """``term, df, idf`` of a vocabulary ``term, df``: negative values become a quarter of the mean over the vocabulary."""
    raw = df.select("term", "df", (F.log(F.lit(n_docs) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)).alias("raw"))
    mean = raw.agg(F.avg("raw").alias("mean"))
    return raw.crossJoin(F.broadcast(mean)).select(  # one row
        "term", "df", F.when(F.col("raw") < 0, EPSILON * F.col("mean")).otherwise(F.col("raw")).alias("idf")
    )


class Segment:
    """One segment, opened; counts the blocks that it looks at."""

    def __init__(self, batch: pa.RecordBatch, i: int, mean: float):
        of = lambda c: np.frombuffer(batch.column(c)[i].as_py(), "<i4").astype(np.int64)
        row = lambda c: batch.column(c)[i].values
        self.ids, self.pos = row("chunk_id"), row("corpus_pos").to_numpy(zero_copy_only=False)
        self.named = {c: _codes(row(c)) for c in ("book_title", "chapter")}
        self.terms = row("terms")
        self.lengths, self.starts, self.range, self.first = map(of, ("lengths", "block_starts", "block_range", "block_first"))
        self.docs, self.tfs = of("docs"), of("tfs")
        self.norm = K1 * (1 - B + B * self.lengths / mean) if mean else np.full(len(self.lengths), K1)
        # a block's largest contribution is no more than this, before its weight
        most, least = of("block_tf"), of("block_length")
        self.bound = most * (K1 + 1) / (most + (K1 * (1 - B + B * least / mean) if mean else K1))
        self.width = batch.column("width")[i].as_py()
        self.n_ranges = -(-len(self.lengths) // self.width)
        self.blocks = self.skipped = 0
        self._masks: dict[tuple, np.ndarray | None] = {}

    def numbers(self, terms: pa.Array) -> np.ndarray:
        """The segment's numbers of some terms, -1 for those it lacks."""
        return pc.index_in(terms, value_set=self.terms).fill_null(-1).to_numpy(zero_copy_only=False)

    def passing(self, book: str | None, chapter: str | None) -> np.ndarray | None:
        """Which chunks pass a query's filters; None: all."""
        if (book, chapter) not in self._masks:
            mask = None
            for c, wanted in (("book_title", book), ("chapter", chapter)):
                if wanted is not None:
                    number, codes = self.named[c]
                    own = codes == number.get(wanted, -2)
                    mask = own if mask is None else mask & own
            self._masks[book, chapter] = mask
        return self._masks[book, chapter]

    def best(self, terms: np.ndarray, weights: np.ndarray, mask: np.ndarray | None, depth: int, floor: float, zeros: bool, digits: int) -> tuple[np.ndarray, np.ndarray]:
        """Chunks and rounded scores, all of the ``depth`` best whose score is at least ``floor``, ties included.

        ``terms`` are the query's that the segment holds. Chunks without any have a score of
        zero and belong to it if ``zeros``.
        """
        blocks = _spans(self.starts[terms], self.starts[terms + 1])
        weight = np.repeat(weights, self.starts[terms + 1] - self.starts[terms])
        self.blocks += len(blocks)
        least, margin = floor, 10.0**-digits
        dense = zeros and not least > 0  # chunks of score zero may be among the best: nothing is skipped
        upper = np.zeros(self.n_ranges)
        np.add.at(upper, self.range[blocks], np.maximum(weight * self.bound[blocks], 0))
        held = np.zeros(self.n_ranges, bool)
        held[self.range[blocks]] = True
        if mask is not None:
            held &= np.add.reduceat(mask, np.arange(0, len(mask), self.width)) > 0
        order = np.argsort(-upper, kind="stable")
        order = order[held[order]]
        score, hit = np.zeros(len(self.lengths)), np.zeros(len(self.lengths), bool)
        at, step, kept = 0, len(order) if dense else 4, np.empty(0)
        chosen = np.zeros(self.n_ranges, bool)
        while at < len(order) and (dense or upper[order[at]] >= least - margin):
            now = order[at : at + step]
            now = now if dense else now[upper[now] >= least - margin]
            chosen[:] = False
            chosen[now] = True
            some = chosen[self.range[blocks]]
            mine = blocks[some]
            read = _spans(self.first[mine], self.first[mine + 1])
            w = np.repeat(weight[some], self.first[mine + 1] - self.first[mine])
            doc, tf = self.docs[read], self.tfs[read]
            np.add.at(score, doc, w * tf * (K1 + 1) / (tf + self.norm[doc]))
            hit[doc] = True
            at += len(now)
            if not dense:
                new = np.flatnonzero(chosen[np.arange(len(score)) // self.width] & hit & (True if mask is None else mask))
                kept = np.concatenate((kept, np.round(score[new], digits)))
                if len(kept) >= depth:
                    kept = np.partition(kept, len(kept) - depth)[len(kept) - depth :]
                    least = max(least, float(kept.min()))
                step *= 2
        if not dense:
            done = np.zeros(self.n_ranges, bool)
            done[order[:at]] = True
            self.skipped += int((~done[self.range[blocks]]).sum())
        found = np.flatnonzero((hit | zeros) if mask is None else (hit | zeros) & mask)
        score = np.round(score[found], digits) + 0.0
        found, score = found[score >= least], score[score >= least]
        if len(found) > depth:
            cut = np.partition(score, len(score) - depth)[len(score) - depth]
            found, score = found[score >= cut], score[score >= cut]
        if len(found) > depth:  # ties beyond the cut: the first by place
            some = np.lexsort((self.pos[found], -score))
            last = self.pos[found[some[depth - 1]]]
            some = some[: depth + int((self.pos[found[some[depth:]]] == last).sum())]
            found, score = found[some], score[some]
        return found, score


def _codes(names: pa.Array) -> tuple[dict, np.ndarray]:
    coded = names.dictionary_encode()
    return {v: i for i, v in enumerate(coded.dictionary.to_pylist())}, coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _spans(low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """All whole numbers of some spans, end to end."""
    n = high - low
    ends = np.cumsum(n)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(low - (ends - n), n)


def question_blocks(queries: DataFrame, block_bytes: int = BLOCK_BYTES) -> Iterator[list]:
    """Ids, words and filters of questions, streamed to the driver in bounded blocks."""
    block, size = [], 0
    for r in queries.select("query_id", X.whitespace_tokens("question").alias("w"), "book_filter", "chapter_filter").toLocalIterator():
        block.append((r["query_id"], r["w"] or [], r["book_filter"], r["chapter_filter"]))
        size += 32 + sum(map(len, r["w"] or []))
        if size >= block_bytes:
            yield block
            block, size = [], 0
    if block:
        yield block


def top_k(
    index: DataFrame, queries: DataFrame, *, vocabulary: DataFrame | None = None, size: tuple[int, int] | None = None, depth: int = CANDIDATE_DEPTH,
    drop_zero: bool = False, digits: int = 6, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """``query_id, chunk_id, rank0, score``: the best chunks of each query; a stored table.

    ``index`` is a stored table of segments, ``queries`` has ``query_id, question,
    book_filter, chapter_filter`` (null filters pass all). Statistics are those of the whole
    index unless given as ``vocabulary`` (``term, df``) and ``size`` (chunks, words).
    Filters act before the cut. Ordered by score rounded to ``digits``, then corpus
    position, then chunk id. Chunks without a word of the query have a score of zero and
    are among the results unless ``drop_zero``.
    """
    spark = index.sparkSession
    ship(spark)
    kind = queries.schema["query_id"].dataType.simpleString()
    n_docs, n_words = size or totals(index).first()
    mean, terms_of = (n_words / n_docs if n_docs else 0.0), vocabulary if vocabulary is not None else frequencies(index)
    weights = stored(weighted(terms_of, n_docs), "weights")  # once for all blocks
    order = Window.partitionBy("number").orderBy(F.desc("score"), "corpus_pos", "chunk_id")
    out = None
    for block in question_blocks(queries, block_bytes):
        shared = _sent(weights, block)
        found = index.mapInArrow(_search(shared, mean, depth, not drop_zero, digits), _FOUND)
        ranked = found.where("number is not null").withColumn("rank0", F.row_number().over(order) - 1).where(F.col("rank0") < depth)
        ids = F.broadcast(spark.createDataFrame([(i, b[0]) for i, b in enumerate(block)], f"number long, query_id {kind}"))  # of one block
        part = stored(ranked.join(ids, "number").select("query_id", "chunk_id", "rank0", "score"), "ranked")
        shared.unpersist()
        out = part if out is None else out.unionByName(part)
    dropped(weights)
    if out is None:
        return spark.createDataFrame([], f"query_id {kind}, chunk_id string, rank0 int, score double")
    return out


def skipped_blocks(index: DataFrame, queries: DataFrame, *, depth: int = CANDIDATE_DEPTH, digits: int = 6) -> tuple[int, int]:
    """Blocks of the queries' words, and how many of them a search of chunks with a word passes over."""
    ship(index.sparkSession)
    n_docs, n_words = totals(index).first()
    weights, found = weighted(frequencies(index), n_docs), None
    for block in question_blocks(queries):
        part = index.mapInArrow(_search(_sent(weights, block), n_words / n_docs if n_docs else 0.0, depth, False, digits), _FOUND)
        found = part if found is None else found.unionByName(part)
    return tuple(found.where("number is null").agg(F.sum("blocks"), F.sum("skipped")).first()) if found is not None else (0, 0)


def _sent(weights: DataFrame, block: list):
    """A block's words, and each of its queries as numbers and weights of words, and filters; broadcast."""
    spark = weights.sparkSession
    words = sorted({w for _, ws, _, _ in block for w in ws})
    asked = F.broadcast(spark.createDataFrame([(w,) for w in words], "term string"))  # of one block: bounded by its bytes
    idf = {r["term"]: r["idf"] for r in weights.join(asked, "term").collect()}
    known = sorted(idf)
    number = {w: i for i, w in enumerate(known)}
    sent = []
    for _, ws, book, chapter in block:
        own = sorted({number[w] for w in ws if w in number})
        sent.append((np.array(own, np.int64), np.array([idf[known[i]] * ws.count(known[i]) for i in own], np.float64), book, chapter))
    return spark.sparkContext.broadcast((known, sent))


_FOUND = "number long, score double, corpus_pos long, chunk_id string, blocks long, skipped long"


def _search(shared, mean: float, depth: int, zeros: bool, digits: int):
    names = ["number", "score", "corpus_pos", "chunk_id", "blocks", "skipped"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, sent = shared.value
        terms = pa.array(known, pa.string())
        kept: dict[int, list] = {}
        blocks = skipped = 0
        for b in batches:
            for i in range(b.num_rows):
                seg = Segment(b, i, mean)
                here = seg.numbers(terms)
                for q, (own, weights, book, chapter) in enumerate(sent):
                    at = here[own]
                    mine = kept.get(q, [])
                    floor = -mine[-1][0] if len(mine) == depth else -np.inf
                    mask = seg.passing(book, chapter)
                    if mask is not None and not mask.any() or not (at >= 0).any() and (not zeros or floor > 0):
                        continue
                    found, score = seg.best(at[at >= 0], weights[at >= 0], mask, depth, floor, zeros, digits)
                    if len(found):
                        new = [(-s, p, c) for s, p, c in zip(score.tolist(), seg.pos[found].tolist(), seg.ids.take(pa.array(found)).to_pylist())]
                        kept[q] = sorted(mine + new)[:depth]
                blocks, skipped = blocks + seg.blocks, skipped + seg.skipped
        rows = [(q, -s, p, c, None, None) for q, own in kept.items() for s, p, c in own] + [(None, None, None, None, blocks, skipped)]
        kinds = (pa.int64(), pa.float64(), pa.int64(), pa.string(), pa.int64(), pa.int64())
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    return run


def index_chunks(chunks: DataFrame, **options) -> DataFrame:
    """The segments of ``chunks`` as a stored table; texts are read once."""
    return stored(segments(spread(chunks.select("chunk_id", "corpus_pos", "book_title", "chapter", "text")), **options), "postings", **LONG_ROWS)
