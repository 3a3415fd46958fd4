"""Token counts as rollups that signed deltas maintain.

Totals by source, language and tokenizer version are sums, so a change to the corpus is
a small signed table: an insert adds a document and its tokens, a delete takes them off,
a revision adds the difference of two counts. A batch's changes are aggregated by group
before they are stored, so a store grows with batches and groups, not with documents.

A batch counts once its commit file exists. That file names the batch's data, is written
aside after them and renamed to the batch's name, which fails if the name is taken: a
batch that breaks off leaves data nobody reads, and one that is sent again changes
nothing. Where a rename to a name that is taken is not refused in one step (local files,
object stores) one writer at a time may commit.

Compaction is a commit that replaces those it lists. It is named by its generation, one
more than the last it knows, so of two that read the same batches one fails. Readers open
the last compaction and the commits it does not list.
"""

from __future__ import annotations

import base64
import json
import uuid
from collections.abc import Iterator
from functools import lru_cache
from urllib.parse import quote, unquote

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import lean, new_column, ship

GROUP = ["source", "lang", "version"]
_COMPACTION = "compaction-"
_SCHEMA = "source string, lang string, version string, n_docs long, n_tokens long"


@lru_cache(maxsize=4)
def _encoding(rank_path: str, pattern: str):
    import tiktoken

    with open(rank_path, "rb") as f:
        ranks = {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}
    return tiktoken.Encoding("counting", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def with_token_counts(docs: DataFrame, out: str, rank_paths: dict[str, str], pattern: str, *, text: str = "text") -> DataFrame:
    """``docs`` with the column ``out``: ``map<version, tokens>`` of each whole text; null text: zeros."""
    ship(docs.sparkSession)
    versions = sorted(rank_paths)

    @F.arrow_udf("map<string,bigint>")
    @lean
    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encodings = [(v, _encoding(rank_paths[v], pattern)) for v in versions]
        for batch in batches:
            rows = []
            for item in batch:
                t = (item.as_py() or "").encode("utf-8", "replace").decode()
                rows.append([(v, len(e.encode_ordinary(t))) for v, e in encodings])
            yield pa.array(rows, pa.map_(pa.string(), pa.int64()))

    return docs.withColumn(new_column(docs, out), count.asNondeterministic()(F.col(text)))


def inserts(counts: DataFrame) -> DataFrame:
    """Changes that add documents; ``counts`` has ``source, lang, version, n_tokens``, a row per document."""
    return counts.select(*GROUP, F.lit(1).cast("long").alias("n_docs"), F.col("n_tokens").cast("long").alias("n_tokens"))


def deletes(counts: DataFrame) -> DataFrame:
    """Changes that take documents off, given as they were counted."""
    return counts.select(*GROUP, F.lit(-1).cast("long").alias("n_docs"), (-F.col("n_tokens")).cast("long").alias("n_tokens"))


def revisions(counts: DataFrame) -> DataFrame:
    """Changes that replace counts; ``counts`` has ``old_tokens`` and ``n_tokens``."""
    moved = (F.col("n_tokens") - F.col("old_tokens")).cast("long")
    return counts.select(*GROUP, F.lit(0).cast("long").alias("n_docs"), moved.alias("n_tokens"))


class Rollup:
    """A store of committed batches at a path that all machines reach."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _file(self, name: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p, p.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def _names(self) -> tuple[list[int], list[str]]:
        """Generations of the compactions, and the names of the other batches that have a commit file of their own."""
        p, system = self._file("commits")
        files = [f.getPath().getName() for f in system.listStatus(p)] if system.exists(p) else []
        names = [unquote(f.removesuffix(".json")) for f in files if f.endswith(".json")]
        folded = [n.removeprefix(_COMPACTION) for n in names if n.startswith(_COMPACTION)]
        return sorted(map(int, folded)), sorted(n for n in names if not n.startswith(_COMPACTION))

    def _read(self, batch: str) -> dict:
        p, system = self._file(f"commits/{quote(batch, safe='')}.json")
        stream = system.open(p)
        raw = bytes(self.spark._jvm.org.apache.hadoop.io.IOUtils.readFullyToByteArray(stream))
        stream.close()
        return json.loads(raw)

    def _commit(self, batch: str, changes: DataFrame, replaces: list[str]) -> bool:
        folder = f"{self.path}/data/{uuid.uuid4().hex}"
        grouped = changes.groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        grouped.write.parquet(folder)
        p, system = self._file(f"commits/{quote(batch, safe='')}.json")
        part, _ = self._file(f"commits/{uuid.uuid4().hex}.part")
        body = json.dumps({"batch": batch, "data": folder, "replaces": replaces}).encode()
        stream = system.create(part, False)
        stream.write(bytearray(body))
        stream.close()
        done = not system.exists(p) and system.rename(part, p)
        if not done:
            system.delete(part, False)
        return done

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Add a batch's signed changes once; False if a batch of that name is committed already."""
        if batch.startswith(_COMPACTION):
            raise ValueError(f"names that begin with {_COMPACTION} are for compactions")
        if batch in self.batches():
            return False
        return self._commit(batch, changes, [])

    def batches(self) -> set[str]:
        """All batches ever committed, folded ones included."""
        return set(self._names()[1])

    def _live(self) -> tuple[int, list[dict]]:
        """The last compaction's generation, 0 if there is none, and the commits that count."""
        folded, names = self._names()
        last = [self._read(f"{_COMPACTION}{folded[-1]}")] if folded else []
        replaced = set(last[0]["replaces"]) if last else set()
        return folded[-1] if folded else 0, last + [self._read(n) for n in names if n not in replaced]

    def changes(self) -> DataFrame:
        """The stored changes that count."""
        paths = [c["data"] for c in self._live()[1]]
        if not paths:
            return self.spark.createDataFrame([], _SCHEMA)
        return self.spark.read.schema(_SCHEMA).parquet(*paths)

    def totals(self) -> DataFrame:
        """``source, lang, version, n_docs, n_tokens``; groups without documents or tokens are left out."""
        out = self.changes().groupBy(*GROUP).agg(F.sum("n_docs").alias("n_docs"), F.sum("n_tokens").alias("n_tokens"))
        return out.where((F.col("n_docs") != 0) | (F.col("n_tokens") != 0))

    def compact(self) -> bool:
        """Fold all live batches into one; readers see the same totals before and after.

        False if there is nothing to fold, or another compaction of this generation came first.
        """
        last, live = self._live()
        if len(live) < 2:
            return False
        names = sorted({b for c in live for b in [c["batch"], *c["replaces"]] if not b.startswith(_COMPACTION)})
        stored = self.spark.read.schema(_SCHEMA).parquet(*[c["data"] for c in live])
        return self._commit(f"{_COMPACTION}{last + 1}", stored, names)
