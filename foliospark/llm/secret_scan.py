"""Secret scans judged by corpus-wide ownership frequency.

Every text is scanned once for candidate spans. The candidates' hashes are aggregated
over the whole corpus by distinct owners and repositories (distinct pairs first, so a
value that is everywhere is pre-aggregated before any shuffle). A value that many owners
share is a widely copied *example*; one that few owners hold is a *live*-looking
credential. The frequency also decides which generic high-entropy tokens, too weak a
sign by themselves, are reported: only the owner-specific ones.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, materialize, new_column, ship

#: Kinds in the order in which spans of one start are listed; the first three are the base.
KINDS = ("assign", "access", "hex", "generic")
#: A value held by at least so many owners is an example.
EXAMPLE_OWNERS = 3
#: Bits a character that a generic token needs.
MIN_ENTROPY = 3.5

_ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]+")
_GENERIC = re.compile(r"[A-Za-z0-9+/_-]{20,}")
_WORDS = (b"password", b"passwd", b"secret", b"token", b"apikey", b"api_key")
_HEX_RUN, _GENERIC_RUN = b"h" * 24, b"g" * 20
_HEX_TABLE = bytes(104 if chr(i) in "0123456789abcdef" else 32 for i in range(256))
_GENERIC_TABLE = bytes(103 if i < 128 and (chr(i).isalnum() or chr(i) in "+/_-") else 32 for i in range(256))

Span = tuple[str, int, int, str]


def base_spans(text: str) -> list[Span]:
    """``(kind, start, end, value)`` of the base kinds, by start, then kind.

    Leftmost matches of each kind that do not overlap; matches whose value is too short
    (assign 6, access 20, hex 24 characters) are dropped after they took their place.
    Positions are code points, ends exclusive.
    """
    raw = text.encode("utf-8", "surrogatepass")
    low = raw.lower()
    out: list[Span] = []
    if any(w in low for w in _WORDS):
        out += [("assign", m.start(), m.end(), m[2]) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if b"AKIA" in raw:
        out += [("access", m.start(), m.end(), m[0]) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    if _HEX_RUN in raw.translate(_HEX_TABLE):
        out += [("hex", m.start(), m.end(), m[0]) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    out.sort(key=lambda s: (s[1], KINDS.index(s[0])))
    return out


def generic_spans(text: str, base: list[Span], min_entropy: float = MIN_ENTROPY) -> list[Span]:
    """High-entropy tokens of 20+ characters with lower, upper and digits, outside ``base``."""
    if _GENERIC_RUN not in text.encode("utf-8", "surrogatepass").translate(_GENERIC_TABLE):
        return []
    out = []
    for m in _GENERIC.finditer(text):
        t = m[0]
        if not (any(c.isdigit() for c in t) and any(c.islower() for c in t) and any(c.isupper() for c in t)):
            continue
        bits = -sum(n / len(t) * math.log2(n / len(t)) for n in Counter(t).values())
        if bits >= min_entropy and not any(s < m.end() and m.start() < e for _, s, e, _ in base):
            out.append(("generic", m.start(), m.end(), t))
    return out


_SPAN_TYPE = pa.struct(
    [("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("hash", pa.string())]
)
_SPAN_DDL = "array<struct<kind:string,start:int,end:int,hash:string>>"


def with_candidates(docs: DataFrame, out: str, *, text: str = "text", min_entropy: float = MIN_ENTROPY) -> DataFrame:
    """``docs`` with the column ``out``: all candidate spans with their values' SHA-256."""
    ship(docs.sparkSession)

    @F.arrow_udf(_SPAN_DDL)
    @lean
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = []
            for item in batch:
                t = item.as_py() or ""
                base = base_spans(t)
                rows.append(
                    [
                        {"kind": k, "start": s, "end": e, "hash": hashlib.sha256(v.encode()).hexdigest()}
                        for k, s, e, v in base + generic_spans(t, base, min_entropy)
                    ]
                )
            yield pa.array(rows, pa.list_(_SPAN_TYPE))

    return docs.withColumn(new_column(docs, out), scan.asNondeterministic()(F.col(text)))


def ownership(candidates: DataFrame, *, example_owners: int = EXAMPLE_OWNERS) -> DataFrame:
    """Per candidate hash: ``n_owners, n_repos, n_spans, verdict``.

    ``candidates`` has ``hash, owner, repo``, a row per span. A null owner or repository
    counts as one unknown owner or repository.
    """
    c = candidates.select("hash", F.coalesce("owner", F.lit("")).alias("owner"), F.coalesce("repo", F.lit("")).alias("repo"))
    pairs = c.groupBy("hash", "owner", "repo").agg(F.count("*").alias("n"))
    owners = pairs.groupBy("hash", "owner").agg(F.sum("n").alias("n")).groupBy("hash").agg(
        F.count("*").alias("n_owners"), F.sum("n").alias("n_spans")
    )
    repos = pairs.select("hash", "repo").distinct().groupBy("hash").agg(F.count("*").alias("n_repos"))
    return owners.join(repos, "hash").select(
        "hash",
        "n_owners",
        "n_repos",
        "n_spans",
        F.when(F.col("n_owners") >= example_owners, "example").otherwise("live").alias("verdict"),
    )


def _judged(marked: DataFrame, example_owners: int) -> DataFrame:
    """Per row number: its judged spans in order; only rows that have candidates."""
    spans = marked.where("_n > 0").select("_row", "_owner", "_repo", F.explode("_spans").alias("s"))
    verdicts = ownership(
        spans.select("s.hash", F.col("_owner").alias("owner"), F.col("_repo").alias("repo")),
        example_owners=example_owners,
    )
    flat = spans.select("_row", "s.*").join(verdicts, "hash")
    order = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind"))
    return (
        flat.where((F.col("kind") != "generic") | (F.col("verdict") == "live"))
        .groupBy("_row")
        .agg(
            F.array_sort(
                F.collect_list(F.struct("start", order.alias("nth"), "end", "kind", "hash", "verdict", "n_owners", "n_repos"))
            ).alias("judged")
        )
    )


def _mark(docs: DataFrame, text: str, repo: Column, owner: Column, min_entropy: float, keep: list) -> DataFrame:
    out = with_candidates(
        docs.select(*keep, F.col(text).alias("_text"), repo.cast("string").alias("_repo"), owner.cast("string").alias("_owner")),
        "_spans",
        text="_text",
        min_entropy=min_entropy,
    )
    return out.withColumn("_n", F.size("_spans")).withColumn("_row", F.monotonically_increasing_id())


def scan_secrets(
    docs: DataFrame, *, key: str = "doc_id", text: str = "text", repo: Column | str = "source",
    owner: Column | str = "source", example_owners: int = EXAMPLE_OWNERS, min_entropy: float = MIN_ENTROPY,
) -> DataFrame:
    """One row per document: ``doc_id, judged`` with every span found and its verdict.

    ``judged`` is ``array<struct<start, nth, end, kind, hash, verdict, n_owners, n_repos>>``,
    sorted by start, then kind; null where nothing was found. Null texts are empty. Base
    spans are always there; generic ones only if owner-specific. Repeated rows each give
    a row and count as often in ``n_spans``, but once in the distinct counts. Other
    columns of ``docs`` are not read. An empty table gives an empty result.
    """
    repo, owner = (F.col(c) if isinstance(c, str) else c for c in (repo, owner))
    marked = materialize(_mark(docs, text, repo, owner, min_entropy, [F.col(key).alias("doc_id")]).drop("_text"), "spans")
    return marked.select("doc_id", "_row").join(_judged(marked, example_owners), "_row", "left").drop("_row")


def redact_secrets(
    docs: DataFrame, *, text: str = "text", repo: Column | str = "source", owner: Column | str = "source",
    example_owners: int = EXAMPLE_OWNERS, min_entropy: float = MIN_ENTROPY,
) -> DataFrame:
    """``docs`` with live-looking credentials in ``text`` replaced by ``[secret:<kind>]``.

    Widely copied examples stay, as do all rows and all other columns. Overlapping live
    spans are replaced as one, named after the first.
    """
    repo, owner = (F.col(c) if isinstance(c, str) else c for c in (repo, owner))
    marked = materialize(_mark(docs, text, repo, owner, min_entropy, [F.struct("*").alias("_doc")]).drop("_text"), "spans")
    live = F.filter("judged", lambda s: s["verdict"] == "live")
    judged = _judged(marked, example_owners).select("_row", live.alias("_live"))
    hit = marked.where("_n > 0").join(judged, "_row", "left")

    @F.arrow_udf("string")
    def replace(texts: pa.Array, spans: pa.Array) -> pa.Array:
        out = []
        for t, found in zip(texts.to_pylist(), spans.to_pylist()):
            out.append(replace_spans(t, [(s["kind"], s["start"], s["end"]) for s in found or ()]) if t else t)
        return pa.array(out, pa.string())

    fixed = hit.withColumn("_fixed", replace(F.col(f"_doc.{text}"), F.col("_live")))
    as_docs = lambda df, fixed: df.select(*[fixed if c == text else F.col(f"_doc.`{c}`").alias(c) for c in docs.columns])
    return as_docs(marked.where("_n = 0"), F.col(f"_doc.`{text}`").alias(text)).unionByName(
        as_docs(fixed, F.col("_fixed").alias(text))
    )


def replace_spans(text: str, spans: list[tuple[str, int, int]]) -> str:
    """``text`` with the spans, given by start, replaced; overlapping ones as one."""
    out, at = [], 0
    for kind, start, end in spans:
        if start >= at:
            out += [text[at:start], f"[secret:{kind}]"]
        at = max(at, end)
    return "".join(out) + text[at:]


def digest(scanned: DataFrame) -> DataFrame:
    """The digest columns of the scan: counts of the base kinds, their hash, all spans."""
    spans = F.coalesce("judged", F.array().cast(scanned.schema["judged"].dataType))
    base = F.filter(spans, lambda s: s["kind"] != "generic")
    show = lambda a: F.array_join(F.transform(a, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter(spans, lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    verdicts = lambda v: F.size(F.filter(spans, lambda s: s["verdict"] == v)).cast("long").alias(f"n_{v}")
    return scanned.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(show(base), 256).alias("base_sha256"),
        show(spans).alias("spans"), verdicts("live"), verdicts("example"),
    )
