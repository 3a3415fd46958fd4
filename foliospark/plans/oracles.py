"""DuckDB SQL for the queries of :mod:`.queries`; written for clarity, not for scale."""

from __future__ import annotations

from ..model import GREEK, NON_CHAPTER_KEYWORDS, POLLUTION_KEYWORDS, STOPWORDS
from ..operators.concepts import PROMPT
from ..operators.evaluate import JUDGES
from ..operators.query import INSTRUCTIONS

_STOP = ", ".join(f"'{w}'" for w in STOPWORDS)

CHUNKS = """chunks AS (SELECT lower(replace(source, ' ', '_')) || '_p' || doc_id || '_g0_c0' AS chunk_id, text, source AS book_title,
  lang AS chapter, 'Unknown' AS section, doc_id AS page_number, doc_id AS corpus_pos FROM documents)"""

QUESTIONS = "q AS (SELECT item_id AS query_id, text AS question, NULL AS book_filter, NULL AS chapter_filter FROM benchmark)"
FILTERED = """q AS (SELECT item_id AS query_id, text AS question, 'src' || (item_id % 20) AS book_filter,
  CASE WHEN item_id % 2 = 0 THEN 'en' END AS chapter_filter FROM benchmark)"""
WITH_VECTOR = """q AS (SELECT item_id AS query_id, text AS question, embedding AS qv, NULL AS book_filter, NULL AS chapter_filter
  FROM benchmark JOIN embeddings ON vec_id = item_id)"""

BM25_STATS = r"""
w AS (SELECT chunk_id, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM chunks),
dl AS (SELECT c.chunk_id, count(w.term) AS dl FROM chunks c LEFT JOIN w USING (chunk_id) GROUP BY 1),
st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
df AS (SELECT term, count(*) AS df FROM (SELECT DISTINCT chunk_id, term FROM w) GROUP BY 1),
rawidf AS MATERIALIZED (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS v FROM df, st),
meanidf AS MATERIALIZED (SELECT avg(v) AS mean FROM rawidf),
idf AS (SELECT term, df, CASE WHEN v < 0 THEN 0.25 * mean ELSE v END AS idf FROM rawidf, meanidf)"""

BM25 = BM25_STATS + r""",
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '\S+')) AS term FROM q) GROUP BY ALL),
tf AS (SELECT chunk_id, term, count(*) AS tf FROM w GROUP BY ALL),
sc AS (SELECT query_id, chunk_id, sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score
  FROM qt JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id), st GROUP BY ALL),
lexall AS (SELECT q.query_id, c.chunk_id, round(coalesce(score, 0), 6) AS score, row_number() OVER (PARTITION BY q.query_id
  ORDER BY round(coalesce(score, 0), 6) DESC, corpus_pos, c.chunk_id) - 1 AS rank0
  FROM q CROSS JOIN chunks c LEFT JOIN sc ON sc.query_id = q.query_id AND sc.chunk_id = c.chunk_id
  WHERE (book_filter IS NULL OR book_filter = book_title) AND (chapter_filter IS NULL OR chapter_filter = chapter)),
lex AS (SELECT * FROM lexall WHERE rank0 < 20)"""

#: The chunks of a changed library's versions 1 to 5, under the names of the queries that follow.
CHANGED = """first AS (SELECT chunk_id, text, book_title, chapter, section, page_number, corpus_pos FROM base),
again AS (SELECT * REPLACE (coalesce(text, '') || ' Revised TOKEN words revised' AS text) FROM first WHERE book_title = 'src1' AND corpus_pos % 3 > 0),
second AS (SELECT * FROM first WHERE book_title <> 'src1' OR book_title IS NULL UNION ALL SELECT * FROM again
  UNION ALL SELECT * REPLACE ('new — book' AS book_title) FROM first WHERE book_title = 'src3' AND corpus_pos % 4 = 3),
gone AS (SELECT chunk_id FROM first WHERE corpus_pos % 11 = 0 AND book_title NOT IN ('src1', 'src3')),
third AS (SELECT * FROM second WHERE chunk_id NOT IN (SELECT chunk_id FROM gone)),
fourth AS (SELECT * FROM third WHERE book_title <> 'src2' OR book_title IS NULL),
chunks AS (SELECT * FROM fourth WHERE book_title <> 'src1' OR book_title IS NULL UNION ALL SELECT * FROM again WHERE corpus_pos % 7 > 1)"""
BASE = CHUNKS.replace("chunks AS", "base AS", 1)

DENSE_DOCS = """
vec AS (SELECT c.*, embedding FROM chunks c JOIN embeddings ON vec_id = corpus_pos),
denall AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(list_inner_product(qv::DOUBLE[], embedding::DOUBLE[]), 6) DESC, corpus_pos) - 1 AS rank0
  FROM q CROSS JOIN vec WHERE (book_filter IS NULL OR book_filter = book_title) AND (chapter_filter IS NULL OR chapter_filter = chapter)),
den AS (SELECT * FROM denall WHERE rank0 < 20)"""


#: In a changed library two books may have chunks of one id: they are told apart by their book.
LIBRARY_BM25 = (BM25.replace("chunk_id, unnest", "chunk_id || coalesce(book_title, '') AS chunk_id, unnest").replace("SELECT c.chunk_id, count(w.term)", "SELECT c.chunk_id || coalesce(book_title, '') AS chunk_id, count(w.term)")
    .replace("FROM chunks c LEFT JOIN w USING (chunk_id)", "FROM chunks c LEFT JOIN w ON w.chunk_id = c.chunk_id || coalesce(book_title, '')").replace("sc.chunk_id = c.chunk_id", "sc.chunk_id = c.chunk_id || coalesce(book_title, '')"))


def fused(dense: str, lexical: str, k: int) -> str:
    return f"""
both_lists AS (SELECT query_id, chunk_id, rank0, 0 AS src FROM {dense} UNION ALL SELECT query_id, chunk_id, rank0, 1 FROM {lexical}),
summed AS (SELECT query_id, chunk_id, sum(1.0::DOUBLE / (60 + rank0)) AS rrf, min(src * 1000 + rank0) AS first_place FROM both_lists GROUP BY ALL),
placed AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rrf, 12) DESC, first_place, chunk_id) AS pos FROM summed),
fused AS (SELECT query_id, pos, chunk_id, round(rrf, 5) AS rrf_score FROM placed WHERE pos <= {k})"""


RANKINGS = """
bylen AS (SELECT source AS query_id, doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) - 1 AS rank0 FROM documents QUALIFY rank0 < 20),
byid AS (SELECT source AS query_id, doc_id::VARCHAR AS chunk_id, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS rank0 FROM documents QUALIFY rank0 < 20)"""

PROFILES = f"""
words AS (SELECT book_title, corpus_pos, unnest(l) AS word, generate_subscripts(l, 1) AS nth
  FROM (SELECT book_title, corpus_pos, regexp_extract_all(lower(text), '[a-z]+') AS l FROM chunks)),
kept AS (SELECT * FROM words WHERE length(word) > 2 AND word NOT IN ({_STOP})),
cnt AS (SELECT book_title, word, count(*) AS n, min(corpus_pos * 1000000 + nth) AS first_at FROM kept GROUP BY ALL),
scored AS (SELECT book_title, word, first_at, (n / sum(n) OVER (PARTITION BY book_title)) / (sum(n) OVER (PARTITION BY word) / sum(n) OVER ()) * n AS score FROM cnt),
profiles AS (SELECT book_title, word, score, row_number() OVER (PARTITION BY book_title ORDER BY round(score, 9) DESC, first_at) AS rank FROM scored QUALIFY rank <= 60)"""

ROUTES = f"""
qw AS (SELECT DISTINCT query_id, word FROM (SELECT query_id, unnest(regexp_extract_all(lower(question), '[a-z]+')) AS word FROM q) WHERE length(word) > 2 AND word NOT IN ({_STOP})),
hits AS (SELECT query_id, book_title, count(*) AS score FROM qw JOIN profiles USING (word) GROUP BY ALL),
two AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, book_title) AS rn FROM hits),
best AS (SELECT query_id, max(CASE WHEN rn = 1 THEN book_title END) AS book, max(CASE WHEN rn = 1 THEN score END) AS top, coalesce(max(CASE WHEN rn = 2 THEN score END), 0) AS second FROM two GROUP BY 1),
routes AS (SELECT q.query_id, CASE WHEN second = 0 OR top >= 1.5 * second THEN book END AS book_filter FROM q LEFT JOIN best USING (query_id))"""

LINES = """
cut AS (SELECT doc_id, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS line_no FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents)),
lines AS (SELECT 'doc' || doc_id AS book_title, line_no, line_no // 10 + 1 AS page_number, trim(raw) AS text,
  CASE WHEN length(trim(raw)) <= 24 THEN 16.0 WHEN length(trim(raw)) <= 48 THEN 13.0 ELSE 10.0 END::DOUBLE AS size
  FROM cut WHERE trim(raw) <> '')"""

LEVELS = LINES + """,
sizes AS (SELECT book_title, size, count(*) AS n, min(line_no) AS first_no FROM lines GROUP BY ALL),
body AS (SELECT book_title, size AS body_size FROM sizes QUALIFY row_number() OVER (PARTITION BY book_title ORDER BY n DESC, first_no) = 1),
levelled AS (SELECT l.*, CASE WHEN size / body_size >= 1.5 THEN 'chapter' WHEN size / body_size >= 1.2 THEN 'section' END AS level FROM lines l JOIN body USING (book_title))"""

HEADS = LEVELS + """,
pages_of AS (SELECT book_title, max(page_number) AS n_pages FROM lines GROUP BY 1),
heads AS (SELECT book_title, row_number() OVER w - 1 AS pos, text AS title, page_number AS start_page,
  coalesce(lead(page_number) OVER w - 1, n_pages) AS end_page, 1 AS level
  FROM levelled JOIN pages_of USING (book_title) WHERE level = 'chapter' WINDOW w AS (PARTITION BY book_title ORDER BY page_number, line_no))"""

TOC = """
toc AS (SELECT 'conv' || conv_id AS book_title, turn AS pos, CASE role WHEN 'system' THEN 1 WHEN 'user' THEN 2 ELSE 3 END AS level,
  (turn // 2) || '.1 ' || coalesce(text, '') AS title, turn AS start_page FROM conversations),
toc_pages AS (SELECT book_title, max(start_page) + 3 AS n_pages FROM toc GROUP BY 1),
nexts AS (SELECT a.book_title, a.pos, arg_min(b.start_page, b.pos) AS nxt FROM toc a JOIN toc b ON b.book_title = a.book_title AND b.pos > a.pos AND b.level <= a.level GROUP BY ALL),
ranges AS (SELECT t.book_title, t.pos, title, start_page, greatest(coalesce(nxt - 1, n_pages), start_page) AS end_page, level
  FROM toc t JOIN toc_pages USING (book_title) LEFT JOIN nexts n ON n.book_title = t.book_title AND n.pos = t.pos)"""

_REAL = "NOT (" + " OR ".join(f"contains(lower(title), '{k}')" for k in NON_CHAPTER_KEYWORDS) + ")"
_POLLUTED = "(" + " OR ".join(f"contains(lower({{}}), '{k}')" for k in POLLUTION_KEYWORDS) + ")"

SOURCE_RANGES = """
tops AS (SELECT source AS book_title, max(doc_id) AS top FROM documents GROUP BY 1),
src_ranges AS (SELECT book_title, 0 AS pos, 'en' AS title, 0 AS s, floor(top * 0.5) AS e FROM tops UNION ALL SELECT book_title, 1, 'later', floor(top * 0.25), floor(top * 0.75) FROM tops),
hitsr AS (SELECT chunk_id, arg_min(title, pos) AS title FROM chunks c JOIN src_ranges r ON c.book_title = r.book_title AND page_number BETWEEN s AND e GROUP BY 1),
assigned AS (SELECT c.*, h.title AS hit FROM chunks c LEFT JOIN hitsr h USING (chunk_id))"""

ORDERED = """
ordered AS (SELECT book_title, chapter, min(corpus_pos) AS first_at FROM chunks WHERE chapter IS NOT NULL AND chapter <> 'Front/Back Matter' GROUP BY ALL),
chapters AS (SELECT book_title, chapter, row_number() OVER (PARTITION BY book_title ORDER BY first_at, chapter) AS chapter_pos FROM ordered)"""

BATCHES = """
batched AS (SELECT book_title, chunk_id, (row_number() OVER (PARTITION BY book_title ORDER BY corpus_pos, chunk_id) - 1) // 15 AS batch_id FROM chunks),
keys AS (SELECT book_title, batch_id, md5(string_agg(chunk_id, '|' ORDER BY chunk_id)) AS cache_key FROM batched GROUP BY ALL)"""

GRAPH = r"""
toks AS (SELECT item_id, item_id % 5 AS book_pos, regexp_extract_all(lower(text), '\S+') AS l FROM benchmark),
terms AS (SELECT 'b' || book_pos AS book_title, book_pos, item_id * 1000 + generate_subscripts(l, 1) - 1 AS term_pos, unnest(l) AS term, 'item ' || item_id AS definition FROM toks),
nodes AS (SELECT term AS term_id, arg_min(term, (book_pos * 100000000 + term_pos)) AS label, arg_min(definition, (book_pos * 100000000 + term_pos)) AS definition,
  string_agg(DISTINCT book_title, ',' ORDER BY book_title) AS books, count(DISTINCT book_title) AS n_books, min(book_pos * 100000000 + term_pos) AS first_at FROM terms GROUP BY 1),
rels AS (SELECT a.book_title, a.book_pos, a.term_pos AS rel_pos, a.term AS src, 'r' || (a.term_pos % 1000) AS relation, b.term AS dst
  FROM terms a JOIN terms b ON b.term_pos = a.term_pos + 1 AND b.definition = a.definition),
edges AS (SELECT src, dst, arg_max(relation, book_pos * 100000000 + rel_pos) AS relation, 'INTERNAL_LINK' AS edge_type,
  arg_max(book_title, book_pos * 100000000 + rel_pos) AS book, min(book_pos * 100000000 + rel_pos) AS first_at FROM rels GROUP BY ALL),
ends AS (SELECT src AS term_id FROM edges UNION ALL SELECT dst FROM edges),
degs AS (SELECT n.term_id, count(e.term_id) AS degree FROM nodes n LEFT JOIN ends e USING (term_id) GROUP BY 1),
degrees AS (SELECT term_id, degree, max(degree) OVER () AS max_degree, degree >= greatest(2, max(degree) OVER ()) AS is_hub FROM degs)"""

NEIGHBOURS = GRAPH + """,
both_ways AS (SELECT src AS term_id, dst AS other, relation, 0 AS dir, first_at FROM edges UNION ALL SELECT dst, src, relation, 1, first_at FROM edges),
nth AS (SELECT b.*, label, row_number() OVER (PARTITION BY b.term_id ORDER BY dir, b.first_at, other) AS nth, count(*) OVER (PARTITION BY b.term_id) AS n FROM both_ways b JOIN nodes ON nodes.term_id = other),
related AS (SELECT n.term_id, coalesce(max(n), 0) AS n_related, coalesce(string_agg(relation || '>' || nth.label, ',' ORDER BY nth) FILTER (nth <= 8), '') AS related
  FROM nodes n LEFT JOIN nth USING (term_id) GROUP BY 1)"""

HTML = r"""
found AS (SELECT page_id, url, unnest(l) AS raw, generate_subscripts(l, 1) - 1 AS line_no
  FROM (SELECT page_id, url, regexp_extract_all(html, '(?is)<(?:h1|h2|h3|p|li)\b[^>]*>.*?</(?:h1|h2|h3|p|li)>') AS l FROM pages)),
tagged AS (SELECT *, lower(regexp_extract(raw, '^<(\w+)', 1)) AS tag, trim(regexp_replace(regexp_replace(raw, '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g')) AS text FROM found),
hlines AS (SELECT url AS book_title, line_no, page_id AS page_number, text, CASE tag WHEN 'h1' THEN 18.0 WHEN 'h2' THEN 15.0 WHEN 'h3' THEN 13.0 ELSE 10.0 END::DOUBLE AS size FROM tagged WHERE text <> '')"""

TRUTHS = """truths AS (SELECT item_id AS query_id, lower(replace(source, ' ', '_')) || '_p' || doc_id || '_g0_c0' AS chunk_id
  FROM documents d JOIN benchmark b ON contains(d.text, b.text))"""

QUESTIONS_OF = r"""
rowsq AS (SELECT *, list_filter([trim(x) for x in string_split(text, chr(10))], lambda x: x <> '') AS ls FROM chunks
  WHERE NOT contains(text, '....') AND NOT contains(text, 'Table of Contents') AND length(trim(text)) >= 150),
made AS (SELECT corpus_pos, chunk_id, 'According to the text on ' || substring(ls[1], 1, 50) || ', what is explained about ' || substring(array_to_string(ls[1:2], ' '), 1, 60) || '?' AS question,
  trim(replace(substring(text, 1, 250), chr(10), ' ')) || '...' AS ground_truth_answer FROM rowsq WHERE len(ls) > 0)"""


_SPACE = r"[\s\x{0B}\x{85}\p{Z}]"
_WORD = r"[\p{L}\p{M}\p{Nd}\p{Nl}\p{Pc}]"
_FORMULAS = r"""coalesce(text, '') || ' Let $\frac{' || doc_id || '}{n}\sum_{i=1}^{n} x_i \leq \alpha^2$ and E = mc^3 \times y^{k+1}, $\nabla_\theta L$; '
  || 'a^2^3 b^{2}^n, x_{i}_j c_d_e $$\beta \neq \pi \cdot z^10$$ (see p.4) \geq é^2.'"""


def _spoken(text: str) -> str:
    """Speech as nested replacements; a power's exponent stands between two marks until it is named."""
    for pattern, by in (
        (rf"{_SPACE}*\([^()]*p\.\p{{Nd}}+\)", ""), (r"\\frac\{([^{}]*)\}\{([^{}]*)\}", r"\1 over \2 "), (r"\\sum_\{([^{}]*)\}\^\{([^{}]*)\}", r"the sum from \1 to \2 of"),
        (r"\\(" + "|".join(GREEK) + r")\b", r"\1"), (rf"({_WORD}+)\^(?:\{{([^{{}}]*)\}}|({_WORD}+))", "\\1\x02\\2\\3\x03"), ("\x022\x03", " squared"), ("\x023\x03", " cubed"),
        ("\x02([^\x02\x03]*)\x03", r" to the power of \1"), (rf"({_WORD}+)_(?:\{{([^{{}}]*)\}}|({_WORD}+))", r"\1 sub \2\3"), (r"\\times|\\cdot", "times"),
        (r"\\leq", "less than or equal to"), (r"\\geq", "greater than or equal to"), (r"\\neq", "not equal to"), ("=", " equals "), (r"\$", ""), (r"\\([a-zA-Z]+)", r"\1"),
        (rf"{_SPACE}+", " "), ("^ | $", ""),
    ):
        text = f"regexp_replace({text}, '{pattern}', '{by}', 'g')"
    return text


def _with(*parts: str) -> str:
    return "WITH " + ",\n".join(p.strip() for p in parts) + "\n"


ORACLES: dict[str, str] = {
    "bm25_topk": _with(CHUNKS, QUESTIONS, BM25) + "SELECT query_id, chunk_id, rank0, score FROM lex",
    "bm25_filtered": _with(CHUNKS, FILTERED, BM25) + "SELECT query_id, chunk_id, rank0, score FROM lex",
    "bm25_idf": _with(CHUNKS, BM25_STATS) + "SELECT term, df, round(idf, 6) AS idf FROM idf",
    "dense_topk": """SELECT a.vec_id AS query_id, 'v' || b.vec_id AS chunk_id, row_number() OVER w - 1 AS rank0, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
      FROM embeddings a CROSS JOIN embeddings b WHERE a.vec_id % 50 = 0
      WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) QUALIFY rank0 < 20""",
    "dense_filtered": """SELECT a.vec_id AS query_id, 'v' || b.vec_id AS chunk_id, row_number() OVER w - 1 AS rank0, round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) AS score
      FROM embeddings a JOIN embeddings b ON a.label = b.label WHERE a.vec_id % 50 = 0
      WINDOW w AS (PARTITION BY a.vec_id ORDER BY round(list_inner_product(a.embedding::DOUBLE[], b.embedding::DOUBLE[]), 6) DESC, b.vec_id) QUALIFY rank0 < 20""",
    "rrf_fusion": _with(RANKINGS, fused("bylen", "byid", 5)) + "SELECT * FROM fused",
    "hybrid_search": _with(CHUNKS, WITH_VECTOR, BM25, DENSE_DOCS, fused("den", "lex", 5))
    + "SELECT query_id, pos, pos AS found_pos, chunk_id, rrf_score, book_title, chapter, page_number FROM fused JOIN chunks USING (chunk_id)",
    "orphan_results": _with(RANKINGS, fused("bylen", "byid", 10))
    + "SELECT query_id, count(*) AS n_skipped FROM fused WHERE chunk_id NOT IN (SELECT doc_id::VARCHAR FROM labels) GROUP BY 1",
    "hydrated_results": _with(RANKINGS, fused("bylen", "byid", 10))
    + "SELECT query_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS found_pos, chunk_id, quality::BIGINT AS quality FROM fused JOIN labels ON chunk_id = doc_id::VARCHAR",
    "book_profiles": _with(CHUNKS, PROFILES) + "SELECT book_title, word, round(score, 6) AS score, rank FROM profiles",
    "route_book": _with(CHUNKS, QUESTIONS, PROFILES, ROUTES) + "SELECT * FROM routes",
    "route_chapter": """WITH parts AS (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings),
      means AS (SELECT label, i, avg(x::DOUBLE) AS x FROM parts GROUP BY ALL),
      vecs AS (SELECT label, list(x ORDER BY i) AS v FROM means GROUP BY 1),
      two AS (SELECT vec_id AS query_id, v.label, round(list_inner_product(embedding::DOUBLE[], v.v), 6) AS score FROM embeddings CROSS JOIN vecs v WHERE vec_id % 50 = 0),
      rn AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, label) AS rn FROM two),
      best AS (SELECT query_id, max(CASE WHEN rn = 1 THEN label END)::VARCHAR AS c, max(CASE WHEN rn = 1 THEN score END) AS top, coalesce(max(CASE WHEN rn = 2 THEN score END), 0) AS second FROM rn GROUP BY 1)
      SELECT query_id, CASE WHEN top >= 0.25 AND (second <= 0 OR top >= 1.15 * second) THEN c END AS chapter_filter FROM best""",
    "debug_query": _with(
        CHUNKS,
        "q0 AS (SELECT item_id AS query_id, text AS question, embedding AS qv FROM benchmark JOIN embeddings ON vec_id = item_id)",
        PROFILES,
        ROUTES.replace("FROM q LEFT", "FROM q0 q LEFT").replace("FROM q)", "FROM q0)"),
        "q AS (SELECT q0.*, book_filter, NULL AS chapter_filter FROM q0 JOIN routes USING (query_id))",
        BM25, DENSE_DOCS, fused("den", "lex", 10),
    ) + f"SELECT query_id, pos, chunk_id, rrf_score, {_POLLUTED.format(*['chapter'] * len(POLLUTION_KEYWORDS))} AS polluted FROM fused JOIN chunks USING (chunk_id)",
    "library_changes": _with(BASE, CHANGED)
    + """SELECT 'delete' AS change, chunk_id, book_title, md5(text) AS text_md5 FROM (SELECT chunk_id, book_title, text FROM first EXCEPT ALL SELECT chunk_id, book_title, text FROM chunks)
      UNION ALL SELECT 'insert', chunk_id, book_title, md5(text) FROM (SELECT chunk_id, book_title, text FROM chunks EXCEPT ALL SELECT chunk_id, book_title, text FROM first)""",
    "library_changes_step": _with(BASE, CHANGED) + "SELECT 'delete' AS change, chunk_id, book_title FROM second WHERE chunk_id IN (SELECT chunk_id FROM gone)",
    "library_search": _with(BASE, CHANGED, QUESTIONS, LIBRARY_BM25) + "SELECT query_id, chunk_id, rank0, score FROM lex",
    "library_vocabulary": _with(BASE, CHANGED) + r"SELECT term, count(*) AS df FROM (SELECT DISTINCT book_title, chunk_id, unnest(regexp_extract_all(lower(text), '\S+')) AS term FROM chunks) GROUP BY 1",
    "library_sizes": _with(BASE, CHANGED)
    + "".join(
        f"{' UNION ALL ' * (i > 1)}SELECT {i}::BIGINT AS version, 'n_chunks' AS name, count(*) AS value FROM {t} UNION ALL "
        rf"SELECT {i}, 'n_words', sum(len(regexp_extract_all(coalesce(text, ''), '\S+')))::BIGINT FROM {t}"
        for i, t in enumerate(("first", "second", "third", "fourth", "chunks"), 1)
    ),
    "library_profiles": _with(BASE, CHANGED, PROFILES) + "SELECT book_title, word, round(score, 6) AS score, rank FROM profiles",
    "library_nearest": _with(BASE, CHANGED, WITH_VECTOR, DENSE_DOCS) + "SELECT query_id, chunk_id, rank0 FROM den",
    "library_keyword": _with(BASE, CHANGED)
    + "SELECT chunk_id, book_title, substring(text, greatest(1, i - 40), i + 60 - greatest(1, i - 40)) AS snippet FROM (SELECT *, strpos(lower(text), 'revised token') AS i FROM chunks) WHERE i > 0",
    "library_pages": _with(BASE, CHANGED) + "SELECT chunk_id, book_title, page_number FROM chunks WHERE page_number BETWEEN 100 AND 400",
    "keyword_search_snippet": _with(CHUNKS)
    + "SELECT chunk_id, book_title, substring(text, greatest(1, i - 40), i + 60 - greatest(1, i - 40)) AS snippet FROM (SELECT *, strpos(lower(text), 'token') AS i FROM chunks) WHERE i > 0",
    "keyword_first_matches": _with(CHUNKS)
    + "SELECT chunk_id, substring(text, greatest(1, i - 40), i + 60 - greatest(1, i - 40)) AS snippet FROM (SELECT *, strpos(lower(text), 'token') AS i FROM chunks WHERE book_title = 'src1') WHERE i > 0 ORDER BY corpus_pos LIMIT 5",
    "pollution_flag": f"SELECT doc_id, coalesce({_POLLUTED.format(*['text'] * len(POLLUTION_KEYWORDS))}, false) AS polluted FROM documents",
    "format_context": _with(RANKINGS, fused("bylen", "byid", 3))
    + """, c AS (SELECT query_id, string_agg('[' || lang || ' | Unknown | p.' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS c
      FROM fused JOIN documents ON chunk_id = doc_id::VARCHAR GROUP BY 1) SELECT query_id, md5(c) AS context_md5, length(c) AS n_chars FROM c""",
    "text_lines": _with(LINES) + "SELECT book_title, line_no, page_number, text, size FROM lines",
    "html_lines": _with(HTML) + "SELECT * FROM hlines",
    "html_toc": _with(HTML)
    + "SELECT book_title, line_no AS pos, CASE size WHEN 18 THEN 1 WHEN 15 THEN 2 ELSE 3 END::BIGINT AS level, text AS title, page_number AS start_page FROM hlines WHERE size > 10",
    "body_size_mode": _with(LEVELS) + "SELECT * FROM body",
    "heading_levels": _with(LEVELS) + "SELECT book_title, line_no, page_number, level FROM levelled",
    "heading_groups": _with(LEVELS)
    + """, m AS (SELECT *, coalesce(last_value(CASE WHEN level = 'chapter' THEN text END IGNORE NULLS) OVER w, 'Unknown') AS chapter,
        coalesce(last_value(CASE level WHEN 'chapter' THEN 'Unknown' WHEN 'section' THEN text END IGNORE NULLS) OVER w, 'Unknown') AS section,
        count(level) OVER w AS island FROM levelled WINDOW w AS (PARTITION BY book_title ORDER BY page_number, line_no ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
      g AS (SELECT book_title, island, any_value(chapter) AS chapter, any_value(section) AS section, arg_min(page_number, line_no) AS page_number, string_agg(text, ' ' ORDER BY line_no) AS text FROM m WHERE level IS NULL GROUP BY ALL)
      SELECT book_title, row_number() OVER (PARTITION BY book_title ORDER BY island) - 1 AS group_index, chapter, section, page_number, text FROM g""",
    "heading_ranges": _with(HEADS) + "SELECT book_title, pos, title, start_page, end_page, level::BIGINT AS level FROM heads",
    "page_slice": _with(LINES) + "SELECT book_title, line_no, page_number, text FROM lines WHERE page_number BETWEEN 2 AND 3",
    "toc_ranges": _with(TOC) + "SELECT book_title, pos, title, start_page, end_page, level::BIGINT AS level FROM ranges",
    "chapter_labels": _with(TOC) + "SELECT book_title, pos, repeat('  ', level - 1) || title || ' (pages ' || start_page || '-' || end_page || ')' AS label FROM ranges",
    "content_start": _with(TOC) + "SELECT book_title, min(start_page) AS content_start FROM (SELECT *, min(level) OVER (PARTITION BY book_title) AS t FROM toc) WHERE level = t GROUP BY 1",
    "content_chapters": _with(TOC)
    + f"SELECT book_title, pos, title, start_page, end_page, level::BIGINT AS level FROM (SELECT *, min(level) OVER (PARTITION BY book_title) AS t FROM ranges) WHERE level = t AND {_REAL}",
    "leading_number_groups": _with(TOC)
    + rf""", n AS (SELECT *, regexp_extract(title || ' ', '^(\d+)(?:\.\d+)*\s', 1) AS number FROM ranges WHERE {_REAL}),
      g AS (SELECT book_title, number, min(start_page) AS start_page, max(end_page) AS end_page, min(pos) AS f FROM n WHERE number <> '' GROUP BY ALL)
      SELECT book_title, row_number() OVER (PARTITION BY book_title ORDER BY f) - 1 AS pos, 'Chapter ' || number AS title, start_page, end_page, 1::BIGINT AS level FROM g""",
    "single_chapter": _with(HEADS)
    + "SELECT l.book_title || ' — ' || title AS book_title, line_no, page_number, text FROM lines l JOIN heads h ON l.book_title = h.book_title AND page_number BETWEEN start_page AND end_page",
    "page_offset": _with(LEVELS) + "SELECT book_title, line_no, page_number + 7 AS page_number, level FROM levelled",
    "document_lines": r"""WITH paged AS (SELECT page_id // 100 AS doc, row_number() OVER (PARTITION BY page_id // 100 ORDER BY page_id) AS page_number,
      regexp_replace(coalesce(html, ''), '[\r\n]+', ' ', 'g') AS line FROM pages),
      cut AS (SELECT doc, page_number, list_filter(regexp_split_to_array(line, '<[^>]*>'), lambda x: trim(x, ' ') <> '') AS l FROM paged WHERE page_number BETWEEN 2 AND 40)
      SELECT doc, page_number, nth - 1 AS nth, trim(x, ' ') AS text, (length(x) % 7 + 10)::DOUBLE AS size FROM (SELECT doc, page_number, unnest(l) AS x, generate_subscripts(l, 1) AS nth FROM cut)""",
    "list_chapters": _with(HEADS, TOC)
    + "SELECT book_title, pos, title, start_page, end_page, level::BIGINT AS level FROM ranges UNION ALL SELECT book_title, pos, title, start_page, end_page, level::BIGINT FROM heads",
    "reassign_chapters": _with(CHUNKS, SOURCE_RANGES) + "SELECT chunk_id, book_title, hit AS chapter, page_number FROM assigned WHERE hit IS NOT NULL",
    "reassign_summary": _with(CHUNKS, SOURCE_RANGES)
    + "SELECT book_title, count(*) FILTER (hit IS DISTINCT FROM chapter AND hit IS NOT NULL) AS relabelled, count(*) FILTER (hit IS NULL) AS removed FROM assigned GROUP BY 1",
    "chunk_ids": "SELECT doc_id, lower(replace(source, ' ', '_')) || '_p' || doc_id || '_g0_c0' AS chunk_id FROM documents",
    "upsert_book": _with(CHUNKS)
    + """, rest AS (SELECT * FROM chunks WHERE book_title <> 'src1') SELECT chunk_id, book_title, corpus_pos FROM rest
      UNION ALL SELECT chunk_id, book_title, corpus_pos + (SELECT max(corpus_pos) FROM rest) + 1 FROM chunks WHERE book_title = 'src1' AND corpus_pos IN (SELECT doc_id FROM labels)""",
    "delete_by_ids": _with(CHUNKS) + "SELECT chunk_id, book_title FROM chunks WHERE corpus_pos NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "stored_upsert": _with(CHUNKS)
    + """SELECT chunk_id, book_title, md5(text) AS text_md5 FROM chunks WHERE book_title NOT IN ('src1', 'src2') OR book_title = 'src1' AND corpus_pos IN (SELECT doc_id FROM labels)
      UNION ALL SELECT chunk_id, '007 — [b=c], é%', md5(text) FROM chunks WHERE book_title = 'src3'""",
    "stored_delete_ids": _with(CHUNKS) + "SELECT chunk_id, book_title, corpus_pos FROM chunks WHERE corpus_pos NOT IN (SELECT doc_id FROM labels WHERE quality = 0)",
    "stored_fix_chapters": _with(CHUNKS, SOURCE_RANGES) + "SELECT chunk_id, book_title, hit AS chapter, page_number FROM assigned WHERE hit IS NOT NULL",
    "library_wire": _with(CHUNKS) + "SELECT chunk_id, md5(text) AS text_md5, book_title, chapter, section, page_number, 0::BIGINT AS chunk_index_on_page FROM chunks",
    "validate_chunks": """SELECT lang NOT IN ('es', 'fr') AS valid, CASE lang WHEN 'es' THEN 'chunk_id' WHEN 'fr' THEN 'page_number' END AS reason, count(*) AS n,
      coalesce(sum(CASE WHEN lang <> 'fr' THEN doc_id END), 0)::BIGINT AS sum_pages FROM documents GROUP BY ALL""",
    "id_collisions": _with(CHUNKS) + "SELECT chunk_id, 2::BIGINT AS n_books, 2::BIGINT AS n FROM chunks WHERE chapter = 'de'",
    "library_stats": "SELECT count(*) AS n_chunks, count(DISTINCT source) AS n_books FROM documents",
    "library_books": "SELECT DISTINCT source AS book_title FROM documents ORDER BY 1",
    "chapters_in_order": _with(CHUNKS, ORDERED) + "SELECT book_title, chapter, chapter_pos FROM chapters",
    "sample_spread": _with(CHUNKS)
    + """, n AS (SELECT *, row_number() OVER (PARTITION BY book_title ORDER BY page_number, corpus_pos) - 1 AS rn, count(*) OVER (PARTITION BY book_title) AS n FROM chunks),
      s AS (SELECT *, greatest(1, n // least(10, n)) AS step FROM n) SELECT book_title, chunk_id, page_number, rn // step AS nth FROM s WHERE rn % step = 0 AND rn // step < 10""",
    "chapter_cache_key": _with(CHUNKS, ORDERED) + "SELECT book_title, md5(book_title || '|' || string_agg(chapter, '|' ORDER BY chapter)) AS cache_key FROM chapters GROUP BY 1",
    "extraction_batches": _with(CHUNKS, BATCHES) + "SELECT book_title, chunk_id, batch_id FROM batched",
    "batch_keys": _with(CHUNKS, BATCHES) + "SELECT book_title, batch_id, cache_key FROM keys",
    "pending_batches": _with(CHUNKS, BATCHES) + "SELECT book_title, batch_id, cache_key FROM keys WHERE batch_id % 2 = 1",
    "calls_needed": "SELECT source AS book_title, lang AS chapter, count(*) AS n_chunks, (count(*) + 7) // 8 AS n_calls FROM documents GROUP BY ALL",
    "extraction_prompts": _with(CHUNKS, BATCHES)
    + f""", joined AS (SELECT b.book_title, batch_id, string_agg(text, chr(10) || '---' || chr(10) ORDER BY corpus_pos, chunk_id) AS texts FROM batched b JOIN chunks USING (chunk_id) GROUP BY ALL)
      SELECT book_title, batch_id, cache_key, md5(texts) AS text_key, md5('{PROMPT}' || texts) AS prompt_md5 FROM joined JOIN keys USING (book_title, batch_id)""",
    "extracted_terms": _with(GRAPH) + "SELECT book_title, book_pos, (term_pos // 1000) * 4294967296 + term_pos % 1000 AS term_pos, term, definition FROM terms",
    "extracted_relations": _with(GRAPH) + "SELECT book_title, book_pos, (rel_pos // 1000) * 4294967296 + rel_pos % 1000 AS rel_pos, src AS source, relation, dst AS target FROM rels",
    "extracted_nodes": _with(GRAPH) + "SELECT term_id, label, definition, books, CASE WHEN n_books > 1 THEN books END AS cross_referenced_in FROM nodes",
    "extracted_edges": _with(GRAPH) + "SELECT src, dst, relation, edge_type, book FROM edges",
    "concept_node_filter": _with(GRAPH) + "SELECT term_id, definition FROM nodes WHERE definition IN ('item 0', 'item 7')",
    "concept_edge_payload": _with(GRAPH) + """SELECT src AS "from", dst AS "to", relation AS label, 'to' AS arrows, true AS dashes FROM edges""",
    "concept_nodes": _with(GRAPH) + "SELECT term_id, label, definition, books, CASE WHEN n_books > 1 THEN books END AS cross_referenced_in FROM nodes",
    "concept_edges": _with(GRAPH) + "SELECT src, dst, relation, edge_type, book FROM edges",
    "concept_degree": _with(GRAPH) + "SELECT * FROM degrees",
    "concept_related": _with(NEIGHBOURS) + "SELECT * FROM related",
    "concept_colours": _with(GRAPH)
    + """, p AS (SELECT term_id, string_split(books, ',')[1] AS primary_book, first_at FROM nodes), f AS (SELECT primary_book, min(first_at) AS f FROM p GROUP BY 1),
      c AS (SELECT primary_book, (row_number() OVER (ORDER BY f) - 1) % 5 AS colour FROM f) SELECT term_id, primary_book, colour FROM p JOIN c USING (primary_book)""",
    "concept_two_hop": _with(GRAPH)
    + """, b AS (SELECT src AS a, dst AS b FROM edges UNION SELECT dst, src FROM edges), s AS (SELECT term_id AS selected FROM degrees WHERE is_hub),
      one AS (SELECT selected, b AS term_id FROM s JOIN b ON a = selected), two AS (SELECT selected, b.b AS term_id FROM one JOIN b ON a = term_id),
      u AS (SELECT selected, selected AS term_id, 0 AS level FROM s UNION ALL SELECT *, 1 FROM one UNION ALL SELECT *, 2 FROM two)
      SELECT selected, term_id, min(level)::BIGINT AS level FROM u GROUP BY ALL""",
    "graph_summary": _with(GRAPH) + "SELECT (SELECT count(*) FROM nodes) AS n_nodes, (SELECT count(*) FROM nodes WHERE n_books > 1) AS n_shared, (SELECT count(*) FROM edges) AS n_edges",
    "concept_node_labels": _with(NEIGHBOURS)
    + r"""SELECT term_id AS id, '<b>' || replace(replace(replace(replace(replace(label, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;') || '</b>' || chr(10) || '<i>' || n_related || ' connection' || CASE WHEN n_related <> 1 THEN 's' ELSE '' END || '</i>' AS label,
      CASE WHEN n_books > 1 THEN 'cross_ref' WHEN is_hub THEN 'hub' ELSE 'book' END AS kind, n_books > 1 AS isCrossRef FROM nodes JOIN related USING (term_id) JOIN degrees USING (term_id)""",
    "concept_edge_filter": _with(GRAPH) + "SELECT src AS term_id FROM edges WHERE relation IN ('r1', 'r2') UNION SELECT dst FROM edges WHERE relation IN ('r1', 'r2')",
    "hit_rate_and_mrr": _with(RANKINGS, fused("bylen", "byid", 10))
    + """, h AS (SELECT query_id, chunk_id, pos, row_number() OVER (PARTITION BY query_id ORDER BY pos) AS fp FROM fused JOIN labels ON chunk_id = doc_id::VARCHAR),
      t AS (SELECT source AS query_id, doc_id::VARCHAR AS chunk_id FROM documents JOIN labels USING (doc_id) WHERE quality = 1),
      b AS (SELECT t.query_id, min(pos) AS pos, min(fp) AS fp FROM t LEFT JOIN h USING (query_id, chunk_id) GROUP BY 1)
      SELECT round(avg(coalesce(pos <= 1, false)::INT), 6) AS hit_rate_1, round(avg(coalesce(pos <= 3, false)::INT), 6) AS hit_rate_3, round(avg(coalesce(pos <= 5, false)::INT), 6) AS hit_rate_5, round(avg(CASE WHEN fp <= 10 THEN 1.0::DOUBLE / fp ELSE 0 END), 6) AS mrr FROM b""",
    "mean_judge_scores": r"""SELECT lang, round(coalesce(avg(try_cast(nullif(regexp_extract(text, '([01](?:\.\d+)?)', 1), '') AS DOUBLE)), 0), 6) AS mean_score FROM documents GROUP BY 1""",
    "judged_items": f"""SELECT item_id, CASE WHEN n % 11 <> 0 THEN (n % 2)::DOUBLE END AS score, CASE WHEN n % 11 = 0 THEN 'TimeoutError: ' || n END AS judged_error
      FROM (SELECT item_id, {len(JUDGES['faithfulness']) - len('{context}{answer}')} + length(text) + length(item_id::VARCHAR) AS n FROM benchmark)""",
    "eval_slice": _with(CHUNKS, QUESTIONS_OF) + "SELECT 'q' || corpus_pos AS id, question FROM made ORDER BY corpus_pos LIMIT 8 OFFSET 3",
    "eval_set_json": "SELECT 'q' || item_id AS id, coalesce(text, '') AS question, md5(text) AS ground_truth_answer, 'c' || item_id AS ground_truth_chunk_id FROM benchmark",
    "answer_prompts": _with(RANKINGS, fused("bylen", "byid", 3))
    + f""", c AS (SELECT query_id, string_agg('[' || lang || ' | Unknown | p.' || doc_id || ']' || chr(10) || text, chr(10) || chr(10) || '---' || chr(10) || chr(10) ORDER BY pos) AS c
      FROM fused JOIN documents ON chunk_id = doc_id::VARCHAR GROUP BY 1)
      SELECT query_id, md5('{INSTRUCTIONS}' || chr(10) || chr(10) || 'EXCERPTS:' || chr(10) || c || chr(10) || chr(10) || 'QUESTION: What of ' || query_id || '?' || chr(10) || chr(10) || 'ANSWER:') AS prompt_md5 FROM c""",
    "benchmark_truths": _with(TRUTHS) + "SELECT * FROM truths",
    "retrieval_eval": _with(CHUNKS, QUESTIONS, BM25, TRUTHS)
    + """, b AS (SELECT t.query_id, min(rank0 + 1) AS pos FROM truths t LEFT JOIN lex USING (query_id, chunk_id) GROUP BY 1)
      SELECT round(avg(coalesce(pos <= 1, false)::INT), 6) AS hit_rate_1, round(avg(coalesce(pos <= 3, false)::INT), 6) AS hit_rate_3, round(avg(coalesce(pos <= 5, false)::INT), 6) AS hit_rate_5, round(avg(CASE WHEN pos <= 10 THEN 1.0::DOUBLE / pos ELSE 0 END), 6) AS mrr FROM b""",
    "eval_candidates": _with(CHUNKS)
    + """, k AS (SELECT * FROM chunks WHERE NOT contains(text, '....') AND NOT contains(text, 'Table of Contents') AND NOT contains(text, 'Acknowledgments') ORDER BY corpus_pos LIMIT 5)
      SELECT 'q' || row_number() OVER (ORDER BY corpus_pos) AS id, 'TODO: Write a question about ' || chapter AS question, chunk_id AS ground_truth_chunk_id, regexp_replace(substring(text, 1, 250), '^\\s+|\\s+$', '', 'g') || '...' AS ground_truth_answer FROM k""".replace("\\\\", "\\"),
    "eval_questions": _with(CHUNKS, QUESTIONS_OF) + "SELECT 'q' || corpus_pos AS id, question, ground_truth_answer, chunk_id AS ground_truth_chunk_id FROM made",
    "eval_questions_first": _with(CHUNKS, QUESTIONS_OF)
    + "SELECT 'q' || row_number() OVER (ORDER BY corpus_pos) AS id, question, ground_truth_answer, chunk_id AS ground_truth_chunk_id FROM (SELECT * FROM made ORDER BY corpus_pos LIMIT 20)",
    "parse_judge_score": r"SELECT doc_id, try_cast(nullif(regexp_extract(text, '([01](?:\.\d+)?)', 1), '') AS DOUBLE) AS score FROM documents",
    "word_counts": rf"""SELECT doc_id, len(regexp_extract_all(lower(text), '\S+')) AS n_tokens,
      len(list_filter(regexp_extract_all(lower(text), '[a-z]+'), lambda x: length(x) > 2 AND x NOT IN ({_STOP}))) AS n_words FROM documents""",
    "strip_citations": rf"""SELECT doc_id, md5(regexp_replace(mark || substring(text, 1, (length(text) // 2)::BIGINT) || mark || substring(text, length(text) // 2 + 1) || mark,
      '{_SPACE}*\([^()]*p\.\p{{Nd}}+\)', '', 'g')) AS text_md5 FROM documents, (SELECT ' (Chapter 1, Section 2, p.12)' AS mark)""",
    "fence_stripped": r"""SELECT doc_id, md5(regexp_replace(regexp_replace('```json ' || coalesce(text, '') || ' ```', '^```json\s*', ''), '\s*```$', '')) AS text_md5 FROM documents""",
    "latex_to_spoken": f"SELECT doc_id, md5({_spoken(_FORMULAS)}) AS spoken_md5 FROM documents",
    "sentence_end_test": _with(LINES)
    + r"""SELECT book_title, line_no, NOT regexp_matches(text, '(?i:\bp\.\s*\d*$|\be\.g\.$|\bi\.e\.$)|\b\d+\.$') AS ends, NOT regexp_matches(text || '.', '(?i:\bp\.\s*\d*$|\be\.g\.$|\bi\.e\.$)|\b\d+\.$') AS cited_ends FROM lines""",
    "html_escape": """SELECT page_id, md5(replace(replace(replace(replace(replace(coalesce(html, ''), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS escaped_md5 FROM pages""",
}
