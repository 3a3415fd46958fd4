"""Schemas and fixed parameters of the retrieval engine."""

from __future__ import annotations

UNKNOWN = "Unknown"
LEGACY_MATTER = "Front/Back Matter"

LINES = "book_title string, line_no bigint, page_number int, text string, size double"
TOC = "book_title string, pos int, level int, title string, start_page int"
CHAPTERS = "book_title string, pos int, title string, start_page int, end_page int, level int"
CHUNK_WIRE = (
    "chunk_id string, text string, metadata struct<book_title: string, chapter: string, section: string, "
    "page_number: int, chunk_index_on_page: int>"
)
EXTRACTION = (
    "terms array<struct<term: string, definition: string>>, "
    "relations array<struct<source: string, relation: string, target: string>>"
)
EVAL_SET = "id string, question string, ground_truth_answer string, ground_truth_chunk_id string"

#: Retrieval defaults.
CANDIDATE_DEPTH = 20
RRF_K = 60
TOP_K = 5
ASK_TOP_K = 6
PROFILE_SIZE = 60
BOOK_MARGIN = 1.5
CHAPTER_MARGIN = 1.15
CHAPTER_FLOOR = 0.25

#: Chunking defaults, in characters.
CHUNK_SIZE = 800
CHUNK_OVERLAP = 100

#: Concept extraction: chunks a call, and neighbours that a node shows.
EXTRACTION_BATCH = 15
RELATED_CAP = 8

# Words that routing ignores, titles that are no chapters, chapters that
# pollute results, Greek letters that are read out.
STOPWORDS = [
    "the", "a", "an", "is", "are", "of", "to", "and", "in", "on", "for", "that", "this", "it", "as", "by",
    "with", "or", "be", "at", "from", "which", "each", "can", "will", "its", "into", "used", "also",
]
NON_CHAPTER_KEYWORDS = [
    "acknowledg", "dedicat", "preface", "notation", "table of contents", "bibliograph",
    "reference", "index", "appendix", "foreword", "about the author", "glossary",
    "copyright", "cover", "title page", "how to use this book", "list of figures", "list of tables",
]
POLLUTION_KEYWORDS = ["content", "acknowledg", "bibliograph", "index", "appendix", "preface", "notation"]
GREEK = ["alpha", "beta", "gamma", "delta", "epsilon", "theta", "lambda", "mu", "sigma", "pi", "omega", "eta"]
