"""Concept maps as HTML pages."""

from __future__ import annotations

import html
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .concepts import colours, edge_payload, node_payload

#: Nodes and edges of a page at most: more than a reader takes in, and gathered on the driver.
MOST_NODES, MOST_EDGES = 20_000, 60_000
PALETTE = ["#4e79a7", "#f28e2b", "#59a14f", "#b07aa1", "#76b7b2"]

_PAGE = """<!DOCTYPE html>
<html lang="en"><head><meta charset="utf-8"><title>{title}</title></head>
<body><h1>{title}</h1>
<ul id="legend">{legend}</ul>
<div id="map"></div><ul id="terms"></ul>
<dialog id="term"><h2></h2><p></p><p></p><ul></ul><form method="dialog"><button>Close</button></form></dialog>
<script id="nodes" type="application/json">{nodes}</script>
<script id="edges" type="application/json">{edges}</script>
<script>{own}</script>
{script}</body></html>
"""

#: Lists the terms and opens one's definition, books and neighbours; all as text, never as markup.
_OWN = """
const nodes = JSON.parse(document.getElementById("nodes").textContent);
const box = document.getElementById("term");
function showTerm(node) {
  const [name, about, books, near] = ["h2", "p", "p + p", "ul"].map(s => box.querySelector(s));
  name.textContent = node.term;
  about.textContent = node.definition;
  books.textContent = node.books.join(", ");
  near.replaceChildren(...node.related.map(r => {
    const line = document.createElement("li");
    line.textContent = (r.relation || "") + " " + r.term;
    return line;
  }));
  box.showModal();
}
document.getElementById("terms").append(...nodes.map(node => {
  const line = document.createElement("li");
  line.textContent = node.term;
  line.addEventListener("click", () => showTerm(node));
  return line;
}));
"""


def _inline(items: list[str]) -> str:
    """JSON that cannot end the script element it stands in."""
    return json.dumps([json.loads(i) for i in items]).replace("</", "<\\/")


def concept_map(nodes: DataFrame, edges: DataFrame, *, title: str = "Concept Map", script: str = "") -> str:
    """The page for a graph that a reader can take in: it is gathered on the driver, larger ones are an error.

    It lists the terms, shows one's definition and neighbours in a dialog, and says what
    the colours stand for. ``script`` is markup that draws the two JSON elements, such as
    a graph library; it may call ``showTerm`` with a node.
    """
    for df, most in ((nodes, MOST_NODES), (edges, MOST_EDGES)):
        if df.limit(most + 1).count() > most:
            raise ValueError(f"a page shows {MOST_NODES} terms and {MOST_EDGES} relations at most; filter the graph first")
    as_json = lambda df: [r[0] for r in df.select(F.to_json(F.struct("*"))).collect()]
    n = as_json(node_payload(nodes, edges).orderBy("book_pos", "term_pos").drop("book_pos", "term_pos"))
    e = as_json(edge_payload(edges).orderBy("book_pos", "rel_pos").drop("book_pos", "rel_pos"))
    return _PAGE.format(title=html.escape(title), legend=legend(nodes), nodes=_inline(n), edges=_inline(e), own=_OWN, script=script)


def legend(nodes: DataFrame) -> str:
    """What the colours stand for: a line per primary book, and one each for shared terms and hubs."""
    books = colours(nodes).select("primary_book", "colour").distinct().orderBy("primary_book").collect()  # a row per book
    lines = [f'<li style="color: {PALETTE[r["colour"]]}">{html.escape(r["primary_book"])}</li>' for r in books]
    return "".join([*lines, "<li>shared by several books</li>", "<li>most connected</li>"])
