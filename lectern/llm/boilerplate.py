"""Problem 2: the main body of each page, and the lines that are furniture around it.

Every page is laid out by ``page.parse`` (a block tree with implied blocks and visibility rules) and emitted again by
``page.matter``.  The work is one pass over the documents, in Arrow batches, without a shuffle.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from lectern.functions import html
from lectern.llm import page
from lectern.llm.batches import per_text


def furniture_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title") -> DataFrame:
    """(id, line_no) of every furniture line; lines are counted from 1 at each \\n, blank ones too.

    Null, empty and blank texts give no rows.  Rows repeated in the input are repeated in the result.
    """
    return per_text(docs, lambda text, title: [(n,) for n in page.furniture(text, title)], id_col, text_col, title_col, "line_no int")


def main_bodies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title") -> DataFrame:
    """(id, body) of every row: the text without furniture; null stays null, a page of furniture alone gives ''."""
    return per_text(docs, lambda text, title: [(page.matter(text, title),)], id_col, text_col, title_col, "body string")


def rendered(pages: DataFrame, id_col: str = "doc_id", markup_col: str = "markup") -> DataFrame:
    """(id, text) of every page of markup: its visible text by the tree builder, blocks and list items a line each, tables aligned.

    Navigation, asides and footers are left out with all they hold.  Null markup gives a null text, an empty page ''.
    """

    def found(markup, _):
        return [(None if markup is None else "\n".join(html.render(html.build(markup), skip=page.SKIPPED, code=True)),)]

    return per_text(pages, found, id_col, markup_col, None, "text string")
