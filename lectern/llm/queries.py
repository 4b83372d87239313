"""The registered queries of problems 1 to 8, each over its whole tables with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.llm import boilerplate, encode, leaks, near_pairs, readability, repeated_lines, residue, split
from lectern.session import table, texts

Query = Callable[[SparkSession, str], DataFrame]


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return split.oversized(texts(spark, d, "chunks"), table(spark, d, "chunk_limits"))


def p1_pieces(spark: SparkSession, d: str) -> DataFrame:
    return split.pieces(texts(spark, d, "chunks"), table(spark, d, "chunk_limits"))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.furniture_lines(texts(spark, d, "documents"))


def p2_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(texts(spark, d, "documents"))


def p2_rendered(spark: SparkSession, d: str) -> DataFrame:
    """Every document's lines as paragraphs, items and cells of a page with scripts, menus and hidden parts, rendered again."""
    lines = F.split(F.regexp_replace("text", "[&<>]", " "), "\n")

    def marked(line, i):
        kind = i % 4
        return (
            F.when(kind == 0, F.concat(F.lit("<p>"), line))
            .when(kind == 1, F.concat(F.lit("<ul><li>"), line, F.lit("</ul>")))
            .when(kind == 2, F.concat(F.lit("<DIV>"), line, F.lit("<span style='display:none'>gone</span></DIV>")))
            .otherwise(F.concat(F.lit("<aside><p>away</aside><blockquote>"), line, F.lit("</blockquote><script>gone()</script>")))
        )

    page = F.concat(
        F.lit("<!doctype html><title>gone</title><nav><ul><li>Home<li>About</ul></nav><main>"), F.array_join(F.transform(lines, marked), ""),
        F.lit("<table><tr><th>number<td>"), F.col("doc_id"), F.lit("<tr><th>kind<td>page</table></main><footer><div><p>imprint</div></footer>"),
    )
    return boilerplate.rendered(texts(spark, d, "documents").where("text is not null").select("doc_id", page.alias("markup")))


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return repeated_lines.found_lines(texts(spark, d, "documents"), table(spark, d, "manifest"))


def p3_wordings(spark: SparkSession, d: str) -> DataFrame:
    """How many wordings each site repeats, and in how many of its documents the commonest stands."""
    sited = repeated_lines.sited_lines(texts(spark, d, "documents"), table(spark, d, "manifest"))
    found = repeated_lines.repeated(sited)
    return found.groupBy("site").agg(F.count(F.lit(1)).alias("n_wordings"), F.max("n_docs").alias("most_docs"), F.max("n_site").alias("n_site"))


def p3_texts(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents")
    return repeated_lines.without_lines(docs, repeated_lines.found_lines(docs, table(spark, d, "manifest")))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return residue.residues(texts(spark, d, "documents")).select("doc_id")


def p4_kinds(spark: SparkSession, d: str) -> DataFrame:
    return residue.residues(texts(spark, d, "documents")).groupBy("residue").agg(F.count(F.lit(1)).alias("n_docs"))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    found = near_pairs.overlaps(table(spark, d, "eval_cases")).expanded()
    return found.select(F.least("train_id", "held_id").alias("question_id_a"), F.greatest("train_id", "held_id").alias("question_id_b")).distinct()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    return near_pairs.overlaps(table(spark, d, "eval_cases")).counts()


def p5_classes(spark: SparkSession, d: str) -> DataFrame:
    """Each case with its class and the number of cases of the other side that ask the same."""
    return near_pairs.overlaps(table(spark, d, "eval_cases")).classes().select("question_id", "split_name", "train", "n_links")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return encode.encoded(texts(spark, d, "documents"))


def p6_round_trip(spark: SparkSession, d: str) -> DataFrame:
    """Whether each text comes back from its ids (null as '')."""
    docs = texts(spark, d, "documents")
    back = encode.decoded(encode.encoded(docs)).withColumnRenamed("text", "back")
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(back, "doc_id").select("doc_id", (F.col("text") == F.col("back")).alias("same"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leaks.leaks(texts(spark, d, "documents"), table(spark, d, "heldout_items")).select("doc_id", "item_id")


def p7_items(spark: SparkSession, d: str) -> DataFrame:
    """The items that leaked, in how many documents, and the longest verbatim match."""
    found = leaks.leaks(texts(spark, d, "documents"), table(spark, d, "heldout_items"))
    return found.groupBy("item_id").agg(F.count(F.lit(1)).alias("n_docs"), F.max("longest").alias("longest"))


def p7_kept(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "source")
    return leaks.without_leaks(docs, leaks.leaks(texts(spark, d, "documents"), table(spark, d, "heldout_items")))


def _levels(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d, "documents")
    return readability.levels(docs, readability.fit(docs, table(spark, d, "level_labels")))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).where(F.col("level") >= readability.DEMANDING).select("doc_id")


def p8_levels(spark: SparkSession, d: str) -> DataFrame:
    return _levels(spark, d).select("doc_id", "level", F.round("grade", 4).alias("grade"))


def queries() -> dict[str, Query]:
    return {
        f.__name__: f
        for f in (
            p1_found, p1_pieces, p2_found, p2_bodies, p2_rendered, p3_found, p3_wordings, p3_texts, p4_found, p4_kinds, p5_found, p5_counts, p5_classes,
            p6_ids, p6_round_trip, p7_found, p7_items, p7_kept, p8_found, p8_levels,
        )
    }


_STRIPPED = r"regexp_replace(text, '^[ \t\r\n\x{00A0}\x{3000}]+|[ \t\r\n\x{00A0}\x{3000}]+$', '', 'g')"
#: What Python strips.
_STRIP = r"[\x{9}-\x{d}\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_OVER = rf"""
over AS (
  SELECT DISTINCT c.chunk_id, s.stripped, l.max_chars
  FROM chunks c JOIN chunk_limits l ON l.chunk_rule = coalesce(c.chunk_rule, 'default'),
  LATERAL (SELECT {_STRIPPED.replace("text", "c.text")} AS stripped) s
  WHERE length(s.stripped) > l.max_chars)"""
_WIDE_LETTERS = "".join(map(chr, [*range(0xFF21, 0xFF3B), *range(0xFF41, 0xFF5B)]))
_LETTERS = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"
_REPEATED = rf"""
site AS (SELECT doc_id AS doc_ref, min(source_id) AS site FROM manifest GROUP BY doc_id HAVING min(source_id) IS NOT NULL),
doc AS (SELECT d.doc_id, s.site, string_split(d.text, chr(10)) AS lines FROM documents d JOIN site s USING (doc_ref) WHERE d.text IS NOT NULL),
n AS (SELECT site, count(*) AS n_site FROM doc GROUP BY site),
line AS (SELECT doc_id, site, unnest(lines) AS line, generate_subscripts(lines, 1) AS line_no FROM doc),
keyed AS (SELECT doc_id, site, line_no, regexp_replace(lower(translate(line, '{_WIDE_LETTERS}', '{_LETTERS}')), '[^\p{{L}}]', '', 'g') AS wording FROM line),
heavy AS (
  SELECT k.site, wording, count(DISTINCT doc_id) AS n_docs, any_value(n_site) AS n_site
  FROM keyed k JOIN n USING (site) WHERE wording <> '' GROUP BY k.site, wording
  HAVING count(DISTINCT doc_id) >= 5 AND count(DISTINCT doc_id) >= 0.02 * any_value(n_site))"""


def oracle_sql() -> dict[str, str]:
    """SQL for the problems it can state; the others are tested against brute force, round trips or held-out ratings."""
    return {
        "p1_found": rf"""WITH {_OVER}
SELECT chunk_id, CAST(max(CASE WHEN list_max(list_transform(
    regexp_split_to_array(regexp_replace(regexp_replace(stripped, '([。！？；])', '\1' || chr(10), 'g'),
      '([.!?])([ \t\r\n\x{{00A0}}\x{{3000}}])', '\1' || chr(10) || '\2', 'g'), '[\r\n]'), lambda p: length(p))) > max_chars THEN 1 ELSE 0 END) AS INTEGER) AS forced
FROM over GROUP BY chunk_id""",
        "p2_rendered": rf"""WITH l AS (SELECT doc_id, list_transform(string_split(regexp_replace(text, '[&<>]', ' ', 'g'), chr(10)),
    lambda x, i: regexp_replace(regexp_replace(CASE WHEN i % 4 = 2 THEN '- ' || x ELSE x END, '[ \t\r\n\f\x{{a0}}]+', ' ', 'g'), '^{_STRIP}+|{_STRIP}+$', '', 'g')) AS lines FROM documents WHERE text IS NOT NULL)
SELECT doc_id, array_to_string(list_concat(list_filter(lines, lambda x: x <> ''),
  ['number | ' || doc_id, 'kind   | page']), chr(10)) AS text FROM l""",
        "p3_found": f"WITH {_REPEATED} SELECT k.doc_id, CAST(k.line_no AS INTEGER) AS line_no FROM keyed k JOIN heavy h ON k.site = h.site AND k.wording = h.wording",
        "p3_wordings": f"WITH {_REPEATED} SELECT site, count(*) AS n_wordings, max(n_docs) AS most_docs, max(n_site) AS n_site FROM heavy GROUP BY site",
        "p6_round_trip": "SELECT doc_id, true AS same FROM documents",
    }
