"""Queries of sources, sinks, filters, ingest and scalar functions (parts A to D and I of the inventory)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import hashing, urls
from lectern.functions import text as tx
from lectern.functions.lexicon import CAMPUS
from lectern.operators import evaluation, ingest
from lectern.operators import indexing as ix
from lectern.plans import fragments as q
from lectern.plans.registry import query
from lectern.session import scratch, settled, table, texts
from lectern.sources import readers, writers

TEXT = "coalesce(text, '')"
HOST_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
PATH_SQL = "regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1)"
SCHEME_SQL = "lower(regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1))"
PDF_SQL = f"(contains(lower(coalesce(mime_type, '')), 'pdf') OR ends_with(lower({PATH_SQL}), '.pdf'))"
_KEPT = "list_filter(string_split(regexp_extract({u}, '^[^?#]*\\?([^#]*)', 1), '&'), lambda i: i <> '' AND NOT regexp_matches(i, '^(utm_.*|spm|from|source|ref|fbclid|gclid)(=|$)'))"


def normalized_sql(u: str) -> str:
    kept = f"array_to_string(list_transform({_KEPT.format(u=u)}, lambda i: CASE WHEN contains(i, '=') THEN i ELSE i || '=' END), '&')"
    scheme, host, path = (e.replace("url", u) for e in (SCHEME_SQL, HOST_SQL, PATH_SQL))
    return f"{scheme} || '://' || {host} || CASE WHEN {path} = '' THEN '/' ELSE {path} END || CASE WHEN {kept} <> '' THEN '?' || {kept} ELSE '' END"


# A, B: sources and sinks


@query("SELECT source_id, name, category FROM sources WHERE coalesce(enabled, true)")
def a03_enabled_sources(spark: SparkSession, d: str) -> DataFrame:
    return readers.enabled(table(spark, d, "sources")).select("source_id", "name", "category")


@query("SELECT doc_id, url, local_path, mime_type, status_code, content_hash, source_id, title, parent_url FROM manifest")
def a07_b03_json_lines(spark: SparkSession, d: str) -> DataFrame:
    """The manifest written as JSON lines and read again with its schema."""
    path = scratch(spark)
    writers.json_lines(table(spark, d, "manifest"), path)
    return readers.manifest(spark, path).drop("crawl_time")


@query("SELECT DISTINCT question_id, question, answerable, split_name FROM eval_cases")
def a08_b09_cases_by_split(spark: SparkSession, d: str) -> DataFrame:
    """Cases written in a folder for each split and read again."""
    path = scratch(spark)
    writers.by_split(table(spark, d, "eval_cases"), path)
    schema = "question_id string, question string, answerable boolean, split_name string"
    return spark.read.schema(schema).json(path).distinct()


_PAGE = "'<html><head><title>' || {t} || '</title><style>p {{}}</style></head><body><nav><li>menu</li></nav><article><p>' || {x} || '</p></article></body></html>'"


@query(
    f"""WITH p AS (SELECT doc_id, list_filter(list_transform(string_split(replace(replace(replace(text, '&', ' '), '<', ' '), '>', ' '), chr(10)),
    lambda l: {q.strip("regexp_replace(l, '[ \\t\\r\\n\\f\\x{a0}]+', ' ', 'g')")}), lambda l: l <> '') AS lines,
    {q.strip("regexp_replace(replace(replace(replace(coalesce(title, ''), '&', ' '), '<', ' '), '>', ' '), '[ \\t\\r\\n\\f\\x{a0}]+', ' ', 'g')")} AS t FROM documents WHERE text IS NOT NULL)
SELECT doc_id, CASE WHEN t = '' THEN 'Untitled HTML document' ELSE t END AS title, {q.strip("array_to_string(lines, chr(10))")} AS text FROM p WHERE len(lines) > 0"""
)
def a10_parsed_html(spark: SparkSession, d: str) -> DataFrame:
    """Every document's lines as paragraphs of an HTML page, parsed back to title and text."""

    def plain(c):
        return F.regexp_replace(c, "[&<>]", " ")

    page = F.concat(
        F.lit("<html><head><title>"), plain(F.coalesce("title", F.lit(""))), F.lit("</title><style>p {}</style></head><body><nav><li>menu</li></nav><article><p>"),
        F.array_join(F.split(plain(F.col("text")), "\n"), "</p><p>"), F.lit("</p></article></body></html>"),
    )
    pages = texts(spark, d, "documents").where("text is not null").select("doc_id", page.alias("markup"))
    return readers.html_pages(pages, "doc_id", "markup").where("text != ''").select("doc_id", "title", "text")


@query("SELECT source_id, count(*)::VARCHAR AS n, count(DISTINCT doc_id)::VARCHAR AS pages FROM manifest GROUP BY source_id")
def a14_b11_csv_summary(spark: SparkSession, d: str) -> DataFrame:
    path = scratch(spark)
    counts = table(spark, d, "manifest").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("pages"))
    writers.csv_summary(counts, path)
    return readers.csv_rows(spark, path)


@query("SELECT DISTINCT question FROM eval_cases WHERE split_name = 'demo' AND question IS NOT NULL")
def a17_demo_questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").where("split_name = 'demo' and question is not null").select("question").distinct()


@query("SELECT source_id, count(*) AS n FROM manifest GROUP BY source_id UNION ALL SELECT 'snapshots', 1")
def b01_snapshot(spark: SparkSession, d: str) -> DataFrame:
    """The latest manifest after a snapshot was written, counted by source, and the number of snapshots."""
    path = scratch(spark)
    writers.snapshot(table(spark, d, "manifest"), path, "20260101T000000Z")
    latest = spark.read.parquet(f"{path}/latest").groupBy("source_id").agg(F.count(F.lit(1)).alias("n"))
    kept = spark.read.parquet(f"{path}/snapshots").agg(F.countDistinct("snapshot").alias("n")).select(F.lit("snapshots").alias("source_id"), "n")
    return latest.unionByName(kept)


@query(f"WITH {q.CHUNK}, t AS (SELECT chunk_id, {q.sparse_tokens('embedding_text')} AS tokens FROM chunk) SELECT term, count(*) AS tf FROM (SELECT unnest(tokens) AS term FROM t) GROUP BY term")
def b06_a12_sparse_index(spark: SparkSession, d: str) -> DataFrame:
    """The index tables written and opened again: each term with its number of occurrences."""
    path = scratch(spark)
    tokens = settled(ix.tokens_of(chunk_hits(spark, d)))
    entries = settled(ix.postings(tokens))
    lengths = tokens.select("chunk_id", F.size("tokens").alias("dl"))
    writers.sparse_index(entries, lengths, ix.term_stats(entries, ix.corpus(tokens)), ix.corpus(tokens), path, buckets=16, parts=2)
    return ix.open_sparse_index(spark, path).entries.groupBy("term").agg(F.sum("tf").alias("tf"))


@query("SELECT category, count(*) AS n FROM (SELECT DISTINCT ON (chunk_id) chunk_id, coalesce(metadata.category, 'unknown') AS category FROM chunks WHERE chunk_id IS NOT NULL) GROUP BY category")
def b07_b08_a13_vector_index(spark: SparkSession, d: str) -> DataFrame:
    """Chunks hashed to vectors, written by category with their payload and opened again."""
    path = scratch(spark)
    chunks = chunk_hits(spark, d)
    payload = chunks.select("chunk_id", "doc_id", F.coalesce("metadata.category", F.lit("unknown")).alias("category"), "metadata.effective_year", "metadata.status")
    writers.vector_index(payload.join(ix.hashed_embeddings(chunks), "chunk_id"), path)
    return ix.open_vector_index(spark, path).where("size(embedding) > 0").groupBy("category").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT doc_ref, title, md5(text) AS digest, metadata::VARCHAR IS NOT NULL AS known FROM documents")
def b02_overwritten_documents(spark: SparkSession, d: str) -> DataFrame:
    """The documents written as JSON lines over an older copy, and read again with their schema."""
    path = scratch(spark)
    docs = table(spark, d, "documents").withColumn("doc_id", F.col("doc_ref"))
    writers.json_lines(docs.limit(1), path)
    writers.json_lines(docs, path)
    return readers.documents(spark, path).select(F.col("doc_id").alias("doc_ref"), "title", F.md5("text").alias("digest"), F.col("metadata").isNotNull().alias("known"))


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN upper(title) ELSE title END AS title FROM documents UNION ALL SELECT -1 - doc_id, title FROM documents WHERE doc_id % 3 = 1")
def b04_upserted_sink(spark: SparkSession, d: str) -> DataFrame:
    """Two batches put into the versioned sink: all documents, then changes of a third and as many new ones."""
    from lectern.streaming import fetches

    path = scratch(spark)
    docs = table(spark, d, "documents").select("doc_id", "title", F.lit(1).alias("at"))
    changed = docs.where("doc_id % 3 = 0").withColumns({"title": F.upper("title"), "at": F.lit(2)})
    write = fetches.upsert_into(path, "doc_id", "at", buckets=8)
    write(docs, 0)
    write(changed.unionByName(docs.where("doc_id % 3 = 1").withColumn("doc_id", -1 - F.col("doc_id"))), 1)
    return fetches.latest(spark, path).select("doc_id", "title")


@query(
    f"""WITH f AS (SELECT source_id, url, row_number() OVER (PARTITION BY source_id ORDER BY crawl_time, url, doc_id) - 1 AS n, sha256(url) AS h,
  CASE WHEN {PDF_SQL} THEN '.pdf' WHEN lower(trim(split_part(mime_type, ';', 1))) = 'text/plain' THEN '.txt' ELSE '.html' END AS ext FROM manifest WHERE status_code < 400 AND url IS NOT NULL AND source_id IS NOT NULL)
SELECT source_id, CASE WHEN n < 10000 THEN lpad(n::VARCHAR, 4, '0') ELSE n::VARCHAR END || '_' || left(h, 16) || ext AS file, url FROM f"""
)
def b05_raw_bytes(spark: SparkSession, d: str) -> DataFrame:
    """Bodies (here the bytes of the urls) saved under their file names, in order of the crawl, and read again."""
    path = scratch(spark)
    fetches = ingest.fetched(_manifest(spark, d)).where("url is not null and source_id is not null")
    saved = ingest.numbered(fetches, "source_id", "crawl_time", "url", "doc_id")
    body = F.encode("url", "utf-8")
    writers.raw_bytes(saved.select("source_id", "n", F.sha2(body, 256).alias("content_hash"), urls.extension(F.col("url"), F.col("mime_type")).alias("extension"), body.alias("body")), path)
    return spark.read.parquet(path).select("source_id", "file", F.decode("body", "utf-8").alias("url"))


_ASCII = "left(regexp_replace(coalesce({t}, ''), '[^A-Za-z0-9 ]', '', 'g'), 60)"


@query(
    f"""WITH p AS (SELECT doc_id, trim({_ASCII.format(t="title")}) AS a, trim({_ASCII.format(t="source_url")}) AS b FROM documents)
SELECT doc_id, 'T' || doc_id AS title, trim(CASE WHEN a = '' THEN '' ELSE '[PDF_PAGE 1]' || chr(10) || a END || CASE WHEN a <> '' AND b <> '' THEN chr(10) || chr(10) ELSE '' END
  || CASE WHEN b = '' THEN '' ELSE '[PDF_PAGE 2]' || chr(10) || b || chr(10) || 'end' END || CASE WHEN b = '' THEN CASE WHEN a = '' THEN '' ELSE chr(10) || chr(10) END || '[PDF_PAGE 2]' || chr(10) || 'end' ELSE '' END) AS text,
  2 AS page_count FROM p"""
)
def a11_pdf_text(spark: SparkSession, d: str) -> DataFrame:
    """A PDF file of two pages made of each document's title and address, read back with its page marks."""
    plain = lambda c: F.trim(F.substring(F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9 ]", ""), 1, 60))
    page = "{n} 0 obj << /Type /Page /Parent 2 0 R /Contents {c} 0 R >> endobj "
    stream = lambda n, *parts: F.concat(F.lit(f"{n} 0 obj << /Length 99 >> stream\nBT /F1 12 Tf 72 700 Td "), *parts, F.lit(" ET\nendstream endobj "))
    file = F.concat(
        F.lit("%PDF-1.4\n1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj 2 0 obj << /Type /Pages /Kids [4 0 R 3 0 R] /Count 2 >> endobj "),
        F.lit(page.format(n=3, c=5) + page.format(n=4, c=6)),
        stream(5, F.lit("("), plain(F.col("source_url")), F.lit(") Tj T* [(e) -20 (nd)] TJ")), stream(6, F.lit("("), plain(F.col("title")), F.lit(") Tj")),
        F.lit("7 0 obj << /Title (T"), F.col("doc_id"), F.lit(") >> endobj trailer << /Root 1 0 R /Info 7 0 R >>"),
    )
    files = table(spark, d, "documents").select("doc_id", F.encode(file, "utf-8").alias("content"))
    return readers.pdf_files(files, "doc_id", "content").where("error is null").select("doc_id", "title", "text", "page_count")


@query(
    """WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(title, '[&<>]', ' ', 'g'), ' '), lambda x: trim(x)), lambda x: x <> '') AS words FROM documents WHERE title IS NOT NULL)
SELECT doc_id, 'head' || CASE WHEN len(words) > 0 THEN chr(10) || array_to_string(list_transform(words, lambda w: '- ' || w), chr(10)) ELSE '' END || chr(10) || 'a    | b' || chr(10) || 'long | c' AS text FROM l"""
)
def i07_rendered_markup(spark: SparkSession, d: str) -> DataFrame:
    """Markup as an interface gives it, made of the titles' words: a heading, a list and a table, rendered."""
    words = F.filter(F.transform(F.split(F.regexp_replace("title", "[&<>]", " "), " "), lambda x: F.trim(x)), lambda x: x != "")
    markup = F.concat(F.lit("<h1>head</h1><script>no</script><ul>"), F.array_join(F.transform(words, lambda w: F.concat(F.lit("<li>"), w)), ""), F.lit("</ul><table><tr><td>a<td>b<tr><td>long<td>c</table>"))
    return readers.rendered(table(spark, d, "documents").where("title is not null").select("doc_id", markup.alias("m")), "doc_id", "m")


# C: predicates and projections


def _manifest(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "manifest")


def chunk_hits(spark: SparkSession, d: str) -> DataFrame:
    """Chunks, each once."""
    return ingest.once(texts(spark, d, "chunks").where("chunk_id is not null"), "chunk_id")


@query(
    f"""SELECT m.doc_id, m.url, coalesce({SCHEME_SQL} IN ('http', 'https') AND list_contains(s.allowed_domains, {HOST_SQL})
  AND len(list_filter(s.excluded_patterns, lambda x: x <> '' AND contains({PATH_SQL}, x))) = 0, false) AS allowed
FROM manifest m LEFT JOIN sources s USING (source_id)"""
)
def c01_allowed_url(spark: SparkSession, d: str) -> DataFrame:
    rules = ingest.small(table(spark, d, "sources").select("source_id", "allowed_domains", "excluded_patterns"))
    ok = urls.allowed(F.col("url"), F.col("allowed_domains"), F.col("excluded_patterns"))
    return _manifest(spark, d).join(rules, "source_id", "left").select("doc_id", "url", F.coalesce(ok, F.lit(False)).alias("allowed"))


@query(f"SELECT doc_id, url, {PDF_SQL} AS is_pdf FROM manifest WHERE url IS NOT NULL")
def c02_is_pdf(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).where("url is not null").select("doc_id", "url", urls.is_pdf(F.col("url"), F.col("mime_type")).alias("is_pdf"))


@query(
    f"""SELECT doc_id, url, contains(lower(coalesce(mime_type, '')), 'html') OR NOT contains({PATH_SQL}, '.') OR regexp_matches({PATH_SQL}, '(?i)\\.(html|htm|php|asp|aspx)$') AS is_html
FROM manifest WHERE url IS NOT NULL"""
)
def c03_is_html(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).where("url is not null").select("doc_id", "url", urls.is_html(F.col("url"), F.col("mime_type")).alias("is_html"))


@query("SELECT doc_id, contains(left(text, 2048), chr(0)) AS is_binary FROM documents WHERE text IS NOT NULL")
def c04_looks_binary(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null").select("doc_id", ingest.looks_binary(F.col("text").cast("binary")).alias("is_binary"))


@query("SELECT doc_id, url, status_code FROM manifest WHERE status_code < 400")
def c05_fetched(spark: SparkSession, d: str) -> DataFrame:
    return ingest.fetched(_manifest(spark, d)).select("doc_id", "url", "status_code")


@query(
    f"""SELECT m.doc_id, m.url FROM manifest m JOIN sources s USING (source_id)
WHERE m.status_code < 400 AND {SCHEME_SQL} IN ('http', 'https') AND list_contains(s.allowed_domains, {HOST_SQL}) AND len(list_filter(s.excluded_patterns, lambda x: x <> '' AND contains({PATH_SQL}, x))) = 0"""
)
def c06_in_scope(spark: SparkSession, d: str) -> DataFrame:
    """Successful fetches whose final address is within its source's scope."""
    rules = ingest.small(table(spark, d, "sources").select("source_id", "allowed_domains", "excluded_patterns"))
    scope = urls.allowed(F.col("url"), F.col("allowed_domains"), F.col("excluded_patterns"))
    return ingest.fetched(_manifest(spark, d)).join(rules, "source_id").where(scope).select("doc_id", "url")


@query("SELECT doc_id, strlen(text) AS bytes, strlen(text) <= CASE WHEN source_type = 'pdf' THEN 52428800 ELSE 5242880 END AS fits FROM documents WHERE text IS NOT NULL")
def c07_size_caps(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents").where("text is not null")
    size = F.octet_length("text")
    return docs.select("doc_id", size.cast("long").alias("bytes"), ingest.within_size(size, F.col("source_type") == "pdf").alias("fits"))


@query("SELECT doc_id, url FROM manifest WHERE NOT regexp_matches(url, '(?i)\\.(jpg|jpeg|png|gif|zip|rar)$')")
def c08_no_media(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).where(~urls.is_media(F.col("url"))).select("doc_id", "url")


@query("SELECT doc_id, url, source_id FROM manifest WHERE source_id IN (SELECT source_id FROM sources WHERE authority_level >= 80)")
def c09_source_subset(spark: SparkSession, d: str) -> DataFrame:
    chosen = ingest.small(table(spark, d, "sources").where("authority_level >= 80").select("source_id"))
    return _manifest(spark, d).join(chosen, "source_id", "left_semi").select("doc_id", "url", "source_id")


@query("SELECT doc_id, length(text) AS chars FROM documents WHERE length(text) >= 100")
def c10_long_enough(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(F.length("text") >= ingest.LEAST_CHARS).select("doc_id", F.length("text").cast("long").alias("chars"))


@query(f"SELECT doc_id FROM documents WHERE length(text) >= 100 AND NOT {q.any_held('left(text, 1200)', CAMPUS.login_marks)}")
def c11_no_login_page(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where(ingest.readable(F.col("text"))).select("doc_id")


@query(f"SELECT doc_id, url, CASE WHEN contains(lower(coalesce(mime_type, '')), 'pdf') OR ends_with(lower(local_path), '.pdf') THEN 'pdf' ELSE 'html' END AS parser FROM manifest")
def c12_parser(spark: SparkSession, d: str) -> DataFrame:
    pdf = F.contains(F.lower(F.coalesce("mime_type", F.lit(""))), F.lit("pdf")) | F.coalesce(F.lower("local_path").endswith(".pdf"), F.lit(False))
    return _manifest(spark, d).select("doc_id", "url", F.when(pdf, "pdf").otherwise("html").alias("parser"))


@query(
    """SELECT 'parsed' AS outcome, count(*) AS n FROM documents WHERE doc_id % 7 NOT IN (0, 3) AND text IS NOT NULL
UNION ALL SELECT 'UnicodeDecodeError', count(*) FROM documents WHERE doc_id % 7 = 3 AND text IS NOT NULL"""
)
def c13_broken_pages_dropped(spark: SparkSession, d: str) -> DataFrame:
    """Every text as a page, of which some are no UTF-8, some null and all nested deeply: broken ones are dropped and counted."""
    markup = F.concat(F.lit("<div>" * 2000), F.lit("<p>x "), F.regexp_replace("text", "[&<>]", " "))
    raw = F.when(F.col("doc_id") % 7 == 3, F.concat(F.unhex(F.lit("FFFE41")), F.encode(markup, "utf-8"))).when(F.col("doc_id") % 7 != 0, F.encode(markup, "utf-8"))
    parsed = readers.html_pages(texts(spark, d, "documents").where("text is not null").select("doc_id", raw.alias("raw")), "doc_id", "raw")
    parsed = settled(parsed.select("doc_id", "text", "error"))
    kept = readers.parsed_only(parsed).agg(F.count(F.lit(1)).alias("n")).select(F.lit("parsed").alias("outcome"), "n")
    return kept.unionByName(readers.parse_errors(parsed).withColumnRenamed("error", "outcome"))


_LINE = q.strip("regexp_replace(l, '[ \\t\\r\\n\\f\\x{a0}]+', ' ', 'g')")


@query(
    f"""WITH p AS (SELECT doc_id, list_transform(string_split(replace(replace(replace(text, '&', ' '), '<', ' '), '>', ' '), chr(10)), lambda l: {_LINE}) AS lines FROM documents WHERE text IS NOT NULL),
part AS (SELECT doc_id, list_filter(list_transform(lines, lambda l, i: CASE WHEN l = '' THEN NULL WHEN i % 5 = 3 THEN chr(10) || l || chr(10) ELSE l END), lambda x: x IS NOT NULL) AS parts FROM p)
SELECT doc_id, 'Page ' || doc_id AS title, 'https://e.example/' || doc_id AS canonical, {q.strip("regexp_replace(array_to_string(parts, chr(10)), '\n{3,}', chr(10) || chr(10), 'g')")} AS text FROM part WHERE len(parts) > 0"""
)
def a10_i08_i09_i10_varied_markup(spark: SparkSession, d: str) -> DataFrame:
    """Every document's lines as paragraphs without end tags, items, headings and cells of a page with furniture and a canonical link."""
    lines = F.split(F.regexp_replace("text", "[&<>]", " "), "\n")

    def marked(line, i):
        kind = (i + 1) % 5
        return F.when(kind == 0, F.concat(F.lit("<P>"), line)).when(kind == 1, F.concat(F.lit("<ul class=x><li>"), line, F.lit("</ul>"))).when(
            kind == 2, F.concat(F.lit("<table><tr><td>"), line, F.lit("</table>"))
        ).when(kind == 3, F.concat(F.lit("<h3><b>"), line, F.lit("</b></h3>"))).otherwise(F.concat(F.lit("<p>"), line, F.lit("<nav>away<p>away</nav>")))

    page = F.concat(
        F.lit("<!doctype html><head><link rel='alternate canonical' href='https://e.example/"), F.col("doc_id"), F.lit("'><title>other</title></head><header><h1>Site</h1></header><form><p>login</form><h1>Page <i>"),
        F.col("doc_id"), F.lit("</i></h1><p>before<main>"), F.array_join(F.transform(lines, marked), ""), F.lit("</main><footer>end"),
    )
    pages = texts(spark, d, "documents").where("text is not null").select("doc_id", page.alias("markup"))
    return readers.html_pages(pages, "doc_id", "markup").where("text != ''").select("doc_id", "title", "canonical", "text")


@query("SELECT doc_id, TRY_CAST(replace(published_date, '/', '-') AS DATE)::VARCHAR AS day FROM documents WHERE TRY_CAST(replace(published_date, '/', '-') AS DATE) IS NOT NULL AND regexp_matches(published_date, '^\\d{4}[-/]\\d{2}[-/]\\d{2}$')")
def c13_dates_parsed(spark: SparkSession, d: str) -> DataFrame:
    """Dates of full numeric form; what can't be parsed becomes null and is dropped, nothing raises."""
    day = F.try_to_date(F.replace("published_date", F.lit("/"), F.lit("-")), "yyyy-MM-dd")
    return table(spark, d, "documents").where(F.col("published_date").rlike(r"^\d{4}[-/]\d{2}[-/]\d{2}$")).select("doc_id", day.cast("string").alias("day")).where("day is not null")


@query(
    f"""SELECT chunk_id, {{'fit': length(x) >= 120 AND NOT {q.any_held("x", CAMPUS.unfit_words)} AND {q.count_held("left(x, 220)", CAMPUS.menu_terms)} < 5
  AND NOT (({" OR ".join(f"starts_with(x, {q.literal(s)})" for s in CAMPUS.unfit_starts)}) AND NOT contains(left(x, 160), '。'))
  AND NOT starts_with(t, '- ') AND NOT list_contains({q.strings(CAMPUS.unfit_titles)}, t) AND {q.count_held("k", CAMPUS.menu_terms)} < 3}}.fit AS fit
FROM (SELECT chunk_id, {q.squeeze("display_text")} AS x, coalesce(title, '') AS t, {q.key_phrase("display_text")} AS k FROM (SELECT DISTINCT ON (chunk_id) chunk_id, display_text, metadata.title AS title FROM chunks WHERE chunk_id IS NOT NULL)) WHERE x IS NOT NULL"""
)
def c16_case_candidates(spark: SparkSession, d: str) -> DataFrame:
    fit = evaluation.fit_for_cases(F.col("display_text"), F.col("metadata.title"))
    return chunk_hits(spark, d).where("display_text is not null").select("chunk_id", fit.alias("fit"))


@query("SELECT DISTINCT question_id, split_name FROM eval_cases WHERE coalesce(answerable, true)")
def c17_answerable(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").where(F.coalesce("answerable", F.lit(True))).select("question_id", "split_name").distinct()


@query("SELECT chunk_id, token_count, effective_year FROM (SELECT chunk_id, token_count, metadata.effective_year AS effective_year FROM chunks) WHERE token_count IS NOT NULL AND effective_year IS NOT NULL")
def c19_metadata_present(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").select("chunk_id", "token_count", "metadata.effective_year").where("token_count is not null and effective_year is not null")


# D: joins of ingest


@query("SELECT m.doc_id, m.url, s.name, coalesce(s.category, 'unknown') AS category, coalesce(s.authority_level, 50) AS authority_level FROM manifest m LEFT JOIN sources s USING (source_id)")
def d01_with_registry(spark: SparkSession, d: str) -> DataFrame:
    return ingest.with_registry(_manifest(spark, d), table(spark, d, "sources")).select("doc_id", "url", "name", "category", "authority_level")


SPLIT_DAY = "2026-01-01"


@query(
    f"""WITH old AS (SELECT * FROM manifest WHERE crawl_time < TIMESTAMP '{SPLIT_DAY}'), fresh AS (
  SELECT * FROM manifest WHERE crawl_time >= TIMESTAMP '{SPLIT_DAY}' AND (url IS NULL OR url NOT IN (SELECT url FROM old WHERE url IS NOT NULL))
    AND (content_hash IS NULL OR content_hash NOT IN (SELECT content_hash FROM old WHERE content_hash IS NOT NULL))),
by_url AS (SELECT * FROM fresh QUALIFY url IS NULL OR row_number() OVER (PARTITION BY url ORDER BY crawl_time, url, doc_id) = 1)
SELECT doc_id, url, content_hash FROM by_url QUALIFY content_hash IS NULL OR row_number() OVER (PARTITION BY content_hash ORDER BY crawl_time, url, doc_id) = 1"""
)
def d02_new_fetches(spark: SparkSession, d: str) -> DataFrame:
    fetches = _manifest(spark, d)
    at = F.lit(SPLIT_DAY).cast("timestamp_ntz")
    return ingest.new_fetches(fetches.where(F.col("crawl_time") >= at), fetches.where(F.col("crawl_time") < at)).select("doc_id", "url", "content_hash")


@query(
    """WITH change AS (SELECT doc_id, max_by(content_hash, crawl_time) AS hash FROM manifest WHERE content_hash IS NOT NULL AND doc_id IS NOT NULL GROUP BY doc_id)
SELECT doc_ref AS doc_id, hash FROM documents WHERE doc_ref NOT IN (SELECT doc_id FROM change) UNION ALL SELECT doc_id, hash FROM change"""
)
def d03_upserted_documents(spark: SparkSession, d: str) -> DataFrame:
    """Document hashes replaced by the hash of the last fetch that has one; pages that never became a document are added."""
    current = table(spark, d, "documents").select(F.col("doc_ref").alias("doc_id"), "hash")
    changes = _manifest(spark, d).where("content_hash is not null").select("doc_id", F.col("content_hash").alias("hash"), "crawl_time")
    last = changes.groupBy("doc_id").agg(F.max_by("hash", "crawl_time").alias("hash"), F.max("crawl_time").alias("crawl_time"))
    return ingest.upserted(current, last, "doc_id", "crawl_time").select("doc_id", "hash")


_N = normalized_sql


@query(
    f"""WITH RECURSIVE link AS (
  SELECT DISTINCT {_N("p")} AS parent, {_N("u")} AS url FROM (
    SELECT parent_url AS p, url AS u FROM manifest WHERE parent_url IS NOT NULL AND url IS NOT NULL
    UNION ALL SELECT s.base_url, m.parent_url FROM manifest m JOIN sources s USING (source_id) WHERE m.parent_url IS NOT NULL)
  WHERE NOT regexp_matches({_N("u")}, '(?i)\\.(jpg|jpeg|png|gif|zip|rar)$')),
src AS (SELECT * FROM sources WHERE coalesce(enabled, true)),
seed AS (SELECT DISTINCT source_id, {_N("u")} AS url, 0 AS depth FROM (SELECT source_id, unnest(seed_urls) AS u FROM src)),
walk AS (
  SELECT * FROM seed
  UNION
  SELECT w.source_id, link.url, w.depth + 1 FROM walk w JOIN src s USING (source_id) JOIN link ON link.parent = w.url
  WHERE w.depth < s.crawl_depth AND regexp_extract(link.url, '^([a-z]+)://', 1) IN ('http', 'https') AND list_contains(s.allowed_domains, {HOST_SQL.replace("url", "link.url")})
    AND len(list_filter(s.excluded_patterns, lambda x: x <> '' AND contains({PATH_SQL.replace("url", "link.url")}, x))) = 0),
first AS (SELECT source_id, url, min(depth) AS depth FROM walk GROUP BY source_id, url)
SELECT f.source_id, f.url, f.depth FROM first f JOIN src s USING (source_id)
QUALIFY row_number() OVER (PARTITION BY f.source_id ORDER BY f.depth, f.url) <= any_value(s.max_pages) OVER (PARTITION BY f.source_id)"""
)
def d11_frontier(spark: SparkSession, d: str) -> DataFrame:
    """Pages a crawl would save: links from each listing page to its pages, and from each source's home to its listings."""
    fetches, sources = _manifest(spark, d), table(spark, d, "sources")
    pages = fetches.select(F.col("parent_url").alias("parent"), "url")
    homes = fetches.join(ingest.small(sources.select("source_id", "base_url")), "source_id").select(F.col("base_url").alias("parent"), F.col("parent_url").alias("url"))
    edges = pages.unionByName(homes).where("parent is not null and url is not null")
    return ingest.frontier(edges, readers.enabled(sources))


# I: scalar functions


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("text is not null")


@query("SELECT doc_id, sha256(text) AS hash FROM documents WHERE text IS NOT NULL")
def i01_sha256(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", hashing.sha256(F.col("text")).alias("hash"))


@query("SELECT doc_id, coalesce(nullif(left(trim(regexp_replace(title, '[^A-Za-z0-9._-]+', '_', 'g'), '_'), 120), ''), 'item') || '.html' AS name FROM documents WHERE title IS NOT NULL")
def i02_safe_filename(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").where("title is not null").select("doc_id", tx.safe_filename(F.col("title"), ".html").alias("name"))


@query(f"SELECT doc_id, url, {normalized_sql('url')} AS normalized FROM manifest WHERE url IS NOT NULL")
def i03_normalized_url(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).where("url is not null").select("doc_id", "url", urls.normalized(F.col("url")).alias("normalized"))


@query(
    f"""SELECT doc_id, url, CASE WHEN {PDF_SQL} THEN '.pdf' WHEN lower(trim(split_part(mime_type, ';', 1))) = 'text/plain' THEN '.txt' ELSE '.html' END AS extension
FROM manifest WHERE url IS NOT NULL"""
)
def i04_extension(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).where("url is not null").select("doc_id", "url", urls.extension(F.col("url"), F.col("mime_type")).alias("extension"))


@query("SELECT source_id, parent_url AS page, url AS href, count(*) AS n FROM manifest WHERE parent_url IS NOT NULL AND url IS NOT NULL GROUP BY ALL")
def i05_links(spark: SparkSession, d: str) -> DataFrame:
    """Anchors of listing pages: one paragraph of markup for each fetch, its links extracted again."""
    anchor = F.concat(F.lit("<p>see <a class=x href=\""), F.col("url"), F.lit("\">page</a></p>"))
    pages = _manifest(spark, d).where("parent_url is not null and url is not null").select(F.struct("source_id", "parent_url").alias("page"), anchor.alias("markup"))
    found = readers.links(pages, "page", "markup")
    return found.groupBy(F.col("page.source_id").alias("source_id"), F.col("page.parent_url").alias("page"), "href").agg(F.count(F.lit(1)).alias("n"))


_CLEAN = "regexp_replace(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '[ \\t\\x{a0}]+', ' ', 'g'), '\\n{3,}', chr(10) || chr(10), 'g')"


@query(f"SELECT doc_id, {q.strip(_CLEAN)} AS text FROM documents WHERE text IS NOT NULL")
def i06_clean(spark: SparkSession, d: str) -> DataFrame:
    return _docs(spark, d).select("doc_id", tx.clean(F.col("text")).alias("text"))


@query(f"SELECT doc_id, url, coalesce(nullif(trim(regexp_replace(regexp_extract({PATH_SQL}, '([^/]*)/?$', 1), '(.)\\.[^.]*$', '\\1')), ''), title) AS name FROM manifest WHERE url IS NOT NULL")
def i11_title_from_url(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).where("url is not null").select("doc_id", "url", urls.title_from(F.col("url"), F.col("title")).alias("name"))


@query(f"SELECT doc_id, list_max(list_transform(regexp_extract_all(coalesce(title, '') || chr(10) || left({TEXT}, 2000), '20[0-3]\\d'), lambda y: y::INT)) AS year FROM documents")
def i12_e08_latest_year(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tx.latest_year(F.col("title"), F.col("text")).alias("year"))


@query("SELECT chunk_id, greatest(1, length(text) // 2)::INT AS tokens FROM (SELECT DISTINCT chunk_id, text FROM chunks WHERE text IS NOT NULL)")
def i13_token_estimate(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", "text").distinct().select("chunk_id", tx.token_estimate(F.col("text")).alias("tokens"))


@query(
    f"""WITH l AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents WHERE text IS NOT NULL)
SELECT doc_id, count(*) FILTER (regexp_matches(line, {q.pattern(tx.HEADING)})) AS headings, count(*) FILTER (regexp_matches({q.strip("line")}, {q.pattern(tx.PAGE_MARK)})) AS marks FROM l GROUP BY doc_id"""
)
def i14_i15_headings(spark: SparkSession, d: str) -> DataFrame:
    lines = F.split("text", "\n", -1)
    heads = F.size(F.filter(lines, lambda x: x.rlike("(?U)" + tx.HEADING.replace("0-9", "0-9"))))
    marks = F.size(F.filter(lines, lambda x: tx.strip(x).rlike(tx.PAGE_MARK)))
    return _docs(spark, d).select("doc_id", heads.cast("long").alias("headings"), marks.cast("long").alias("marks"))


def _token_query(name: str, spark_tokens, sql_tokens: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        t = spark_tokens(F.col("text"))
        return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, "|")).alias("digest"))

    run.__name__ = name
    query(f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, '|')) AS digest FROM (SELECT doc_id, {sql_tokens} AS t FROM documents WHERE text IS NOT NULL)")(run)


_token_query("i16_sparse_tokens", tx.sparse_tokens, q.sparse_tokens("text"))
_token_query("i17_rerank_tokens", tx.rerank_tokens, q.rerank_tokens("text"))
_token_query("i18_hash_tokens", tx.hash_tokens, q.hash_tokens("text"))


@query(
    """SELECT chunk_id, (list_reduce(list_transform(string_split(left(upper(sha256(chunk_id)), 16), ''), lambda c: (strpos('0123456789ABCDEF', c) - 1)::HUGEINT), lambda a, b: a * 16 + b))::VARCHAR AS point_id
FROM (SELECT DISTINCT chunk_id FROM chunks WHERE chunk_id IS NOT NULL)"""
)
def i20_point_id(spark: SparkSession, d: str) -> DataFrame:
    ids = table(spark, d, "chunks").select("chunk_id").where("chunk_id is not null").distinct()
    return ids.select("chunk_id", hashing.point_id(F.col("chunk_id")).cast("string").alias("point_id"))


def _questions(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "eval_cases").where("question is not null").select("question_id", "question").distinct()


_QUESTIONS = "(SELECT DISTINCT question_id, question FROM eval_cases WHERE question IS NOT NULL)"


@query(
    f"""SELECT question_id, TRY_CAST(nullif(regexp_extract(question, '20[0-3]\\d'), '') AS INT) AS year, c AS comparison,
  CASE WHEN c AND len(p) >= 2 THEN trim(p[1], '？?，, ') ELSE '' END AS "left", CASE WHEN c AND len(p) >= 2 THEN trim(substring(question, length(p[1]) + 2), '？?，, ') ELSE '' END AS "right"
FROM (SELECT question_id, question, {q.any_held("question", CAMPUS.comparison_words)} AS c, regexp_split_to_array(question, '和|与|跟|、') AS p FROM {_QUESTIONS})"""
)
def i21_query_analysis(spark: SparkSession, d: str) -> DataFrame:
    question = F.col("question")
    comparison = tx.holds_any(question, CAMPUS.comparison_words)
    parts = F.split(question, CAMPUS.comparison_split, 2)
    two = comparison & (F.size(parts) == 2)
    side = lambda i: F.when(two, F.btrim(F.get(parts, F.lit(i)), F.lit("？?，, "))).otherwise("")
    year = F.nullif(F.regexp_extract(question, tx.YEAR, 0), F.lit("")).cast("int")
    return _questions(spark, d).select("question_id", year.alias("year"), comparison.alias("comparison"), side(0).alias("left"), side(1).alias("right"))


@query(f"SELECT question_id, {q.precise('question')} AS precise FROM {_QUESTIONS}")
def i24_precise(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("question_id", tx.precise(F.col("question")).alias("precise"))


@query(f"SELECT doc_id, len(s) AS n, md5(array_to_string(s, '|')) AS digest FROM (SELECT doc_id, {q.sentences('x')} AS s FROM (SELECT doc_id, {q.squeeze('text')} AS x FROM documents WHERE text IS NOT NULL))")
def i25_sentences(spark: SparkSession, d: str) -> DataFrame:
    s = tx.sentences(tx.squeeze(F.col("text")))
    return _docs(spark, d).select("doc_id", F.size(s).cast("long").alias("n"), F.md5(F.array_join(s, "|")).alias("digest"))


@query(
    f"""WITH c AS (SELECT DISTINCT e.question_id, e.question, k.chunk_id, k.text FROM {_QUESTIONS.replace("question_id, question", "question_id, question, relevant_chunk_ids")} e,
  LATERAL (SELECT unnest(e.relevant_chunk_ids) AS chunk_id) r JOIN (SELECT DISTINCT chunk_id, text FROM chunks) k ON k.chunk_id = r.chunk_id)
SELECT question_id, chunk_id, {q.best_snippet("question", "text")} AS snippet FROM c"""
)
def i26_i27_best_snippet(spark: SparkSession, d: str) -> DataFrame:
    """The best snippet of each relevant chunk for its question."""
    asked = table(spark, d, "eval_cases").where("question is not null").select("question_id", "question", F.explode("relevant_chunk_ids").alias("chunk_id")).distinct()
    chunks = table(spark, d, "chunks").select("chunk_id", "text").distinct()
    return asked.join(chunks, "chunk_id").select("question_id", "chunk_id", tx.best_snippet(F.col("question"), F.col("text")).alias("snippet"))


@query(f"SELECT question_id, array_to_string({q.important_terms('question')}, '|') AS terms FROM {_QUESTIONS}")
def i28_important_terms(spark: SparkSession, d: str) -> DataFrame:
    return _questions(spark, d).select("question_id", F.array_join(tx.important_terms(F.col("question")), "|").alias("terms"))


@query(f"SELECT question_id, array_to_string({q.qualifiers('question')}, '|') AS places FROM (SELECT question_id, replace(question, '实验室', '校区') AS question FROM {_QUESTIONS})")
def i29_qualifiers(spark: SparkSession, d: str) -> DataFrame:
    """What is said of which campus; the questions' laboratories stand in for campuses."""
    asked = _questions(spark, d).withColumn("question", F.replace("question", F.lit("实验室"), F.lit("校区")))
    return asked.select("question_id", F.array_join(tx.qualifiers(F.col("question")), "|").alias("places"))


@query(f"SELECT DISTINCT chunk_id, {q.key_phrase('text')} AS phrase FROM chunks WHERE text IS NOT NULL")
def i31_key_phrase(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", tx.key_phrase(F.col("text")).alias("phrase")).distinct()


def _templated(name: str, phrase: str) -> str:
    def fill(t: str) -> str:
        a, b, c = t.split("%s")
        return f"{q.literal(a)} || {name} || {q.literal(b)} || {phrase} || {q.literal(c)}"

    kinds = " ".join(f"WHEN category = {q.literal(k)} THEN {fill(t)}" for k, t in CAMPUS.question_templates.items())
    return f"CASE {kinds} WHEN {q.any_held('text', CAMPUS.study_words)} THEN {fill(CAMPUS.study_template)} ELSE {fill(CAMPUS.other_template)} END"


@query(
    f"""SELECT DISTINCT chunk_id, {_templated("name", "phrase")} AS question
FROM (SELECT chunk_id, text, metadata.category AS category, coalesce(nullif(metadata.title, ''), '该资料') AS name, {q.key_phrase("text")} AS phrase FROM chunks WHERE text IS NOT NULL)"""
)
def i32_d13_question_for(spark: SparkSession, d: str) -> DataFrame:
    question = evaluation.question_for(F.col("text"), F.col("metadata.title"), F.col("metadata.category"))
    return table(spark, d, "chunks").where("text is not null").select("chunk_id", question.alias("question")).distinct()


@query("SELECT DISTINCT chunk_id, metadata.title AS title, metadata.effective_year AS year FROM chunks WHERE metadata IS NOT NULL")
def i35_json(spark: SparkSession, d: str) -> DataFrame:
    """Metadata to JSON and back."""
    from lectern.sources.schemas import CHUNK_METADATA

    chunks = table(spark, d, "chunks").where("metadata is not null")
    back = F.from_json(F.to_json("metadata"), CHUNK_METADATA)
    return chunks.select("chunk_id", back.alias("m")).select("chunk_id", "m.title", F.col("m.effective_year").alias("year")).distinct()


@query("SELECT doc_id, strftime(crawl_time, '%Y%m%dT%H%M%SZ') AS stamp FROM manifest")
def i36_stamps(spark: SparkSession, d: str) -> DataFrame:
    return _manifest(spark, d).select("doc_id", writers.stamp(F.col("crawl_time")).alias("stamp"))
