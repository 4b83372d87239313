"""From fetches to documents: registry joins, duplicate fetches, upserts, filters of pages, and the crawl frontier."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.functions import text as tx
from lectern.functions import urls
from lectern.functions.lexicon import CAMPUS, Lexicon
from lectern.session import settled

#: Rows of a registry that may be broadcast.
REGISTRY_ROWS = 100_000
PDF_BYTES, HTML_BYTES = 52_428_800, 5_242_880
LEAST_CHARS, LEAST_API_CHARS, LOGIN_REACH = 100, 80, 1200
#: Parts that the links of a page are dealt out to where pages are too many to be broadcast.
LINK_SALTS = 16


def small(df: DataFrame, most: int = REGISTRY_ROWS) -> DataFrame:
    """The frame with a broadcast hint if it is known to have at most ``most`` rows, else as it is.

    It runs once to be counted; what is dear to compute is settled before.
    """
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df


def parted(rows: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """The rows whose key stands once, and those whose key repeats (null is a key).  Keys are counted without the other columns."""
    repeated = small(settled(rows.groupBy(F.col(key).alias("_key")).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("_key")))
    same = rows[key].eqNullSafe(repeated["_key"])
    return rows.join(repeated, same, "left_anti"), rows.join(repeated, same, "left_semi")


def chosen(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key, chosen by a hash of all columns."""
    plain = [F.map_entries(f.name) if isinstance(f.dataType, T.MapType) else F.col(f.name) for f in rows.schema.fields]
    return rows.groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*rows.columns), F.xxhash64(*plain)).alias("_row")).select("_row.*")


def once(rows: DataFrame, key: str) -> DataFrame:
    """One row of each key (null is a key).  Of several versions one is chosen by a hash of all columns; only such rows are shuffled."""
    single, several = parted(rows, key)
    return single.unionByName(chosen(several, key))


def with_registry(fetches: DataFrame, sources: DataFrame) -> DataFrame:
    """Fetches with name, category and authority of their source; 'unknown' and 50 where it isn't registered."""
    known = small(sources.select("source_id", "name", F.col("category").alias("_category"), F.col("authority_level").alias("_level")))
    return (
        fetches.join(known, "source_id", "left")
        .withColumn("category", F.coalesce("_category", F.lit("unknown")))
        .withColumn("authority_level", F.coalesce("_level", F.lit(50)))
        .drop("_category", "_level")
    )


def fetched(fetches: DataFrame) -> DataFrame:
    return fetches.where(F.col("status_code") < 400)


def within_size(body_length: Column, is_pdf: Column) -> Column:
    return body_length <= F.when(is_pdf, PDF_BYTES).otherwise(HTML_BYTES)


def looks_binary(body: Column) -> Column:
    """Whether the first 2048 bytes hold a NUL."""
    return F.contains(F.substring(body, 1, 2048), F.lit(b"\x00"))


def readable(text: Column, least: int = LEAST_CHARS, lexicon: Lexicon = CAMPUS) -> Column:
    """Long enough and no log-in page (by marks near the start)."""
    return (F.length(text) >= least) & ~tx.holds_any(F.substring(text, 1, LOGIN_REACH), lexicon.login_marks)


def new_fetches(incoming: DataFrame, existing: DataFrame) -> DataFrame:
    """Incoming fetches whose url and content are new, to the existing ones and among themselves (the first wins).

    Order among the incoming is crawl_time, then url, then doc_id.  A null url or hash equals nothing and is new.
    """
    order = ("crawl_time", "url", "doc_id")
    fresh = incoming.join(existing.select("url").where("url is not null").distinct(), "url", "left_anti")
    fresh = fresh.join(existing.select("content_hash").where("content_hash is not null").distinct(), "content_hash", "left_anti")

    def first(df: DataFrame, key: str) -> DataFrame:
        # the first of each key is picked on both sides of the shuffle, so a key of very many rows is no hot group;
        # null keys have their own branch
        best = df.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(F.min_by(F.struct(*df.columns), F.struct(*order)).alias("_row"))
        return best.select("_row.*").unionByName(df.where(F.col(key).isNull()))

    return first(first(fresh, "url"), "content_hash")


def numbered(rows: DataFrame, by: str, time: str, *ties: str) -> DataFrame:
    """Rows with n, counted from 0 within ``by`` in order of time, then ties.

    Numbers are taken within an hour and added to what came before, so that no task orders all rows of a large group.
    """
    slot = F.date_trunc("hour", F.col(time)).alias("_slot")
    hours = rows.select(F.col(by).alias("_by"), slot).groupBy("_by", "_slot").agg(F.count(F.lit(1)).alias("_n"))
    earlier = W.partitionBy("_by").orderBy("_slot").rowsBetween(W.unboundedPreceding, -1)
    hours = small(settled(hours.select("_by", "_slot", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before"))))
    within = F.row_number().over(W.partitionBy(by, "_slot").orderBy(time, *ties))
    each = rows.withColumn("_slot", slot).withColumn("_within", within)
    same = F.col(by).eqNullSafe(F.col("_by")) & each["_slot"].eqNullSafe(hours["_slot"])
    return each.join(hours, same).select(*rows.columns, (F.col("_before") + F.col("_within") - 1).alias("n"))


def upserted(current: DataFrame, changes: DataFrame, key: str, order: str) -> DataFrame:
    """Current rows replaced by the last change of their key, and the changes of new keys; changes without a key are dropped."""
    known = changes.where(F.col(key).isNotNull())
    last = known.groupBy(F.col(key).alias("_key")).agg(F.max_by(F.struct(*changes.columns), F.col(order)).alias("_row")).select("_row.*")
    return current.join(last.select(key), key, "left_anti").unionByName(last, allowMissingColumns=True)


def _linked(pages: DataFrame, links: DataFrame, few: bool) -> DataFrame:
    """Pages joined with their links.  Few pages are broadcast; else the links of each page are dealt out, as a home page may have very many."""
    if few:
        return links.join(F.broadcast(pages), "parent")
    salted = pages.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(LINK_SALTS - 1))))
    return links.withColumn("_salt", F.pmod(F.xxhash64("url"), F.lit(LINK_SALTS)).cast("int")).join(salted, ["parent", "_salt"])


def frontier(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(source_id, url, depth): pages a breadth-first crawl saves, from each source's seeds over links parent -> url.

    Only allowed links that aren't media are followed, while depth is under crawl_depth; of what is reached the first
    max_pages by depth and url are saved.  A round joins the links to the last round's pages; rounds are as many as the
    deepest crawl_depth allows, and each is kept in the shared folder.
    """
    rules = sources.select("source_id", "allowed_domains", "excluded_patterns", "crawl_depth", "max_pages")
    links = (
        edges.select(urls.normalized(F.col("parent")).alias("parent"), urls.normalized(F.col("url")).alias("url"))
        .where("parent is not null and url is not null")
        .where(~urls.is_media(F.col("url")))
        .distinct()
    )
    links = settled(links)
    seeds = sources.select("source_id", F.explode("seed_urls").alias("url")).select("source_id", urls.normalized(F.col("url")).alias("url")).distinct()
    reached = seeds.withColumn("depth", F.lit(0))
    deepest = sources.agg(F.max("crawl_depth").alias("d")).first()["d"] or 0
    known = small(rules)
    last = reached
    for depth in range(1, deepest + 1):
        pages = (
            last.join(known.select("source_id", "allowed_domains", "excluded_patterns", "crawl_depth"), "source_id")
            .where(F.col("crawl_depth") >= depth)
            .withColumnRenamed("url", "parent")
        )
        step = (
            _linked(pages, links, last.limit(REGISTRY_ROWS + 1).count() <= REGISTRY_ROWS)
            .where(urls.allowed(F.col("url"), F.col("allowed_domains"), F.col("excluded_patterns")))
            .select("source_id", "url")
            .distinct()
            .join(reached.select("source_id", "url"), ["source_id", "url"], "left_anti")
        )
        last = settled(step.withColumn("depth", F.lit(depth)))
        reached = reached.unionByName(last)
    most = sources.agg(F.max("max_pages").alias("m")).first()["m"] or 0
    ranked = reached.withColumn("_n", F.row_number().over(W.partitionBy("source_id").orderBy("depth", "url")))
    # the limit that holds for all sources is applied before the shuffle, within each partition
    return ranked.where(F.col("_n") <= most).join(known.select("source_id", "max_pages"), "source_id").where("_n <= max_pages").select("source_id", "url", "depth")


def documents_of(fetches: DataFrame, parsed: DataFrame, sources: DataFrame, lexicon: Lexicon = CAMPUS) -> DataFrame:
    """Documents: successful fetches with their parsed text (by local_path) and the registry's fields.

    The title of a PDF comes from its URL, else the parser's or the fetch's.  Unparsed (null), short and log-in pages
    are dropped.  parsed: local_path, title, text.
    """
    pages = fetched(fetches).join(parsed.select("local_path", F.col("title").alias("_title"), "text"), "local_path").where(readable(F.col("text"), lexicon=lexicon))
    pages = with_registry(pages, sources)
    pdf = urls.is_pdf(F.col("url"), F.col("mime_type"))
    title = F.when(pdf, urls.title_from(F.col("url"), F.coalesce("title", "_title"))).otherwise(F.coalesce("_title", "title"))
    return pages.withColumn("title", title).select(
        "doc_id",
        "title",
        F.col("url").alias("source_url"),
        F.when(pdf, "pdf").otherwise("html").alias("source_type"),
        "category",
        "authority_level",
        tx.latest_year(F.col("title"), F.col("text")).alias("effective_year"),
        F.lit("unknown").alias("status"),
        F.sha2("text", 256).alias("hash"),
        "local_path",
        "text",
        F.map_from_arrays(F.array(F.lit("source_id"), F.lit("source_name"), F.lit("content_hash")), F.array("source_id", "name", "content_hash")).alias("metadata"),
    )
