"""Problem 3: lines that a site repeats over its documents, and the documents without them.

Two lines are the same if their letters are (see codes.letter_table).  Each line is reduced to a 64-bit value of its
letters in one pass over the texts; from then on only these values travel, never the texts.

1. Every partition keeps a heavy-hitter summary per site (Misra-Gries, ``capacity`` counters): counts and what was
   taken off.  Summaries merge by adding up: a wording's documents are at most its counts plus all that was taken off at
   the site.  Wordings whose bound reaches the site's threshold are candidates; no other can reach it.
2. A second pass counts the candidates exactly.
3. Confirmed wordings mark the lines; they are broadcast while they are few enough, and joined with salted keys beyond.

How many wordings a site can confirm is bounded: with threshold share s and d distinct lines a document at d / s.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import codes
from lectern.session import settled

LEAST_DOCS, LEAST_SHARE = 5, 0.02
#: Counters of a summary.  More make fewer false candidates; the result is the same with any number.
CAPACITY = 4096
#: Rows (of some 40 bytes) that may be broadcast.
BROADCAST_ROWS = 1_000_000
SALTS = 16
#: Counters of all sites that a partition holds at a time.
MOST_COUNTERS = 2_000_000


def line_values(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text index, line number from 1, 64-bit value of the letters) of every line that has letters."""
    table = codes.letter_table()
    out = []
    for at, block in codes.blocks(texts):
        flat = codes.points("\n".join(block))
        if not len(flat):
            continue
        line = np.cumsum(flat == 10)  # the line a code point stands in, the separators between texts included
        counts = np.array([t.count("\n") + 1 for t in block], dtype=np.int64)
        first = np.concatenate(([0], np.cumsum(counts)))
        letters = table[flat]
        keep = letters > 0
        letters, line = letters[keep].astype(np.uint64), line[keep]
        if not len(letters):
            continue
        bounds = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        place = np.arange(len(letters)) - np.repeat(bounds, np.diff(np.append(bounds, len(letters))))
        with np.errstate(over="ignore"):
            mixed = codes.mixed((letters + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15) + codes.mixed(place.astype(np.uint64) + np.uint64(77)))
            value = codes.mixed(np.add.reduceat(mixed, bounds)).view(np.int64)
        number = line[bounds]
        text = np.searchsorted(first, number, "right") - 1
        out.append((text + at, number - first[text] + 1, value))
    if not out:
        return (np.zeros(0, np.int64),) * 3
    return tuple(np.concatenate(x) for x in zip(*out))


def _lines(docs: DataFrame, id_col: str, ref_col: str, text_col: str) -> DataFrame:
    """(id, _ref, numbers, values) of each document with non-null text; the arrays hold its lines with letters."""
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(ref_col).alias("_ref"), F.col(text_col).cast("string").alias("_text")).where("_text is not null")
    schema = T.StructType(
        [*narrow.schema.fields[:2], T.StructField("numbers", T.ArrayType(T.IntegerType())), T.StructField("values", T.ArrayType(T.LongType()))]
    )

    def run(batches):
        for b in batches:
            text, number, value = line_values(b.column(2).to_pylist())
            ends = np.concatenate(([0], np.cumsum(np.bincount(text, minlength=b.num_rows)))).astype(np.int32)
            offsets = pa.array(ends)
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.ListArray.from_arrays(offsets, pa.array(number.astype(np.int32))),
                    pa.ListArray.from_arrays(offsets, pa.array(value)),
                ],
                names=[id_col, "_ref", "numbers", "values"],
            )

    return narrow.mapInArrow(run, schema)


def _summaries(sited: DataFrame, capacity: int) -> DataFrame:
    """(site, value, n): the counters of each partition's summaries; value null holds what was taken off at the site."""

    def run(batches):
        counters: dict[str, dict[int, int]] = {}
        off: dict[str, int] = {}

        def flushed():
            rows = [(s, v, n) for s, own in counters.items() for v, n in own.items()] + [(s, None, n) for s, n in off.items()]
            counters.clear()
            off.clear()
            for i in range(0, len(rows), 50_000):
                s, v, n = zip(*rows[i : i + 50_000])
                yield pa.RecordBatch.from_arrays([pa.array(s, pa.string()), pa.array(v, pa.int64()), pa.array(n, pa.int64())], names=["site", "value", "n"])

        for b in batches:
            if sum(map(len, counters.values())) > MOST_COUNTERS:  # many sites in one partition: parts of a summary merge as well
                yield from flushed()
            for site, values in zip(b.column(0).to_pylist(), b.column(1)):
                own = counters.setdefault(site, {})
                for v in set(values.values.to_numpy(zero_copy_only=False).tolist() if values.is_valid else ()):
                    own[v] = own.get(v, 0) + 1
                if len(own) > 2 * capacity:
                    least = sorted(own.values(), reverse=True)[capacity]
                    off[site] = off.get(site, 0) + least
                    counters[site] = {v: n - least for v, n in own.items() if n > least}
        yield from flushed()

    schema = T.StructType([T.StructField("site", T.StringType()), T.StructField("value", T.LongType()), T.StructField("n", T.LongType())])
    return sited.select("site", "values").mapInArrow(run, schema)


def sited_lines(docs: DataFrame, manifest: DataFrame, id_col: str = "doc_id", ref_col: str = "doc_ref", text_col: str = "text") -> DataFrame:
    """(site, id, numbers, values) of each document with a site, kept in the shared folder for the passes that follow."""
    site = manifest.select(F.col("doc_id").alias("_ref"), F.col("source_id").alias("site")).where("_ref is not null and site is not null").groupBy("_ref").agg(F.min("site").alias("site"))
    return settled(_lines(docs, id_col, ref_col, text_col).join(site, "_ref").select("site", id_col, "numbers", "values"))


def _by_site(rows: DataFrame, sizes: DataFrame) -> DataFrame:
    """Rows (with a value) joined with what is known of their site: sites are broadcast while they are few, and dealt out by value beyond, as one may be very large."""
    if sizes.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(sizes), "site")
    salted = sizes.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("value"), F.lit(SALTS)).cast("int")).join(salted, ["site", "_salt"]).drop("_salt")


def repeated(sited: DataFrame, least_docs: int = LEAST_DOCS, least_share: float = LEAST_SHARE, capacity: int = CAPACITY) -> DataFrame:
    """(site, value, n_docs, n_site) of the wordings in at least least_docs and least_share of a site's documents.

    Where so much was taken off at a site that a wording without any counter could reach the threshold (documents with
    more than least_share * capacity distinct lines on average), all wordings of that site are counted.
    """
    sizes = sited.groupBy("site").agg(F.count(F.lit(1)).alias("n_site")).withColumn("need", F.greatest(F.lit(least_docs), F.ceil(F.col("n_site") * F.lit(least_share) - 1e-9)))
    summary = _summaries(sited, capacity).groupBy("site", "value").agg(F.sum("n").alias("n"))
    summary = settled(summary)
    off = summary.where("value is null").select("site", F.col("n").alias("off"))
    sizes = settled(sizes.join(off, "site", "left").withColumn("off", F.coalesce("off", F.lit(0))))
    bound = _by_site(summary.where("value is not null"), sizes.where("off < need"))
    candidates = settled(bound.where("n + off >= need").select("site", "value"))
    if candidates.count() <= BROADCAST_ROWS:
        candidates = F.broadcast(candidates)
    each = sited.select("site", F.explode(F.array_distinct("values")).alias("value"))
    rows = each.join(candidates, ["site", "value"], "left_semi").unionByName(_by_site(each, sizes.where("off >= need").select("site")))
    counted = rows.groupBy("site", "value").agg(F.count(F.lit(1)).alias("n_docs"))
    return _by_site(counted, sizes).where("n_docs >= need").select("site", "value", "n_docs", "n_site")


def repeated_lines(sited: DataFrame, confirmed: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """(site, id, line_no, value) of every line whose wording is confirmed for its site."""
    each = sited.select("site", id_col, F.explode(F.arrays_zip("numbers", "values")).alias("l")).select("site", id_col, F.col("l.numbers").alias("line_no"), F.col("l.values").alias("value"))
    confirmed = settled(confirmed.select("site", "value"))
    if confirmed.count() <= BROADCAST_ROWS:
        return each.join(F.broadcast(confirmed), ["site", "value"])
    salted = confirmed.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return each.withColumn("salt", F.pmod(F.xxhash64(id_col), F.lit(SALTS)).cast("int")).join(salted, ["site", "value", "salt"]).drop("salt")


def found_lines(docs: DataFrame, manifest: DataFrame, id_col: str = "doc_id", ref_col: str = "doc_ref", text_col: str = "text") -> DataFrame:
    """(id, line_no) of the repeated lines.

    Documents without text or site count nowhere and have none.  A document that is given twice counts twice.  Lines are
    counted from 1 at each \\n; lines without letters never match.  Empty tables give an empty result.
    """
    sited = sited_lines(docs, manifest, id_col, ref_col, text_col)
    return repeated_lines(sited, repeated(sited), id_col).select(id_col, "line_no")


def without_lines(docs: DataFrame, lines: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, text) of every document, the given lines (id, line_no) taken out; null texts stay null."""
    drop = lines.groupBy(id_col).agg(F.collect_set("line_no").alias("_drop"))
    kept = F.array_except(F.sequence(F.lit(1), F.size("_lines")), "_drop")
    left = F.array_join(F.transform(kept, lambda i: F.element_at("_lines", i)), "\n")
    return (
        docs.select(id_col, F.col(text_col).alias("_text"))
        .join(drop, id_col, "left")
        .withColumn("_lines", F.split("_text", "\n", -1))
        .select(id_col, F.when(F.col("_drop").isNull(), F.col("_text")).otherwise(left).alias(text_col))
    )
