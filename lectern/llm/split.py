"""Problem 1: chunks over their rule's limit, cut into pieces at natural boundaries with the rule's overlap.

Balanced targets: the least number of pieces gives targets at equal distances; each cut moves to the strongest boundary
near its target (blank line, line, end of sentence, clause, space), as far as the limits of this and all later pieces
allow.  A cut that finds no natural boundary (line or end of sentence) is a forced one.  How few forced cuts can do is known
beforehand from the stretches without a natural boundary; as long as there are more, a greater number of pieces is tried,
which leaves every cut more room, one more at first and then in growing steps.  Where none of these does, each piece is taken
as far as it goes to a natural boundary, which always has the fewest forced cuts.  Neighbouring pieces share exactly
``overlap`` characters, and no piece is longer than the limit.  The work grows with the text's length, whatever is in it.
"""

from __future__ import annotations

import re
import unicodedata
from bisect import bisect_left, bisect_right

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.operators.ingest import once

BLANKS = " \t\r\n 　"
DEFAULT_RULE = "default"
BROADCAST_RULES = 10_000
BLANK_LINE, LINE, SENTENCE, CLAUSE, SPACE, NONE = 5, 4, 3, 2, 1, 0
_BOUNDARIES = re.compile(r"(?P<s5>(?:\r?\n[ \t 　]*){2,})|(?P<s4>\r\n|\r|\n)|(?P<s3>[。！？；]|[.!?](?=[ \t\r\n 　]))|(?P<s2>[，、：,;:|](?!\d))|(?P<s1>[ \t 　])")
_PARTS = re.compile(r"[\r\n]|(?<=[。！？；])|(?<=[.!?])(?=[ \t\r\n 　])")


def boundaries(text: str) -> tuple[list[int], list[int]]:
    """(places, strengths): where the text may be cut, in order."""
    at, strength = [], []
    for m in _BOUNDARIES.finditer(text):
        at.append(m.end())
        strength.append(int(m.lastgroup[1]))
    return at, strength


def _cuts(n: int, text: str, limit: int, overlap: int, k: int, at: list[int], strength: list[int]) -> tuple[list[int], int] | None:
    """The ends of k pieces and how many of the cuts are forced; None if k pieces can't hold the text."""
    room = limit - overlap
    step = (n - overlap) / k
    ends, start, bad = [], 0, 0
    for i in range(1, k):
        lo, hi = max(start + overlap + 1, n - (k - i) * room), min(start + limit, n - 1)
        if lo > hi:
            return None
        target = min(max(round(overlap + i * step), lo), hi)
        a, b = bisect_left(at, lo), bisect_right(at, hi)
        near = [(min(strength[j], LINE) if abs(at[j] - target) > step / 4 else strength[j] + 1, -abs(at[j] - target), at[j], strength[j]) for j in range(a, b)]
        natural = [x for x in near if x[3] >= SENTENCE]
        if natural:
            cut = max(natural)[2]
        else:
            bad += 1
            cut = _forced_cut(text, lo, target, [(x[3], x[1], x[2]) for x in near])
        ends.append(cut)
        start = cut - overlap
    if n - start > limit:
        return None
    return [*ends, n], bad


def _forced_cut(text: str, lo: int, target: int, weak: list[tuple]) -> int:
    """A cut where nothing natural is near: at the strongest weak boundary, else at the target, but not before a combining mark."""
    if weak:
        return max(weak)[2]
    cut = target
    while cut > lo and (unicodedata.combining(text[cut]) or text[cut] in "\u200d\ufe0f"):
        cut -= 1
    return cut if cut > lo else target


def _farthest(n: int, text: str, limit: int, overlap: int, natural: list[int]) -> list[int]:
    """The ends of pieces that each go as far as they can to a natural boundary, or as far as the limit where there is none."""
    ends, start, least = [], 0, 0
    while start + limit < n:
        hi, lo = start + limit, max(start + overlap, least) + 1
        i = bisect_right(natural, hi) - 1
        cut = natural[i] if i >= 0 and natural[i] >= lo else _forced_cut(text, lo, hi, [])
        ends.append(cut)
        start, least = cut - overlap, cut
    return [*ends, n]


def _counts(least: int):
    """The numbers of pieces to try: the least and up to four more, then in growing steps up to twice the least."""
    step, more = 1, 0
    while more <= least + 2:
        yield least + more
        more += step
        if more > 4:
            step *= 2


def cut_places(text: str, limit: int, overlap: int) -> list[int]:
    """The ends of the pieces of a stripped text that is over the limit; 0 <= overlap < limit."""
    n, room = len(text), limit - overlap
    at, strength = boundaries(text)
    natural = [p for p, s in zip(at, strength) if s >= SENTENCE and p > overlap]
    stretches = zip([overlap, *natural], [*natural, n])  # the first piece has its overlap to itself
    fewest = sum(max(0, -(-(b - a) // room) - 1) for a, b in stretches)
    best = None
    least = -(-(n - overlap) // room)
    for k in _counts(least):
        got = _cuts(n, text, limit, overlap, k, at, strength)
        if got and (best is None or got[1] < best[1]):
            best = got
        if best and best[1] <= fewest:
            return best[0]
    return _farthest(n, text, limit, overlap, natural)


def split_text(text: str, limit: int, overlap: int) -> list[str]:
    """The pieces of a text, stripped of blanks at both ends before; a text within the limit is one piece.

    Some new text must fit into each piece: a limit under 1 counts as 1, an overlap of the limit or more as one less.
    """
    return [text for text, _ in cut_pieces(text, limit, overlap)]


def cut_pieces(text: str, limit: int, overlap: int) -> list[tuple[str, int]]:
    """The pieces as in split_text, each with the length of the natural part that its end cuts through, 0 at a part's end."""
    text = text.strip(BLANKS)
    limit = max(1, limit)
    overlap = max(0, min(overlap, limit - 1))
    if len(text) <= limit:
        return [(text, 0)]
    ends = cut_places(text, limit, overlap)
    stops, starts = [0], [0]  # where natural parts end and the next ones start
    for m in _PARTS.finditer(text):
        stops.append(m.start())
        starts.append(m.end())
    stops.append(len(text))
    out, start = [], 0
    for end in ends:
        i = bisect_right(starts, end) - 1  # the part that the cut lies in, or at the start of
        inside = starts[i] < end < stops[i + 1]
        out.append((text[start:end], stops[i + 1] - starts[i] if inside else 0))
        start = end - overlap
    return out


def token_count(piece: str) -> int:
    """The estimate of the chunk pipeline: one token for two characters, at least one."""
    return max(1, len(piece) // 2)


def _limited(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """chunk_id, section_path, _text (stripped), _limit, _overlap; a null rule or one without a limit has the default's."""
    rules = limits.groupBy(F.col("chunk_rule").alias("_rule")).agg(F.min("max_chars").alias("_limit"), F.min("overlap_chars").alias("_overlap"))
    small = rules.count() <= BROADCAST_RULES
    rules = F.broadcast(rules) if small else rules
    default = limits.where(F.col("chunk_rule") == DEFAULT_RULE).agg(F.min("max_chars").alias("_limit0"), F.min("overlap_chars").alias("_overlap0"))
    strip = F.regexp_replace(F.col("text"), f"^[{BLANKS}]+|[{BLANKS}]+$", "")
    return (
        chunks.select("chunk_id", "section_path", F.coalesce("chunk_rule", F.lit(DEFAULT_RULE)).alias("_rule"), strip.alias("_text"))
        .join(rules, "_rule", "left")
        .crossJoin(F.broadcast(default))  # one row
        .select("chunk_id", "section_path", "_text", F.coalesce("_limit", "_limit0").alias("_limit"), F.coalesce("_overlap", "_overlap0", F.lit(0)).alias("_overlap"))
    )


def _split(oversized: DataFrame) -> DataFrame:
    """(chunk_id, section_path, piece_no, text, token_count, forced): forced is 1 where the piece's end cuts through a natural part over the limit."""
    schema = T.StructType(
        [
            *oversized.select("chunk_id", "section_path").schema.fields,
            T.StructField("piece_no", T.IntegerType()),
            T.StructField("text", T.StringType()),
            T.StructField("token_count", T.IntegerType()),
            T.StructField("forced", T.IntegerType()),
        ]
    )

    def run(batches):
        for b in batches:
            at, rows = [], []
            for i, (text, limit, overlap) in enumerate(zip(*(b.column(c).to_pylist() for c in ("_text", "_limit", "_overlap")))):
                for number, (piece, part) in enumerate(cut_pieces(text, limit, overlap)):
                    at.append(i)
                    rows.append((number, piece, token_count(piece), int(part > limit)))
            take = pa.array(at, pa.int64())
            columns = zip(zip(*rows) if rows else [()] * 4, (pa.int32(), pa.string(), pa.int32(), pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column("chunk_id").take(take), b.column("section_path").take(take), *(pa.array(c, t) for c, t in columns)], names=schema.names)

    return oversized.mapInArrow(run, schema)


def oversized_pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, section_path, piece_no, text, token_count, forced) of the chunks over their limit only.

    Only these leave the JVM.  A chunk that is given twice comes out twice.
    """
    return _split(_limited(chunks, limits).where(F.length("_text") > F.col("_limit")))


def pieces(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, section_path, piece_no, text, token_count) of all chunks, each chunk_id once.

    Chunks within their limit are one piece, with their token count set right.  A null text gives one piece with a null
    text and count 0, an empty or blank one an empty piece with count 0.  Without a default rule, a chunk whose rule has
    no limit stays whole.  Empty tables give an empty result.  Where an id has several versions, all pieces are of one,
    chosen by a hash of its rule, section and text; only rows of repeated ids are shuffled for that.
    """
    limited = once(_limited(chunks, limits), "chunk_id")
    over = F.coalesce(F.length("_text") > F.col("_limit"), F.lit(False))
    whole = limited.where(~over).select(
        "chunk_id",
        "section_path",
        F.lit(0).alias("piece_no"),
        F.col("_text").alias("text"),
        F.when(F.coalesce(F.length("_text"), F.lit(0)) == 0, 0).otherwise(F.greatest(F.lit(1), F.floor(F.length("_text") / 2))).cast("int").alias("token_count"),
    )
    return _split(limited.where(over)).drop("forced").unionByName(whole)


def oversized(chunks: DataFrame, limits: DataFrame) -> DataFrame:
    """(chunk_id, forced) of each chunk that was cut, once; forced is 1 if some natural part is over the limit by itself.

    Pieces end where they were cut, and every part over the limit has a cut inside: its length there tells.
    """
    made = oversized_pieces(chunks, limits).where("piece_no > 0 or forced = 1")
    return made.groupBy("chunk_id").agg(F.max("forced").alias("forced"))
