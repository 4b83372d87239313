"""Problem 5: questions of the evaluation splits that also stand, exactly or almost, in the training split.

A weighted cosine join between the two sides.  A question is a vector of term weights (idf, length 1) over terms that
slips of the pen hardly change: ideographs, unordered pairs and triples of near ones, the letters of a word as a set, its three-letter
runs, near words in pairs.  Two questions that ask the same name the same numbers, so each term is taken together with the
numbers of its question: lists are shorter by what the numbers tell apart, and no pair that counts is lost.

Terms are ordered from rare to common.  Of each vector only the head is entered in the inverted lists: the tail is cut
where it can no longer bring a dot product to the threshold, by the lesser of two bounds, the norm of the tail (residual
norm) and the sum of its weights times the other side's greatest weight of each term (maximum weight).  The first common
term of a pair that reaches the threshold stands in both heads.  From a common term on, the product of the two residual
norms bounds what the pair can still gain; postings whose product is under the threshold are pruned where they meet.
The rest are summed by pair, and a pair stays only if its sum and the product behind its last common term reach the
threshold together.  Of those that stay the exact dot products are taken.  No pair over the threshold is lost.

The join runs on distinct wordings; copies of a question are one class.  An exact check follows: a pair counts if both ask
the same of the same subject, so numbers must agree, and after politeness and question words are set aside what is left must
be equal but for slips (a doubled, dropped or transposed letter).
"""

from __future__ import annotations

import math
import re
import unicodedata
from itertools import combinations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.session import settled

#: Chosen by recall: of made-up questions with two slips each, 99 in 100 lie above it (tests/llm), of the test tables' pairs all.
THRESHOLD = 0.55
#: A term weighs ln(n / df), at least LEAST_WEIGHT, so that what most questions share says next to nothing.
LEAST_WEIGHT = 0.1
#: Rows (of some 40 bytes) that may be broadcast.
BROADCAST_ROWS = 1_000_000
#: Vectors (of some 2 KB) of one side that may be broadcast.
BROADCAST_VECTORS = 20_000
#: Entries of a list, or copies of a wording, that one task joins; longer ones are split over several.
LONG = 4096
#: Politeness, question words and particles that two wordings of one question may differ in.
FILLERS_ZH = """麻烦问一下 麻烦告知 麻烦了 麻烦 请问一下 请问 请教一下 请教 求问 劳驾 打扰一下 打扰了 想问一下 想问 想咨询 咨询一下 想了解一下 我想知道 想知道 请告知
各位老师好 老师您好 老师好 老师 同学们好 大家好 您好 你好 谢谢您 谢谢老师 谢谢 多谢 感谢 辛苦了 有人知道 怎么样 怎样 如何 怎么 什么样 什么 都有哪些 有哪些 哪些 哪里 哪儿 到底 究竟
应该 应当 具体 内容 一下 的 是 有 何 要 吗 呢 啊 吧 了 呀 说 看 请 在 中 里 关于""".split()
FILLERS_EN = """hi hello hey dear sorry excuse good morning afternoon evening please kindly thanks thank you cheers quick question could can may might would do does did is
are was be what which how where who i we me one tell let know us find get way according going by wondering like just a an the of for in on at to about regarding it its s""".split()
_ZH = re.compile("|".join(sorted(FILLERS_ZH, key=len, reverse=True)))
_EN = frozenset(FILLERS_EN)
_NUMBER = re.compile(r"\d+")
_TOKEN = re.compile(r"\d+|[a-z]+|[㐀-鿿]+")
_WIDE = re.compile(r"[㐀-鿿]")


def folded(question: str | None) -> str:
    """Letters and digits in compatibility form and lower case, words one space apart."""
    if not question:
        return ""
    text = unicodedata.normalize("NFKC", question).lower()
    if _WIDE.search(text):  # no spaces between ideographs
        text = re.sub(r"(?<=[^a-z])\s+|\s+(?=[^a-z])", "", text)
    return " ".join(re.sub(r"[^\w]+|_", " ", text).split())


def _near(items: list[str], n: int, window: int) -> set[str]:
    """Every n items within a window, in no order."""
    return {"".join(sorted((first, *rest))) for i, first in enumerate(items) for rest in combinations(items[i + 1 : i + window], n - 1)}


def terms(text: str) -> list[str]:
    """The distinct terms of a folded question; fillers give none unless there is nothing else."""
    bare = " ".join(w for w in _ZH.sub("", text).split() if w not in _EN) or text
    wide = _WIDE.findall(bare)
    found = set(wide) | _near(wide, 2, 3) | _near(wide, 3, 4)
    sets = []
    for word in re.findall(r"[^\W\d_]+", _WIDE.sub(" ", bare)):
        sets.append("=" + "".join(sorted(set(word))))
        padded = f"^{word}$"
        if len(word) > 3:
            found.update(padded[i : i + 3] for i in range(len(padded) - 2))
    found |= set(sets) | _near(sets, 2, 3)
    numbers = " ".join(sorted(_NUMBER.findall(text)))
    return sorted(f"{numbers}#{term}" for term in found or {""})


def _slips(a: str, b: str, most: int) -> int | None:
    """Slips that turn a into b: a transposition of neighbours, a doubled or a lost letter; None if more than ``most``."""
    if abs(len(a) - len(b)) > most:
        return None
    if most == 0 or a == b:
        return 0 if a == b else None
    i = 0
    while i < len(a) and i < len(b) and a[i] == b[i]:
        i += 1
    best = None
    for x, y in ((a, b), (b, a)):
        if x[i : i + 2][::-1] == y[i : i + 2] and len(x[i : i + 2]) == 2:
            n = _slips(x[i + 2 :], y[i + 2 :], most - 1)
            if n is not None:
                best = min(n + 1, best or 9)
        if i < len(x):  # a letter too many in x
            n = _slips(x[i + 1 :], y[i:], most - 1)
            if n is not None:
                best = min(n + 1, best or 9)
    return best


def content(text: str) -> list[str]:
    """What a folded question asks about: its tokens without fillers and numbers."""
    words = []
    for token in _TOKEN.findall(text):
        if token[0].isdigit():
            continue
        if token[0] <= "z":
            if token not in _EN:
                words.append(token)
        else:
            words.append(token)
    return words


def same_question(a: str, b: str, most: int = 3) -> bool:
    """Whether two folded questions ask the same of the same subject in equal or nearly equal words."""
    if a == b:
        return True
    if sorted(_NUMBER.findall(a)) != sorted(_NUMBER.findall(b)):
        return False
    if _WIDE.search(a) or _WIDE.search(b):
        x, y = "".join(content(a)), "".join(content(b))
        if _slips(x, y, most) is not None:
            return True
        return _slips(_ZH.sub("", x), _ZH.sub("", y), most) is not None
    x, y = content(a), content(b)
    for longer, other in ((x, y), (y, x)):  # a slip may hide a filler
        for word in [w for w in longer if w not in other]:
            if len(longer) > len(other) and any(word == f[::-1] or (len(f) > 2 and _slips(word, f, 1) is not None) for f in _EN):
                longer.remove(word)
    if len(x) == len(y):
        left = most
        for u, v in zip(x, y):
            if u != v:
                n = _slips(u, v, min(2, left)) if len(u) > 2 or len(v) > 2 else None
                if n is None:
                    break
                left -= n
        else:
            return True
    x = [w for w in re.findall("[a-z]+", a)]
    y = [w for w in re.findall("[a-z]+", b)]
    return _slips(" ".join(x), " ".join(y), most) is not None


_CASE = T.StructType([T.StructField(n, T.StringType()) for n in ("question_id", "split_name", "source_id", "wording")])


def _read(cases: DataFrame, id_col: str, question_col: str, split_col: str, source_col: str) -> DataFrame:
    """(question_id, split_name, source_id, wording): one row for each id, split and wording; a question without words is dropped."""
    import pyarrow as pa

    once = (
        cases.select(*(F.col(c).cast("string").alias(n) for c, n in zip((id_col, split_col, source_col, question_col), _CASE.names)))
        .where("question_id is not null and split_name is not null and wording is not null")
        .groupBy("question_id", "split_name", "wording")
        .agg(F.min("source_id").alias("source_id"))
        .select(*_CASE.names)
    )

    def run(batches):
        for b in batches:
            words = pa.array([folded(q) for q in b.column(3).to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), words], names=_CASE.names)

    folds = once.mapInArrow(run, _CASE).where("wording != ''")
    return folds.groupBy("question_id", "split_name", "wording").agg(F.min("source_id").alias("source_id"))


def _postings(classes: DataFrame) -> DataFrame:
    """(cid, train, held, terms): the terms of each class as 64-bit hashes."""

    def run(batches):
        import pyarrow as pa

        for b in batches:
            names = pa.array([terms(w) for w in b.column(3).to_pylist()], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), names], names=["cid", "train", "held", "names"])

    narrow = classes.select("cid", "train", "held", "wording")
    schema = T.StructType([*narrow.schema.fields[:3], T.StructField("names", T.ArrayType(T.StringType()))])
    return narrow.mapInArrow(run, schema).select("cid", "train", "held", F.transform("names", lambda t: F.xxhash64(t)).alias("terms"))


def _sized(df: DataFrame, most: int | None = None) -> DataFrame:
    """A table kept in the shared folder, with a broadcast hint if it has at most ``most`` (else BROADCAST_ROWS) rows."""
    df = settled(df)
    return F.broadcast(df) if df.count() <= (BROADCAST_ROWS if most is None else most) else df


def _vectors(classes: DataFrame) -> DataFrame:
    """(cid, train, held, terms): terms are structs (df, term, w, other) from rare to common; w makes length 1.

    Only terms that the other side has too are kept, since others can't be common; they count for the norm.  ``other`` is
    the greatest weight of the term on the other side.
    """
    listed = settled(_postings(classes))
    n = listed.count()
    one = F.lit(1)
    idf = F.greatest(F.lit(LEAST_WEIGHT), F.log(F.lit(float(max(n, 1))) / F.col("df")))
    each = listed.select("cid", "train", "held", F.explode("terms").alias("term"))
    frequency = _sized(
        each.groupBy("term")
        .agg(F.count(one).alias("df"), F.max("train").alias("in_train"), F.max("held").alias("in_held"))
        .where("df > 1 or (in_train and in_held)")  # any other occurs once, with df 1
        .withColumn("idf", idf)
    )
    common = (F.col("train") & F.col("in_held")) | (F.col("held") & F.col("in_train"))
    alone = F.lit(max(LEAST_WEIGHT, math.log(max(n, 1))))
    vectors = settled(
        each.join(frequency, "term", "left")
        .withColumn("idf", F.coalesce("idf", alone))
        .groupBy("cid", "train", "held")
        .agg(F.sqrt(F.sum(F.col("idf") * F.col("idf"))).alias("norm"), F.collect_list(F.when(common, F.struct("df", "term", "idf"))).alias("terms"))
        .where(F.size("terms") > 0)
        .select("cid", "train", "held", F.transform("terms", lambda t: F.struct(t["df"].alias("df"), t["term"].alias("term"), (t["idf"] / F.col("norm")).alias("w"))).alias("terms"))
    )
    weighted = vectors.select("cid", "train", "held", F.explode("terms").alias("t")).select("cid", "train", "held", "t.df", "t.term", "t.w")
    greatest = _sized(weighted.groupBy("term").agg(F.max(F.when(F.col("train"), F.col("w"))).alias("max_train"), F.max(F.when(F.col("held"), F.col("w"))).alias("max_held")))
    other = F.greatest(F.when(F.col("train"), F.coalesce("max_held", F.lit(0.0))), F.when(F.col("held"), F.coalesce("max_train", F.lit(0.0))))
    return (
        weighted.join(greatest, "term")
        .groupBy("cid", "train", "held")
        .agg(F.sort_array(F.collect_list(F.struct("df", "term", "w", other.alias("other")))).alias("terms"))
    )


def _heads(vectors: DataFrame, side: str, threshold: float) -> DataFrame:
    """(cid, term, w, rest, after) of the terms that one side enters in the inverted lists.

    For each place of a vector two bounds hold for what the terms from there on can bring: their norm (``rest``; ``after``
    is the norm of those behind the place), and the sum of their weights times the other side's greatest weight of each.
    Places where the lesser is under the threshold make the tail, which stays out.
    """
    import pyarrow as pa

    def run(batches):
        for b in batches:
            lists = b.column(1)
            offsets = lists.offsets.to_numpy()
            size = np.diff(offsets)
            flat = lists.values.slice(offsets[0], offsets[-1] - offsets[0])
            w, other = (flat.field(n).to_numpy() for n in ("w", "other"))
            end = np.repeat(offsets[1:] - offsets[0], size)

            def behind(x):  # the sum from each place to the end of its vector
                upto = np.concatenate(([0.0], np.cumsum(x)))
                return upto[end] - upto[:-1]

            sq = behind(w * w)
            keep = (sq >= (threshold - 1e-9) ** 2) & (behind(w * other) >= threshold - 1e-9)
            place = pa.array(np.flatnonzero(keep))
            after = np.sqrt(np.maximum(sq - w * w, 0.0))
            columns = [b.column(0).take(pa.array(np.repeat(np.arange(len(size)), size)[keep])), flat.field("term").take(place)]
            yield pa.RecordBatch.from_arrays([*columns, *(pa.array(x[keep]) for x in (w, np.sqrt(sq), after))], names=["cid", "term", "w", "rest", "after"])

    return vectors.where(side).select("cid", "terms").mapInArrow(run, "cid long, term long, w double, rest double, after double")


def _dots(pairs: DataFrame) -> DataFrame:
    """(a, b, cosine) of pairs with the terms and weights of both: (a, b, ta, wa, tb, wb)."""
    import pyarrow as pa

    def run(batches):
        for batch in batches:
            sides = []
            for c in (2, 3, 4, 5):
                lists = batch.column(c)
                sides.append((lists.offsets.to_numpy(), lists.values.to_numpy()))
            (oa, ta), (_, wa), (ob, tb), (_, wb) = sides
            out = np.zeros(batch.num_rows)
            for i in range(batch.num_rows):
                a, b = slice(oa[i], oa[i + 1]), slice(ob[i], ob[i + 1])
                _, x, y = np.intersect1d(ta[a], tb[b], assume_unique=True, return_indices=True)
                out[i] = wa[a][x] @ wb[b][y]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out)], names=["a", "b", "cosine"])

    return pairs.select("a", "b", "ta", "wa", "tb", "wb").mapInArrow(run, "a long, b long, cosine double")


def _split_lists(left: DataFrame, right: DataFrame, long: int) -> tuple[DataFrame, DataFrame]:
    """Both sides with a salt: of a list with more than ``long`` entries on the left, each part meets a copy of the right."""
    sizes = _sized(left.groupBy("term").agg(F.ceil(F.count(F.lit(1)) / long).cast("int").alias("parts")).where("parts > 1"))
    parts = F.coalesce("parts", F.lit(1))
    left = left.join(sizes, "term", "left").withColumn("salt", F.pmod(F.xxhash64("a"), parts).cast("int")).drop("parts")
    right = right.join(sizes, "term", "left").withColumn("salt", F.explode(F.sequence(F.lit(0), parts - 1))).drop("parts")
    return left, right


def cosine_pairs(classes: DataFrame, threshold: float = THRESHOLD, long: int = LONG) -> DataFrame:
    """(a, b, cosine) of all pairs of a train class a and a held-out class b with cosine >= threshold.

    classes: cid, wording (distinct), train and held (whether it stands in either side; in both, it also meets itself).
    """
    vectors = settled(_vectors(classes))
    left = settled(_heads(vectors, "train", threshold).select(F.col("cid").alias("a"), "term", F.col("w").alias("wa"), F.col("rest").alias("ra"), F.col("after").alias("na")))
    right = settled(_heads(vectors, "held", threshold).select(F.col("cid").alias("b"), "term", F.col("w").alias("wb"), F.col("rest").alias("rb"), F.col("after").alias("nb")))
    left, right = _split_lists(left, right, long)
    met = left.join(right, ["term", "salt"]).where(F.col("ra") * F.col("rb") >= threshold - 1e-9)
    # common terms that aren't in the sum lie behind the last one that is
    reach = F.sum(F.col("wa") * F.col("wb")) + F.min(F.col("na") * F.col("nb"))
    pairs = met.groupBy("a", "b").agg(reach.alias("reach")).where(F.col("reach") >= threshold - 1e-9).select("a", "b")
    va = vectors.where("train").select(F.col("cid").alias("a"), F.col("terms.term").alias("ta"), F.col("terms.w").alias("wa"))
    vb = _sized(vectors.where("held").select(F.col("cid").alias("b"), F.col("terms.term").alias("tb"), F.col("terms.w").alias("wb")), BROADCAST_VECTORS)
    return _dots(pairs.join(va, "a").join(vb, "b")).where(F.col("cosine") >= threshold - 1e-9)


class Overlaps:
    """The overlaps of one table of cases, as pairs of classes and as the cases in each class.

    ``pairs``: (a, b, cosine) of the classes of equal wordings that ask the same.
    ``members``: (cid, question_id, split_name, source_id, train): the class of each case; a case of two wordings has two rows.
    """

    def __init__(self, pairs: DataFrame, members: DataFrame):
        self.pairs, self.members = pairs, members

    def classes(self) -> DataFrame:
        """(cid, question_id, split_name, source_id, train, n_links): each case with its class and how many cases of the other side it is linked to."""
        size = self.members.groupBy("cid").agg(F.count_if("train").alias("n_train"), F.count_if(~F.col("train")).alias("n_held"))
        to_held = self.pairs.join(size.select(F.col("cid").alias("b"), "n_held"), "b").groupBy(F.col("a").alias("cid")).agg(F.sum("n_held").alias("to_held"))
        to_train = self.pairs.join(size.select(F.col("cid").alias("a"), "n_train"), "a").groupBy(F.col("b").alias("cid")).agg(F.sum("n_train").alias("to_train"))
        links = F.coalesce(F.when(F.col("train"), F.col("to_held")).otherwise(F.col("to_train")), F.lit(0))
        return self.members.join(to_held, "cid", "left").join(to_train, "cid", "left").select("cid", "question_id", "split_name", "source_id", "train", links.alias("n_links"))

    def counts(self) -> DataFrame:
        """(split_name, source_id, n_pairs, n_held): linked pairs and linked cases by split and source of the held-out case; no pair is expanded."""
        held = self.classes().where("not train and n_links > 0").groupBy("split_name", "source_id")
        return held.agg(F.sum("n_links").alias("n_pairs"), F.countDistinct("question_id").alias("n_held"))

    def expanded(self, long: int = LONG) -> DataFrame:
        """(train_id, held_id, split_name, source_id, cosine): each train case with each case of another split that asks the same.

        A class of many train cases is dealt out, so that no task holds all of its pairs.
        """
        parts = self.members.where("train").groupBy(F.col("cid").alias("a")).agg(F.ceil(F.count(F.lit(1)) / long).cast("int").alias("parts"))
        pairs = self.pairs.join(parts, "a").withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
        left = self.members.where("train").select(F.col("cid").alias("a"), F.col("question_id").alias("train_id")).join(parts, "a")
        left = left.withColumn("salt", F.pmod(F.xxhash64("train_id"), "parts").cast("int")).drop("parts")
        right = self.members.where("not train").select(F.col("cid").alias("b"), F.col("question_id").alias("held_id"), "split_name", "source_id")
        return pairs.join(right, "b").join(left, ["a", "salt"]).select("train_id", "held_id", "split_name", "source_id", "cosine")


def overlaps(
    cases: DataFrame,
    threshold: float = THRESHOLD,
    id_col: str = "question_id",
    question_col: str = "question",
    split_col: str = "split_name",
    source_col: str = "source_id",
    train: str = "train",
) -> Overlaps:
    """The classes of train cases and of cases of other splits that ask the same.

    Rows delivered twice count once; a case that stands under one id and split in two wordings is in two classes.  Null and
    blank questions, null ids and null splits match nothing; an empty table gives an empty result.
    """
    read = settled(_read(cases, id_col, question_col, split_col, source_col).withColumn("train", F.col("split_name") == train))
    classes = read.groupBy("wording").agg(F.max("train").alias("train"), F.max(~F.col("train")).alias("held"))
    classes = settled(classes.withColumn("cid", F.monotonically_increasing_id()))
    pairs = cosine_pairs(classes, threshold)
    pairs = pairs.join(classes.select(F.col("cid").alias("a"), F.col("wording").alias("wa")), "a").join(classes.select(F.col("cid").alias("b"), F.col("wording").alias("wb")), "b")

    def run(batches):
        import pyarrow as pa

        for b in batches:
            same = [same_question(x, y) for x, y in zip(b.column("wa").to_pylist(), b.column("wb").to_pylist())]
            yield b.filter(pa.array(same, pa.bool_()))

    pairs = settled(pairs.mapInArrow(run, pairs.schema).select("a", "b", "cosine"))
    members = settled(read.join(classes.select("cid", "wording"), "wording").select("cid", "question_id", "split_name", "source_id", "train"))
    return Overlaps(pairs, members)
