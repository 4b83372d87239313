"""Problem 8: the reading level of each document's main body, on the scale of human ratings (1 to 5).

Several classic readability formulas estimate the grade, and the median of the estimates is the level:

* a Flesch-type formula from the length of clauses and syllables per word,
* a Dale-Chall-type formula from the share of unfamiliar terms and the length of sentences,
* a graded-vocabulary formula from the mean grade of the terms.

Syllables of words in alphabets are counted with hyphenation-style rules (vowel groups, silent endings, hiatus).  In
Chinese each ideograph is a syllable, and the runs between function words stand for words, neighbouring ideographs for
terms.  Sentence length is only one input, and clauses rather than full stops bound it, since simple matter stays simple
when its sentences are strung together.

What is familiar, the grades of terms and the weights of each formula are fitted on the ratings, on at most
``most_rated`` rated documents (chosen by a hash of the id where there are more).  The fitted model is two tables of
2**20 hashed terms and six small vectors, whatever the data's size; it is broadcast, and one pass over the documents
applies it.  Pages that are residue (problem 4) and null, empty or blank texts have no level.
"""

from __future__ import annotations

import re
import zlib
from dataclasses import dataclass
from functools import lru_cache
from statistics import median

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lectern.llm import page, residue
from lectern.session import settled

MOST_RATED = 20_000
#: A document is demanding from this level on.
DEMANDING = 4
BITS = 20
#: Rated documents that a term must occur in, and the weight of the mean grade in a term's grade.
LEAST_DOCS, PRIOR = 3, 3.0
#: A term is familiar if it stands in this share of the rated documents up to grade EASY (and in LEAST_DOCS of them).
EASY, FAMILIAR = 2.5, 0.01
#: Function words and particles that part runs of ideographs.
FUNCTION_WORDS = "的了在和与之以是将就不也很都还把被让给对从向到由为有可能会要请我你他她它们这那其此及或若则而所于上下里去来后前时完成"
_WORD = re.compile(r"[a-zà-ÿ]+(?:'[a-z]+)?")
_CLAUSE = re.compile(r"[,，。;；!！?？:：、.\n]+")
_SENTENCE = re.compile(r"[。;；!！?？.\n]+")
_VOWELS = re.compile(r"[aeiouyà-ÿ]+")
_HIATUS = re.compile(r"i[ao]|[aeou]ing\b|eo|ua(?!r)|uou")
_SILENT = re.compile(r"(?:[^aeiouyl]|[^aeiouy]e)e$|[^aeiouytd]ed$|[^aeiouysxz]es$")


@lru_cache(200_000)
def syllables(word: str) -> int:
    """Syllables of a lower-case word: vowel groups, more where two vowels part, less where an ending is silent."""
    n = len(_VOWELS.findall(word)) + len(_HIATUS.findall(word)) - len(_SILENT.findall(word))
    return max(1, n)


@lru_cache(200_000)
def _term(word: str) -> int:
    return zlib.crc32(word.encode()) >> (32 - BITS)


HAN, LETTER, FUNCTION, CLAUSE_END, SENTENCE_END = 1, 2, 4, 8, 16


def _classes() -> np.ndarray:
    """What each code point of the basic plane is, as bits."""
    table = np.zeros(0x10000, dtype=np.uint8)
    table[0x3400:0xA000] = HAN
    table[[ord(c) for c in FUNCTION_WORDS]] |= FUNCTION
    table[[*range(0x61, 0x7B), *range(0xE0, 0xF7), *range(0xF8, 0x100)]] = LETTER
    table[[ord(c) for c in ",，:：、"]] = CLAUSE_END
    table[[ord(c) for c in "。;；!！?？.\n"]] = CLAUSE_END | SENTENCE_END
    return table


_CLASSES = _classes()


def _starts(mask: np.ndarray) -> int:
    """How many runs of true values there are."""
    return int(mask[0]) + int(np.count_nonzero(mask[1:] > mask[:-1]))


@dataclass
class Measures:
    wide: bool  # mostly ideographs
    clause: float  # words (ideographs) in a clause
    sentence: float  # log of words in a sentence
    syllables: float  # in a word
    terms: np.ndarray  # hashed terms


def measures(text: str) -> Measures | None:
    """What the formulas need of a body; None where there are no words."""
    low = text.lower()
    data = low.encode("utf-16-le", "surrogatepass")
    if len(data) == 2 * len(low):  # all of the basic plane
        codes = np.frombuffer(data, dtype="<u2")
        kinds = _CLASSES.take(codes)
    else:
        codes = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype="<u4")
        kinds = np.where(codes < 0x10000, _CLASSES[codes & 0xFFFF], 0)
    han = (kinds & HAN) > 0
    n_han = np.count_nonzero(han)
    if n_han > 0.5 * np.count_nonzero(kinds == LETTER):
        solid = codes > 32
        said = solid & ((kinds & CLAUSE_END) == 0)
        clause = int(np.count_nonzero(said)) / max(1, _starts(said))
        sentences = _starts(solid & ((kinds & SENTENCE_END) == 0)) or 1
        unit = han & ((kinds & FUNCTION) == 0)
        units = _starts(unit) or 1
        both = np.flatnonzero(han[:-1] & han[1:])
        # modulo 2**32
        mixed = codes[both].astype(np.uint32) * np.uint32(0x9E3779B1) + codes[both + 1].astype(np.uint32) * np.uint32(0x85EBCA77)
        terms = (mixed >> np.uint32(32 - BITS)).astype(np.int32)
        return Measures(True, clause, float(np.log(max(1.0, units / sentences))), int(np.count_nonzero(unit)) / units, terms)
    words = _WORD.findall(low)
    if not words:
        return None
    sentences = sum(1 for s in _SENTENCE.split(low) if len(s.strip()) > 3) or 1
    clauses = [c.count(" ") + 1 for c in _CLAUSE.split(low) if c.strip()]
    terms = np.array([_term(w) for w in words if len(w) > 3], dtype=np.int32)
    return Measures(
        False, sum(clauses) / max(1, len(clauses)), float(np.log(max(1.0, len(words) / sentences))), sum(map(syllables, words)) / len(words), terms
    )


def body_text(text: str | None, title: str | None) -> str | None:
    """The main body's running text; None of residue and of null, empty and blank texts."""
    if not text or not text.strip():
        return None
    blocks = page.parse(text, title)
    if residue.verdict(blocks)[0] >= residue.SHARE:
        return None
    kinds = (page.TEXT, page.ITEM, page.ROW)
    lines = [b.line for b in blocks if b.kind in kinds] or [b.line for b in blocks if b.kind in (page.HEADING, page.TITLE)]
    return "\n".join(lines) or None


@dataclass
class Model:
    grades: np.ndarray  # float32, of each hashed term; nan where unknown
    easy: np.ndarray  # bool, whether a hashed term is familiar
    fits: dict  # (wide, formula) -> weights of the formula, and the two rows of the curve that maps it to the scale

    def inputs(self, m: Measures) -> dict[str, list[float]]:
        grades = self.grades[m.terms]
        known = grades[~np.isnan(grades)]
        mean = float(known.mean()) if len(known) else float("nan")
        strange = float(1 - self.easy[m.terms].mean()) if len(m.terms) else float("nan")
        return {"flesch": [m.clause, m.syllables], "dale_chall": [strange, m.sentence], "graded": [mean]}

    def levels(self, m: Measures) -> dict[str, float]:
        out = {}
        for name, x in self.inputs(m).items():
            fit = self.fits.get((m.wide, name))
            if fit is not None and not np.isnan(x).any():
                linear, (at, level) = fit
                out[name] = float(np.interp(np.dot(linear, [1.0, *x]), at, level))
        return out


def rated_documents(docs: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> DataFrame:
    """(doc_id, grade, _text, _title): rated documents with their mean rating; a rater counts once a document."""
    grade = (
        ratings.where("doc_id is not null and reading_level between 1 and 5")
        .groupBy("doc_id", "rater")
        .agg(F.avg("reading_level").alias("level"))
        .groupBy("doc_id")
        .agg(F.avg("level").alias("grade"))
    )
    grade = grade.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rated)
    title = F.col("title") if "title" in docs.columns else F.lit(None)
    texts = docs.select("doc_id", F.col("text").cast("string").alias("_text"), title.cast("string").alias("_title"))
    return texts.join(F.broadcast(grade), "doc_id").dropDuplicates(["doc_id"])  # at most most_rated rows are broadcast


def fit(docs: DataFrame, ratings: DataFrame, most_rated: int = MOST_RATED) -> Model:
    """The model; without ratings one that gives no level."""
    schema = T.StructType(
        [
            T.StructField("grade", T.DoubleType()),
            T.StructField("wide", T.BooleanType()),
            T.StructField("clause", T.DoubleType()),
            T.StructField("sentence", T.DoubleType()),
            T.StructField("syllables", T.DoubleType()),
            T.StructField("terms", T.ArrayType(T.IntegerType())),
        ]
    )

    def run(batches):
        for b in batches:
            rows = []
            for grade, text, title in zip(*(b.column(c).to_pylist() for c in ("grade", "_text", "_title"))):
                body = body_text(text, title)
                m = measures(body) if body else None
                if m:
                    rows.append((grade, m.wide, m.clause, m.sentence, m.syllables, m.terms))
            columns = list(zip(*rows)) if rows else [()] * 6
            types = [pa.float64(), pa.bool_(), pa.float64(), pa.float64(), pa.float64(), pa.list_(pa.int32())]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=schema.names)

    rated = settled(rated_documents(docs, ratings, most_rated).mapInArrow(run, schema))
    by_term = (
        rated.select("grade", F.explode(F.array_distinct("terms")).alias("term"))
        .groupBy("term")
        .agg(F.sum("grade").alias("sum"), F.count(F.lit(1)).alias("n"), F.sum((F.col("grade") <= EASY).cast("int")).alias("easy"))
        .where(F.col("n") >= LEAST_DOCS)
        .toPandas()  # at most 2**BITS rows
    )
    grades, easy = np.full(1 << BITS, np.nan, dtype=np.float32), np.zeros(1 << BITS, dtype=bool)
    model = Model(grades, easy, {})
    mean = rated.agg(F.avg("grade").alias("m")).first()["m"]
    if mean is None:
        return model
    term = by_term["term"].to_numpy(dtype=np.int64)
    total, n = np.zeros(1 << BITS), np.zeros(1 << BITS)
    total[term], n[term] = by_term["sum"].to_numpy(), by_term["n"].to_numpy()
    n_easy = rated.where(F.col("grade") <= EASY).count()
    easy[term] = by_term["easy"].to_numpy() >= max(LEAST_DOCS, FAMILIAR * n_easy)
    grades[term] = (total[term] + PRIOR * mean) / (n[term] + PRIOR)
    shared = docs.sparkSession.sparkContext.broadcast((model, total, n, mean))
    names = ("flesch", "dale_chall", "graded")
    inputs = T.StructType([T.StructField("grade", T.DoubleType()), T.StructField("wide", T.BooleanType()), *(T.StructField(f, T.ArrayType(T.DoubleType())) for f in names)])

    def measured(batches):
        model, total, n, mean = shared.value
        for b in batches:
            rows, terms = [], b.column("terms")
            for i, r in enumerate(b.select(["grade", "wide", "clause", "sentence", "syllables"]).to_pylist()):
                m = Measures(r["wide"], r["clause"], r["sentence"], r["syllables"], terms[i].values.to_numpy(zero_copy_only=False))
                x = model.inputs(m)
                t = m.terms[n[m.terms] > 0]
                # a document's own rating must not speak through its terms
                own = (total[t] - r["grade"] + PRIOR * mean) / (n[t] - 1 + PRIOR)
                x["graded"] = [float(own.mean()) if len(t) else float("nan")]
                rows.append((r["grade"], r["wide"], *(x[f] for f in names)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.float64(), pa.bool_(), *[pa.list_(pa.float64())] * 3]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=inputs.names)

    points: dict = {}
    for r in rated.mapInArrow(measured, inputs).collect():  # at most most_rated rows of a few numbers
        for name in names:
            if not np.isnan(r[name]).any():
                points.setdefault((r["wide"], name), []).append((r[name], r["grade"]))
    for key, values in points.items():
        if len(values) < 10:
            continue
        a = np.array([[1.0, *x] for x, _ in values])
        y = np.array([g for _, g in values])
        linear = np.linalg.lstsq(a, y, rcond=None)[0]
        model.fits[key] = (linear, _curve(a @ linear, y))
    return model


def _curve(p: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, levels) of the curve from a formula to the scale: a cubic through the ratings (a line if they are few or alike), made never to fall."""
    middle, width = p.mean(), np.ptp(p) / 2 or 1.0
    x = (p - middle) / width
    degree = min(3 if len(p) >= 40 and np.ptp(p) > 0.5 else 1, len(np.unique(np.round(x, 3))) - 1)
    at = np.linspace(x.min(), x.max(), 65)
    level = np.maximum.accumulate(np.polyval(np.polyfit(x, y, degree), at))
    return at * width + middle, np.clip(level, 1.0, 5.0)


def levels(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", title_col: str | None = "title") -> DataFrame:
    """(id, grade, level, flesch, dale_chall, graded): grade is the median estimate, level the grade rounded.

    Documents without a level (see above), and all documents under a model without ratings, have nulls.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    title = F.col(title_col) if title_col and title_col in docs.columns else F.lit(None)
    narrow = docs.select(F.col(id_col).alias(id_col), F.col(text_col).cast("string").alias("_text"), title.cast("string").alias("_title"))
    numbers = ["flesch", "dale_chall", "graded"]
    schema = T.StructType(
        [narrow.schema.fields[0], T.StructField("grade", T.DoubleType()), T.StructField("level", T.IntegerType()), *(T.StructField(n, T.DoubleType()) for n in numbers)]
    )

    def run(batches):
        model = shared.value
        for b in batches:
            rows = []
            for text, title in zip(b.column(1).to_pylist(), b.column(2).to_pylist()):
                body = body_text(text, title)
                m = measures(body) if body else None
                got = model.levels(m) if m else {}
                grade = median(got.values()) if got else None
                rows.append((grade, None if grade is None else int(grade + 0.5), *(got.get(n) for n in numbers)))
            columns = list(zip(*rows)) if rows else [()] * 5
            types = [pa.float64(), pa.int32(), *[pa.float64()] * 3]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, t) for c, t in zip(columns, types))], names=schema.names)

    return narrow.mapInArrow(run, schema)
