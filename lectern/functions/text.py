"""Text functions as column expressions: cleaning, tokens, years, sentences, terms, snippets.

Everything here stays in the JVM.  White space is Unicode white space ((?U) in patterns), lengths are code points.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from lectern.functions.lexicon import CAMPUS, Lexicon

# Patterns that tokens, headings and years are defined by.
SPARSE_TOKEN = r"[A-Za-z]{1,8}\d{1,5}|20[0-3]\d|[A-Za-z]+|\d+(?:\.\d+)?|[一-鿿]"
RERANK_TOKEN = r"[A-Za-z]{1,8}\d{0,5}|20[0-3]\d|\d+(?:\.\d+)?"
HASH_TOKEN = r"[a-z]{1,8}\d{0,5}|20[0-3]\d|\d+(?:\.\d+)?|[一-鿿]"
TERM = r"[A-Za-z]{2,}\d*|20[0-3]\d|[一-鿿]{2,}"
HEADING = r"^\s*(第[一二三四五六七八九十0-9]+[章节条]|[一二三四五六七八九十0-9]+[、.])"
PAGE_MARK = r"^\[PDF_PAGE\s+(\d+)\]"
YEAR = r"20[0-3]\d"
QUALIFIER = r"([一-鿿]{2,12})校区"
YEAR_REACH = 2000


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def squeeze(c: Column) -> Column:
    """Runs of white space to one space, none at the ends."""
    return strip(F.regexp_replace(c, r"(?U)\s+", " "))


def clean(c: Column) -> Column:
    """Line ends to \\n, runs of spaces, tabs and no-break spaces to one space, at most one blank line, stripped."""
    lines = F.regexp_replace(c, r"\r\n?", "\n")
    return strip(F.regexp_replace(F.regexp_replace(lines, r"[ \t\x{a0}]+", " "), r"\n{3,}", "\n\n"))


def holds_any(c: Column, words) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def holds_all(c: Column, words) -> Column:
    out = F.lit(True)
    for w in words:
        out = out & F.contains(c, F.lit(w))
    return out


def count_held(c: Column, words) -> Column:
    return sum((F.contains(c, F.lit(w)).cast("int") for w in words), F.lit(0))


def all_matches(c: Column, pattern: str, group: int = 0) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(group))


def bigrams(c: Column) -> Column:
    """All pairs of neighbouring characters."""
    chars = F.split(c, "")
    pairs = F.zip_with(F.slice(chars, 1, F.size(chars) - 1), F.slice(chars, 2, F.size(chars)), lambda a, b: F.concat(a, b))
    return F.when(F.length(c) >= 2, pairs).otherwise(F.array().cast("array<string>"))


def sparse_tokens(c: Column) -> Column:
    return F.transform(all_matches(c, SPARSE_TOKEN), F.lower)


def rerank_tokens(c: Column) -> Column:
    low = F.lower(c)
    return F.concat(all_matches(low, RERANK_TOKEN), bigrams(F.regexp_replace(low, "[^一-鿿]", "")))


def hash_tokens(c: Column) -> Column:
    low = F.lower(c)
    return F.concat(all_matches(low, HASH_TOKEN), F.filter(bigrams(low), lambda t: ~F.contains(t, F.lit("\n"))))


def token_estimate(c: Column) -> Column:
    return F.greatest(F.lit(1), F.floor(F.length(c) / 2)).cast("int")


def latest_year(title: Column, text: Column) -> Column:
    """The greatest year named in the title or the text's first YEAR_REACH characters; null without one."""
    where = F.concat(F.coalesce(title, F.lit("")), F.lit("\n"), F.substring(F.coalesce(text, F.lit("")), 1, YEAR_REACH))
    return F.array_max(F.transform(all_matches(where, YEAR), lambda y: y.cast("int")))


def safe_filename(c: Column, suffix: str = "") -> Column:
    base = F.regexp_replace(F.regexp_replace(c, r"[^A-Za-z0-9._-]+", "_"), "^_+|_+$", "")
    return F.concat(F.coalesce(F.nullif(F.substring(base, 1, 120), F.lit("")), F.lit("item")), F.lit(suffix))


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences of squeezed text, at least ``least`` characters each, in order."""
    parts = F.transform(F.split(c, r"(?<=[。！？!?；;])\s*"), strip)
    return F.filter(parts, lambda s: F.length(s) >= least)


def important_terms(question: Column, lexicon: Lexicon = CAMPUS, most: int = 8) -> Column:
    """The question's first terms that aren't stop words, distinct, in order."""
    stop = F.array(*map(F.lit, lexicon.stop_terms))
    return F.array_distinct(F.slice(F.filter(all_matches(question, TERM), lambda t: ~F.array_contains(stop, t)), 1, most))


def _without(pattern: str):
    return lambda c: F.regexp_replace(c, pattern, "")


def qualifiers(question: Column, lexicon: Lexicon = CAMPUS) -> Column:
    """What stands before the word for campus, without the site's name, distinct, in order."""
    ignored = F.array(*map(F.lit, lexicon.ignored_qualifiers))
    bare = all_matches(question, QUALIFIER, 1)
    for name in lexicon.site_names:
        bare = F.transform(bare, _without("^" + name))
    return F.array_distinct(F.filter(bare, lambda q: (q != "") & ~F.array_contains(ignored, q)))


def precise(question: Column, lexicon: Lexicon = CAMPUS) -> Column:
    out = F.lit(False)
    for pair in lexicon.precise_pairs:
        out = out | holds_all(question, pair)
    return out


def cut(c: Column, limit: int) -> Column:
    return F.when(F.length(c) > limit, F.concat(F.substring(c, 1, limit), F.lit("..."))).otherwise(c)


def priority_snippet(question: Column, squeezed: Column, lexicon: Lexicon = CAMPUS, limit: int = 220) -> Column:
    """Sentences the question's words give priority to, joined and cut; '' without one."""
    found = []
    for alternatives, patterns in lexicon.priority_patterns:
        asked = reduce(or_, [holds_all(question, words) for words in alternatives])
        for p in patterns:
            found.append(F.when(asked, F.nullif(strip(F.regexp_extract(squeezed, "(?U)" + p, 0)), F.lit(""))))
    return cut(F.array_join(F.array_distinct(F.array_compact(F.array(*found))), " "), limit)


def best_snippet(question: Column, text: Column, lexicon: Lexicon = CAMPUS, limit: int = 220) -> Column:
    """The priority snippet, else the two best of the first 40 sentences, else the text's start; cut to ``limit``.

    A sentence scores 2 for each term it holds, 1 for each bonus key it shares with the question, less 0.02 for its place.
    """
    squeezed = squeeze(F.coalesce(text, F.lit("")))
    priority = priority_snippet(question, squeezed, lexicon, limit)
    terms = important_terms(question, lexicon)

    def score(s: Column, i: Column) -> Column:
        held = F.size(F.filter(terms, lambda t: F.contains(s, t))) * 2
        keys = sum(((F.contains(question, F.lit(k)) & F.contains(s, F.lit(k))).cast("int") for k in lexicon.bonus_keys), F.lit(0))
        return F.struct((-(held + keys - i * F.lit(0.02))).alias("less"), i.alias("i"), s.alias("s"))

    ranked = F.slice(F.array_sort(F.transform(F.slice(sentences(squeezed), 1, 40), score)), 1, 2)
    best = strip(F.array_join(F.transform(ranked, lambda x: x["s"]), " "))
    return F.when(squeezed == "", F.lit("")).when(priority != "", priority).when(best != "", cut(best, limit)).otherwise(cut(squeezed, limit))


def key_phrase(text: Column, lexicon: Lexicon = CAMPUS) -> Column:
    """The first clause of 8 to 36 characters that no menu starts, else the start; at most 28 characters."""
    squeezed = squeeze(text)
    parts = F.transform(F.split(squeezed, "[。！？；\n]"), lambda p: F.btrim(p, F.lit(" -|")))
    fit = F.filter(parts, lambda p: F.length(p).between(8, 36) & ~p.startswith("首页") & ~p.startswith("当前位置"))
    return F.substring(F.coalesce(F.get(fit, F.lit(0)), squeezed), 1, 28)
