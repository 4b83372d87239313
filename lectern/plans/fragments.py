"""Pieces of DuckDB SQL that the oracles share."""

from __future__ import annotations

from lectern.functions import text as tx
from lectern.functions.lexicon import CAMPUS

SPACE = r"[\x{9}-\x{d} \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
CJK = r"[\x{4e00}-\x{9fff}]"


def literal(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def pattern(p: str) -> str:
    """A pattern for DuckDB, ideographs as code points and Unicode white space spelt out."""
    return literal(p.replace("[一-鿿]", CJK).replace(r"\s", SPACE))


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def squeeze(x: str) -> str:
    return strip(f"regexp_replace({x}, '{SPACE}+', ' ', 'g')")


def matches(x: str, p: str, group: int = 0) -> str:
    return f"regexp_extract_all({x}, {pattern(p)}, {group})"


def any_held(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, {literal(w)})" for w in words) + ")"


def all_held(x: str, words) -> str:
    return "(" + " AND ".join(f"contains({x}, {literal(w)})" for w in words) + ")"


def count_held(x: str, words) -> str:
    return "(" + " + ".join(f"contains({x}, {literal(w)})::INT" for w in words) + ")"


def strings(words) -> str:
    return "[" + ", ".join(map(literal, words)) + "]"


def bigrams(x: str) -> str:
    return f"CASE WHEN length({x}) < 2 THEN [] ELSE list_transform(list_zip(string_split({x}, ''), string_split({x}, '')[2:]), lambda z: z[1] || z[2])[1:length({x}) - 1] END"


def sparse_tokens(x: str) -> str:
    return f"list_transform({matches(x, tx.SPARSE_TOKEN)}, lambda t: lower(t))"


def rerank_tokens(x: str) -> str:
    kept = f"regexp_replace(lower({x}), '[^\\x{{4e00}}-\\x{{9fff}}]', '', 'g')"
    return f"list_concat({matches(f'lower({x})', tx.RERANK_TOKEN)}, {bigrams(kept)})"


def hash_tokens(x: str) -> str:
    return f"list_concat({matches(f'lower({x})', tx.HASH_TOKEN)}, list_filter({bigrams(f'lower({x})')}, lambda t: NOT contains(t, chr(10))))"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda t, i: list_position({x}, t) = i)"


def important_terms(x: str) -> str:
    kept = f"list_filter({matches(x, tx.TERM)}, lambda t: NOT list_contains({strings(CAMPUS.stop_terms)}, t))[1:8]"
    return distinct_in_order(kept)


def qualifiers(x: str) -> str:
    bare = matches(x, tx.QUALIFIER, 1)
    for name in CAMPUS.site_names:
        bare = f"list_transform({bare}, lambda q: regexp_replace(q, '^{name}', ''))"
    return distinct_in_order(f"list_filter({bare}, lambda q: q <> '' AND NOT list_contains({strings(CAMPUS.ignored_qualifiers)}, q))")


def precise(x: str) -> str:
    return "(" + " OR ".join(all_held(x, pair) for pair in CAMPUS.precise_pairs) + ")"


def cut(x: str, n: int) -> str:
    return f"CASE WHEN length({x}) > {n} THEN left({x}, {n}) || '...' ELSE {x} END"


def key_phrase(x: str) -> str:
    parts = f"list_transform(regexp_split_to_array({squeeze(x)}, '[。！？；\\n]'), lambda p: trim(p, ' -|'))"
    fit = f"list_filter({parts}, lambda p: length(p) BETWEEN 8 AND 36 AND NOT starts_with(p, '首页') AND NOT starts_with(p, '当前位置'))"
    return f"left(coalesce({fit}[1], {squeeze(x)}), 28)"


def sentences(x: str) -> str:
    parts = f"list_transform(regexp_extract_all({x}, '[^。！？!?；;]*[。！？!?；;]?'), lambda s: {strip('s')})"
    return f"list_filter({parts}, lambda s: length(s) >= 12)"


def priority_snippet(q: str, x: str) -> str:
    found = []
    for alternatives, patterns in CAMPUS.priority_patterns:
        asked = " OR ".join(all_held(q, words) for words in alternatives)
        for p in patterns:
            found.append(f"CASE WHEN {asked} THEN nullif({strip(f'regexp_extract({x}, {pattern(p)})')}, '') END")
    kept = f"list_filter([{', '.join(found)}], lambda s: s IS NOT NULL)"
    return cut(f"array_to_string({distinct_in_order(kept)}, ' ')", 220)


def best_snippet(q: str, text: str) -> str:
    """As an expression; q and text are names of columns."""
    x = squeeze(f"coalesce({text}, '')")
    bonus = " + ".join(f"(contains({q}, {literal(k)}) AND contains(s, {literal(k)}))::INT" for k in CAMPUS.bonus_keys)
    score = f"-(2 * len(list_filter({important_terms(q)}, lambda t: contains(s, t))) + {bonus} - (i - 1) * 0.02::DOUBLE)"
    scored = f"list_transform({sentences(x)}[1:40], lambda s, i: {{'less': round({score}, 9), 'i': i, 's': s}})"
    best = strip(f"array_to_string(list_transform(list_sort({scored})[1:2], lambda z: z.s), ' ')")
    first = priority_snippet(q, x)
    return f"CASE WHEN {x} = '' THEN '' WHEN {first} <> '' THEN {first} WHEN {best} <> '' THEN {cut(best, 220)} ELSE {cut(x, 220)} END"


#: Questions asked of an index: all cases that have an id and a question, each once.
EVERY = """asked AS (
  SELECT question_id AS query_id, min(question) AS question, bool_and(coalesce(answerable, true)) AS answerable,
    any_value(relevant_doc_ids) AS relevant_doc_ids, any_value(relevant_chunk_ids) AS relevant_chunk_ids
  FROM eval_cases WHERE question_id IS NOT NULL AND question IS NOT NULL GROUP BY question_id)"""

#: The same of the cases whose number is divisible by 100.
ASKED = """asked AS (
  SELECT question_id AS query_id, min(question) AS question, bool_and(coalesce(answerable, true)) AS answerable,
    any_value(relevant_doc_ids) AS relevant_doc_ids, any_value(relevant_chunk_ids) AS relevant_chunk_ids
  FROM eval_cases WHERE TRY_CAST(substr(question_id, 2) AS BIGINT) % 100 = 0 AND question IS NOT NULL GROUP BY question_id)"""

#: Chunks, each once, with the fields of a hit.
CHUNK = """chunk AS (
  SELECT DISTINCT ON (chunk_id) chunk_id, doc_id, coalesce(display_text, text) AS text, coalesce(embedding_text, '') AS embedding_text, display_text,
    metadata.title AS title, metadata.url AS url, metadata.category AS category, metadata.effective_year AS effective_year, page_start
  FROM chunks WHERE chunk_id IS NOT NULL ORDER BY chunk_id)"""


def bm25(name: str, tokens_of_chunk: str, tokens_of_question: str, top: int = 30) -> str:
    """CTEs ending in <name>(query_id, chunk_id, score, rank)."""
    n = name
    return f"""{n}_tok AS (SELECT chunk_id, {tokens_of_chunk} AS tokens FROM chunk),
{n}_total AS (SELECT count(*) AS n, avg(len(tokens)) AS avg_dl FROM {n}_tok),
{n}_post AS (SELECT term, chunk_id, count(*) AS tf, any_value(dl) AS dl FROM (SELECT chunk_id, len(tokens) AS dl, unnest(tokens) AS term FROM {n}_tok) GROUP BY term, chunk_id),
{n}_raw AS (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM {n}_post, {n}_total GROUP BY term),
{n}_idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM {n}_raw) ELSE raw END AS idf FROM {n}_raw),
{n}_q AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({tokens_of_question}) AS term FROM asked) GROUP BY query_id, term),
{n}_score AS (
  SELECT query_id, chunk_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avg_dl))), 6) AS score
  FROM {n}_q JOIN {n}_idf USING (term) JOIN {n}_post USING (term), {n}_total GROUP BY query_id, chunk_id),
{n}_all AS (
  SELECT query_id, chunk_id, score FROM {n}_score
  UNION ALL
  SELECT a.query_id, c.chunk_id, 0.0 FROM asked a, (SELECT chunk_id FROM chunk ORDER BY chunk_id LIMIT {2 * top}) c
  WHERE NOT EXISTS (SELECT 1 FROM {n}_score s WHERE s.query_id = a.query_id AND s.chunk_id = c.chunk_id)),
{n} AS (
  SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {n}_all
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {top})"""


def dense(name: str, tokens_of_chunk: str, tokens_of_question: str, top: int = 30) -> str:
    """CTEs ending in <name>(query_id, chunk_id, score, rank): cosines of signed token counts in 768 buckets by MD5."""
    n = name
    value = "CASE WHEN ('0x' || substring(h, 7, 2))::BIGINT % 2 = 0 THEN 1 ELSE -1 END"
    vector = f"SELECT {{key}}, ('0x' || left(h, 6))::BIGINT % 768 AS bucket, sum({value})::DOUBLE AS v FROM (SELECT {{key}}, md5(unnest({{tokens}})) AS h FROM {{rows}}) GROUP BY ALL"
    return f"""{n}_c AS ({vector.format(key="chunk_id", tokens=tokens_of_chunk, rows="chunk")}),
{n}_q AS ({vector.format(key="query_id", tokens=tokens_of_question, rows="asked")}),
{n}_cn AS (SELECT chunk_id, sqrt(sum(v * v)) AS n FROM {n}_c GROUP BY chunk_id),
{n}_qn AS (SELECT query_id, sqrt(sum(v * v)) AS n FROM {n}_q GROUP BY query_id),
{n}_dot AS (SELECT query_id, chunk_id, sum(q.v * c.v) AS dot FROM {n}_q q JOIN {n}_c c USING (bucket) GROUP BY query_id, chunk_id),
{n}_all AS (SELECT a.query_id, c.chunk_id, round(coalesce(dot / (qn.n * cn.n), 0), 6) + 0.0 AS score FROM asked a CROSS JOIN chunk c
  LEFT JOIN {n}_dot d ON d.query_id = a.query_id AND d.chunk_id = c.chunk_id LEFT JOIN {n}_qn qn ON qn.query_id = a.query_id LEFT JOIN {n}_cn cn ON cn.chunk_id = c.chunk_id),
{n} AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) AS rank FROM {n}_all
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, chunk_id) <= {top})"""


def lexical(name: str, hits: str) -> str:
    """CTEs that rerank <hits>(query_id, chunk_id, score, rank) lexically into <name> (with pre_rank)."""
    bonus = " + ".join(f"CASE WHEN {any_held('question', words)} AND category = {literal(kind)} THEN {worth} ELSE 0 END" for words, kind, worth in CAMPUS.category_bonuses)
    return f"""{name}_in AS (SELECT h.*, a.question, c.* EXCLUDE (chunk_id) FROM {hits} h JOIN asked a USING (query_id) JOIN chunk c USING (chunk_id)),
{name}_qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT query_id, unnest({rerank_tokens('question')}) AS term FROM asked) GROUP BY ALL),
{name}_dt AS (SELECT chunk_id, term, count(*) AS dtf FROM (SELECT chunk_id, unnest({rerank_tokens("coalesce(text, '')")}) AS term FROM (SELECT DISTINCT chunk_id, text FROM {name}_in)) GROUP BY ALL),
{name}_ov AS (SELECT i.query_id, i.chunk_id, sum(CASE WHEN length(q.term) >= 2 THEN 2.0 * least(qtf, dtf) ELSE 0 END) AS overlap
  FROM {name}_in i JOIN {name}_qt q USING (query_id) JOIN {name}_dt d ON d.chunk_id = i.chunk_id AND d.term = q.term GROUP BY ALL),
{name}_ti AS (SELECT i.query_id, i.chunk_id, count(*) AS n FROM {name}_in i JOIN {name}_qt q USING (query_id)
  WHERE length(q.term) > 1 AND contains(lower(coalesce(i.title, '')), q.term) GROUP BY ALL),
{name}_new AS (
  SELECT i.query_id, i.chunk_id, i.rank AS pre_rank, i.score AS pre_score,
    round(coalesce(overlap, 0) / sqrt(greatest(1.0, length(coalesce(text, '')) / 300.0)) + 2.5 * coalesce(n, 0) + {bonus} + 0.05 * i.score, 6) AS score
  FROM {name}_in i LEFT JOIN {name}_ov USING (query_id, chunk_id) LEFT JOIN {name}_ti USING (query_id, chunk_id)),
{name} AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pre_rank) AS rank FROM {name}_new
  QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY score DESC, pre_rank) <= 30)"""


def fold(name: str, hits: str, by: str = "query_id", most: int = 30) -> str:
    """A recursive CTE <name> over ranks of <hits>(by, rank, chunk_id, doc_id, head): what deduplication keeps."""
    return f"""{name}_f AS (
  SELECT {by}, 0::BIGINT AS pos, []::VARCHAR[] AS heads, []::VARCHAR[] AS docs, []::VARCHAR[] AS ids, []::BIGINT[] AS ranks FROM (SELECT DISTINCT {by} FROM {hits})
  UNION ALL
  SELECT {by}, h.rank, CASE WHEN ok THEN list_append(heads, h.head) ELSE heads END, CASE WHEN ok THEN list_append(docs, h.doc_id) ELSE docs END,
    CASE WHEN ok THEN list_append(ids, h.chunk_id) ELSE ids END, CASE WHEN ok THEN list_append(ranks, h.rank) ELSE ranks END
  FROM (SELECT f.*, h.rank, h.head, h.doc_id, h.chunk_id, NOT list_contains(heads, h.head) AND len(list_filter(docs, lambda d: d = h.doc_id)) < 3 AS ok
    FROM {name}_f f JOIN {hits} h USING ({by}) WHERE h.rank = f.pos + 1) h),
{name} AS (
  SELECT {by}, unnest(ids) AS chunk_id, unnest(docs) AS doc_id, unnest(ranks) AS old_rank, generate_subscripts(ids, 1) AS rank
  FROM (SELECT * FROM {name}_f QUALIFY row_number() OVER (PARTITION BY {by} ORDER BY pos DESC) = 1))"""
