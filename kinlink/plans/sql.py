"""The derived records that stand in for business records, and the SQL of every query, for an engine with list lambdas.

Records are made from documents by fixed rules with known matches; the same rules are here in both dialects. The SQL
is one chain of common table expressions, of which each query takes what it needs.
"""

from __future__ import annotations

from kinlink.functions.lexicon import ABBR, ADDR_STOP, DIGITS_AS_LETTERS, LEGAL, SOUNDS

RECORDS_SPARK = r"""
WITH base AS (SELECT doc_id, lang, split(trim(regexp_replace(coalesce(text, ''),'[ \\t\\n\\r]+',' ')),' ') AS w FROM {documents})
SELECT 'S1-'||doc_id AS entity_id, array_join(slice(w,1,3),' ')||' Ltd' AS business_name, (doc_id%97+1)||' '||array_join(slice(w,4,5),' ')||' Rd' AS business_address, ' '||upper(lang) AS country FROM base
UNION ALL
SELECT 'S2-'||doc_id, CASE doc_id%5 WHEN 0 THEN array_join(slice(w,1,3),' ')||' Limited' WHEN 1 THEN array_join(reverse(slice(w,1,3)),' ') WHEN 2 THEN ''
  WHEN 3 THEN translate(array_join(slice(w,1,3),' '),'oe','03') ELSE replace(array_join(slice(w,1,3),' '),' ','') END, '0'||(doc_id%97+1)||' '||array_join(slice(w,4,4),' ')||' Road', lang FROM base WHERE doc_id%3<>0
UNION ALL
SELECT 'S3-'||doc_id, array_join(slice(w,1,3),' ')||' & Co', array_join(slice(w,4,5),' ')||', '||(doc_id%97+1), lang FROM base WHERE doc_id%4=0
UNION ALL
SELECT 'S3-'||(1000000+doc_id), array_join(slice(w,9,3),' '), (doc_id%89+1)||' '||array_join(slice(w,12,5),' '), lang FROM base WHERE doc_id%10=9
"""


def _list(values) -> str:
    return "[" + ", ".join(f"'{v}'" for v in values) + "]"


def _phon(tokens: str) -> str:
    """Sound codes of a list of tokens; runs of a character are closed up by a fold, there being no back reference."""
    sounds = "x"
    for a, b in SOUNDS:
        sounds = f"replace({sounds}, '{a}', '{b}')"
    letters = f"CASE WHEN regexp_matches(x, '[a-z]') THEN translate(x, '{DIGITS_AS_LETTERS[0]}', '{DIGITS_AS_LETTERS[1]}') ELSE x END"
    closed = "list_reduce(string_split(x, ''), lambda acc, c: CASE WHEN right(acc, 1) = c THEN acc ELSE acc || c END)"
    bare = "left(x, 1) || regexp_replace(substr(x, 2), '[aeiou]', '', 'g')"
    out = tokens
    for step in (sounds, letters, closed, bare):
        out = f"list_transform({out}, lambda x: {step})"
    return out


def _distinct(values: str) -> str:
    """Distinct in order of first sight."""
    return f"list_reduce({values}, lambda acc, v: CASE WHEN list_contains(acc, v[1]) THEN acc ELSE list_concat(acc, v) END, []::VARCHAR[])"


def _unique(values: str) -> str:
    return _distinct(f"list_transform({values}, lambda z: [z])")


def _two(values: str, tag: str) -> str:
    made = f"list_transform(range(1, len({values}) + 1), lambda i: list_transform(range(i + 1, len({values}) + 1), lambda j: '{tag}|' || least({values}[i], {values}[j]) || '|' || greatest({values}[i], {values}[j])))"
    return f"flatten({made})"


NUMBER = "CASE WHEN ltrim({x}, '0') = '' THEN '0' ELSE ltrim({x}, '0') END"
ABBREVIATIONS = "MAP {" + ", ".join(f"'{a}': '{b}'" for a, b in ABBR.items()) + "}"


def _normal(c: str) -> str:
    plain = f"regexp_replace(strip_accents(coalesce({c}, '')), '[^\\x00-\\x7F]', '', 'g')"
    low = f"replace(lower(CASE WHEN {plain} = '' THEN coalesce({c}, '') ELSE {plain} END), '&', ' and ')"
    words = f"list_filter(string_split(regexp_replace({low}, '[^\\p{{L}}\\p{{N}}_ ]', ' ', 'g'), ' '), lambda w: w <> '')"
    return f"array_to_string(list_transform({words}, lambda w: coalesce(({ABBREVIATIONS})[w], w)), ' ')"


def _words(c: str) -> str:
    return f"list_filter(string_split({c}, ' '), lambda w: w <> '')"


KEYS = {
    "t": "list_transform(list_filter(t, lambda w: length(w) >= 3), lambda w: 't|' || w)",
    "f": "list_transform(list_filter(range(1, len(t) + 1), lambda i: length(t[i]) >= 3 AND length(p[i]) >= 2), lambda i: 'f|' || p[i])",
    "pp": _two("p4", "pp"),
    "p": "CASE WHEN len(t) >= 2 THEN ['p|' || left(t[1], 4) || '|' || left(t[2], 4)] WHEN len(t) = 1 THEN ['p|' || t[1]] ELSE [] END",
    "s": "CASE WHEN len(t) >= 2 THEN ['s|' || left(list_sort(t)[1], 4) || '|' || left(list_sort(t)[2], 4)] ELSE [] END",
    "cat": f"CASE WHEN length(array_to_string(t, '')) >= 5 THEN ['cat|' || ({_phon("[left(array_to_string(t, ''), 12)]")})[1]] ELSE [] END",
    "d": "list_transform(list_filter(num, lambda x: length(x) >= 3), lambda x: 'd|' || x || '|' || coalesce(left(t[1], 3), ''))",
    "nn": _two("num5", "nn"),
    "nw": f"list_transform(range(1, len(nw_n) + 1), lambda i: 'nw|' || nw_n[i] || '|' || nw_p[i])",
    "at": "list_transform(at_p, lambda x: 'at|' || x)",
    "ap": "list_transform(range(1, least(len(al_p), 7)), lambda i: 'ap|' || al_p[i] || '|' || al_p[i + 1])",
}
STOP = _list(ADDR_STOP)

CHAIN = f"""
WITH base AS (SELECT doc_id, lang, string_split(trim(regexp_replace(coalesce(text, ''),'[ \\t\\n\\r]+',' ','g')),' ') AS w FROM documents),
records AS (
SELECT 'S1-'||doc_id AS entity_id, array_to_string(w[1:3],' ')||' Ltd' AS business_name, (doc_id%97+1)||' '||array_to_string(w[4:8],' ')||' Rd' AS business_address, ' '||upper(lang) AS country FROM base
UNION ALL
SELECT 'S2-'||doc_id, CASE doc_id%5 WHEN 0 THEN array_to_string(w[1:3],' ')||' Limited' WHEN 1 THEN array_to_string(list_reverse(w[1:3]),' ') WHEN 2 THEN ''
  WHEN 3 THEN translate(array_to_string(w[1:3],' '),'oe','03') ELSE replace(array_to_string(w[1:3],' '),' ','') END, '0'||(doc_id%97+1)||' '||array_to_string(w[4:7],' ')||' Road', lang FROM base WHERE doc_id%3<>0
UNION ALL
SELECT 'S3-'||doc_id, array_to_string(w[1:3],' ')||' & Co', array_to_string(w[4:8],' ')||', '||(doc_id%97+1), lang FROM base WHERE doc_id%4=0
UNION ALL
SELECT 'S3-'||(1000000+doc_id), array_to_string(w[9:11],' '), (doc_id%89+1)||' '||array_to_string(w[12:16],' '), lang FROM base WHERE doc_id%10=9),
gold AS (SELECT 'S1-'||doc_id AS s1_id, 'S2-'||doc_id AS cand_id FROM documents WHERE doc_id%3<>0 UNION ALL SELECT 'S1-'||doc_id, 'S3-'||doc_id FROM documents WHERE doc_id%4=0),
named AS (SELECT entity_id, {_normal('business_name')} AS name_n, {_normal('business_address')} AS addr_n, lower(trim(coalesce(country, ''))) AS country_n FROM records),
cored AS (SELECT *, array_to_string(list_filter({_words('name_n')}, lambda w: NOT list_contains({_list(LEGAL)}, w)), ' ') AS c FROM named),
prepared AS MATERIALIZED (SELECT entity_id, name_n, CASE WHEN c = '' THEN name_n ELSE c END AS core, addr_n, country_n, coalesce(array_to_string({_phon(_words("CASE WHEN c = '' THEN name_n ELSE c END"))}, ' '), '') AS phon FROM cored),
split AS (SELECT entity_id, country_n, {_words('core')} AS t, {_words('phon')} AS p, {_words('addr_n')} AS a FROM prepared),
listed AS (SELECT *, p[1:4] AS p4, {_unique("list_transform(list_filter(a, lambda w: regexp_matches(w, '[0-9]')), lambda x: " + NUMBER.format(x='x') + ")")} AS num,
  list_filter(a, lambda w: length(w) >= 3 AND regexp_matches(w, '^\\p{{L}}+$')) AS al,
  list_filter(range(1, len(a)), lambda i: regexp_matches(a[i], '[0-9]') AND length(a[i+1]) >= 3 AND regexp_matches(a[i+1], '^\\p{{L}}+$') AND NOT list_contains({STOP}, a[i+1])) AS beside FROM split),
ready AS (SELECT *, num[1:5] AS num5, {_phon('al')} AS al_p, {_phon(f"list_filter(al, lambda w: length(w) >= 5 AND NOT list_contains({STOP}, w))")} AS at_p,
  list_transform(list_transform(beside, lambda i: a[i]), lambda x: {NUMBER.format(x='x')}) AS nw_n, {_phon('list_transform(beside, lambda i: a[i+1])')} AS nw_p FROM listed),
keys AS MATERIALIZED (SELECT DISTINCT entity_id, country_n || '|' || unnest(list_concat({', '.join(KEYS.values())})) AS key FROM ready),
mine AS (SELECT entity_id AS s1_id, key FROM keys WHERE left(entity_id, 2) = 'S1'),
theirs AS (SELECT entity_id AS cand_id, key FROM keys WHERE left(entity_id, 2) <> 'S1'),
sizes AS (SELECT key, count(*) AS block_size FROM theirs GROUP BY key),
idx AS (SELECT cand_id, key, block_size, ln(1 + 200.0::DOUBLE / block_size)::FLOAT AS w FROM theirs JOIN sizes USING (key) WHERE block_size <= 200),
met AS MATERIALIZED (SELECT s1_id, cand_id, count(*) AS shared_keys, sum(w::DOUBLE)::FLOAT AS key_idf FROM mine JOIN idx USING (key) GROUP BY ALL),
pre AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY s1_id ORDER BY key_idf DESC, left(cand_id, 2), split_part(cand_id, '-', 2)::BIGINT) AS cand_pos FROM met QUALIFY cand_pos <= 150),
scored AS MATERIALIZED (SELECT s1_id, cand_id, cand_pos, (key_idf / (key_idf + 10.0::DOUBLE))::DOUBLE AS p FROM (SELECT s1_id, cand_id, cand_pos, key_idf::DOUBLE AS key_idf FROM pre WHERE cand_pos <= 50)),
entities AS (SELECT 'S1-'||doc_id AS s1_id FROM documents),
owned AS MATERIALIZED (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY cand_id ORDER BY p DESC, split_part(s1_id, '-', 2)::BIGINT) = 1),
decoded AS MATERIALIZED (SELECT * FROM owned QUALIFY (row_number() OVER (PARTITION BY s1_id ORDER BY p DESC, cand_pos) = 1 AND p >= 0.5) OR p >= 0.7)
"""


def query(select: str) -> str:
    return CHAIN + select
