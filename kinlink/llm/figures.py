"""The columns of op4, op5 and op8 that owe nothing to a learned model, as queries of their own with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinlink.llm import license, pii, quality
from kinlink.llm.common import table


def pii_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op4's fixed kinds of every document."""
    return pii.op4_pii(spark, sf_dir).select("doc_id", *(f"n_{k}" for k in pii.KINDS), "base_sha256")


def quality_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5's counts of every document."""
    counted = quality.count_statistics(table(spark, sf_dir, "documents")).withColumn("base_failed", quality.base_failed())
    return counted.select(F.col("key").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")


def license_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op8's base phrases of every document."""
    return license.op8_license(spark, sf_dir).select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels")


_WORD = r"[^\x20\x09-\x0D]+"
# The four kinds as the contract writes them.
_KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)",
    "card": r"[0-9](?:[\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_PASSES = {
    "email": "true",
    "ip": "len(list_filter(string_split(m, '.'), lambda p: length(ltrim(p, '0')) > 3 OR coalesce(try_cast(right(ltrim(p, '0'), 3) AS INT), 0) > 255)) = 0",
    "card": """length(d) BETWEEN 16 AND 19 AND list_sum(list_transform(range(0, length(d)), lambda i: CASE WHEN i % 2 = 0 THEN substr(d, length(d) - i, 1)::INT
  WHEN substr(d, length(d) - i, 1)::INT > 4 THEN 2 * substr(d, length(d) - i, 1)::INT - 9 ELSE 2 * substr(d, length(d) - i, 1)::INT END)) % 10 = 0""",
    "phone": "length(d) BETWEEN 8 AND 15",
}


def _kind(place: int, kind: str) -> str:
    """Matches of a kind with their places: from the lengths of the matches and of the pieces between them."""
    return f"""SELECT doc_id, {place} AS k, '{kind}' AS kind, m, starts, regexp_replace(m, '[^0-9]', '', 'g') AS d FROM (
  SELECT doc_id, unnest(ms) AS m, unnest(list_transform(range(1, len(ms) + 1), lambda i: list_sum(list_transform(ps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))) AS starts
  FROM (SELECT doc_id, regexp_extract_all(t, '{_KINDS[kind]}') AS ms, string_split_regex(t, '{_KINDS[kind]}') AS ps FROM texts)) WHERE {_PASSES[kind]}"""


PII_SQL = f"""
WITH texts AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
spans AS ({' UNION ALL '.join(_kind(i, k) for i, k in enumerate(_KINDS))}),
summed AS (SELECT doc_id, {', '.join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in _KINDS)}, string_agg(kind || ':' || starts || ':' || (starts + length(m)), ',' ORDER BY k, starts) AS s FROM spans GROUP BY 1)
SELECT doc_id, {', '.join(f'coalesce(n_{k}, 0) AS n_{k}' for k in _KINDS)}, sha256(coalesce(s, '')) AS base_sha256 FROM texts LEFT JOIN summed USING (doc_id)
"""

QUALITY_SQL = rf"""
WITH split AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
windows AS (SELECT doc_id, i, array_to_string(w[i:i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 3)) AS i FROM split)),
again AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM (SELECT doc_id, unnest(places) AS i FROM (SELECT doc_id, s, list(i) AS places FROM windows GROUP BY ALL HAVING count(*) > 1)), (SELECT unnest(range(5)) AS k) GROUP BY 1),
counted AS (SELECT doc_id, len(w) AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS n_symbols,
  list_filter(string_split(t, chr(10)), lambda l: regexp_matches(l, '{_WORD}')) AS lines, coalesce(n, 0) AS n_repeat_words FROM split LEFT JOIN again USING (doc_id))
SELECT doc_id, n_words, word_chars, n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, n_repeat_words, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM counted
"""

_FOUND = " UNION ALL ".join(
    f"SELECT doc_id, i - 1 AS place, '{label}' AS label FROM (SELECT doc_id, w, unnest(range(1, len(w) - {len(phrase.split()) - 2})) AS i FROM split) WHERE "
    + " AND ".join(f"w[i + {k}] = '{x}'" for k, x in enumerate(phrase.split()))
    for phrase, label in license.BASE.items()
)
LICENSE_SQL = rf"""
WITH split AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
found AS ({_FOUND}),
summed AS (SELECT doc_id, count(*) AS n, min(place) AS lo, max(place) AS hi, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM found GROUP BY 1)
SELECT doc_id, len(w) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(labels, '') AS base_labels FROM split LEFT JOIN summed USING (doc_id)
"""
