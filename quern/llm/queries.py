"""The ``opN_<name>`` queries of this subpackage and, where SQL can express them, their oracles.

A query is thin: it reads whole tables, applies its operator with production
parameters and derives the columns that the query promises.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.llm import decontaminate, mixing, pii, pseudo, quality, sharding, simhash, substring, suffix, tokens
from quern.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]


def op1_consistent_hash_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(table(spark, sf_dir, "documents"), 8, keep=["doc_id"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op2_anchor_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.find_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256")
    )


def op3_masked_pseudo_likelihood(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document's summed conditional log-probability, and its mean per token."""
    found = pseudo.pseudo_likelihood(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_tokens", F.round("log_likelihood", 4).alias("log_likelihood"),
        F.round(F.col("log_likelihood") / F.greatest("n_tokens", F.lit(1)), 6).alias("mean_log_probability"),
    )


def op4_pivotal_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents")).select(
        F.col("id").alias("doc_id"), "size", "source_size", "target", "taken"
    )


def mixing_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What of ``op4_pivotal_mixing`` is not drawn, so that SQL can tell it."""
    return op4_pivotal_mixing(spark, sf_dir).select("doc_id", "size", "source_size", F.round("target", 4).alias("target"))


def op5_run_length_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix.find_repeats(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"), "n_bytes", "n_removed", F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op6_anchor_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.detect(table(spark, sf_dir, "documents"))

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    def joined(spans: Column) -> Column:
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    base = F.filter("spans", lambda s: s["kind"].isin(list(pii.BASE)))
    return found.select(
        F.col("id").alias("doc_id"), *map(count, pii.BASE),
        F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"),
    )


def op7_pretoken_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    found = tokens.count_tokens(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))
    return found.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > 1024).alias("over_limit"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"
    )


def op9_simhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        F.col("id").alias("doc_id"),
        F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op10_latent_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document that leaks a benchmark item, with the item."""
    found = decontaminate.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select(
        F.col("id").alias("doc_id"), F.col("item").alias("item_id"),
        F.round("cosine", 4).alias("cosine"), F.round("lcs_ratio", 4).alias("lcs_ratio"), "answer",
    )


_QUALITY_SQL = r"""
WITH base AS (
  SELECT doc_id, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
windows AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM base, unnest(range(1, len(w) - 1)) AS r(i) WHERE len(w) >= 3),
repeats AS (
  SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT i + k) AS n FROM repeats, unnest([0, 1, 2]) AS o(k) GROUP BY doc_id),
f AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
         len(l)::BIGINT AS n_lines, (len(l) - len(list_distinct(l)))::BIGINT AS n_dup_lines,
         coalesce(n, 0)::BIGINT AS n_repeat_words,
         len(list_filter(w, lambda x: x IN (STOPS)))::BIGINT AS n_stop_words
  FROM base LEFT JOIN covered USING (doc_id)),
g AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed
       AND word_chars >= 2 * n_words AND word_chars <= 15 * n_words
       AND n_symbols <= 0.25 * n_words AND n_stop_words >= 0.03 * n_words
       AND n_dup_lines <= 0.4 * greatest(n_lines, 1) AND n_repeat_words <= 0.5 * n_words AS kept
FROM g
"""


_SUBSTRING_SQL = r"""
WITH base AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM base, unnest(range(1, len(w) - 33)) AS r(i) WHERE len(w) >= 35),
repeats AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM repeats, unnest(range(0, 35)) AS o(k)),
words AS (SELECT doc_id, w[p] AS word, p FROM base, unnest(range(1, len(w) + 1)) AS r(p)),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM base LEFT JOIN kept USING (doc_id)
"""

_SUFFIX_SQL = r"""
WITH base AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
windows AS (SELECT doc_id, i, md5_number(substr(h, 2 * i + 1, 400)) AS g FROM base, unnest(range(0, n - 199)) AS r(i) WHERE n >= 200),
repeats AS (SELECT doc_id, i FROM windows QUALIFY count(*) OVER (PARTITION BY g) > 1),
islands AS (
  SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM (
    SELECT doc_id, i, (i > coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000) + 200)::INT AS fresh FROM repeats)),
spans AS (SELECT doc_id, k, min(i) AS s, max(i) + 200 AS e FROM islands GROUP BY doc_id, k),
cuts AS (
  SELECT doc_id, s, e, lag(e, 1, 0) OVER (PARTITION BY doc_id ORDER BY s) AS before FROM spans),
parts AS (
  SELECT c.doc_id, count(*) AS m, sum(e - s) AS r, string_agg(substr(h, 2 * before + 1, 2 * (s - before)), '' ORDER BY s) AS t, max(e) AS last
  FROM cuts c JOIN base USING (doc_id) GROUP BY c.doc_id)
SELECT doc_id, n::BIGINT AS n_bytes, coalesce(r, 0)::BIGINT AS n_removed, coalesce(m, 0)::BIGINT AS n_spans,
       sha256(unhex(coalesce(t || substr(h, 2 * last + 1), h))) AS kept_sha256
FROM base LEFT JOIN parts USING (doc_id)
"""


_TARGETS_SQL = r"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS n, 1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS w FROM d GROUP BY source),
r AS (SELECT *, 3.0 * n / w AS ratio, sum(n) OVER () AS total FROM s),
q AS (
  SELECT *, coalesce(sum(3.0 * n) OVER (ORDER BY ratio, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(w) OVER (ORDER BY ratio, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rest
  FROM r),
l AS (SELECT arg_min((total - below) / rest, ratio) AS unit FROM q WHERE (total - below) / rest <= ratio)
SELECT doc_id, size, n AS source_size, round(least(3.0 * n, unit * w), 4) AS target
FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source CROSS JOIN l
"""

_PII_SQL = r"""
WITH base AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
patterns(kind, place, p, lead) AS (VALUES
  ('email', 0, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+', ''),
  ('ip', 1, '[0-9]+(?:\.[0-9]+){3}', ''),
  ('card', 2, '[0-9](?:[\x20-]?[0-9])+', ''),
  ('phone', 3, '\+[0-9][\x20().0-9-]+[0-9]', ''),
  ('url', 4, '(?:http|https|ftp|ssh)://[^\x00-\x20<>"''/?#]+@[^\x00-\x20<>"''/?#@]+(?:[/?#][^\x00-\x20<>"'']*)?', ''),
  ('account', 5, 'LEAD[A-Za-z0-9][A-Za-z0-9_-]{7,}', 'LEAD')),
cut AS (
  SELECT doc_id, kind, place, lead, regexp_extract_all(t, p) AS m, string_split_regex(t, p) AS g FROM base, patterns),
met AS (
  SELECT doc_id, kind, place, m[k] AS whole,
         CASE WHEN lead = '' THEN m[k] ELSE regexp_replace(m[k], '^(?:' || lead || ')', '') END AS s,
         list_sum(list_transform(g[1:k], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:k - 1], lambda x: length(x))), 0) AS a
  FROM cut, unnest(range(1, len(m) + 1)) AS r(k)),
spans AS (
  SELECT doc_id, kind, place, s, (a + length(whole) - length(s))::BIGINT AS first, (a + length(whole))::BIGINT AS last,
         regexp_replace(s, '[^0-9]', '', 'g') AS d
  FROM met),
good AS (
  SELECT *, concat_ws(':', kind, first, last) AS told FROM spans
  WHERE CASE kind
    WHEN 'ip' THEN list_bool_and(list_transform(string_split(s, '.'), lambda x: length(ltrim(x, '0')) < 3 OR (length(ltrim(x, '0')) = 3 AND ltrim(x, '0') <= '255')))
    WHEN 'card' THEN length(d) BETWEEN 12 AND 19 AND list_sum(list_transform(range(1, length(d) + 1), lambda i:
      CASE WHEN i % 2 = 1 THEN substr(d, length(d) + 1 - i, 1)::INT
           ELSE (2 * substr(d, length(d) + 1 - i, 1)::INT) // 10 + (2 * substr(d, length(d) + 1 - i, 1)::INT) % 10 END)) % 10 = 0
    WHEN 'phone' THEN length(d) BETWEEN 9 AND 15
    WHEN 'account' THEN length(d) > 0
    ELSE true END)
SELECT b.doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip,
       count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
       sha256(coalesce(string_agg(told, ',' ORDER BY first, place) FILTER (place < 4), '')) AS base_sha256,
       coalesce(string_agg(told, ',' ORDER BY first, place, last), '') AS spans
FROM base b LEFT JOIN good g ON b.doc_id = g.doc_id GROUP BY b.doc_id
"""


def _pii_sql() -> str:
    words = sorted({f for w in pii.IDENTIFIERS for f in (w, w.upper(), w.capitalize())})
    blank = r"[\s\x0b\p{Z}]*"
    links = "|".join(w.replace(".", r"\.") for w in pii.LINKS)
    return _PII_SQL.replace("LEAD", rf"(?:^|[^\p{{L}}\p{{N}}])(?:{'|'.join(words)}){blank}(?:{links})?{blank}[:=#]{blank}[\x22\x27]?")


def _quality_sql() -> str:
    stops = sorted({w for s in quality.STOP_WORDS for w in (s, s.capitalize())})
    return _QUALITY_SQL.replace("STOPS", ", ".join(f"'{w}'" for w in stops))


def queries() -> dict[str, Query]:
    return {
        "op1_consistent_hash_sharding": op1_consistent_hash_sharding,
        "op2_anchor_substring_dedup": op2_anchor_substring_dedup,
        "op3_masked_pseudo_likelihood": op3_masked_pseudo_likelihood,
        "op4_pivotal_mixing": op4_pivotal_mixing,
        "mixing_targets": mixing_targets,
        "op5_run_length_suffix_dedup": op5_run_length_suffix_dedup,
        "op6_anchor_pii": op6_anchor_pii,
        "op7_pretoken_counts": op7_pretoken_counts,
        "op8_quality_rules": op8_quality_rules,
        "op9_simhash_neardup": op9_simhash_neardup,
        "op10_latent_decontamination": op10_latent_decontamination,
    }


def oracle_sql() -> dict[str, str]:
    return {
        "op2_anchor_substring_dedup": _SUBSTRING_SQL,
        "mixing_targets": _TARGETS_SQL,
        "op5_run_length_suffix_dedup": _SUFFIX_SQL,
        "op6_anchor_pii": _pii_sql(),
        "op8_quality_rules": _quality_sql(),
    }
