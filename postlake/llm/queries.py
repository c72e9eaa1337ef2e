"""The operators as queries over the supplied tables, with production parameters, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from postlake.llm import (
    exact_dedup, language_id, lexical_search, mixing, ngram_join, packing, quality_gam, quality_rules, secrets, sharding, toxicity, warc, whitening,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality_gam.score(docs, quality_gam.train(docs, _table(spark, sf_dir, "labels")))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(_table(spark, sf_dir, "pages"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard(_table(spark, sf_dir, "documents"))


def op6_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality_rules.apply_rules(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.train(docs, _table(spark, sf_dir, "labels")))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.dedup(_table(spark, sf_dir, "documents"))


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.find_secrets(_table(spark, sf_dir, "documents"))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitening(_table(spark, sf_dir, "embeddings"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return language_id.predict(docs, language_id.train(docs))


QUERIES = {
    f.__name__: f
    for f in (
        op1_best_fit_packing, op2_source_mixing, op3_quality_classifier, op4_warc, op5_sharding,
        op6_ngram_jaccard_join, op7_quality_rules, op8_toxicity, op9_exact_dedup, op10_secret_scan,
        op11_embedding_whitening, op12_ranked_search, op13_language_id,
    )
}

_STOPS = ", ".join(f"'{x}'" for x in dict.fromkeys(quality_rules.STOP_WORDS))

# the contract's patterns of the base and those of the other rules, with the group whose length counts
_SECRETS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""", 2, 12, True),
    ("access", "AKIA[A-Z0-9]+", 0, 18, True),
    ("hex", "[0-9a-f]+", 0, 16, True),
    ("pem", "-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1, False),
    ("bearer", "eyJ[A-Za-z0-9_-]{8,}[.]eyJ[A-Za-z0-9_-]{8,}", 0, 1, False),
    ("prefixed", "gh[pousr]_[A-Za-z0-9]{36,}", 0, 1, False),
)

_TERMS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

SQL = {
    "op12_ranked_search": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS ws FROM documents),
i AS (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS ws FROM benchmark),
q AS (SELECT i, term, count(*) AS times FROM (SELECT i, unnest(ws) AS term FROM i) GROUP BY i, term),
total AS (SELECT count(*) AS n_docs, CAST(sum(len(ws)) AS BIGINT) AS n_terms FROM d WHERE len(ws) > 0),
p AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(ws) AS term FROM d) WHERE term IN (SELECT term FROM q) GROUP BY r, term),
w AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * df + 1)::DOUBLE)) AS BIGINT) AS w FROM (SELECT term, count(*) AS df FROM p GROUP BY term), total),
g AS (SELECT r, term, w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * len(ws) * n_docs) // n_terms))) AS gain FROM p JOIN w USING (term) JOIN d USING (r), total),
s AS (SELECT i, r, CAST(sum(times * gain) AS BIGINT) AS score FROM q JOIN g USING (term) GROUP BY i, r)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score
FROM (SELECT i, doc_id, score, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id ASC NULLS LAST) AS rank FROM s JOIN d USING (r) WHERE score > 0) JOIN i USING (i) WHERE rank <= 20
""",
    "op2_source_mixing": r"""
WITH sized AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS k, md5(coalesce(text, '')) AS h
  FROM documents),
per AS (
  SELECT source, CAST(sum(size) AS DOUBLE) AS s, row_number() OVER (ORDER BY source ASC NULLS LAST) AS n FROM sized GROUP BY source),
weighed AS (
  SELECT source, s, n, CASE n % 3 WHEN 1 THEN 5.0::DOUBLE WHEN 2 THEN 2.0::DOUBLE ELSE 1.0::DOUBLE END AS w FROM per),
-- the level at which the capped sources are those whose cap lies below it
levels AS (
  SELECT a.source,
    (1.5::DOUBLE * (SELECT sum(s) FROM weighed) - coalesce(sum(2.0::DOUBLE * b.s) FILTER (2.0::DOUBLE * b.s / b.w < 2.0::DOUBLE * a.s / a.w), 0))
      / sum(b.w) FILTER (2.0::DOUBLE * b.s / b.w >= 2.0::DOUBLE * a.s / a.w) AS water,
    2.0::DOUBLE * a.s / a.w AS cap_level
  FROM weighed a, weighed b GROUP BY a.source, a.s, a.w),
chosen AS (SELECT arg_min(water, cap_level) FILTER (water <= cap_level) AS water FROM levels),
goals AS (
  SELECT source, CAST(s AS BIGINT) AS source_size, least(2.0::DOUBLE * s, water * w) AS target, n - 1 AS sid FROM weighed, chosen),
laid AS (
  SELECT d.doc_id, d.size, g.sid, g.source_size, g.target, CAST(floor(g.target) AS BIGINT) AS goal, row_number() OVER () AS r,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id, d.size, d.h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM sized d JOIN goals g ON d.source IS NOT DISTINCT FROM g.source),
-- the schedule: the source whose share of the targets holds the golden-ratio point of a slot
shares AS (
  SELECT sid, CAST(ceil(target / 1024) AS BIGINT) AS need, sum(target) OVER (ORDER BY sid) / sum(target) OVER () AS upto,
    (sum(target) OVER (ORDER BY sid) - target) / sum(target) OVER () AS since FROM goals WHERE target > 0),
total AS (SELECT CAST(ceil(round(sum(target), 3) / 1024) AS BIGINT) AS n, (SELECT count(*) FROM goals) AS n_sources FROM goals),
points AS (SELECT slot, slot * 0.6180339887498949::DOUBLE - floor(slot * 0.6180339887498949::DOUBLE) AS x FROM total, unnest(range(coalesce(n, 0))) AS q(slot)),
drawn AS (SELECT slot, sid, need, row_number() OVER (PARTITION BY sid ORDER BY slot) - 1 AS rank FROM points, shares WHERE x >= since AND x < upto),
got AS (SELECT s.sid, s.need, count(d.sid) AS n FROM shares s LEFT JOIN drawn d ON s.sid = d.sid GROUP BY s.sid, s.need),
slots AS (
  SELECT sid, rank, slot FROM drawn WHERE rank < need
  UNION ALL SELECT sid, rank, total.n + (rank - got.n) * n_sources + sid FROM got, total, unnest(range(got.n, got.need)) AS q(rank)),
spans AS (
  SELECT r, sid, start + p * source_size AS f, least(start + p * source_size + size, goal) AS t FROM laid, (VALUES (0), (1)) AS q(p) WHERE size > 0),
firsts AS (
  SELECT r, CAST(min(slot) AS BIGINT) AS first_slot FROM spans JOIN slots ON spans.sid = slots.sid AND rank BETWEEN f // 1024 AND (t - 1) // 1024 WHERE f < t GROUP BY r)
SELECT doc_id, size, source_size, target, first_slot,
  CAST(CASE WHEN size = 0 THEN 0 ELSE goal // source_size * size + greatest(0, least(goal % source_size - start, size)) END AS BIGINT) AS taken
FROM laid LEFT JOIN firsts USING (r)
""",
    "op4_warc": r"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS h FROM pages),
b AS (
  SELECT page_id, strlen(html) AS payload_bytes, h,
    list_aggregate(list_transform(range(32), lambda k:
      substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
        CAST(((('0x' || substr(h, CAST(k // 8 * 10 + 1 AS BIGINT), 10))::UBIGINT >> CAST((7 - k % 8) * 5 AS INT)) & 31) AS BIGINT) + 1, 1)), 'string_agg', '') AS payload_digest
  FROM p),
f AS (SELECT h, min(page_id) AS first_id FROM b GROUP BY h)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
  CASE WHEN page_id > first_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id > first_id THEN first_id END AS refers_to
FROM b JOIN f USING (h)
""",
    "op7_quality_rules": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words FROM t),
five AS (
  SELECT r, i, words[i] || chr(1) || words[i + 1] || chr(1) || words[i + 2] || chr(1) || words[i + 3] || chr(1) || words[i + 4] AS g
  FROM (SELECT r, words, unnest(range(1, CAST(len(words) - 3 AS BIGINT))) AS i FROM w)),
twice AS (SELECT r, i FROM (SELECT r, i, count(*) OVER (PARTITION BY r, g) AS n FROM five) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT i + k) AS n_repeat_words FROM twice, range(5) AS q(k) GROUP BY r),
m AS (
  SELECT doc_id, words, CAST(len(words) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, text
  FROM w LEFT JOIN covered USING (r)),
v AS (
  SELECT doc_id, n_words, word_chars, n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, n_repeat_words, len(lines) AS n_lines,
    n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
    len(list_filter(words, lambda x: ends_with(x, '!!'))) AS n_exclaimed,
    len(list_filter(words, lambda x: x IN (STOPS))) AS n_stop,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '^[\x20\x09]*[-*•]'))) AS n_bullets,
    len(list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09]*$'))) AS n_ellipsis,
    coalesce(list_max(list_transform(words, lambda x: length(x))), 0) AS longest
  FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / n_words BETWEEN 3 AND 10 AND n_symbols / n_words <= 0.1 AND n_dup_lines / n_lines <= 0.4
    AND n_exclaimed / n_words <= 0.1 AND (n_words < 30 OR n_stop / n_words >= 0.06) AND n_bullets / n_lines <= 0.9
    AND n_ellipsis / n_lines <= 0.3 AND longest <= 1000 AS kept
FROM v
""".replace("STOPS", _STOPS),
    "op9_exact_dedup": r"""
WITH d AS (SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g')) AS text_sha256 FROM documents),
g AS (SELECT text_sha256, min(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM d JOIN g USING (text_sha256)
""",
    # matches and what lies between them give each match's place
    "op10_secret_scan": r"""
WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
RULES),
placed AS (
  SELECT r, k, kind, base, len(m) AS n, least, part,
    CAST(len(coalesce(list_aggregate(gaps[1:j], 'string_agg', ''), '')) + len(coalesce(list_aggregate(ms[1:j - 1], 'string_agg', ''), '')) AS BIGINT) AS a
  FROM (SELECT *, unnest(ms) AS m, unnest(range(1, CAST(len(ms) + 1 AS BIGINT))) AS j, unnest(parts) AS part FROM found)),
kept AS (SELECT *, kind || ':' || a || ':' || (a + n) AS span FROM placed WHERE len(part) >= least),
per AS (
  SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
    string_agg(span, ',' ORDER BY a, k) FILTER (base) AS own, string_agg(span, ',' ORDER BY a, k) AS spans
  FROM kept GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM t LEFT JOIN per USING (r)
""".replace(
        "RULES",
        " UNION ALL ".join(
            f"SELECT r, {k} AS k, '{kind}' AS kind, {base} AS base, {least} AS least, regexp_extract_all(text, '{p}') AS ms,"
            f" regexp_extract_all(text, '{p}', {group}) AS parts, string_split_regex(text, '{p}') AS gaps FROM t"
            for k, (kind, p, group, least, base) in enumerate(_SECRETS)
        ),
    ),
}
