"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quillon.llm import chat, decontamination, html, licenses, linededup, minhash, mixing, quality, toxicity, urls


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.toxicity(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html.extract(_read(spark, sf_dir, "pages"))


def op4_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = "</s>[INST] ok [/INST]"
    extra = spark.createDataFrame(
        [(-7, 0, "user", told), (-7, 1, "assistant", told)], "conv_id long, turn long, role string, text string"
    )
    turns = _read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra)
    return chat.read_back(chat.format_conversations(turns))


def op5_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op6_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.filter_urls(_read(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.line_dedup(_read(spark, sf_dir, "documents"))


def op8_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(_read(spark, sf_dir, "documents"))


def op9_mixing_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_read(spark, sf_dir, "documents")).drop("copies")


def op10_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_dedup(_read(spark, sf_dir, "documents"))


QUERIES = {
    "op1_quality_rules": op1_quality_rules,
    "op2_toxicity": op2_toxicity,
    "op3_html_extraction": op3_html_extraction,
    "op4_chat_formatting": op4_chat_formatting,
    "op5_benchmark_decontamination": op5_benchmark_decontamination,
    "op6_url_filters": op6_url_filters,
    "op7_line_dedup": op7_line_dedup,
    "op8_license_scans": op8_license_scans,
    "op9_mixing_sources": op9_mixing_sources,
    "op10_minhash_near_dedup": op10_minhash_near_dedup,
}

_OP4 = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, regexp_replace(role, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS er,
         regexp_replace(text, '([<\[])(\\*)(/?(?:s>|INST\]))', '\1\\\2\3', 'g') AS et FROM t
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(20 + length(er) + length(et)) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""

_OP6 = r"""
WITH u AS (
  SELECT page_id, coalesce(url, '') AS url, CASE WHEN contains(url, '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS r FROM pages
), s AS (
  SELECT page_id, url, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(regexp_replace(r, '^[^/?#]*', ''), '^[^?#]*') AS path FROM u
), rules(v, h, p) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), m AS (
  SELECT page_id, max_by(h || p, length(h || p)) AS rule, max_by(v, length(h || p)) AS verdict
  FROM (SELECT DISTINCT page_id, host, path FROM s), rules
  WHERE (host = h OR host LIKE '%.' || h) AND starts_with(path, p) GROUP BY page_id
)
SELECT s.page_id, host, path, rule,
       coalesce(verdict, CASE WHEN regexp_matches(lower(url), '(^|[^a-z0-9_%-])(ads-track|free-bets|cheap-pills|spam-farm|casino-win|adult-x|doubleclick\.net|popunder)($|[^a-z0-9_%-])|/banner/.*\.swf')
                      THEN 'block' ELSE 'allow' END) AS verdict
FROM s LEFT JOIN m USING (page_id)
"""

_OP9 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size FROM documents
), z AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS w
  FROM d GROUP BY source
), f AS (
  SELECT *, (SELECT sum(source_size) FROM z)
            - coalesce(sum(3 * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
         sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS ws
  FROM z WINDOW o AS (ORDER BY CAST(3 * source_size AS DOUBLE) / w, source IS NULL, source)
), g AS (
  SELECT *, CASE WHEN 3 * source_size > w * (CAST(rest AS DOUBLE) / CAST(ws AS DOUBLE)) THEN CAST(rest AS DOUBLE) / CAST(ws AS DOUBLE) END AS lv FROM f
), t AS (
  SELECT source, source_size, CASE WHEN lv IS NOT NULL THEN w * (max(lv) OVER ()) ELSE CAST(3 * source_size AS DOUBLE) END AS target FROM g
), p AS (
  SELECT *, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS ratio FROM t
), r AS (
  SELECT d.doc_id, d.size, p.source, p.source_size, p.target, CAST(floor(ratio) AS BIGINT) AS sure, ratio - floor(ratio) AS pi,
         (CAST(CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), 'null')), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
), q AS (
  SELECT *, CASE WHEN pi > 0 THEN (u / (1 - u)) / (pi / (1 - pi)) END AS q, target - sure * source_size AS need FROM r
), c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY q) AS upto, sum(size) OVER (PARTITION BY source, q) AS tied FROM q
)
SELECT doc_id, size, source_size, target,
       CAST((sure + CASE WHEN q IS NOT NULL AND upto - tied / 2.0 <= need THEN 1 ELSE 0 END) * size AS BIGINT) AS taken FROM c
"""

_AZ = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"

_OP5 = rf"""
WITH iw AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark
), win AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g
  FROM iw, range(1, greatest(len(w) - 10, 0) + 2) t(i) WHERE len(w) > 0
), sizes AS (SELECT DISTINCT n FROM win), dw AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), dg AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM dw, sizes, range(1, len(w) - n + 2) t(i)
), m AS (SELECT doc_id, i, n, item_id FROM dg JOIN win USING (n, g)), hit AS (
  SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT DISTINCT doc_id, i, n FROM m), range(i, i + n) t(j) GROUP BY doc_id
), found AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT doc_id, item_id FROM m) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)
"""

_OP7 = rf"""
WITH s AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents), l AS (
  SELECT doc_id, i, ls[i] AS line, translate(trim(ls[i], chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {_AZ}) AS k
  FROM s, range(1, len(ls) + 1) t(i)
), rep AS (SELECT k, max(doc_id) AS holder FROM l WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (holder <> doc_id) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (holder IS NULL OR holder = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN rep USING (k) GROUP BY doc_id
"""

_OP10 = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x20\x09-\x0D]+') AS w FROM documents
), sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i : i + least(len(w), 5) - 1], ' ') AS g
  FROM w, range(1, greatest(len(w) - 5, 0) + 2) t(i) WHERE len(w) > 0
), n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id), common AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2
), link AS MATERIALIZED (
  SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 75 * (x.n + y.n - c)
), reach AS (SELECT doc_id AS d, doc_id AS r FROM w UNION SELECT reach.d, link.b FROM reach JOIN link ON link.a = reach.r)
SELECT w.doc_id, coalesce(n, 0) AS n_shingles, min(r) AS component_id, min(r) = w.doc_id AS kept
FROM w LEFT JOIN n USING (doc_id) JOIN reach ON reach.d = w.doc_id GROUP BY w.doc_id, n
"""

_VALUES = lambda rows: ", ".join(f"({k}, '{a}', '{b}')" for k, (a, b) in enumerate(rows))

_OP8 = rf"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {_AZ}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), phrases(p, phrase, label) AS (VALUES {_VALUES(licenses.PHRASES)}), places AS (
  SELECT doc_id, i - 1 AS pos, label FROM d, (SELECT string_split(phrase, ' ') AS pw, label FROM phrases), range(1, greatest(len(w) - len(pw) + 1, 0) + 1) t(i)
  WHERE w[i : i + len(pw) - 1] = pw
), base AS (
  SELECT doc_id, count(*) AS n, min(pos) AS a, max(pos) AS b, list_sort(list(DISTINCT label)) AS labels FROM places GROUP BY doc_id
), g AS (
  SELECT doc_id, i - 1 AS pos, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM d, range(1, greatest(len(w) - 2, 0) + 1) t(i)
), templates(t, label, text) AS (VALUES {_VALUES(licenses.TEMPLATES)}), tw AS (SELECT t, label, string_split(text, ' ') AS w FROM templates), tg AS (
  SELECT t, label, len(w) AS tn, i - 1 AS ta, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS k FROM tw, range(1, len(w) - 1) r(i)
), dg AS (
  SELECT doc_id, t, label, tn, pos - ta AS dd, list(DISTINCT ta) AS ats, min(pos) AS f, max(pos) AS l FROM g JOIN tg USING (k) GROUP BY ALL
), cut AS (
  SELECT *, CASE WHEN dd - lag(dd) OVER (PARTITION BY doc_id, t ORDER BY dd) > {licenses.GAP} THEN 1 ELSE 0 END AS fresh FROM dg
), run AS (SELECT *, sum(fresh) OVER (PARTITION BY doc_id, t ORDER BY dd) AS sp FROM cut), span AS (
  SELECT doc_id, label, tn, flatten(list(ats)) AS ats, max(l) + 2 - min(f) + 1 AS width FROM run GROUP BY doc_id, t, label, tn, sp
), cover AS (
  SELECT doc_id, label, CAST(len(list_distinct(flatten(list_transform(ats, lambda a: [a, a + 1, a + 2])))) AS DOUBLE) / tn AS c, width <= tn + {2 * licenses.GAP} AS tight
  FROM span
), found AS (SELECT doc_id, list(label) FILTER (c >= {licenses.COVER} AND tight) AS labels, max(c) AS c FROM cover GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n, 0) AS n_base, a AS first_word, b AS last_word,
       coalesce(array_to_string(base.labels, ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base.labels, []), coalesce(found.labels, [])))), ','), '') AS labels,
       CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE least(coalesce(c, 0.0), 1.0)::DOUBLE END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN found USING (doc_id)
"""

ORACLE: dict[str, str] = {
    "op4_chat_formatting": _OP4,
    "op5_benchmark_decontamination": _OP5,
    "op6_url_filters": _OP6,
    "op7_line_dedup": _OP7,
    "op8_license_scans": _OP8,
    "op9_mixing_sources": _OP9,
    "op10_minhash_near_dedup": _OP10,
}
