"""The registered queries of this subpackage: op1_ to op10_, each over its whole table, and the pipeline."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wherewhen.llm.common import table
from wherewhen.llm.decontamination import contaminated
from wherewhen.llm.html_text import main_text
from wherewhen.llm.jaccard_join import jaccard_components
from wherewhen.llm.lm_scoring import lm_scores
from wherewhen.llm.mixing import mix_sources
from wherewhen.llm.quality_classifier import classify
from wherewhen.llm.quality_rules import quality_rules
from wherewhen.llm.substring_dedup import substring_dedup
from wherewhen.llm.token_files import token_files
from wherewhen.llm.url_filter import url_filter


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"), width=13)


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op3_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents"), entropy_ratio=0.95, max_repeats=4.0)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return token_files(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), end_id=1)


def op5_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm_scores(table(spark, sf_dir, "documents"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op7_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return main_text(table(spark, sf_dir, "pages"))


def op9_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter(table(spark, sf_dir, "pages"))


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_substring_dedup": op1_substring_dedup,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_source_mixing": op3_source_mixing,
    "op4_token_files": op4_token_files,
    "op5_lm_scoring": op5_lm_scoring,
    "op6_decontamination": op6_decontamination,
    "op7_quality_classifier": op7_quality_classifier,
    "op8_html_text": op8_html_text,
    "op9_url_filter": op9_url_filter,
    "op10_quality_rules": op10_quality_rules,
}

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_HASH = "CAST('0x' || substr(md5({}), 1, 12) AS BIGINT)"

ORACLE_SQL: dict[str, str] = {
    # the bisection for the target entropy; the repetition limit of 4 doesn't bind where no source is that small
    "op3_source_mixing": rf"""
WITH RECURSIVE d AS (SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS n, {_HASH.format("'7/' || doc_id")} AS h FROM documents),
s AS (SELECT source, CAST(sum(n) AS BIGINT) AS t, CAST(greatest(256, ceil(sum(n) / 1048576)) AS BIGINT) AS nb FROM d GROUP BY source),
q AS (SELECT t / (SELECT sum(t) FROM s) AS q FROM s WHERE t > 0),
grid AS (SELECT 0 AS i, 0.0::DOUBLE AS lo, 1.0::DOUBLE AS hi UNION ALL
  SELECT i + 1, CASE WHEN ok THEN mid ELSE lo END, CASE WHEN ok THEN hi ELSE mid END FROM (
    SELECT i, lo, hi, (lo + hi) / 2 AS mid,
      (SELECT ln(sum(power(q, (lo + hi) / 2))) - sum(power(q, (lo + hi) / 2) * ln(q)) * (lo + hi) / 2 / sum(power(q, (lo + hi) / 2)) FROM q) >= 0.95 * (SELECT ln(count(*)) FROM q) AS ok
    FROM grid WHERE i < 60)),
a AS (SELECT CASE WHEN (SELECT -sum(q * ln(q)) FROM q) >= 0.95 * (SELECT ln(count(*)) FROM q) THEN 1.0 ELSE (SELECT lo FROM grid WHERE i = 60) END AS a),
w AS (SELECT source, t, power(t / (SELECT sum(t) FROM s), a) / sum(power(t / (SELECT sum(t) FROM s), a)) OVER () AS weight FROM s, a WHERE t > 0),
b AS (SELECT source, h % nb AS block, CAST(sum(n) AS BIGINT) AS bt FROM d JOIN s USING (source) GROUP BY ALL),
e AS (SELECT b.*, t, weight, weight * (SELECT sum(t) FROM s) AS budget, unnest(range(0, CAST(ceil(weight * (SELECT sum(t) FROM s) / t) AS BIGINT))) AS epoch FROM b JOIN w USING (source)),
p AS (SELECT *, epoch * t + coalesce(sum(bt) OVER (PARTITION BY source, epoch ORDER BY {_HASH.format("'7/' || source || '/' || epoch || '/' || block")}, block ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM e)
SELECT d.doc_id, d.source, d.n AS n_tokens, p.block, CAST(p.epoch AS INTEGER) AS epoch, round(p.weight, 9) AS weight, round(p.start / p.budget, 9) AS position
FROM p JOIN s USING (source) JOIN d ON d.source = p.source AND d.h % s.nb = p.block WHERE p.start + p.bt / 2 <= p.budget""",
    "op2_jaccard_join": rf"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT doc_id, list_slice(w, p, p + 4) AS g
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 2))) AS p FROM d WHERE len(w) > 0)),
s AS (SELECT DISTINCT doc_id, g FROM sh),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS i FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * i >= 75 * (x.n + y.n - i)),
e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a AS doc_id, a AS c FROM e UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.doc_id),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, d.doc_id) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op1_substring_dedup": rf"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
win AS (SELECT doc_id, p, list_slice(w, p, p + 12) AS g
        FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 11, 1))) AS p FROM d)),
firsts AS (SELECT g, min(doc_id) AS f FROM win GROUP BY g HAVING count(*) > 1),
hit AS (SELECT win.doc_id, win.p FROM win JOIN firsts USING (g) WHERE firsts.f < win.doc_id),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 13)) AS p FROM hit),
gl AS (SELECT doc_id, list(p) AS ps, count(*) AS n FROM gone GROUP BY doc_id),
word AS (SELECT doc_id, unnest(w) AS t, unnest(range(1, len(w) + 1)) AS p FROM d),
kept AS (SELECT doc_id, string_agg(t, ' ' ORDER BY p) AS k FROM word ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(gl.n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(kept.k, '')) AS kept_sha256
FROM d LEFT JOIN gl USING (doc_id) LEFT JOIN kept USING (doc_id)""",
}
