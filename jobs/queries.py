"""The jobs as registered queries with matching SQL. Each run takes whole tables, writes into a folder of its own in the shared folder, and leaves its files there."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from eqspark.plans import filter_queries as fq
from eqspark.plans import oracle_dsp as dsp
from eqspark.plans.registry import with_views
from eqspark.session import ship
from eqspark.sources import bridge
from eqspark.storage import shared_dir

from . import import_texts, preset_catalog


def _folder(spark: SparkSession, job: str) -> str:
    return f"{shared_dir(spark)}/eqspark/jobs/{job}-{uuid.uuid4().hex}"


def job1_import_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``documents`` as they are, and the curves and presets that Spark writes as text files' contents, imported twice: the second run finds nothing new."""
    ship(spark)
    where = _folder(spark, "import-texts")
    inputs = {"documents": f"{sf_dir}/documents.parquet", "curves": f"{where}/inbox/curves", "presets": f"{where}/inbox/presets"}
    fq.curve_texts(spark, sf_dir).select(F.col("curve_id").alias("doc_id"), "text").write.parquet(inputs["curves"])
    fq.preset_texts(spark, sf_dir).select(F.col("preset_id").alias("doc_id"), "text").write.parquet(inputs["presets"])
    for _ in range(2):
        import_texts.run(spark, inputs, f"{where}/out", f"{where}/checkpoint")
    rows = spark.read.schema(import_texts.schema(import_texts.config())).parquet(f"{where}/out/texts")
    f = F.transform("points", lambda p: p["frequency_hz"])
    size = lambda c: F.when(F.col(c).isNotNull(), F.size(c)).cast("long")
    return rows.select("origin", "id", "lang", "source", "digest", "n_lines", "verdict", "category", "message", "delimiter", size("points").alias("n_points"), F.array_min(f).alias("lo_hz"), F.array_max(f).alias("hi_hz"), size("filters").alias("n_filters"))


def job2_preset_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The whole catalog, made twice."""
    where = _folder(spark, "preset-catalog")
    for _ in range(2):
        preset_catalog.run(spark, sf_dir, where)
    return spark.read.schema(preset_catalog.CATALOG).parquet(f"{where}/presets")


#: A line's columns under each delimiter, as the reader of curve texts sees them.
_BLANK = r"[\x09-\x0D\x20\x{FEFF}\x{A0}]"
_NUMBER = r"(?i)^[+-]?(?:(?:[0-9]+(?:\.[0-9]*)?|\.[0-9]+)(?:e[+-]?[0-9]+)?|Infinity|NaN)$"
JOB1_SQL = rf"""WITH d AS (SELECT CAST(doc_id AS VARCHAR) AS id, lang, source, coalesce(text, '') AS text FROM documents),
raw AS (SELECT id, row_number() OVER () AS k, lang, source, text, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS parts FROM d),
cleaned AS (SELECT k, list_transform(list_filter(parts, lambda x: NOT regexp_matches(x, '^{_BLANK}*$') AND NOT regexp_matches(x, '^{_BLANK}*(#|//|; )')), lambda x: regexp_replace(x, '^{_BLANK}+|{_BLANK}+$', '', 'g')) AS lines FROM raw),
delimiters(name, place, pattern) AS (VALUES ('tab', 1, '\t'), ('semicolon', 2, ';'), ('comma', 3, ','), ('whitespace', 4, '[ \f\v]+')),
one AS (SELECT k, unnest(lines) AS line, unnest(range(len(lines))) AS n FROM cleaned),
cols AS (SELECT k, n, name, list_transform(string_split_regex(line, pattern), lambda c: trim(c)) AS c FROM one, delimiters),
told AS (SELECT k, n, name, len(c) = 2 AND regexp_matches(c[1], '{_NUMBER}') AND regexp_matches(c[2], '{_NUMBER}') AS two,
    n = 0 AND len(c) = 2 AND c[1] <> '' AND c[2] <> '' AND NOT regexp_matches(c[1], '{_NUMBER}') AND NOT regexp_matches(c[2], '{_NUMBER}') AS header, c FROM cols),
fits AS (SELECT k, name FROM told GROUP BY k, name HAVING coalesce(bool_and(two) FILTER (NOT header), TRUE)),
found AS (SELECT k, count(*) AS n_found, any_value(name) AS name FROM fits GROUP BY k),
points AS (SELECT k, CASE WHEN regexp_matches(c[1], '(?i)infinity|nan') THEN NULL ELSE try_cast(c[1] AS DOUBLE) END AS f, CASE WHEN regexp_matches(c[2], '(?i)infinity|nan') THEN NULL ELSE try_cast(c[2] AS DOUBLE) END AS db FROM told JOIN found USING (k, name) WHERE n_found = 1 AND NOT header),
read AS (SELECT k, bool_and(f IS NOT NULL AND db IS NOT NULL AND abs(f) < 'Infinity'::DOUBLE AND abs(db) < 'Infinity'::DOUBLE) AS finite, bool_and(f > 0) AS positive, count(DISTINCT (f, db)) AS n, count(DISTINCT f) AS n_f, min(f) AS lo, max(f) AS hi FROM points GROUP BY k),
judged AS (
    SELECT k, len(lines) AS n_lines, name, n, lo, hi,
           CASE WHEN len(lines) = 0 THEN 'validation: no numeric data' WHEN n_found IS NULL THEN 'parse: malformed rows or columns' WHEN n_found > 1 THEN 'parse: ambiguous delimiter' WHEN NOT coalesce(finite, TRUE) THEN 'validation: numbers must be finite'
                WHEN NOT coalesce(positive, TRUE) THEN 'validation: frequencies must be positive' WHEN n <> n_f THEN 'validation: a frequency has conflicting levels' WHEN coalesce(n, 0) < 2 THEN 'validation: two points at least are needed' END AS error
    FROM cleaned LEFT JOIN found USING (k) LEFT JOIN read USING (k)),
prose AS (
    SELECT 'documents' AS origin, id, lang, source, sha256(text) AS digest, n_lines, CASE WHEN error IS NULL THEN 'curve' ELSE 'rejected' END AS verdict, string_split(error, ': ')[1] AS category, string_split(error, ': ')[2] AS message,
           CASE WHEN error IS NULL THEN name END AS delimiter, CASE WHEN error IS NULL THEN n END AS n_points, CASE WHEN error IS NULL THEN lo END AS lo_hz, CASE WHEN error IS NULL THEN hi END AS hi_hz, CAST(NULL AS BIGINT) AS n_filters
    FROM raw JOIN judged USING (k)),
"""
_CURVES = rf"""{bridge.SQL['first_of']}, {bridge.SQL['points'].replace('points AS', 'curve_points AS')},
lines_of AS (SELECT curve_id, curve_id % 4 AS d, idx, f, db, list_extract([chr(9), ';', ',', '  '], CAST(curve_id % 4 + 1 AS BIGINT)) AS b FROM curve_points),
curve_texts AS (SELECT curve_id, any_value(d) AS d, count(*) AS n, min(f) AS lo, max(f) AS hi, concat('# curve', chr(13), chr(10), 'Frequency', any_value(b), 'dB', chr(13), chr(10),
    string_agg(concat(CAST(CAST(f AS DECIMAL(20, 6)) AS VARCHAR), b, CASE WHEN curve_id % 11 = 0 AND idx = 5 THEN 'Infinity' ELSE CAST(CAST(db AS DECIMAL(20, 6)) AS VARCHAR) END, CASE WHEN curve_id % 10 = 0 AND idx = 63 THEN concat(b, '1') ELSE '' END), chr(13) || chr(10) ORDER BY idx), chr(10)) AS text FROM lines_of GROUP BY curve_id),
curves AS (SELECT 'curves' AS origin, CAST(curve_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS source, sha256(text) AS digest, n + 1 AS n_lines, CASE WHEN curve_id % 10 = 0 OR curve_id % 11 = 0 THEN 'rejected' ELSE 'curve' END AS verdict,
    CASE WHEN curve_id % 10 = 0 THEN 'parse' WHEN curve_id % 11 = 0 THEN 'validation' END AS category, CASE WHEN curve_id % 10 = 0 THEN 'malformed rows or columns' WHEN curve_id % 11 = 0 THEN 'numbers must be finite' END AS message,
    CASE WHEN curve_id % 10 <> 0 AND curve_id % 11 <> 0 THEN CASE d WHEN 0 THEN 'tab' WHEN 1 THEN 'semicolon' WHEN 2 THEN 'comma' ELSE 'whitespace' END END AS delimiter, CASE WHEN curve_id % 10 <> 0 AND curve_id % 11 <> 0 THEN n END AS n_points,
    CASE WHEN curve_id % 10 <> 0 AND curve_id % 11 <> 0 THEN lo END AS lo_hz, CASE WHEN curve_id % 10 <> 0 AND curve_id % 11 <> 0 THEN hi END AS hi_hz, CAST(NULL AS BIGINT) AS n_filters FROM curve_texts),
"""
_PRESETS = rf"""{bridge.SQL['filters']}{fq.TEXTS_SQL},
presets AS (SELECT 'presets' AS origin, CAST(preset_id AS VARCHAR) AS id, CAST(NULL AS VARCHAR) AS lang, CAST(NULL AS VARCHAR) AS source, sha256(text) AS digest, 1 + coalesce(n, 0) AS n_lines, CASE WHEN n > 0 THEN 'filters' ELSE 'rejected' END AS verdict,
    CASE WHEN n IS NULL THEN 'parse' END AS category, CASE WHEN n IS NULL THEN 'malformed rows or columns' END AS message, CAST(NULL AS VARCHAR) AS delimiter, CAST(NULL AS BIGINT) AS n_points, CAST(NULL AS DOUBLE) AS lo_hz, CAST(NULL AS DOUBLE) AS hi_hz, n AS n_filters
    FROM texts LEFT JOIN (SELECT preset_id, count(*) AS n FROM e GROUP BY preset_id) USING (preset_id))
SELECT * FROM prose UNION ALL SELECT * FROM curves UNION ALL SELECT * FROM presets"""
JOB1_SQL += _CURVES + _PRESETS

_STEPPED = f"""stepped AS (SELECT h.preset_id, h.ordinal, o.enabled, o.type, h.f, h.gain + 0.0e0 AS gain, h.q FROM ({fq.HALF_UP_SQL.replace('FROM off', 'FROM filters')}) AS h JOIN filters AS o USING (preset_id, ordinal))"""
_LABEL = "CASE type WHEN 'PK' THEN 'PK' WHEN 'LS' THEN 'LSC' ELSE 'HSC' END"
_TENTHS = lambda x: f"concat(CASE WHEN {x} < 0 THEN '-' ELSE '' END, CAST(round(abs({x}) * 10) AS BIGINT) // 10, '.', CAST(round(abs({x}) * 10) AS BIGINT) % 10)"
_LINE = f"concat('Filter ', n, ': ON ', {_LABEL}, ' Fc ', CAST(round(f) AS BIGINT), ' Hz Gain ', {_TENTHS('gain')}, ' dB Q ', printf('%.3f', q))"
JOB2_SQL = with_views("filters", _STEPPED, dsp.GRID958, dsp.coefficients("coefs", "stepped", "preset_id, ordinal, enabled"), dsp.LEVELS, dsp.CASCADE, dsp.PAIRS) + f""",
heads AS (SELECT o_orderkey AS preset_id, o_custkey AS owner, trim(concat('eqspark ', o_orderkey, ' ', coalesce(o_orderpriority, ''))) AS name, coalesce(strftime(o_orderdate, '%Y-%m'), 'none') AS month FROM orders WHERE o_orderkey IN (SELECT preset_id FROM filters)),
per AS (SELECT preset_id, count(*) AS filter_count, count(*) FILTER (enabled) AS enabled, coalesce(bool_and(f BETWEEN 20 AND 20000 AND gain BETWEEN -15 AND 15 AND q BETWEEN 0.1 AND 12), FALSE) AND count(*) <= 64 AS valid FROM stepped GROUP BY preset_id),
boost AS (SELECT preset_id, greatest(max(db), 0e0) AS boost FROM cascade GROUP BY preset_id),
found AS (SELECT preset_id, count(*) FILTER (score >= 0.35 AND score < 0.65) AS moderate, count(*) FILTER (score >= 0.65) AS strong FROM pairs GROUP BY preset_id),
e AS (SELECT *, row_number() OVER (PARTITION BY preset_id ORDER BY ordinal) AS n FROM stepped WHERE enabled),
lines AS (SELECT preset_id, string_agg({_LINE}, chr(13) || chr(10) ORDER BY n) AS body FROM e GROUP BY preset_id),
keys AS (SELECT preset_id, sha256(string_agg(concat_ws('|', type, CAST(CAST(round(f * 1000) AS BIGINT) AS VARCHAR), CAST(CAST(round(gain * 10) AS BIGINT) AS VARCHAR), CAST(CAST(round(q * 100) AS BIGINT) AS VARCHAR), enabled), ';' ORDER BY type, round(f * 1000), round(gain * 10), round(q * 100), enabled)) AS sig FROM stepped GROUP BY preset_id),
whole AS (SELECT h.preset_id, owner, name, filter_count, enabled, valid, -ceil(boost * 10 - 1e-6) / 10 + 0.0e0 AS preamp_db, round(boost, 6) + 0.0e0 AS boost_db, coalesce(moderate, 0) AS moderate, coalesce(strong, 0) AS strong, sig, body, month, min(h.preset_id) OVER (PARTITION BY month, sig) AS first
    FROM heads AS h JOIN per USING (preset_id) JOIN boost USING (preset_id) JOIN keys USING (preset_id) LEFT JOIN found USING (preset_id) LEFT JOIN lines USING (preset_id))
SELECT preset_id, owner, name, filter_count, enabled, valid, preamp_db, boost_db, moderate, strong, sig, CASE WHEN first <> preset_id THEN first END AS twin_of, concat_ws(chr(13) || chr(10), concat('Preamp: ', {_TENTHS('preamp_db')}, ' dB'), body) AS text, month FROM whole"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"job1_import_texts": job1_import_texts, "job2_preset_catalog": job2_preset_catalog}


def oracle_sql() -> dict[str, str]:
    return {"job1_import_texts": JOB1_SQL, "job2_preset_catalog": JOB2_SQL}
