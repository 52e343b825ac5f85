"""SQL for the mixing operator: sweeps by recursion, as many as the operator may take (those after the last that it takes change nothing)."""

from __future__ import annotations

from . import mixing as m


def mixing_sql() -> str:
    power = {"source": m.SOURCE_POWER, "lang": m.LANG_POWER, "topic": 1.0}
    words = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> ''))"
    ctes = [
        rf"""d AS (
    SELECT doc_id, source, lang, CAST({words} AS BIGINT) AS tokens,
           CASE WHEN regexp_matches(coalesce(text, ''), '[{{}};]\s*\n|</\w+>') THEN 'markup'
                WHEN regexp_matches(coalesce(text, ''), '\n\s*[-*•]\s') THEN 'list'
                WHEN regexp_matches(coalesce(text, ''), '\w@\w|https?://') THEN 'contact'
                WHEN regexp_matches(coalesce(text, ''), '\?') THEN 'questions'
                WHEN length(coalesce(text, '')) > 2500 THEN 'long prose' ELSE 'short prose' END AS topic
    FROM documents)""",
        "c AS (SELECT source, lang, topic, sum(tokens) AS tokens FROM d GROUP BY source, lang, topic)",
    ]
    for x in m.DIMENSIONS:
        ctes.append(f"p_{x} AS (SELECT {x}, power(CAST(sum(tokens) AS DOUBLE), {power[x]}) AS m FROM c GROUP BY {x})")
        ctes.append(f"t_{x} AS (SELECT {x} AS key_, m * (SELECT CAST(sum(tokens) AS DOUBLE) FROM c) / nullif((SELECT sum(m) FROM p_{x}), 0) AS target_{x} FROM p_{x})")
    joins = " ".join(f"JOIN t_{x} ON c.{x} IS NOT DISTINCT FROM t_{x}.key_" for x in m.DIMENSIONS)
    ctes.append(f"w0 AS (SELECT c.*, {', '.join('target_' + x for x in m.DIMENSIONS)}, CAST(tokens AS DOUBLE) AS w FROM c {joins})")
    rows = "source, lang, topic, tokens, target_source, target_lang, target_topic"
    ctes.append(f"""raked AS (
    SELECT 0 AS n, {rows}, w FROM w0
    UNION ALL
    SELECT n + 1, {rows}, coalesce(w * target_topic / nullif(sum(w) OVER (PARTITION BY topic), 0), 0) FROM (
        SELECT * REPLACE (coalesce(w * target_lang / nullif(sum(w) OVER (PARTITION BY lang), 0), 0) AS w) FROM (
            SELECT * REPLACE (coalesce(w * target_source / nullif(sum(w) OVER (PARTITION BY source), 0), 0) AS w) FROM raked WHERE n < {m.MAX_SWEEPS})))""")
    ctes.append(f"r AS (SELECT source, lang, topic, w / nullif(CAST(tokens AS DOUBLE), 0) AS ratio FROM raked WHERE n = {m.MAX_SWEEPS})")
    ctes.append("p AS (SELECT source, lang, topic, coalesce(ratio / nullif((SELECT max(ratio) FROM r), 0), 1.0) AS p FROM r)")
    u = f"CAST(CAST(concat('0x', substr(md5(concat('{m.SEED}', coalesce(CAST(doc_id AS VARCHAR), ''))), 1, 12)) AS BIGINT) AS DOUBLE) / 281474976710656.0"
    on = " AND ".join(f"d.{x} IS NOT DISTINCT FROM p.{x}" for x in m.DIMENSIONS)
    return "WITH RECURSIVE " + ",\n".join(ctes) + f"\nSELECT doc_id, tokens AS n_tokens, d.topic, round(p, 6) AS probability, {u} < p AS kept FROM d JOIN p ON {on}"
