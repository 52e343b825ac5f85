"""SQL for the quality rules, written apart from the operator: covariances by the engine's own aggregates, distances by elimination."""

from __future__ import annotations

from . import quality_rules as q

K = range(5)
KEY = "level, g_lang, g_source"


def _chain(name: str, source: str, steps: list[str]) -> list[str]:
    """CTEs that add the columns of each step to those before."""
    out, last = [], source
    for i, step in enumerate(steps):
        here = name if i == len(steps) - 1 else f"{name}_{i}"
        out.append(f"{here} AS MATERIALIZED (SELECT *, {step} FROM {last})")
        last = here
    return out


def _elimination() -> list[str]:
    """Unit lower factor u and pivots p of the covariances k{i}{j}: one column after the other."""
    steps = []
    for j in K:
        steps.append(f"k{j}{j}" + "".join(f" - u{j}{m} * u{j}{m} * p{m}" for m in range(j)) + f" AS p{j}")
        rest = [f"(k{i}{j}" + "".join(f" - u{i}{m} * u{j}{m} * p{m}" for m in range(j)) + f") / p{j} AS u{i}{j}" for i in K if i > j]
        if rest:
            steps.append(", ".join(rest))
    return steps


PIVOTS = [f"p{j}" for j in K] + [f"u{i}{j}" for i in K for j in range(i)]
MEANS = [f"mu{j}" for j in K]
DISTANCE = " + ".join(f"e{j} * e{j} / p{j}" for j in K)


def _residuals() -> list[str]:
    return [f"v{i} - mu{i}" + "".join(f" - u{i}{m} * e{m}" for m in range(i)) + f" AS e{i}" for i in K]


def _covariances(x: str, ridge: list[str], raised: list[float] | None = None) -> str:
    out = []
    for i in K:
        for j in range(i + 1):
            value = f"covar_pop({x}{i}, {x}{j})"
            if i == j:
                value = (f"greatest({value}, {raised[i]!r})" if raised else value) + f" + {ridge[i]}"
            out.append(f"{value} AS k{i}{j}")
    return ", ".join(out)


def _step(name: str, model: str, keys: str, ridge: list[str], raised: list[float] | None = None) -> list[str]:
    """The nearest rows of each group by ``model`` and the model ``name`` of these."""
    out = [f"{name}_rows AS MATERIALIZED (SELECT {keys}, {', '.join(f'v{j}' for j in K)}, {', '.join(MEANS + PIVOTS)} FROM usable JOIN {model} USING ({KEY}))"]
    out += _chain(f"{name}_far", f"{name}_rows", _residuals())
    out += [
        f"{name}_binned AS MATERIALIZED (SELECT {keys}, {', '.join(f'v{j}' for j in K)}, CAST(floor(64 * ln(1 + {DISTANCE})) AS BIGINT) AS b FROM {name}_far)",
        f"{name}_cut AS MATERIALIZED (SELECT {keys}, quantile_disc(b, 0.75) AS cut FROM {name}_binned GROUP BY {keys})",
        f"{name}_sums AS MATERIALIZED (SELECT {keys}, {', '.join(f'avg(v{j}) AS mu{j}' for j in K)}, {_covariances('v', ridge, raised)} FROM {name}_binned JOIN {name}_cut USING ({keys}) WHERE b <= cut GROUP BY {keys})",
    ]
    return out + _chain(name, f"{name}_sums", _elimination())


def quality_rules_sql() -> str:
    floors = [1024 * x for x in (1.0, 0.15, 0.06, 0.06, 0.10)]
    squares = [x * x for x in floors]
    ridge = [repr(0.01 * x) for x in squares]
    v = ", ".join(f"v{j}" for j in K)
    space = r"[\x20\x09-\x0D]"
    ctes = [
        f"""words AS MATERIALIZED (
    SELECT row_number() OVER () AS row_id, doc_id, lang, source, coalesce(text, '') AS t,
           list_filter(string_split_regex(coalesce(text, ''), '{space}+'), lambda x: x <> '') AS w,
           list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l
    FROM documents)""",
        """windows AS (SELECT row_id, i, concat_ws(' ', w[i], w[i + 1], w[i + 2]) AS x FROM (SELECT row_id, w, unnest(range(1, len(w) - 1)) AS i FROM words))""",
        """doubled AS (SELECT row_id, i FROM (SELECT row_id, i, count(*) OVER (PARTITION BY row_id, x) AS n FROM windows) WHERE n > 1)""",
        """covered AS (SELECT row_id, count(DISTINCT i + k) AS n FROM doubled, (SELECT unnest([0, 1, 2]) AS k) GROUP BY row_id)""",
        f"""base AS MATERIALIZED (
    SELECT words.row_id, doc_id, lang, source, CAST(len(w) AS BIGINT) AS n_words,
           CAST(length(regexp_replace(t, '{space}+', '', 'g')) AS BIGINT) AS word_chars,
           CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
           CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines, CAST(coalesce(n, 0) AS BIGINT) AS n_repeat_words,
           CASE WHEN lang IS NULL THEN '0' ELSE concat('1', lang) END AS g_lang, CASE WHEN source IS NULL THEN '0' ELSE concat('1', source) END AS g_source
    FROM words LEFT JOIN covered USING (row_id))""",
        "judged AS MATERIALIZED (SELECT *, n_words < 50 OR 2 * n_repeat_words > n_words AS base_failed FROM base)",
        """vectors AS MATERIALIZED (
    SELECT row_id, g_lang, g_source, base_failed,
           CAST(round(1024 * ln(1 + n_words)) AS BIGINT) AS v0, CAST(round(1024 * sqrt(word_chars / n_words)) AS BIGINT) AS v1, CAST(round(1024 * sqrt(n_symbols / word_chars)) AS BIGINT) AS v2,
           CAST(round(1024 * sqrt(n_dup_lines / n_words)) AS BIGINT) AS v3, CAST(round(1024 * n_repeat_words / n_words) AS BIGINT) AS v4
    FROM judged WHERE n_words > 0)""",
        f"levels AS (SELECT 2 AS level, g_lang, g_source, {v} FROM vectors WHERE NOT base_failed UNION ALL SELECT 1, g_lang, '', {v} FROM vectors WHERE NOT base_failed UNION ALL SELECT 0, '', '', {v} FROM vectors WHERE NOT base_failed)",
        f"usable AS MATERIALIZED (SELECT * FROM levels JOIN (SELECT {KEY} FROM levels GROUP BY {KEY} HAVING count(*) >= 100) USING ({KEY}))",
        f"med AS (SELECT {KEY}, {', '.join(f'quantile_cont(v{j}, 0.5) AS mu{j}' for j in K)} FROM usable GROUP BY {KEY})",
        f"scales AS MATERIALIZED (SELECT {KEY}, {', '.join(f'any_value(mu{j}) AS mu{j}, greatest(1.4826 * quantile_cont(abs(v{j} - mu{j}), 0.5), {floors[j]!r}) AS d{j}' for j in K)} FROM usable JOIN med USING ({KEY}) GROUP BY {KEY})",
        f"z AS MATERIALIZED (SELECT {KEY}, {', '.join(f'(v{j} - mu{j}) / d{j} AS z{j}' for j in K)} FROM usable JOIN scales USING ({KEY}))",
        f"bent AS (SELECT {KEY}, 1 AS start, {', '.join(f'round(1024 * tanh(z{j})) / 1024 AS y{j}' for j in K)} FROM z UNION ALL SELECT {KEY}, 2, {', '.join(f'coalesce(round(1024 * z{j} / nullif(sqrt(' + ' + '.join(f'z{m} * z{m}' for m in K) + '), 0)) / 1024, 0)' for j in K)} FROM z)",
        f"scatter AS MATERIALIZED (SELECT {KEY}, start, {', '.join(f'(avg(y{i} * y{j})' + (' + 0.01' if i == j else '') + f') * any_value(d{i}) * any_value(d{j}) AS k{i}{j}' for i in K for j in range(i + 1))}, {', '.join(f'any_value(mu{j}) AS mu{j}' for j in K)} FROM bent JOIN scales USING ({KEY}) GROUP BY {KEY}, start"
        f" UNION ALL SELECT {KEY}, 0, {', '.join(f'd{i} * d{i}' if i == j else '0.0' for i in K for j in range(i + 1))}, {', '.join(MEANS)} FROM scales)",
        *_chain("first0", "scatter", _elimination()),
    ]
    for n in (1, 2):
        ctes += _step(f"first{n}", f"first{n - 1}", f"{KEY}, start", ridge)
    size = " * ".join(f"p{j}" for j in K)
    ctes.append(f"step0 AS MATERIALIZED (SELECT * FROM first2 QUALIFY row_number() OVER (PARTITION BY {KEY} ORDER BY {size}, start) = 1)")
    for n in range(1, q.MAX_STEPS + 1):
        ctes += _step(f"step{n}", f"step{n - 1}", KEY, ridge)
    ctes += _step("final", f"step{q.MAX_STEPS}", KEY, ridge, squares)
    ctes += [f"placed AS MATERIALIZED (SELECT {KEY}, {v}, {', '.join(MEANS + PIVOTS)} FROM usable JOIN final USING ({KEY}))", *_chain("placed_far", "placed", _residuals())]
    ctes += [
        f"mids AS (SELECT {KEY}, quantile_disc(CAST(floor(64 * ln(1 + {DISTANCE})) AS BIGINT), 0.5) AS mid FROM placed_far GROUP BY {KEY})",
        f"whole AS MATERIALIZED (SELECT * FROM final JOIN mids USING ({KEY}))",
        f"""chosen AS MATERIALIZED (
    SELECT v.row_id, {v}, {', '.join(MEANS + PIVOTS)}, mid FROM vectors AS v JOIN whole AS m ON (m.level = 2 AND m.g_lang = v.g_lang AND m.g_source = v.g_source) OR (m.level = 1 AND m.g_lang = v.g_lang) OR m.level = 0
    QUALIFY row_number() OVER (PARTITION BY v.row_id ORDER BY level DESC) = 1)""",
        *_chain("chosen_far", "chosen", _residuals()),
    ]
    fine = f"({DISTANCE}) * 4.351460191095526 <= 30.86 * greatest(exp((mid + 0.5) / 64) - 1, 4.351460191095526 / 2)"
    return "WITH " + ",\n".join(ctes) + f"\nSELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({fine}, TRUE) AS kept FROM judged LEFT JOIN chosen_far USING (row_id)"
