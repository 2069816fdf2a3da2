"""DuckDB SQL of the URL filter, from the same definitions."""

from __future__ import annotations

from collections.abc import Sequence

from flowtide.llm.urls import ALL_HOSTS, LOWER, MICRO, PARTS, RULES, STEP, SYMBOLS, UPPER, Rule


def judge_sql(rules: Sequence[Rule] = RULES, order: int = 4) -> str:
    by_length = sorted(rules, key=lambda r: (-len(r.text), r.text))
    fits = lambda r: f"(host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}')"
    rule = "CASE " + " ".join(f"WHEN {fits(r)} THEN '{r.text}'" for r in by_length) + " END"
    label = "CASE rule " + " ".join(f"WHEN '{r.text}' THEN '{r.verdict}'" for r in rules) + " END"
    longest = order + 1
    joins = " ".join(
        f"LEFT JOIN counts c{k} ON c{k}.model = w.model AND c{k}.tail = right(w.gram, {k}) "
        f"LEFT JOIN contexts x{k} ON x{k}.model = w.model AND x{k}.k = {k} AND x{k}.context = left(right(w.gram, {k}), {k - 1})"
        for k in range(1, longest + 1)
    )

    def chain(c: str) -> str:
        """The interpolation as nested selects, one order each."""
        columns = ", ".join(
            f"coalesce(c{k}.{c}, 0) AS n{k}, coalesce(x{k}.{c}_all, 0) AS a{k}, coalesce(x{k}.{c}_next, 0) AS t{k}" for k in range(1, longest + 1)
        )
        inner = f"SELECT w.model, w.gram, 1.0::DOUBLE / {SYMBOLS} AS p0, {columns} FROM wanted w {joins}"
        for k in range(1, longest + 1):
            inner = f"SELECT *, CASE WHEN a{k} + t{k} > 0 THEN (n{k} + t{k} * p{k - 1}) / (a{k} + t{k}) ELSE p{k - 1} END AS p{k} FROM ({inner})"
        return f"SELECT model, gram, p{longest} AS p FROM ({inner})"

    return f"""
WITH raw AS (
    SELECT page_id, coalesce(url, '') AS url FROM pages
), parsed AS (
    SELECT *, translate(regexp_extract(url, '{PARTS}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(url, '{PARTS}', 2) AS path FROM raw
), ruled AS (
    SELECT *, {rule} AS rule FROM parsed
), urls AS (
    SELECT url, label, CASE WHEN rule IS NULL THEN {ALL_HOSTS} WHEN left(md5(host), 1) < '8' THEN 0 ELSE 1 END AS model,
        repeat(chr(2), {order}) || url || chr(3) AS padded
    FROM (SELECT DISTINCT url, host, rule, {label} AS label FROM ruled)
), grams AS (
    SELECT url, label, model, substr(padded, i, {longest}) AS gram
    FROM (SELECT *, unnest(range(1, length(padded) - {order} + 1)) AS i FROM urls)
), seen AS (
    SELECT m.model, g.label, g.gram, count(*) AS n FROM grams g JOIN range({ALL_HOSTS + 1}) m(model) ON m.model <> g.model
    WHERE g.label IS NOT NULL GROUP BY ALL
), counts AS (
    SELECT model, k, right(gram, k) AS tail, CAST(coalesce(sum(n) FILTER (label = 'allow'), 0) AS BIGINT) AS allow,
        CAST(coalesce(sum(n) FILTER (label = 'block'), 0) AS BIGINT) AS block
    FROM (SELECT *, unnest(range(1, {longest + 1})) AS k FROM seen) GROUP BY ALL
), contexts AS (
    SELECT model, k, left(tail, k - 1) AS context, CAST(sum(allow) AS BIGINT) AS allow_all, CAST(sum(block) AS BIGINT) AS block_all,
        count(*) FILTER (allow > 0) AS allow_next, count(*) FILTER (block > 0) AS block_next
    FROM counts GROUP BY ALL
), wanted AS (
    SELECT DISTINCT model, gram FROM grams
), allowing AS ({chain('allow')}), blocking AS ({chain('block')}), ratios AS (
    SELECT a.model, a.gram, CAST(round((ln(a.p) - ln(b.p)) * {MICRO}) AS BIGINT) AS ratio FROM allowing a JOIN blocking b USING (model, gram)
), scored AS (
    SELECT url, label, CAST(sum(ratio) AS BIGINT)::DOUBLE / count(*) AS score, CAST(floor(CAST(sum(ratio) AS BIGINT)::DOUBLE / count(*) / {STEP}) AS BIGINT) AS step
    FROM grams JOIN ratios USING (model, gram) GROUP BY url, label
), steps AS (
    SELECT step, count(*) FILTER (label = 'allow') AS allow, count(*) FILTER (label = 'block') AS block FROM scored WHERE label IS NOT NULL GROUP BY step
), gains AS (
    SELECT step, sum(allow) OVER () AS allowed, sum(block) OVER () AS blocked, coalesce(sum(allow) OVER w, 0) AS lost, coalesce(sum(block) OVER w, 0) AS caught,
        least(step, greatest(coalesce(lag(step) OVER (ORDER BY step) + 1, step), 0)) AS nearest
    FROM steps WINDOW w AS (ORDER BY step ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), cut AS (
    SELECT nearest AS least FROM gains WHERE allowed > 0 AND blocked > 0 ORDER BY caught * allowed - lost * blocked DESC, abs(nearest), nearest LIMIT 1
)
SELECT page_id, host, path, rule,
    coalesce({label}, CASE WHEN s.step < (SELECT least FROM cut) THEN 'block' ELSE 'allow' END) AS verdict,
    CASE WHEN rule IS NULL THEN s.score END AS score
FROM ruled r LEFT JOIN scored s ON r.url = s.url AND r.rule IS NULL
"""
