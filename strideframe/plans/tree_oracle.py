"""DuckDB SQL of the exact trees: one block of CTEs per level, grids of all values and classes and plain windows."""

from __future__ import annotations


def _values(level: str, numeric: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT node, '{c}' AS col, {c} AS value, y FROM {level}" for c in numeric) \
        or f"SELECT node, '' AS col, CAST(NULL AS DOUBLE) AS value, y FROM {level}"


def _categories(level: str, categorical: list[str]) -> str:
    return " UNION ALL ".join(f"SELECT node, '{c}' AS col, {c} AS value, y FROM {level}" for c in categorical) \
        or f"SELECT node, '' AS col, CAST(NULL AS VARCHAR) AS value, y FROM {level}"


def _class_level(p: str, k: int, numeric: list[str], categorical: list[str]) -> str:
    return f"""
{p}t{k} AS (SELECT node, y, count(*) AS t FROM {p}a{k} GROUP BY node, y),
{p}n{k} AS (SELECT node, CAST(sum(t) AS BIGINT) AS n, CAST(sum(t * t) AS DOUBLE) AS sq, first(y ORDER BY t DESC, y) AS label,
                   CAST(NULL AS DOUBLE) AS mean,
                   (CAST(sum(t) AS DOUBLE) - CAST(sum(t * t) AS DOUBLE) / CAST(sum(t) AS DOUBLE)) / CAST(sum(t) AS DOUBLE) AS impurity
            FROM {p}t{k} GROUP BY node),
{p}nv{k} AS (SELECT node, col, value, y, count(*) AS m FROM ({_values(f'{p}a{k}', numeric)}) WHERE value IS NOT NULL
             GROUP BY node, col, value, y),
{p}v{k} AS (SELECT node, col, value, lead(value) OVER (PARTITION BY node, col ORDER BY value) AS nxt
            FROM (SELECT DISTINCT node, col, value FROM {p}nv{k})),
{p}g{k} AS (SELECT v.node, v.col, v.value, v.nxt, t.t,
                   sum(coalesce(nv.m, 0)) OVER (PARTITION BY v.node, v.col, t.y ORDER BY v.value) AS l
            FROM {p}v{k} v JOIN {p}t{k} t ON t.node = v.node
            LEFT JOIN {p}nv{k} nv ON nv.node = v.node AND nv.col = v.col AND nv.value = v.value AND nv.y = t.y),
{p}cv{k} AS (SELECT node, col, value, y, count(*) AS m FROM ({_categories(f'{p}a{k}', categorical)}) WHERE value IS NOT NULL
             GROUP BY node, col, value, y),
{p}h{k} AS (SELECT v.node, v.col, v.value, t.t, coalesce(cv.m, 0) AS r
            FROM (SELECT DISTINCT node, col, value FROM {p}cv{k}) v JOIN {p}t{k} t ON t.node = v.node
            LEFT JOIN {p}cv{k} cv ON cv.node = v.node AND cv.col = v.col AND cv.value = v.value AND cv.y = t.y),
{p}c{k} AS (SELECT node, col AS feature, col, CAST(NULL AS VARCHAR) AS category, (value + nxt) / 2 AS threshold,
                   CAST(sum(l) AS DOUBLE) AS nl, CAST(sum(t - l) AS DOUBLE) AS nr,
                   CAST(sum(l * l) AS DOUBLE) AS ql, CAST(sum((t - l) * (t - l)) AS DOUBLE) AS qr
            FROM {p}g{k} WHERE nxt IS NOT NULL GROUP BY node, col, value, nxt
            UNION ALL
            SELECT node, col || '=' || value, col, value, 0.5, CAST(sum(t - r) AS DOUBLE), CAST(sum(r) AS DOUBLE),
                   CAST(sum((t - r) * (t - r)) AS DOUBLE), CAST(sum(r * r) AS DOUBLE)
            FROM {p}h{k} GROUP BY node, col, value),
{p}o{k} AS (SELECT node, feature, col, category, threshold, round(((nl - ql / nl) + (nr - qr / nr)) / (nl + nr), 9) AS left_over
            FROM {p}c{k} WHERE nl > 0 AND nr > 0)"""


def _value_level(p: str, k: int, numeric: list[str], categorical: list[str]) -> str:
    return f"""
{p}n{k} AS (SELECT node, count(*) AS n, CAST(NULL AS VARCHAR) AS label, sum(y) / CAST(count(*) AS DOUBLE) AS mean, sum(y) AS s, sum(y * y) AS q,
                   (sum(y * y) - sum(y) * sum(y) / CAST(count(*) AS DOUBLE)) / CAST(count(*) AS DOUBLE) AS impurity FROM {p}a{k} GROUP BY node),
{p}nv{k} AS (SELECT node, col, value, count(*) AS m, sum(y) AS s, sum(y * y) AS q FROM ({_values(f'{p}a{k}', numeric)})
             WHERE value IS NOT NULL GROUP BY node, col, value),
{p}g{k} AS (SELECT node, col, (value + lead(value) OVER w) / 2 AS threshold, CAST(sum(m) OVER w AS DOUBLE) AS nl,
                   sum(s) OVER w AS sl, sum(q) OVER w AS ql
            FROM {p}nv{k} WINDOW w AS (PARTITION BY node, col ORDER BY value)),
{p}c{k} AS (SELECT g.node, col AS feature, col, CAST(NULL AS VARCHAR) AS category, threshold, nl, n.n - nl AS nr, sl, n.s - sl AS sr,
                   ql, n.q - ql AS qr
            FROM {p}g{k} g JOIN {p}n{k} n ON n.node = g.node WHERE threshold IS NOT NULL
            UNION ALL
            SELECT c.node, col || '=' || value, col, value, 0.5, n.n - c.nr, c.nr, n.s - c.sr, c.sr, n.q - c.qr, c.qr
            FROM (SELECT node, col, value, CAST(count(*) AS DOUBLE) AS nr, sum(y) AS sr, sum(y * y) AS qr
                  FROM ({_categories(f'{p}a{k}', categorical)}) WHERE value IS NOT NULL GROUP BY node, col, value) c
            JOIN {p}n{k} n ON n.node = c.node),
{p}o{k} AS (SELECT node, feature, col, category, threshold, round(((ql - sl * sl / nl) + (qr - sr * sr / nr)) / (nl + nr), 9) AS left_over
            FROM {p}c{k} WHERE nl > 0 AND nr > 0)"""


def _moved(p: str, k: int, row: str, numeric: list[str], categorical: list[str]) -> str:
    left = " ".join([f"WHEN '{c}' THEN coalesce({row}.{c} <= s.threshold, false)" for c in numeric]
                    + [f"WHEN '{c}' THEN NOT coalesce({row}.{c} = s.category, false)" for c in categorical])
    return f"CASE WHEN CASE s.col {left} END THEN 2 * {row}.node ELSE 2 * {row}.node + 1 END"


def tree_ctes(source: str, p: str, depth: int, numeric: list[str], categorical: list[str], regress: bool = False) -> str:
    """CTEs named with prefix ``p`` from the CTE ``source`` (numeric features as DOUBLE, ``y``): ``{p}nodes``."""
    features = ", ".join([*numeric, *categorical])
    out = f"{p}a0 AS (SELECT CAST(1 AS BIGINT) AS node, {features}, y FROM {source} WHERE y IS NOT NULL)"
    level = _value_level if regress else _class_level
    for k in range(depth + 1):
        out += "," + level(p, k, numeric, categorical)
        last = " AND false" if k == depth else ""
        out += f""",
{p}s{k} AS (SELECT o.* EXCLUDE (rk) FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY left_over, feature, threshold) AS rk
                                           FROM {p}o{k}) o
            JOIN {p}n{k} n ON n.node = o.node WHERE rk = 1 AND round(n.impurity, 9) > 0{last})"""
        if k < depth:
            out += f""",
{p}a{k + 1} AS (SELECT {_moved(p, k, 'a', numeric, categorical)} AS node, {', '.join('a.' + c for c in [*numeric, *categorical])}, a.y
              FROM {p}a{k} a JOIN {p}s{k} s ON s.node = a.node)"""
    nodes = " UNION ALL ".join(
        f"SELECT n.node, s.feature, s.col, s.category, s.threshold, CAST(n.n AS BIGINT) AS n, n.impurity, n.label, n.mean "
        f"FROM {p}n{k} n LEFT JOIN {p}s{k} s ON s.node = n.node" for k in range(depth + 1))
    return out + f",\n{p}nodes AS ({nodes})"


def scored_ctes(source: str, p: str, depth: int, numeric: list[str], categorical: list[str], keep: str) -> str:
    """CTEs on from ``tree_ctes``: ``{p}scored`` has the columns ``keep`` of ``source``, and label and mean of each row's leaf."""
    features = ", ".join([*numeric, *categorical])
    out = f"{p}r0 AS (SELECT CAST(1 AS BIGINT) AS node, {keep}, {features} FROM {source})"
    kept = ", ".join("r." + c.strip() for c in f"{keep}, {features}".split(","))
    for k in range(depth):
        out += f""",
{p}r{k + 1} AS (SELECT CASE WHEN s.node IS NULL THEN r.node ELSE {_moved(p, k, 'r', numeric, categorical)} END AS node, {kept}
              FROM {p}r{k} r LEFT JOIN {p}s{k} s ON s.node = r.node)"""
    return out + f",\n{p}scored AS (SELECT r.*, n.label, n.mean FROM {p}r{depth} r JOIN {p}nodes n ON n.node = r.node)"
