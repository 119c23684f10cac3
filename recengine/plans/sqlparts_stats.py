"""DuckDB SQL for the descriptive-statistics oracles."""

from __future__ import annotations


def summary_select(src: str, col: str) -> str:
    """mean, sample std, min, max, median, smallest mode of ``col`` in ``src``."""
    return f"""SELECT round(avg({col}), 6) AS mean, round(stddev_samp({col}), 6) AS std,
       CAST(min({col}) AS DOUBLE) AS min, CAST(max({col}) AS DOUBLE) AS max,
       round(median({col}), 6) AS median,
       (SELECT CAST({col} AS DOUBLE) FROM {src} WHERE {col} IS NOT NULL GROUP BY {col}
        ORDER BY count(*) DESC, {col} ASC LIMIT 1) AS mode
FROM {src}"""


def fanout(rel_sql: str, a: str, b: str, relation: str) -> str:
    return f"""WITH rel AS ({rel_sql}),
  ab AS (SELECT {a}, count({b}) AS n FROM rel WHERE {a} IS NOT NULL GROUP BY {a}),
  ba AS (SELECT {b}, count({a}) AS n FROM rel WHERE {b} IS NOT NULL GROUP BY {b})
SELECT '{relation}' AS relation, '{a}->{b}' AS direction, * FROM ({summary_select('ab', 'n')})
UNION ALL
SELECT '{relation}', '{b}->{a}', * FROM ({summary_select('ba', 'n')})"""
