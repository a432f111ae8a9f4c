"""The isolation forest in SQL: the same draws, trees and walks, level by level."""

from __future__ import annotations

import math

from wearline.operators.iforest import CONTAMINATION, SAMPLE, TREES

_SPAN = "4503599627370496.0::DOUBLE"


def _digest(*parts: object) -> str:
    text = " || ':' || ".join(f"({p})::VARCHAR" for p in parts)
    return f"('0x' || substr(md5({text}), 1, 13))::BIGINT"


def _mean_path(n: str) -> str:
    return (
        f"CASE WHEN {n} > 2 THEN 2 * (ln({n} - 1) + 0.5772156649015329::DOUBLE) - 2 * ({n} - 1)::DOUBLE / {n} "
        f"WHEN {n} = 2 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"
    )


def forest_ctes(width: int, *, trees: int = TREES, sample: int = SAMPLE, seed: int = 42) -> list[str]:
    """From ``marked(id, ident, x, healthy)``, with ``x`` a list of ``width`` numbers, to ``leaves(id, tree, len)``."""
    steps = [k for k in range(1, trees + 1) if math.gcd(k, trees) == 1]
    depth = (sample - 1).bit_length()
    low = ", ".join(f"min(x[{i}])" for i in range(1, width + 1))
    high = ", ".join(f"max(x[{i}])" for i in range(1, width + 1))
    ctes = [
        f"""par AS MATERIALIZED (SELECT *, CASE WHEN size > 2 THEN length(bin(size - 1)) ELSE 1 END AS depth,
  {trees} * least(1.0::DOUBLE, size * 1.6::DOUBLE / total) AS served
  FROM (SELECT count(*) AS total, least({sample}, count(*)) AS size FROM marked WHERE healthy) t)""",
        f"""thrown AS MATERIALIZED (SELECT x, {_digest('ident')} AS who, c AS chance, served
  FROM marked, par, range(1, {trees + 1}) r(c) WHERE healthy AND c <= ceil(served))""",
        f"""drawn AS MATERIALIZED (SELECT x, who, chance, {_digest('who', 'chance', seed + 2)} AS draw,
    ({_digest('who', seed + 1)} % {trees} + chance * ({steps})[{_digest('who', seed + 3)} % {len(steps)} + 1]) % {trees} AS tree
  FROM thrown WHERE {_digest('who', 'chance', seed)} / {_SPAN} < served / ceil(served))""",
        """l0 AS MATERIALIZED (SELECT tree, 1::BIGINT AS path, x FROM (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY draw, who, chance) AS rank FROM drawn) t, par WHERE rank <= size)""",
        f"w0 AS MATERIALIZED (SELECT id, x, t.tree, 1::BIGINT AS path FROM marked, range({trees}) t(tree))",
    ]
    for d in range(depth + 1):
        ctes += [
            f"""s{d} AS MATERIALIZED (SELECT tree, path, n, f, CASE WHEN cut >= hi[f] THEN lo[f] ELSE cut END AS cut FROM (
  SELECT *, lo[f] + {_digest(seed, 'tree', 'path', "'cut'")} / {_SPAN} * (hi[f] - lo[f]) AS cut FROM (
    SELECT *, CASE WHEN len(varied) > 0 AND {d} < depth
      THEN varied[{_digest(seed, 'tree', 'path', "'feature'")} % len(varied) + 1] END AS f FROM (
      SELECT *, list_filter(range(1, {width + 1}), lambda i: hi[i] > lo[i]) AS varied FROM (
        SELECT tree, path, count(*) AS n, [{low}] AS lo, [{high}] AS hi FROM l{d} GROUP BY 1, 2) a) b, par) c) e)""",
            f"""h{d} AS (SELECT id, tree, {d} + {_mean_path('n')} AS len FROM w{d} JOIN s{d} USING (tree, path) WHERE f IS NULL)""",
        ]
        if d < depth:
            ctes += [
                f"l{d + 1} AS MATERIALIZED (SELECT tree, path * 2 + (x[f] > cut)::INTEGER AS path, x "
                f"FROM l{d} JOIN s{d} USING (tree, path) WHERE f IS NOT NULL)",
                f"w{d + 1} AS MATERIALIZED (SELECT id, x, tree, path * 2 + (x[f] > cut)::INTEGER AS path "
                f"FROM w{d} JOIN s{d} USING (tree, path) WHERE f IS NOT NULL)",
            ]
    union = " UNION ALL ".join(f"SELECT * FROM h{d}" for d in range(depth + 1))
    return [*ctes, f"leaves AS MATERIALIZED ({union})"]


def raw_scores(name: str = "raw", first: int = TREES) -> str:
    """Scores of the first trees, to 12 places, so that equal rows stay equal."""
    return f"""{name} AS MATERIALIZED (SELECT id, round(pow(2.0::DOUBLE, -(sum(len) / count(*)) / greatest((SELECT {_mean_path('size')} FROM par), 1e-12::DOUBLE)), 12) AS score
  FROM leaves WHERE tree < {first} GROUP BY 1)"""


OFFSET = f"""scored AS MATERIALIZED (SELECT m.*, r.score - (SELECT quantile_cont(score, {1.0 - CONTAMINATION}) FROM raw JOIN marked USING (id) WHERE healthy) AS score
  FROM marked m JOIN raw r USING (id))"""


def metrics(source: str, limit: str) -> str:
    """(roc_auc, pr_auc, tp, alerts, positives, rows) of the rows of ``source(y, score)`` at a limit."""
    return f"""(SELECT round((sum(y * r) - any_value(p) * (any_value(p) + 1) / 2.0::DOUBLE) / nullif(any_value(p) * any_value(q)::DOUBLE, 0), 6) AS roc_auc,
    round(coalesce(sum(y * tp_upto / n_upto::DOUBLE) / nullif(any_value(p), 0), 0), 6) AS pr_auc,
    sum((score >= {limit})::INTEGER * y) AS tp, sum((score >= {limit})::INTEGER) AS alerts, any_value(p) AS positives, count(*) AS rows
  FROM (SELECT y, score, sum(y) OVER () AS p, sum(1 - y) OVER () AS q,
      rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0::DOUBLE AS r,
      sum(y) OVER (ORDER BY score DESC) AS tp_upto, count(*) OVER (ORDER BY score DESC) AS n_upto
    FROM {source}) t)"""
