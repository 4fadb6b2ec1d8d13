"""Pieces of DuckDB SQL from which the queries' oracles are put together."""

from __future__ import annotations

from collections.abc import Sequence

from chronolens.functions.plan import KERNELS
from chronolens.operators.attribution import Feature

EMBED = "series AS (SELECT vec_id AS id, label AS y, CAST(embedding AS DOUBLE[]) AS x FROM embeddings)"

DAILY = """
day_sum AS (SELECT user_id AS id, date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, sum(coalesce(value, 0)) AS v
  FROM events WHERE user_id IS NOT NULL GROUP BY 1, 2),
day_grid AS (SELECT id, t FROM (SELECT DISTINCT id FROM day_sum WHERE t BETWEEN 0 AND 29) CROSS JOIN (SELECT unnest(range(0, 30)) AS t)),
daily AS (SELECT g.id, CAST(g.id % 3 AS INT) AS y, list(coalesce(s.v, 0.0) ORDER BY g.t) AS x
  FROM day_grid g LEFT JOIN day_sum s USING (id, t) GROUP BY 1, 2)
"""

CHANNELS = """
ch_sum AS (SELECT user_id AS id, CASE event_type WHEN 'click' THEN 0 WHEN 'error' THEN 1 WHEN 'purchase' THEN 2 WHEN 'signup' THEN 3 ELSE 4 END AS channel,
    date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS t, sum(coalesce(value, 0)) AS v
  FROM events WHERE user_id IS NOT NULL AND event_type IS NOT NULL GROUP BY 1, 2, 3),
ch_grid AS (SELECT id, channel, t FROM (SELECT DISTINCT id, channel FROM ch_sum WHERE t BETWEEN 0 AND 29) CROSS JOIN (SELECT unnest(range(0, 30)) AS t)),
channels AS (SELECT g.id, g.channel, CAST(g.id % 3 AS INT) AS y, list(coalesce(s.v, 0.0) ORDER BY g.t) AS x
  FROM ch_grid g LEFT JOIN ch_sum s USING (id, channel, t) GROUP BY 1, 2, 3)
"""

PRED = "p AS (SELECT vec_id AS id, label AS y, CASE WHEN vec_id % 3 = 0 THEN CAST((vec_id * 7 + label) % 10 AS INT) ELSE label END AS pred FROM embeddings)"

DIFF = "list_transform(range(1, len(x)), lambda i: x[i + 1] - x[i])"


def conv(taps: Sequence[int], d: int) -> str:
    """Convolution of xp (the padded xx), written as the engine writes it."""
    three = " + ".join(f"xp[t + {1 + i * d}]" for i in taps)
    nine = " + ".join(f"xp[t + {1 + k * d}]" for k in range(9))
    return f"list_transform(range(0, len(xx)), lambda t: 3 * ({three}) - ({nine}))"


def padded(source: str, d: int, rep: str = "raw", keys: str = "id, y") -> str:
    """(keys, xx, xp) of a table with (keys, x)."""
    zeros = f"list_resize(CAST([] AS DOUBLE[]), {4 * d}, 0.0)"
    return f"(SELECT {keys}, xx, {zeros} || xx || {zeros} AS xp FROM (SELECT {keys}, {'x' if rep == 'raw' else DIFF} AS xx FROM {source}))"


def conv_rows(source: str, chosen: Sequence[Feature], keys: str = "id, y") -> str:
    """Query of (keys, fi, imp, rep, d, k, b, c)."""
    return "\nUNION ALL ".join(
        f"SELECT {keys}, {f.feature_index} AS fi, CAST({f.importance} AS DOUBLE) AS imp, '{f.representation}' AS rep, {f.dilation} AS d, {f.kernel_index} AS k,"
        f" CAST({f.bias} AS DOUBLE) AS b, {conv(KERNELS[f.kernel_index], f.dilation)} AS c FROM {padded(source, f.dilation, f.representation, keys)}"
        for f in chosen
    )


def act(source: str, chosen: Sequence[Feature], shift: bool, keys: str = "id, y") -> str:
    """CTEs conv_r and act(keys, fi, imp, rep, d, k, b, t, c, a)."""
    t = "CASE WHEN rep = 'diff' THEN t + 1 ELSE t END" if shift else "t"
    return f"""conv_r AS ({conv_rows(source, chosen, keys)}),
act_r AS (SELECT {keys}, fi, imp, rep, d, k, b, unnest(c) AS c, unnest(range(0, len(c))) AS t FROM conv_r),
act AS (SELECT {keys}, fi, imp, rep, d, k, b, {t} AS t, c, CASE WHEN c > b THEN 1 ELSE 0 END AS a FROM act_r)"""


def class_mean(source: str) -> str:
    return f"""cm_pts AS (SELECT y, unnest(x) AS v, unnest(range(0, len(x))) AS t FROM {source}),
cm_avg AS (SELECT y, t, avg(v) AS m FROM cm_pts GROUP BY 1, 2),
means AS (SELECT y, list(m ORDER BY t) AS x FROM cm_avg GROUP BY 1)"""


def dim(width: int = 2016, dilations: Sequence[int] = (1, 2, 7)) -> str:
    """CTE dim of the bank for length 64, 1000 features, 32 dilations."""
    half = width // 2
    case = " ".join(f"WHEN {i} THEN {d}" for i, d in enumerate(dilations))
    return f"""dim AS (SELECT CAST(i AS INT) AS feature_index, CASE WHEN i < {half} THEN 'raw' ELSE 'diff' END AS representation,
  CAST(CASE (i % {half}) // 336 {case} END AS INT) AS dilation, CAST(((i % {half}) // 4) % 84 AS INT) AS kernel_index,
  CASE i % 4 WHEN 0 THEN 'PPV' WHEN 1 THEN 'MPV' WHEN 2 THEN 'MIPV' ELSE 'LSPV' END AS pooling_op, CAST(i % 4 AS INT) AS pooling_index,
  ((i * 7919) % 1009) / 1009.0::DOUBLE AS importance FROM range(0, {width}) r(i))"""


KERNEL_CTE = """taps AS (SELECT unnest(range(0, 9)) AS i),
kernels AS (SELECT CAST(row_number() OVER (ORDER BY a.i, b.i, c.i) - 1 AS INT) AS kernel_index, CAST(a.i AS INT) AS i0, CAST(b.i AS INT) AS i1, CAST(c.i AS INT) AS i2
  FROM taps a, taps b, taps c WHERE a.i < b.i AND b.i < c.i)"""
