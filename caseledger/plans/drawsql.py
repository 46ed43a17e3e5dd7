"""SQL twins of order-independent means and of the bootstrap draws."""

from __future__ import annotations

from ..functions import constants as k
from ..operators import resample as rs

REPLICATES = k.BOOTSTRAP_REPLICATES


def hash_sql(parts: str) -> str:
    return f"CAST('0x' || substr(md5({parts}), 1, 8) AS BIGINT)"


def _mix(rows: str, x: str, out: str) -> str:
    """SQL of ``mix32``: the rows with one more column."""
    for at, (shift, factor) in enumerate(((16, 0x7FEB352D), (15, 0x45D9F3B), (16, 1))):
        rows, x = f"SELECT *, {x} AS {out}{at} FROM ({rows})", f"(xor({out}{at}, {out}{at} >> {shift}) * {factor}) & 4294967295"
    return f"SELECT *, {x} AS {out} FROM ({rows})"


def draws_sql(source: str, identity: str, strata: str, label: str, columns: str, name: str = "w", seed: int = k.SEED) -> str:
    """SQL of the draws: ``name(r, w, columns)``, one or two rows a unit and replicate.
    ``strata`` is one column or empty, ``columns`` those that metrics read."""
    own = strata or "1"
    limits = ", ".join(f"list_extract({[rs.poisson_limits(g)[j] for g in range(rs.LEVELS + 1)]}::BIGINT[], lv) AS l{j}" for j in range(rs.MOST))
    level = " + ".join(f"(n_ >= {rs.least_units(g)})::INT" for g in range(1, rs.LEVELS + 1))
    count = " + ".join(f"(u_ >= l{j})::INT" for j in range(rs.MOST))
    beside = _mix(_mix(f"SELECT * FROM num_{name}, rep_{name} WHERE l0 < 4294967296", "(a_ + k_) & 4294967295", "h_"), "xor(h_, b_)", "u_")
    places = _mix(_mix(_mix(f"SELECT *, unnest(range(1, m_ + 1)) AS j_ FROM miss_{name}", "(j_ * 2654435769 + k_) & 4294967295", "h_"), "xor(h_, k_)", "u_"),
                  "(u_ + 1) & 4294967295", "v_")
    keys = f"SELECT {own} AS g_, {columns}, "
    return f""", num_{name} AS ({keys} i_, n_, CAST('0x' || substr(d_, 1, 8) AS BIGINT) AS a_, CAST('0x' || substr(d_, 9, 8) AS BIGINT) AS b_, {limits}
  FROM (SELECT *, 1 + {level} AS lv FROM (SELECT *, row_number() OVER (PARTITION BY {own} ORDER BY {hash_sql(f"'|' || {identity}")}, {identity}) - 1 AS i_,
   count(*) OVER (PARTITION BY {own}) AS n_, md5('{seed}|' || {label} || '|' || {identity}) AS d_ FROM {source}))),
rep_{name} AS ({_mix(f"SELECT unnest(range(1, {REPLICATES + 1})) AS r", f"(r * 2654435769 + {seed}) & 4294967295", "k_")}),
t_{name} AS (SELECT g_, r, CAST(sum(w) AS BIGINT) AS t_ FROM (SELECT g_, r, {count} AS w FROM ({beside})) GROUP BY 1, 2),
miss_{name} AS (SELECT g_, r, k_, n_, t_ > n_ AS over_, CASE WHEN t_ > n_ THEN n_ ELSE n_ - coalesce(t_, 0) END AS m_
  FROM (SELECT g_, count(*) AS n_ FROM num_{name} GROUP BY 1) CROSS JOIN rep_{name} LEFT JOIN t_{name} USING (g_, r)),
{name} AS (SELECT r, w, {columns} FROM (SELECT *, {count} AS w FROM ({beside})) d
  WHERE w > 0 AND NOT EXISTS (SELECT 1 FROM miss_{name} m WHERE over_ AND m.g_ = d.g_ AND m.r = d.r)
 UNION ALL SELECT r, 1 AS w, {columns} FROM (SELECT g_, r, ((h_ & 1073741823) * 4294967296 + v_) % n_ AS i_ FROM ({places})) JOIN num_{name} USING (g_, i_))"""


def exact(x: str) -> str:
    """SQL of a measure in whole billionths."""
    return f"CAST(round({x} * 1000000000.0::DOUBLE) AS BIGINT)"


def mean_sql(x: str, where: str = "") -> str:
    """SQL of ``steady_mean``."""
    only = f" FILTER (WHERE {where})" if where else ""
    return f"((sum({exact(x)}){only})::DOUBLE / count({x}){only} / 1000000000)"


def drawn_mean(x: str) -> str:
    """SQL of the weighted mean of a measure in billionths over the rows that have it."""
    return f"(sum(w * {x})::DOUBLE / sum(w) FILTER (WHERE {x} IS NOT NULL) / 1000000000)"
