"""SQL of the twins for resampling intervals and tails of distributions."""

from __future__ import annotations

_DIGEST = "CAST((CAST(('0x'||substr(md5({key}),{at},8)) AS UBIGINT) % {mod}) AS BIGINT)"
#: Poisson(1) by inverse distribution.
_W = "CASE WHEN u<0.36787944117 THEN 0 WHEN u<0.73575888234 THEN 1 WHEN u<0.91969860293 THEN 2 WHEN u<0.98101184312 THEN 3 WHEN u<0.99634015317 THEN 4 WHEN u<0.99940581518 THEN 5 ELSE 6 END"


def unit_sql(keys: str, units: int = 500) -> str:
    """The unit of a row by its keys."""
    return _DIGEST.format(key=f"concat_ws('|', {keys})", at=1, mod=units)


def replicates_sql(units: str, group: str, unit: str, top: str, bottom: str, reps: int, seed: int) -> str:
    """(group, b, s) from one row a unit."""
    key = f"concat_ws('|', '{seed}', CAST({unit} AS STRING))"
    ks = ", ".join(f"{_DIGEST.format(key=key, at=1 + 8 * i, mod=2147483647)} AS k{i}" for i in range(3))
    by = f"{group}, " if group else ""
    return f"""SELECT {by}b, sum(w*t)/nullif(sum(w*n), 0) AS s FROM (SELECT *, {_W} AS w FROM (SELECT *, ((k0 + k1*b + k2*b*b) % 2147483647)/2147483647.0e0 AS u
        FROM (SELECT {by}CAST({top} AS DOUBLE) AS t, CAST({bottom} AS DOUBLE) AS n, {ks} FROM ({units})), (SELECT unnest(range(0, {reps})) AS b))) GROUP BY ALL"""


def bounds_sql(units: str, group: str, unit: str = "unit", top: str = "total", bottom: str = "n", reps: int = 2000, seed: int = 0, lo: str = "ci_low", hi: str = "ci_high") -> str:
    """(group, lo, hi)."""
    by = f"{group}, " if group else ""
    return f"SELECT {by}round(quantile_cont(s, 0.025), 6) AS {lo}, round(quantile_cont(s, 0.975), 6) AS {hi} FROM ({replicates_sql(units, group, unit, top, bottom, reps, seed)}) GROUP BY ALL"


def ratio_sql(units: str, group: str, unit: str, top: str, bottom: str, reps: int, seed: int) -> str:
    """(group, n_units, estimate, lo, hi)."""
    point = f"SELECT {group}, count(*) AS n_units, round(sum({top})/nullif(sum({bottom}), 0), 6) AS estimate FROM ({units}) GROUP BY ALL"
    return f"SELECT * FROM ({point}) JOIN ({bounds_sql(units, group, unit, top, bottom, reps, seed, 'lo', 'hi')}) USING ({group})"


def sums_sql(rows: str, group: str, value: str, keys: str, scale: float = 100.0, units: int = 500) -> str:
    """(group, unit, total, n): rows dealt to units."""
    by = f"{group}, " if group else ""
    return f"SELECT {by}{unit_sql(keys, units)} AS unit, sum({scale}e0*({value})) AS total, count(*) AS n FROM ({rows}) WHERE ({value}) IS NOT NULL GROUP BY ALL"


def _simpson(f: str, lo: str, step: str, points: int) -> str:
    """Simpson's rule for ``f`` of ``x`` from ``lo`` over ``points`` steps (an even number)."""
    weight = f"CASE WHEN i = 0 OR i = {points} THEN 1 WHEN i % 2 = 1 THEN 4 ELSE 2 END"
    return f"({step}/3*list_sum(list_transform(range(0, {points + 1}), lambda i: {weight}*{f.format(x=f'({lo} + i*{step})')})))"


def tail_sql(t: str, df: str, points: int = 2000) -> str:
    """Two-sided p of Student's t by Simpson's rule over the angle whose tangent is t / sqrt(df)."""

    def part(lo: str) -> str:
        return _simpson(f"pow(cos({{x}}), ({df}) - 1)", lo, f"((least(pi()/2, {lo} + 40/sqrt({df})) - {lo})/{points})", points)

    return f"({part(f'atan(abs({t})/sqrt({df}))')}/{part('0.0e0')})"


def normal_tail_sql(z: str, points: int = 2000) -> str:
    """Two-sided p of a standard normal value by Simpson's rule."""
    return f"(sqrt(2/pi())*{_simpson('exp(-pow({x}, 2)/2)', f'abs({z})', f'(12.0e0/{points})', points)})"


def average_rank_sql(group: str, x: str) -> str:
    return f"rank() OVER (PARTITION BY {group} ORDER BY {x}) + (count(*) OVER (PARTITION BY {group}, {x}) - 1)/2.0e0"


def t_table_sql(ctes: str, rows: str, group: str) -> str:
    """One-sample t: n, mean, sd, sem, p and the interval, from ``rows`` with ``group``, n, mean, sd; the quantile by bisection."""
    over = tail_sql("((lo+hi)/2)", "(n-1)", 1000) + " > 0.05"
    p = tail_sql("(mean/(sd/sqrt(n)))", "(n-1)")
    return f"""WITH RECURSIVE {ctes + ',' if ctes else ''} g AS ({rows}), h AS (SELECT *, 0.0e0 AS lo, 1.0e4 AS hi, 0 AS step FROM g WHERE n > 1
        UNION ALL SELECT {group}, n, mean, sd, CASE WHEN {over} THEN (lo+hi)/2 ELSE lo END, CASE WHEN {over} THEN hi ELSE (lo+hi)/2 END, step + 1 FROM h WHERE step < 48),
        q AS (SELECT {group}, (lo+hi)/2 AS q FROM h WHERE step = 48)
        SELECT {group}, n, round(mean, 6) AS mean, round(sd, 6) AS sd, round(sd/sqrt(n), 6) AS sem, round(CASE WHEN sd > 0 THEN {p} END, 6) AS p, round(mean - q*sd/sqrt(n), 4) AS ci_low, round(mean + q*sd/sqrt(n), 4) AS ci_high FROM g LEFT JOIN q USING ({group})"""
