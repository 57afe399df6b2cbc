"""Rounding shared by the queries and their SQL: exact ties are pushed up by a hair on both sides, and results
that round to zero are a plain 0.0."""

from __future__ import annotations

from pyspark.sql import functions as F


def rd(c, d: int = 6, alias: str | None = None):
    x = (F.col(f"`{c}`") if isinstance(c, str) else c).cast("double")
    out = F.when(F.abs(x) < 0.5 * 10.0 ** -d, F.lit(0.0)).otherwise(F.round(x + 10.0 ** -(d + 3), d))
    name = alias or (c if isinstance(c, str) else None)
    return out.alias(name) if name else out


def rs(expr: str, d: int = 6) -> str:
    half, hair = f"5e-{d + 1}::DOUBLE", f"1e-{d + 3}::DOUBLE"
    return f"CASE WHEN abs({expr}) < {half} THEN 0.0::DOUBLE ELSE round(({expr})::DOUBLE + {hair}, {d}) END"


def r6(*names, d: int = 6):
    return [rd(n, d) for n in names]


def r6s(*names, d: int = 6):
    return ", ".join(f'''{rs(f'"{n}"', d)} AS "{n}"''' for n in names)
