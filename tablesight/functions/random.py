"""Deterministic, partition-independent random numbers from md5 (no ``rand``/``randn``).

A uniform in (0, 1) is the first 52 bits of ``md5(part:part:...)`` plus one half,
divided by 2^52; a normal draw is Box-Muller on two such uniforms. The same
numbers come out on any cluster layout and in any engine with ``md5``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_52 = 4503599627370496.0


def hash_uniform(*parts: Column) -> Column:
    h = F.md5(F.concat_ws(":", *[p.cast("string") for p in parts]))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("bigint") + F.lit(0.5)) / F.lit(TWO_52)


def hash_normal(*parts: Column, salt: str = "") -> Column:
    u1 = hash_uniform(*parts, F.lit(f"{salt}1"))
    u2 = hash_uniform(*parts, F.lit(f"{salt}2"))
    return F.sqrt(F.lit(-2.0) * F.log(u1)) * F.cos(F.lit(2 * math.pi) * u2)


def duck_uniform(*parts_sql: str) -> str:
    """The same uniform as DuckDB SQL text (for oracles)."""
    cat = "concat_ws(':', " + ", ".join(f"CAST({p} AS VARCHAR)" for p in parts_sql) + ")"
    return f"((CAST('0x' || substr(md5({cat}), 1, 13) AS BIGINT) + 0.5) / {TWO_52})"


def duck_normal(*parts_sql: str, salt: str = "") -> str:
    u1 = duck_uniform(*parts_sql, f"'{salt}1'")
    u2 = duck_uniform(*parts_sql, f"'{salt}2'")
    return f"(sqrt(-2.0 * ln({u1})) * cos(2 * pi() * {u2}))"
