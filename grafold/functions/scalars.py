"""Column functions shared by all operators. Hash uniforms use md5, which every SQL engine has."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MASK64 = (1 << 64) - 1
#: Fixed values of the SplitMix64 step and finaliser (public algorithm).
GOLDEN, MIX1, MIX2 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def trial_seed(seed: int, trial: int) -> int:
    """The seed of a trial: SplitMix64's finaliser of seed + trial steps."""
    z = (seed + trial * GOLDEN) & MASK64
    z = ((z ^ (z >> 30)) * MIX1) & MASK64
    z = ((z ^ (z >> 27)) * MIX2) & MASK64
    return z ^ (z >> 31)


def hash_long(*parts: Column | str | int) -> Column:
    """52 bits of the md5 of the parts joined by colons, as a long."""
    text = F.concat_ws(":", *(F.lit(str(p)) if isinstance(p, int) else (F.col(p) if isinstance(p, str) else p).cast("string") for p in parts))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


def uniform(*parts: Column | str | int) -> Column:
    """A number in (0, 1) fixed by the parts."""
    return (hash_long(*parts).cast("double") + 0.5) / float(1 << 52)


def strict(weight: Column) -> Column:
    """Finite and above zero; never null."""
    return F.coalesce((weight > 0) & ~F.isnan(weight) & (weight < float("inf")), F.lit(False))


def non_strict(value: Column) -> Column:
    """Finite and not below zero; never null."""
    return F.coalesce((value >= 0) & ~F.isnan(value) & (value < float("inf")), F.lit(False))


def canonical(df: DataFrame, u: str = "u", v: str = "v") -> DataFrame:
    """Adds src <= dst of an unordered pair."""
    return df.withColumns({"src": F.least(u, v), "dst": F.greatest(u, v)})
