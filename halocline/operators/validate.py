"""Input checks: every rule in one aggregate over the table."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from halocline.errors import BrokenRule, EmptyTable, MissingColumn, MixedDimensions
from halocline.functions.divergences import Divergence, violations
from halocline.operators.assign import features_of


def check(df: DataFrame, features: str, div: Divergence | None = None, weight: str | None = None) -> DataFrame:
    """One row: rows, nulls, with_nan, with_infinite, not_positive, dimensions, outside_domain, bad_weights."""
    x = features_of(df, features)
    rows = df.select(x.alias("x"), (F.col(weight).cast("double") if weight else F.lit(1.0)).alias("w"))
    bad = violations(div, F.col("x")) if div else F.lit(False)
    return rows.agg(
        F.count("*").alias("rows"),
        F.count_if(F.col("x").isNull()).alias("nulls"),
        F.count_if(F.exists("x", F.isnan)).alias("with_nan"),
        F.count_if(F.exists("x", lambda v: F.abs(v) == float("inf"))).alias("with_infinite"),
        F.count_if(F.exists("x", lambda v: v <= 0)).alias("not_positive"),
        F.countDistinct(F.size("x")).alias("dimensions"),
        F.count_if(bad).alias("outside_domain"),
        F.count_if(~(F.col("w") >= 0) | F.col("w").isNull()).alias("bad_weights"),
    )


def require_valid(df: DataFrame, features: str, div: Divergence, weight: str | None = None) -> int:
    """Number of rows; an error that names the rule for input that cannot be clustered."""
    if features not in df.columns:
        raise MissingColumn(features, df.columns)
    r = check(df, features, div, weight).first()
    if not r["rows"]:
        raise EmptyTable
    if r["dimensions"] != 1:
        raise MixedDimensions(r["dimensions"])
    for rule in ("nulls", "outside_domain", "bad_weights"):
        if r[rule]:
            raise BrokenRule(rule, r[rule], f"divergence {div.name}, domain {div.domain}")
    return r["rows"]


#: Rows shown of each broken rule.
SAMPLES = 5


@dataclass(frozen=True)
class Report:
    """Rows checked, and for each broken rule how many rows and up to SAMPLES of them. ``a & b`` holds what both found."""

    rows: int
    broken: dict[str, int] = field(default_factory=dict)
    samples: dict[str, list] = field(default_factory=dict)

    @property
    def ok(self) -> bool:
        return not self.broken

    def __and__(self, other: Report) -> Report:
        return Report(max(self.rows, other.rows), self.broken | other.broken, self.samples | other.samples)

    def require(self) -> None:
        for rule, n in self.broken.items():
            raise BrokenRule(rule, n, f"such as {self.samples[rule]}")


def rules(df: DataFrame, features: str, div: Divergence | None = None, weight: str | None = None, dimension: int | None = None) -> dict[str, Column]:
    """Rules by name, as columns that are true where a row breaks them; callers can add their own."""
    x = features_of(df, features)
    out = {"not_null": x.isNull(), "no_nan": F.exists(x, F.isnan), "finite": F.exists(x, lambda v: F.abs(v) == float("inf"))}
    if div is not None:
        out[f"domain_{div.name}"] = violations(div, x)
    if weight is not None:
        w = F.col(weight).cast("double")
        out["weight"] = ~(w >= 0) | w.isNull() | (w == float("inf"))
    if dimension is not None:
        out["dimension"] = F.size(x) != dimension
    return out


def examine(df: DataFrame, given: Mapping[str, Column], show: str) -> Report:
    """All rules in one aggregate; column ``show`` of a few rows of each rule that is broken."""
    bad = {name: F.coalesce(c, F.lit(False)) for name, c in given.items()}
    r = df.agg(F.count("*").alias("rows"), *[F.count_if(c).alias(f"rule {name}") for name, c in bad.items()]).first()
    broken = {name: r[f"rule {name}"] for name in bad if r[f"rule {name}"]}
    return Report(r["rows"], broken, {name: [s[0] for s in df.where(bad[name]).select(show).limit(SAMPLES).collect()] for name in broken})
