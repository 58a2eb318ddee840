"""Small numeric column expressions."""

from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

EPSILON = 1e-4  # share used for an empty bin; a fixed value of the statistic


def r6(col: Column | str, digits: int = 6) -> Column:
    """Round for reports; never yields a negative zero."""
    return F.round(F.col(col) if isinstance(col, str) else col, digits)


def kolmogorov_p(d: Column, n: Column, m: Column, terms: int = 100) -> Column:
    """Asymptotic two-sample p-value, clipped to [0, 1]; 1 for a vanishing statistic."""
    lam = d * F.sqrt(n.cast("double") * m / (n + m))
    series = F.aggregate(
        F.sequence(F.lit(1), F.lit(terms)), F.lit(0.0),
        lambda acc, k: acc + F.when(k % 2 == 1, 1.0).otherwise(-1.0) * F.exp(F.lit(-2.0) * k * k * lam * lam))
    return F.when(lam < 0.04, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), series * 2.0)))


def psi_of(ref_counts: Column, curr_counts: Column, ref_n: Column, curr_n: Column) -> Column:
    """Population stability index of two aligned count arrays; empty cells take EPSILON."""
    def share(c: Column, n: Column) -> Column:
        return F.when(c == 0, F.lit(EPSILON)).otherwise(c / n)

    terms = F.zip_with(curr_counts, ref_counts,
                       lambda c, r: (share(c, curr_n) - share(r, ref_n)) * F.ln(share(c, curr_n) / share(r, ref_n)))
    return F.aggregate(terms, F.lit(0.0), lambda acc, x: acc + x)


def normal_cut(delta: float) -> float:
    """Two-sided normal threshold."""
    return NormalDist().inv_cdf(1 - delta / 2)


def hoeffding_bound(n: Column, confidence: float) -> Column:
    return F.sqrt(F.lit(math.log(2.0 / confidence)) / (F.lit(2.0) * n))
