"""Tail probabilities for a handful of aggregated statistics.

Spark has no error function; these run on result rows (one per group), never on data rows.
"""

import math
import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def chi_square_upper(x: float, df: int) -> float:
    """P(X >= x) for a chi-square variable with whole degrees of freedom."""
    if not (df >= 1 and math.isfinite(x)):
        return math.nan
    half = max(x, 0.0) / 2.0
    # Q(df/2, half) by upward recurrence: Q(a + 1) = Q(a) + half^a e^-half / gamma(a + 1).
    shape = 1.0 if df % 2 == 0 else 0.5
    total = math.exp(-half) if df % 2 == 0 else math.erfc(math.sqrt(half))
    while shape < df / 2.0:
        if half > 0:
            total += math.exp(shape * math.log(half) - half - math.lgamma(shape + 1.0))
        shape += 1.0
    return min(1.0, total)


def exact_rank_sum_p(u: float, n1: int, n2: int) -> float:
    """Two-sided exact p of the larger U for a small untied sample."""
    small, large = min(n1, n2), max(n1, n2)
    counts = np.ones(1)
    for i in range(1, small + 1):  # Gaussian binomial coefficient, factor by factor
        wide = np.zeros(len(counts) + large + i)
        wide[: len(counts)] += counts
        wide[large + i : large + i + len(counts)] -= counts
        for j in range(i, len(wide)):
            wide[j] += wide[j - i]
        counts = wide[: i * large + 1]
    top = int(max(u, n1 * n2 - u))
    return float(min(1.0, 2.0 * counts[top:].sum() / counts.sum()))


def rank_sum_p(u: float, n1: int, n2: int, ties: float, exact: bool = False) -> float:
    """Two-sided p: normal with tie and continuity correction, at every sample size.

    ``exact`` asks for the permutation distribution of an untied sample instead; its cost grows
    with min(n1, n2)^2 * max(n1, n2). Statistics packages switch to it by themselves for small
    samples; here the method never depends on the size of the data.
    """
    if n1 == 0 or n2 == 0:
        return math.nan
    if exact and ties == 0:
        return exact_rank_sum_p(u, n1, n2)
    n, pairs = n1 + n2, float(n1) * n2
    spread = math.sqrt(pairs / 12.0 * ((n + 1) - ties / (n * (n - 1.0))))
    if spread == 0:
        return 1.0
    z = (max(u, pairs - u) - pairs / 2.0 - 0.5) / spread
    return min(1.0, math.erfc(z / math.sqrt(2.0)))


@pandas_udf(DoubleType())
def chi_square_p(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(
        [chi_square_upper(a, int(b)) if a == a and b == b else None for a, b in zip(x, df)],
        dtype="float64",
    )


@pandas_udf(DoubleType())
def mann_whitney_p(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    rows = zip(u, n1, n2, ties)
    return pd.Series(
        [rank_sum_p(a, int(b), int(c), d) if a == a else None for a, b, c, d in rows],
        dtype="float64",
    )
