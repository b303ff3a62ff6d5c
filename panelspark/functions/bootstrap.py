"""Poisson bootstrap over value counts, summed inside the tasks that hold the values."""

import sys

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import functions as F

from panelspark.functions.columns import ratio
from panelspark.functions.ordering import pinned

# Executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

DRAWS, SEED = 2000, 42


def _draws(generator: np.random.Generator, origin: dict, cell: int, n: int) -> np.ndarray:
    """Poisson(n) draws of one value, from a counter-based generator keyed by the value itself.

    ``origin`` is the generator's state at its first number; setting its key costs less than a new generator.
    """
    origin["state"]["key"][:] = SEED, cell % 2**64
    generator.bit_generator.state = origin
    return generator.poisson(n, DRAWS)


def _resample(batches):
    """Poisson bootstrap sums of one task; the draws of a value are the same in any task.

    ``n`` equal baskets draw Poisson(n) together, which is the sum of n Poisson(1) draws.
    """
    sums, counts = {}, {}
    generator = np.random.Generator(np.random.Philox(key=SEED))
    origin = generator.bit_generator.state
    for batch in batches:
        for segment, part in batch.groupby("segment", sort=False):
            for start in range(0, len(part), 500):
                cells = part.iloc[start : start + 500]
                weights = np.stack([_draws(generator, origin, int(c), int(n)) for c, n in zip(cells["cell"], cells["n"])])
                values = cells["value"].to_numpy(dtype=float)
                sums[segment] = sums.get(segment, 0.0) + values @ weights
                counts[segment] = counts.get(segment, 0) + weights.sum(axis=0)
    for segment, total in sums.items():
        yield pd.DataFrame(
            {
                "segment": segment,
                "draw": np.arange(DRAWS),
                "s": total,
                "n": counts[segment].astype("float64"),
            }
        )


def bootstrap_interval(counts):
    """95% interval of (segment mean - mean of all others) from ``DRAWS`` Poisson resamples."""
    cells = counts.select(
        F.xxhash64("segment", "value").alias("cell"),
        "segment",
        F.col("value").cast("double").alias("value"),
        "n",
    )
    # An asked-for number of tasks is kept: the rows are small but the draws are not.
    tasks = int(counts.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    drawn = cells.repartition(tasks, "cell").mapInPandas(_resample, "segment string, draw int, s double, n double")
    # Both sides of the join below read these sums (one row per segment and draw); unwritten, all would be drawn twice.
    own = pinned(drawn.groupBy("segment", "draw").agg(F.sum("s").alias("s"), F.sum("n").alias("n")))
    everyone = own.groupBy("draw").agg(F.sum("s").alias("ts"), F.sum("n").alias("tn"))
    gap = ratio("s", "n") - ratio(F.col("ts") - F.col("s"), F.col("tn") - F.col("n"))
    ends = F.percentile("gap", F.array(F.lit(0.025), F.lit(0.975)))
    return (
        own.join(everyone, "draw")
        .withColumn("gap", gap)
        .groupBy("segment")
        .agg(ends.alias("p"))
        .select("segment", F.col("p")[0].alias("ci_low"), F.col("p")[1].alias("ci_high"))
    )
