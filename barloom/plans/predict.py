"""Attach user predictions to decisions."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.operators.windows import seq_context

PredictFn = Callable[[pd.DataFrame], pd.Series]


def last_return(pdf: pd.DataFrame) -> pd.Series:
    """Baseline: minus the last return of the context."""
    return pdf["context"].map(lambda rows: -float(rows[-1]["raw_ret_close"]))


def mean_return(pdf: pd.DataFrame) -> pd.Series:
    return pdf["context"].map(lambda rows: sum(float(r["raw_ret_close"]) for r in rows) / len(rows))


def attach_predictions(panel: DataFrame, decisions: DataFrame, predict: PredictFn, length: int, h: int,
                       columns: tuple[str, ...] = ("raw_ret_close",), block: int = 10_080) -> DataFrame:
    """mu per decision from its last ``length`` rows through a user function over Arrow batches, and sigma*sqrt(h).

    Context is only built for decision rows; the batches are whatever the partitions hold, no group is formed.
    """
    marks = decisions.select("symbol", "bar_open_ms").withColumn("_want", F.lit(True))
    ctx = seq_context(panel.select("symbol", "bar_open_ms", "row_idx", "sigma", *columns), length, columns, block=block)
    ctx = ctx.join(marks, ["symbol", "bar_open_ms"]).select("symbol", "bar_open_ms", "sigma", "context")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"symbol": pdf["symbol"], "bar_open_ms": pdf["bar_open_ms"], "mu": predict(pdf).astype("float64"),
                                "sigma_hat": pdf["sigma"] * float(h) ** 0.5})

    return ctx.mapInPandas(run, "symbol string, bar_open_ms long, mu double, sigma_hat double")
