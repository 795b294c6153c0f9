"""Metrics gathered beside a run: a plan's rows are measured as they pass, without a second pass over them.

`Metrics.through` adds aggregates to a frame, which Spark fills while the frame runs for whatever it is made for. Counts and
sums of several runs are held by name until `emit`, which gives the mean over the runs of each and begins anew.

Defined results: a frame without rows gives counts of 0, and means that are null, which are left out; emitting before any run,
or again at once, gives nothing. A frame that is made into a result twice is measured the first time.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession


class Metrics:
    def __init__(self):
        self._open: list[Observation] = []

    def through(self, df: DataFrame, **aggregates: Column) -> DataFrame:
        """df, unchanged, with aggregates that are measured when it runs."""
        seen = Observation()
        self._open.append(seen)
        return df.observe(seen, *[c.alias(n) for n, c in aggregates.items()])

    def emit(self) -> dict[str, float]:
        """The mean of each metric over the runs since the last call. The frames must have run: this waits for them."""
        runs, self._open = [x.get for x in self._open], []
        held: dict[str, list] = {}
        for run in runs:
            for name, value in run.items():
                if value is not None:
                    held.setdefault(name, []).append(value)
        return {name: sum(values) / len(values) for name, values in held.items()}

    def frame(self, spark: SparkSession) -> DataFrame:
        """emit() as (metric, value) rows."""
        return spark.createDataFrame([(k, float(v)) for k, v in sorted(self.emit().items())], "metric string, value double")
