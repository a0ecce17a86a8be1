"""Step history (PIP1-3): a replayable list of operator calls.

``Pipeline(source).step(op, **params)`` records the call; ``result()`` replays
the steps on the source with ``DataFrame.transform`` (Spark only builds the
plan), ``reset()`` goes back to the source and ``revert(i)`` keeps the first
``i`` steps - replayed, not just truncated.
"""

from __future__ import annotations

import datetime as _dt
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass
class Step:
    op: Callable
    params: dict
    description: str
    kind: str
    timestamp: str = field(default_factory=lambda: _dt.datetime.now().isoformat(timespec="seconds"))


class Pipeline:
    def __init__(self, source: DataFrame):
        self.source = source
        self.steps: list[Step] = []

    def step(self, op: Callable[..., DataFrame], description: str | None = None, kind: str = "transformation",
             **params) -> "Pipeline":
        self.steps.append(Step(op, params, description or f"{op.__name__}({', '.join(f'{k}={v!r}' for k, v in params.items())})",
                               kind))
        return self

    def result(self) -> DataFrame:
        df = self.source
        for s in self.steps:
            df = df.transform(lambda d, s=s: s.op(d, **s.params))
        return df

    def reset(self) -> "Pipeline":
        self.steps = []
        return self

    def revert(self, i: int) -> "Pipeline":
        self.steps = self.steps[:i]
        return self

    def row_counts(self) -> DataFrame:
        """step, description and the rows of the table after it (step -1: the source)."""
        df = self.source
        out = df.agg(F.count(F.lit(1)).alias("rows")).select(F.lit(-1).alias("step"), F.lit("source").alias("description"), "rows")
        for i, s in enumerate(self.steps):
            df = s.op(df, **s.params)
            out = out.unionByName(df.agg(F.count(F.lit(1)).alias("rows")).select(
                F.lit(i).alias("step"), F.lit(s.description).alias("description"), "rows"))
        return out

    def history(self) -> DataFrame:
        rows = [(i, s.description, s.kind, s.timestamp, s.op.__name__, repr(s.params)) for i, s in enumerate(self.steps)]
        return self.source.sparkSession.createDataFrame(
            rows, "step int, description string, type string, timestamp string, op string, details string")
