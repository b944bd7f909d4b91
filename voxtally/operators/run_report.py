"""Figures of a run, collected while its tables are written.

Every figure is an aggregate that Spark works out beside the write it observes: no job runs for a
figure alone, and a task that is run again counts once, as its first result is dropped.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from voxtally.session import materialize



def _rows() -> Column:
    return F.count(F.lit(1))


@dataclass
class RunReport:
    """Stages of a run in their order, with the figures observed at each."""

    stages: list[tuple[str, Observation]] = field(default_factory=list)

    def observe(self, df: DataFrame, stage: str, **figures: Column) -> DataFrame:
        """``df``, to be written once, with ``rows`` and further figures noted under ``stage``."""
        observation = Observation(stage)
        self.stages.append((stage, observation))
        return df.observe(observation, _rows().alias("rows"), *(f.alias(n) for n, f in figures.items()))

    def written(self, df: DataFrame, stage: str, **figures: Column) -> DataFrame:
        """``df`` as a written table, observed on the way."""
        return materialize(self.observe(df, stage, **figures), stage.replace(" ", "-"))

    def figures(self) -> list[tuple[str, str, float]]:
        """``(stage, figure, value)`` of all stages that have been written."""
        return [
            (stage, name, float(value) if value is not None else None)
            for stage, observation in self.stages
            for name, value in observation.get.items()
        ]

    def table(self, spark: SparkSession) -> DataFrame:
        """The figures as a table, numbered by stage."""
        order = {stage: i for i, (stage, _) in enumerate(self.stages)}
        rows = [(order[s], s, n, v) for s, n, v in self.figures()]
        return spark.createDataFrame(rows, "step int, stage string, figure string, value double")


def share(part: float | None, whole: float | None) -> float:
    return part / whole if part is not None and whole else 0.0


def report_lines(figures: Mapping[tuple[str, str], float]) -> list[str]:
    """The figures as the console shows them: counts with thousands, shares with one decimal."""
    out = []
    for (stage, name), value in figures.items():
        text = f"{value:.1%}" if name.endswith("_share") else f"{value:,.0f}"
        out.append(f"{stage} {name.replace('_', ' ')}: {text}")
    return out
