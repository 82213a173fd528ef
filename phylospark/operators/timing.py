"""Wall-clock times of the driver's own steps, a row for each step that ended."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager
from time import perf_counter_ns

from pyspark.sql import DataFrame, SparkSession


class Timings:
    def __init__(self):
        self.rows: list[tuple[str, int]] = []

    @contextmanager
    def __call__(self, label: str) -> Iterator[None]:
        began = perf_counter_ns()
        try:
            yield
        finally:
            self.rows.append((label, perf_counter_ns() - began))

    @property
    def durations(self) -> dict[str, list[int]]:
        """Nanoseconds of each label's steps."""
        return {label: [n for own, n in self.rows if own == label] for label, _ in self.rows}

    def table(self, spark: SparkSession) -> DataFrame:
        """(label, nanoseconds)."""
        return spark.createDataFrame(self.rows, "label string, nanoseconds long")
