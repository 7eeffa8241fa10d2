"""Consecutive draws of one seeded generator as a relation, made by many tasks.

A Python data source: the driver runs the generator through once and notes its state where each partition begins (no draw is
kept); a partition goes on from its state. So the draws are those of a plain loop over one generator.
"""

from __future__ import annotations

import random
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Draws of a partition, and of a batch in it.
STEP, BATCH = 1 << 18, 1 << 14


@dataclass
class _Stretch(InputPartition):
    start: int
    stop: int
    state: tuple


class _Reader(DataSourceReader):
    def __init__(self, seed: int, rows: int, step: int):
        self.seed, self.rows, self.step = seed, rows, step

    def partitions(self) -> list[_Stretch]:
        rng, out = random.Random(self.seed), []
        for start in range(0, self.rows, self.step):
            stop = min(start + self.step, self.rows)
            out.append(_Stretch(start, stop, rng.getstate()))
            for _ in range(start, stop):
                rng.random()
        return out or [_Stretch(0, 0, rng.getstate())]

    def read(self, partition: _Stretch) -> Iterator[pa.RecordBatch]:
        rng = random.Random()
        rng.setstate(partition.state)
        for k in range(partition.start, partition.stop, BATCH):
            z = min(k + BATCH, partition.stop)
            yield pa.RecordBatch.from_arrays([pa.array(range(k, z), pa.int64()), pa.array([rng.random() for _ in range(k, z)], pa.float64())], ["ordinal", "draw"])


class SeededDraws(DataSource):
    """Options: seed, rows, step."""

    @classmethod
    def name(cls) -> str:
        return "seeded_draws"

    def schema(self) -> str:
        return "ordinal bigint, draw double"

    def reader(self, schema) -> _Reader:
        return _Reader(int(self.options["seed"]), int(self.options["rows"]), int(self.options.get("step", STEP)))


def draws(spark: SparkSession, seed: int, rows: int, step: int = STEP) -> DataFrame:
    """(ordinal, draw): the first ``rows`` numbers of ``random.Random(seed)``."""
    spark.dataSource.register(SeededDraws)
    return spark.read.format("seeded_draws").options(seed=str(seed), rows=str(rows), step=str(step)).load()
