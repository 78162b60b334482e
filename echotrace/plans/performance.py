"""Times of a scan's stages, without paths or evidence."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession

STAGES = "stage_id string, duration_seconds double, calls long, items long"


class Recorder:
    """Seconds by stage; time while paused doesn't count."""

    def __init__(self, clock: Callable[[], float] = time.monotonic) -> None:
        self.clock, self.rows, self._paused, self._since = clock, {}, 0.0, None

    def pause(self) -> None:
        self._since = self._since if self._since is not None else self.clock()

    def resume(self) -> None:
        if self._since is not None:
            self._paused += self.clock() - self._since
            self._since = None

    @contextmanager
    def stage(self, name: str, items: int = 0) -> Iterator[None]:
        began, paused = self.clock(), self._paused
        try:
            yield
        finally:
            self.resume()
            seconds, calls, n = self.rows.get(name, (0.0, 0, 0))
            self.rows[name] = seconds + self.clock() - began - (self._paused - paused), calls + 1, n + items

    def stages(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([(k, *v) for k, v in sorted(self.rows.items())], STAGES)


def environment(spark: SparkSession) -> dict[str, object]:
    return {"spark": spark.version, "parallelism": spark.sparkContext.defaultParallelism, "master": spark.sparkContext.master.split("[")[0].split(":")[0]}
