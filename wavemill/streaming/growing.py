"""A stream over a result that is still being simulated: each trigger gives the points that have come since the last."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, SimpleDataSourceStreamReader


class _Reader(SimpleDataSourceStreamReader):
    def __init__(self, path: str, signal: str):
        self.path, self.signal = path, signal

    def initialOffset(self) -> dict:
        return {"points": 0}

    def _columns(self):
        from wavemill.sources.files import open_file

        return open_file(self.path).column(self.signal)

    def read(self, start: dict):
        x, y = self._columns()
        n = max(start["points"], min(len(x), len(y)))
        return self._rows(x, y, start["points"], n), {"points": n}

    def readBetweenOffsets(self, start: dict, end: dict):
        x, y = self._columns()
        return self._rows(x, y, start["points"], end["points"])

    @staticmethod
    def _rows(x, y, a: int, b: int):
        return iter([(float(u), float(v)) for u, v in zip(x[a:b], y[a:b], strict=True)])

    def commit(self, end: dict) -> None:
        pass


class GrowingResult(DataSource):
    """Options: path of the file and signal, of real values."""

    @classmethod
    def name(cls) -> str:
        return "growing_result"

    def schema(self) -> str:
        return "x double, value double"

    def simpleStreamReader(self, schema):
        return _Reader(self.options["path"], self.options["signal"])


def follow(spark: SparkSession, path: str, signal: str) -> DataFrame:
    """A streaming table (x, value) of one signal. The file is read anew at each trigger; only whole points count."""
    spark.dataSource.register(GrowingResult)
    return spark.readStream.format("growing_result").option("path", path).option("signal", signal).load()
