"""Epoch tables and the ledger that commits them.

A batch writes each of its tables into a folder of its own, ``<table>/epoch=N``, and last a ledger row.  Rows count once
the ledger names their epoch, so a batch that dies half way leaves nothing behind that a reader sees; its re-run gets the
same epoch number and replaces the folders.  A batch of a stream is known by (source, batch): if the ledger has it, a
re-delivery is left alone.  One writer at a time.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from pagelake.session import TABLE_CODEC, shuffles_dropped
from pagelake.sources.tables import conform

COUNTED = ("pages", "processed", "chunks", "dead_letters")
LEDGER_SCHEMA = T.StructType(
    [T.StructField("source", T.StringType()), T.StructField("batch", T.LongType())]
    + [T.StructField(c, T.LongType()) for c in COUNTED] + [T.StructField("dead_letters_written", T.BooleanType())])
EPOCH = T.StructField("epoch", T.LongType())


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A table that may not exist yet; any other error is raised."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


class Ledger:
    """Epochs of the tables under ``paths`` (``paths["state"]``, by default beside the pages, holds ledger and state)."""

    def __init__(self, spark: SparkSession, paths: dict[str, str]):
        self.spark, self.paths = spark, paths
        self.state = paths.get("state") or paths["pages"].rstrip("/") + "_state"

    def _rows(self) -> DataFrame:
        return read_or_empty(self.spark, f"{self.state}/ledger", T.StructType([*LEDGER_SCHEMA.fields, EPOCH]))

    def last(self) -> int:
        """The last committed epoch, -1 before the first."""
        found = self._rows().agg(F.max("epoch")).first()[0]
        return -1 if found is None else found

    def has(self, source: str, batch: int) -> bool:
        return bool(self._rows().where((F.col("source") == source) & (F.col("batch") == batch)).limit(1).count())

    def totals(self) -> dict[str, int]:
        row = self._rows().agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in COUNTED]).first()
        return row.asDict()

    def path(self, table: str) -> str:
        return self.paths.get(table) or f"{self.state}/{table}"

    def write(self, df: DataFrame, table: str, epoch: int, schema: T.StructType) -> None:
        """One job, which replaces what an uncommitted run of the epoch left."""
        with shuffles_dropped(self.spark):
            conform(df, schema).write.mode("overwrite").option("compression", TABLE_CODEC).parquet(f"{self.path(table)}/epoch={epoch}")

    def epochs(self, table: str, schema: T.StructType, epochs) -> DataFrame:
        """Rows of the epochs named; no other folder is listed."""
        folders = [f"{self.path(table)}/epoch={e}" for e in epochs]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def committed(self, table: str, schema: T.StructType) -> DataFrame:
        """All committed rows of a table."""
        rows = read_or_empty(self.spark, self.path(table), T.StructType([*schema.fields, EPOCH]))
        return rows.where(F.col("epoch") <= self.last()).select(schema.fieldNames())

    def commit(self, epoch: int, source: str | None, batch: int | None, counts: dict[str, int], dead_letters_written: bool) -> None:
        row = (source, batch, *[counts.get(c, 0) for c in COUNTED], dead_letters_written)
        self.write(self.spark.createDataFrame([row], LEDGER_SCHEMA), "ledger", epoch, LEDGER_SCHEMA)
