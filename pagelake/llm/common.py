"""Small helpers shared by the corpus operators."""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# White space that separates words: blank, tab, line feed, vertical tab, form feed, return.
BLANKS = " \t\n\x0b\f\r"


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(os.path.join(sf_dir, f"{name}.parquet"))


def bind(value: Column, body) -> Column:
    """``body(value)`` with ``value`` evaluated once, however often the body uses it."""
    return F.transform(F.array(value), body)[0]


def fold(column: str, buckets: int) -> Column:
    """crc32 of the column as text, modulo ``buckets`` (the train / held-out rule of the queries)."""
    return F.crc32(F.col(column).cast("string")) % buckets


def uniform(*columns: Column, seed: int) -> Column:
    """A number in [0, 1) made from the MD5 of the seed and the columns (52 bits); nulls count as ``~``."""
    parts = [F.lit(str(seed))] + [F.coalesce(c.cast("string"), F.lit("~")) for c in columns]
    head = F.substring(F.md5(F.concat_ws("|", *parts)), 1, 13)
    return F.conv(head, 16, 10).cast("double") / F.lit(float(1 << 52))


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Helper column names that clash with no column of ``df`` (names compare case-insensitively)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def q(name: str) -> Column:
    """A column by its exact name, also when it holds dots or blanks."""
    return F.col("`" + name.replace("`", "``") + "`")


def add_columns(df: DataFrame, column: str, compute, added: dict[str, str], keep: bool = True) -> DataFrame:
    """``df`` with the columns ``added`` (name → type), which ``compute(batches)`` makes in Arrow batches: it gets
    an iterator of the arrays of ``column`` and yields a list of arrays for each.  Columns of ``df`` pass through
    by position, so any names will do; ``column`` itself does unless ``keep`` is false."""
    import pyarrow as pa

    at = df.columns.index(column)
    plain = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    left = [i for i in range(len(df.columns)) if keep or i != at]
    schema = T.StructType([plain.schema.fields[i] for i in left] + [T.StructField(f"n{i}", T._parse_datatype_string(kind))
                                                       for i, kind in enumerate(added.values())])
    names = schema.fieldNames()

    def scan(batches):
        held = []

        def arrays():
            for batch in batches:
                held.append(batch)
                yield batch.column(at)

        for new in compute(arrays()):
            batch = held.pop()
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in left), *new], names=names)

    return plain.mapInArrow(scan, schema).toDF(*[df.columns[i] for i in left], *fresh(df, *added))
