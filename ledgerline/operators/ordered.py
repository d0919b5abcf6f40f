"""Running sums over a whole table in order, without one task that sees all of it.

The table is written in ranges of its order, one sorted file per range. The files' sums, a row each, say
where each file begins; within a file the sum runs by itself. As the ranges are written, a task that is
run again finds the same rows.
"""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerline.sources import files


def sorted_files(df: DataFrame, order: list[str], path: str | None = None, **options: str) -> DataFrame:
    """df in order, in files that ascend with their names, with _file and _row (the place in it)."""
    spark = df.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    path = path or files.scratch(spark, "sorted")
    df.repartitionByRange(parts, *order).sortWithinPartitions(*order).write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select("*", F.col("_metadata.file_name").alias("_file"), F.col("_metadata.row_index").alias("_row"))


def begins(sizes: dict[str, int]) -> dict[str, int]:
    """Where each file begins, by the sizes of all."""
    names = sorted(sizes, key=lambda n: (len(n.split("-")[1]), n))  # part-00000-..., longer beyond five digits
    return dict(zip(names, [0, *accumulate(sizes[n] for n in names)], strict=False))


def _begin(sorted_: DataFrame, total) -> DataFrame:
    sizes = {r["_file"]: r["n"] or 0 for r in sorted_.groupBy("_file").agg(total.alias("n")).collect()}  # a row per file
    at = sorted_.sparkSession.createDataFrame(list(begins(sizes).items()), "_file string, _begin long")
    return sorted_.join(F.broadcast(at), "_file")  # as many rows as shuffle partitions, at most


def numbered(df: DataFrame, order: list[str], name: str, path: str | None = None, **options: str) -> DataFrame:
    """df with name: each row's number in order, from 0."""
    placed = _begin(sorted_files(df, order, path, **options), F.count("*"))
    return placed.withColumn(name, (F.col("_begin") + F.col("_row")).cast("long")).select(*df.columns, name)


def running_sum(df: DataFrame, order: list[str], value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows up to and with each one."""
    placed = _begin(sorted_files(df, order), F.sum(value))
    window = Window.partitionBy("_file").orderBy("_row").rowsBetween(Window.unboundedPreceding, 0)
    return placed.withColumn(name, (F.col("_begin") + F.sum(value).over(window)).cast("long")).select(*df.columns, name)
