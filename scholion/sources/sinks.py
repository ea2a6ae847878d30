"""Results to files, and files to tables of a database."""

from __future__ import annotations

import csv
import os
import sys

from pyspark.sql import DataFrame, SparkSession


def write_rows(result: DataFrame, path: str | None = None, header: bool = False, separator: str = ",", encoding: str = "utf-8") -> None:
    """A result as one delimited file, or on standard output; rows pass through the driver partition by partition."""
    out = open(path, "w", encoding=encoding, newline="") if path else sys.stdout
    try:
        rows = csv.writer(out, delimiter=separator)
        if header:
            rows.writerow(result.columns)
        rows.writerows(result.toLocalIterator())
    finally:
        if path:
            out.close()


def write_parts(result: DataFrame, folder: str, header: bool = True, separator: str = ",", encoding: str = "utf-8") -> None:
    """A large result as a folder of delimited files, one a partition, written by the executors."""
    result.write.mode("overwrite").option("header", header).option("sep", separator).option("encoding", encoding).option("escape", '"').csv(folder)


def import_table(spark: SparkSession, path: str, database: str, name: str, schema: str | None = None, separator: str = ",") -> None:
    """A delimited file, or a folder of them, as a table of a database; all columns are text unless a schema is given."""
    reader = spark.read.option("header", True).option("sep", separator).option("escape", '"').option("multiLine", True)
    (reader.schema(schema) if schema else reader).csv(path).write.mode("overwrite").parquet(os.path.join(database, name))
