"""Containers as a Spark data source: ``spark.read.format("scholion_records")``, open to formats of one's own.

A format is a pattern of file names and a function that gives (container_id, item, member, body) rows of a file. Those of
the built-in sources are known; others are added with ``add_format`` before ``register``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from scholion.sources import containers

FORMATS: dict[str, tuple[str, int, Callable[[int, str], Iterable]]] = {
    "crossref": (r"\.gz$", 1, containers.json_gz),
    "pubmed": (r"^pubmed.*\.xml\.gz$", 1, containers.articles_gz),
    "uspto": (r"\.zip$", 2, containers.patents_zip),
    "datacite": (r"\.tar\.gz$", 1, containers.json_lines_tar),
    "orcid": (r"\.tar\.gz$", 1, containers.xml_tar),
    "ror": (r"\.zip$", 1, containers.organisations_zip),
}


def add_format(name: str, pattern: str, read: Callable[[int, str], Iterable], depth: int = 1) -> None:
    """Adds a format: files under a folder whose names match, read by ``read(container_id, path)``."""
    FORMATS[name] = (pattern, depth, read)


class _Reader(DataSourceReader):
    def __init__(self, files: list[tuple[int, str]], read: Callable[[int, str], Iterable]):
        self.files, self.of = files, read

    def partitions(self) -> list[InputPartition]:
        return [InputPartition(f) for f in self.files]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        container, path = partition.value
        yield from self.of(container, path)


class RecordSource(DataSource):
    """Options: ``path``, a folder, and ``source``, a format; one partition a container file."""

    @classmethod
    def name(cls) -> str:
        return "scholion_records"

    def schema(self) -> str:
        return containers.RECORDS

    def reader(self, schema) -> DataSourceReader:
        if self.options.get("source") not in FORMATS:
            raise ValueError(f"option source must be one of {', '.join(sorted(FORMATS))}")
        pattern, depth, read = FORMATS[self.options["source"]]
        return _Reader(list(enumerate(containers.listing(self.options["path"], pattern, depth))), read)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(RecordSource)
