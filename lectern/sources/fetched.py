"""Documents behind addresses, as a Python data source.

The fetcher is given as ``module:function`` so that executors import it themselves: ``function(address)``
returns the text. News feeds, article pages and race documents are read this way; what a fetch raises
becomes the row's ``error`` and leaves the other rows alone.
"""

from __future__ import annotations

from collections.abc import Iterator
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "address string, body string, error string"


class AddressPartition(InputPartition):
    def __init__(self, addresses: list[str]) -> None:
        self.addresses = addresses


class FetchedReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.addresses = [a for a in options.get("addresses", "").split("\n") if a]
        self.fetcher = options["fetcher"]
        self.per_task = int(options.get("pertask", "16"))

    def partitions(self) -> list[InputPartition]:
        starts = range(0, len(self.addresses), self.per_task)
        return [AddressPartition(self.addresses[i : i + self.per_task]) for i in starts] or [AddressPartition([])]

    def read(self, partition: AddressPartition) -> Iterator[tuple]:
        module, name = self.fetcher.split(":")
        fetch = getattr(import_module(module), name)
        for address in partition.addresses:
            try:
                yield address, fetch(address), None
            except Exception as failure:  # the row records it; the caller falls back per row
                yield address, None, f"{type(failure).__name__}: {failure}"


class FetchedDocuments(DataSource):
    @classmethod
    def name(cls) -> str:
        return "fetched"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return FetchedReader(self.options)


def read_fetched(spark: SparkSession, addresses: list[str], fetcher: str, per_task: int = 16) -> DataFrame:
    """A bounded list of addresses, such as feeds or a season's documents. Tables of addresses use ``fetch_column``."""
    spark.dataSource.register(FetchedDocuments)
    return (
        spark.read.format("fetched")
        .option("addresses", "\n".join(addresses))
        .option("fetcher", fetcher)
        .option("perTask", str(per_task))
        .load()
    )


def fetch_column(rows: DataFrame, column: str, fetcher) -> DataFrame:
    """The rows with the ``body`` behind each address; a failed fetch gives a null body."""
    from pyspark.sql import types as T

    def fetched(frames):
        def attempt(address):
            try:
                return fetcher(address)
            except Exception:  # failure is isolated to its row
                return None

        for frame in frames:
            yield frame.assign(body=frame[column].map(attempt))

    return rows.mapInPandas(fetched, T.StructType([*rows.schema.fields, T.StructField("body", T.StringType())]))
