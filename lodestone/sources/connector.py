"""Connectors to outside sources as Spark data sources, and the semantics of a drive's listing."""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..functions import classify as cl

PAGE = 100
LISTED = "file_id string, name string, mime_type string, parents array<string>, owner_email string, last_modified string"


class Connector(ABC):
    """What a source must offer: a name, a way in, pages of a listing, and file contents."""

    name: str

    @abstractmethod
    def authenticate(self) -> None: ...

    @abstractmethod
    def pages(self) -> int: ...

    @abstractmethod
    def list_page(self, page: int) -> list[tuple]: ...

    @abstractmethod
    def fetch(self, file_id: str) -> bytes: ...


REGISTRY: dict[str, type[Connector]] = {}


class _Reader(DataSourceReader):
    def __init__(self, connector: Connector):
        self.connector = connector

    def partitions(self) -> list[InputPartition]:
        self.connector.authenticate()
        return [InputPartition(i) for i in range(max(1, self.connector.pages()))]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        self.connector.authenticate()
        yield from self.connector.list_page(partition.value) if self.connector.pages() else []


class ListingSource(DataSource):
    """``spark.read.format("lodestone_listing").option("connector", ...)``: a page per partition."""

    @classmethod
    def name(cls) -> str:
        return "lodestone_listing"

    def schema(self) -> str:
        return LISTED

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options_connector())

    def options_connector(self) -> Connector:
        return REGISTRY[self.options["connector"]]()


def register(spark: SparkSession) -> None:
    spark.dataSource.register(ListingSource)


def eligible(listing: DataFrame) -> DataFrame:
    """Listed files that can be taken, with the name and type they have once exported."""
    name, mime = F.col("name"), F.col("mime_type")
    kept = listing.where(cl.listed(name, mime))
    return kept.withColumns({"name": cl.exported_name(name, mime), "mime_type": cl.exported_mime(mime)})
