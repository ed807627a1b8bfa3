"""Interfaces for catalogs and indexes of one's own, and small in-memory ones.

The engine itself uses :class:`quillon.sources.store.Store`; these are for
callers who add documents one by one or bring a storage of their own.
"""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import index as ix
from quillon.operators import search as sx


class DocList(ABC):
    """Names of documents under dense ids."""

    @abstractmethod
    def add(self, name: str) -> int: ...

    @abstractmethod
    def get(self, doc_id: int) -> str: ...

    @abstractmethod
    def save(self) -> None: ...

    @abstractmethod
    def restore(self) -> None: ...

    @abstractmethod
    def clear(self) -> None: ...


class InvertedIndex(ABC):
    """Postings that can be filled, saved and asked."""

    @abstractmethod
    def add(self, doc_id: int, tokens: list[str]) -> None: ...

    @abstractmethod
    def get(self, token: str) -> list[int]: ...

    @abstractmethod
    def search_and(self, tokens: list[str]) -> list[int]: ...

    @abstractmethod
    def count_and(self, tokens: list[str]) -> int: ...

    @abstractmethod
    def save(self) -> None: ...

    @abstractmethod
    def restore(self) -> None: ...

    @abstractmethod
    def clear(self) -> None: ...


class MemoryDocList(DocList):
    """A catalog on the driver, saved as a Parquet table."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/doclist"
        self._names: list[str] = []

    def add(self, name: str) -> int:
        self._names.append(name)
        return len(self._names) - 1

    def get(self, doc_id: int) -> str:
        return self._names[doc_id]

    def save(self) -> None:
        self.spark.createDataFrame(list(enumerate(self._names)), "doc_id long, name string").write.mode("overwrite").parquet(self.path)

    def restore(self) -> None:
        self._names = [r.name for r in self.spark.read.parquet(self.path).orderBy("doc_id").collect()]

    def clear(self) -> None:
        self._names = []


class MemoryInvertedIndex(InvertedIndex):
    """Postings that can be read as soon as they are added; saved as a Parquet table sorted by token."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, f"{path.rstrip('/')}/index"
        self._rows: list[tuple[int, list[str]]] = []
        self._stored: DataFrame | None = None

    def add(self, doc_id: int, tokens: list[str]) -> None:
        self._rows.append((doc_id, list(tokens)))

    def postings(self) -> DataFrame:
        own = ix.postings_from_tokens(self.spark.createDataFrame(self._rows, "doc_id long, tokens array<string>"))
        return own if self._stored is None else self._stored.unionByName(own)

    def get(self, token: str) -> list[int]:
        return self.search_and([token])

    def search_and(self, tokens: list[str]) -> list[int]:
        return [r.doc_id for r in sx.search_and(self.postings(), tokens).orderBy("doc_id").collect()]

    def count_and(self, tokens: list[str]) -> int:
        return sx.count_and(self.postings(), tokens).first().hits

    def save(self) -> None:
        """The table is replaced; what was restored from it must not be asked again before the next restore."""
        rows = self.postings()
        if self._stored is not None:
            rows = self.spark.createDataFrame(rows.collect(), "token string, doc_id long")
        rows.repartitionByRange(F.col("token"), F.col("doc_id")).sortWithinPartitions("token", "doc_id").write.mode("overwrite").parquet(self.path)

    def restore(self) -> None:
        self.clear()
        self._stored = self.spark.read.schema("token string, doc_id long").parquet(self.path)

    def clear(self) -> None:
        self._rows, self._stored = [], None
