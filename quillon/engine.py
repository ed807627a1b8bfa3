"""Facade: an index bound to a directory, filled, saved, restored and searched."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.functions.text import query_terms
from quillon.operators import search as sx
from quillon.sources.corpus import CORPUS
from quillon.sources.store import Store


class Engine:
    """``index``/``index_frame`` collect documents, ``save`` writes them, ``restore`` makes them searchable."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        self.spark, self.store = spark, Store(spark, path, buckets)
        self._rows: list[tuple[str, str]] = []
        self._frames: list[DataFrame] = []
        self._live: dict[str, DataFrame] | None = None

    def index(self, name: str, text: str) -> None:
        """Buffer one document on the driver; use :meth:`index_frame` for a corpus."""
        self._rows.append((name, text))

    def index_frame(self, corpus: DataFrame) -> None:
        """Add a corpus (doc_id, name, text); its ids are moved behind those already there."""
        self._frames.append(corpus.select("doc_id", "name", "text"))

    def save(self) -> None:
        """Write what was added since the last save as new segments. Saving nothing is allowed."""
        start = self.store.next_id()
        if self._rows:
            rows = [(start + i, n, t) for i, (n, t) in enumerate(self._rows)]
            self.store.add(self.spark.createDataFrame(rows, CORPUS))
            self._rows = []
        while self._frames:
            shift = self.store.next_id()
            self.store.add(self._frames[0].withColumn("doc_id", F.col("doc_id") + F.lit(shift)))
            self._frames.pop(0)
        if not self.store.segments():
            self.store.add(self.spark.createDataFrame([], CORPUS))

    def restore(self, cache: bool = False) -> None:
        """Open the saved tables; ``cache`` keeps the postings in executor memory."""
        self.clear()
        self._live = {"docs": self.store.docs(), "terms": self.store.terms(), "postings": self.store.postings()}
        if cache:
            self._live["postings"] = self._live["postings"].cache()

    def clear(self) -> None:
        """Forget buffered documents and loaded tables; files stay."""
        if self._live:
            self._live["postings"].unpersist()
        self._rows, self._frames, self._live = [], [], None

    def _tables(self) -> dict[str, DataFrame]:
        return self._live or {"docs": self.spark.createDataFrame([], "doc_id long, name string"), "terms": None, "postings": None}

    def hits(self, query: str) -> DataFrame:
        wanted = query_terms(query)
        if self._live is None or not wanted:
            return self.spark.createDataFrame([], "doc_id long")
        if not self._live["postings"].is_cached:
            return self.store.search(wanted)
        known = self.store.frequencies(wanted)
        if len(known) < len(wanted):
            return self.spark.createDataFrame([], "doc_id long")
        ordered = sorted(wanted, key=known.__getitem__)
        return sx.search_ordered(self._live["postings"], ordered, known[ordered[0]])

    def search_frame(self, query: str) -> DataFrame:
        return sx.with_names(self.hits(query), self._tables()["docs"])

    def search(self, query: str) -> list[str]:
        """All names, in insertion order."""
        return [r.name for r in self.search_frame(query).collect()]

    def count(self, query: str) -> int:
        """How many documents match; one token is answered from the term table alone."""
        wanted = query_terms(query)
        if self._live is None or not wanted:
            return 0
        if len(wanted) == 1:
            return self.store.frequencies(wanted).get(wanted[0], 0)
        return self.hits(query).count()

    def run(self, commands: DataFrame) -> DataFrame:
        """Answer a table of (id, cmd, query) in one plan."""
        if self._live and not self._live["postings"].is_cached:
            return self.store.run(commands)
        postings = self._live["postings"] if self._live else self.spark.createDataFrame([], "token string, doc_id long")
        return sx.run_commands(commands, postings)


_engine: Engine | None = None


def _bound() -> Engine:
    if _engine is None:
        raise RuntimeError("call init(idx_dir) first")
    return _engine


def init(idx_dir: str, spark: SparkSession | None = None) -> Engine:
    """Bind the module-level engine to a directory."""
    global _engine
    _engine = Engine(spark or SparkSession.builder.getOrCreate(), idx_dir)
    return _engine


def index(name: str, text: str) -> None:
    _bound().index(name, text)


def save_index() -> None:
    _bound().save()


def restore_index() -> None:
    _bound().restore()


def clear_index() -> None:
    _bound().clear()


def search(query: str) -> list[str]:
    return _bound().search(query)


def count(query: str) -> int:
    return _bound().count(query)
