"""A stored index: immutable segments of Parquet tables under one directory.

``<dir>/seg-00000/{docs,terms,postings}``: a segment counts only once its
marker file exists, so a failed save leaves the index as it was. Postings are
partitioned by token bucket, and each file is sorted by (token, doc_id): a
lookup reads one directory and skips pages by their statistics. How many
buckets there are is stored with the index. Many small segments, which
streaming leaves behind, are made one by :meth:`Store.compact`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.operators import chunks as ch
from quillon.operators import index as ix
from quillon.operators import search as sx
from quillon.sources.scratch import input_bytes

MARKER, UPTO, COUNT = "_LIVE", "_UPTO-", "_BUCKETS-"
#: Bytes of input for each bucket and each task of a new index.
BUCKET_BYTES, TASK_BYTES = 1 << 30, 64 << 20
#: Texts of a new segment for each task at least: a few that were filtered from a large table need few tasks and files.
TASK_TEXTS = 64
#: Words of a table of commands up to which only their lists are read.
LOOKUP_TOKENS = 1000
EMPTY = {"docs": "doc_id long, name string", "terms": "token string, df long", "postings": "token string, doc_id long, bucket int"}


def bucket_of(token: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(token), F.lit(buckets)).cast("int")


def _parted(rows: DataFrame, place: Column, buckets: int, tasks: int) -> DataFrame:
    """Rows with a token and a place among the slices of its list, in partitions of one bucket each.

    The task is chosen by hash, so the rows are made once: ranges would need a
    sample, for which all texts would be cut into words once more. A common
    word's list is split over the tasks of its bucket by slice.
    """
    each = -(-tasks // buckets)
    # The 32-bit hash here, as the bucket is taken from the 64-bit one.
    part = (F.col("bucket") * each + F.pmod(F.hash(F.col("token"), place), F.lit(each))).cast("int")
    return rows.withColumn("bucket", bucket_of(F.col("token"), buckets)).repartitionById(buckets * each, part)


def _of_chunks(chunked: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """(token, doc_id, bucket) of chunks. They are put in order, that their ids are nearly sorted."""
    rows = _parted(chunked, F.col("slice"), buckets, tasks).withColumn("_first", F.get("ids", F.lit(0)))
    return rows.sortWithinPartitions("bucket", "token", "slice", "_first").select("token", F.explode("ids").alias("doc_id"), "bucket")


def _of_rows(postings: DataFrame, buckets: int, tasks: int) -> DataFrame:
    """(token, doc_id, bucket) of postings that are stored, sorted, and so cheap to shuffle as they are."""
    rows = postings.select("token", "doc_id")
    return _parted(rows, F.shiftright("doc_id", ch.SLICE_BITS), buckets, tasks)


class Store:
    """Segments in a directory of any Hadoop file system."""

    def __init__(self, spark: SparkSession, path: str, buckets: int | None = None):
        """``buckets`` is for an index that doesn't exist yet; by default its first corpus decides."""
        self.spark, self.path, self._wanted = spark, path.rstrip("/"), buckets
        self._hadoop = spark._jvm.org.apache.hadoop.fs.Path

    @property
    def buckets(self) -> int | None:
        """The stored count; None before the first segment."""
        fs, root = self._fs(), self._hadoop(self.path)
        names = [s.getPath().getName() for s in fs.listStatus(root)] if fs.exists(root) else []
        return next((int(n[len(COUNT) :]) for n in names if n.startswith(COUNT)), None)

    def _settle(self, corpus: DataFrame) -> int:
        found = self.buckets
        if found is None:
            found = self._wanted or min(4096, max(8, input_bytes(corpus) // BUCKET_BYTES))
            self._fs().create(self._hadoop(f"{self.path}/{COUNT}{found}")).close()
        return found

    def _fs(self):
        return self._hadoop(self.path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def segments(self) -> list[str]:
        fs, root = self._fs(), self._hadoop(self.path)
        if not fs.exists(root):
            return []
        found = [s.getPath().getName() for s in fs.listStatus(root)]
        live = sorted(n for n in found if n.startswith("seg-") and fs.exists(self._hadoop(f"{self.path}/{n}/{MARKER}")))
        notes = [s.getPath().getName() for n in live for s in fs.listStatus(self._hadoop(f"{self.path}/{n}"))]
        gone = max((int(n[len(UPTO) :]) for n in notes if n.startswith(UPTO)), default=-1)
        return [n for n in live if int(n[4:]) > gone]

    def add(self, corpus: DataFrame) -> str:
        """Write the corpus (doc_id, name, text) as a new segment; doc_id must be new."""
        buckets = self._settle(corpus)
        return self._write(ix.docs(corpus), lambda n: _of_chunks(ch.gathered(corpus), buckets, max(buckets, min(self._tasks(buckets, corpus), n // TASK_TEXTS))))

    def compact(self) -> None:
        """Make all segments one. Readers see the old ones until the new one is whole; then they are deleted."""
        old = self.segments()
        if len(old) < 2:
            return
        held, buckets = self.postings(), self.buckets
        self._write(self.docs(), lambda _: _of_rows(held, buckets, self._tasks(buckets, held)), self.terms(), int(old[-1][4:]))
        for name in old:
            self._fs().delete(self._hadoop(f"{self.path}/{name}"), True)

    def _tasks(self, buckets: int, sized: DataFrame) -> int:
        return max(buckets, int(self.spark.conf.get("spark.sql.shuffle.partitions")), input_bytes(sized) // TASK_BYTES)

    def _write(self, docs: DataFrame, place: Callable[[int], DataFrame], terms: DataFrame | None = None, upto: int | None = None) -> str:
        """A new segment. ``place`` gives, for a number of texts, the postings in partitions that hold one bucket each.

        Terms are counted from the postings, if there are none yet.
        """
        number = int(s[-1][4:]) + 1 if (s := self.segments()) else 0
        segment = f"{self.path}/seg-{number:05d}"
        fs = self._fs()
        fs.delete(self._hadoop(segment), True)  # left over from a save that failed
        docs.write.parquet(f"{segment}/docs")
        placed = place(self._read([f"{segment}/docs"], "docs").count())
        placed.sortWithinPartitions("bucket", "token", "doc_id").write.partitionBy("bucket").parquet(f"{segment}/postings")
        if terms is None:
            terms = ix.terms(self._read([f"{segment}/postings"], "postings"))
        terms.repartitionByRange("token").sortWithinPartitions("token").write.parquet(f"{segment}/terms")
        if upto is not None:
            fs.create(self._hadoop(f"{segment}/{UPTO}{upto:05d}")).close()
        fs.create(self._hadoop(f"{segment}/{MARKER}")).close()
        return segment

    def _read(self, paths: list[str], table: str) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], EMPTY[table])
        parts = [self.spark.read.schema(EMPTY[table]).parquet(p) for p in paths]
        out = parts[0]
        for part in parts[1:]:
            out = out.unionByName(part)
        return out

    def table(self, name: str) -> DataFrame:
        return self._read([f"{self.path}/{s}/{name}" for s in self.segments()], name)

    def docs(self) -> DataFrame:
        return self.table("docs")

    def postings(self) -> DataFrame:
        return self.table("postings")

    def terms(self) -> DataFrame:
        """Document frequencies over all segments."""
        return self.table("terms").groupBy("token").agg(F.sum("df").alias("df"))

    def frequencies(self, tokens: list[str]) -> dict[str, int]:
        """df of those of the tokens that occur; the filter is pushed to the sorted term tables."""
        rows = self.table("terms").where(F.col("token").isin(tokens)).groupBy("token").agg(F.sum("df").alias("df"))
        return {r.token: r.df for r in rows.collect()} if tokens else {}

    def search(self, tokens: list[str]) -> DataFrame:
        """(doc_id) of the documents with every token: rarest list first, and none read if a token doesn't occur."""
        known = self.frequencies(tokens)
        if not tokens or len(known) < len(set(tokens)):
            return self.spark.createDataFrame([], "doc_id long")
        ordered = sorted(dict.fromkeys(tokens), key=known.__getitem__)
        return sx.search_ordered(self.lookup(ordered), ordered, known[ordered[0]])

    def run(self, commands: DataFrame) -> DataFrame:
        """Answer a table (id, cmd, query) from the lists of its words; all lists are read only if the words are very many."""
        words = sx.query_tokens(commands, "id", "query").select("token").distinct().limit(LOOKUP_TOKENS + 1).collect()
        if len(words) > LOOKUP_TOKENS:
            return sx.run_commands(commands, self.postings())
        lists = self.lookup([r.token for r in words])
        # Files that hold a common word are the largest, which Spark puts into one task; there each id is counted once a command.
        return sx.run_commands(commands, lists.repartition("doc_id") if len(words) <= sx.FEW_TOKENS else lists)

    def next_id(self) -> int:
        top = self.docs().agg(F.max("doc_id")).first()[0]
        return 0 if top is None else top + 1

    def lookup(self, tokens: list[str]) -> DataFrame:
        """Postings of the given tokens, with partition pruning and a pushed-down filter."""
        rows = self.postings()
        if not (buckets := self.buckets):
            return rows.select("token", "doc_id").where(F.lit(False))
        wanted = [bucket_of(F.lit(t), buckets) for t in tokens]
        return rows.where(F.col("bucket").isin(wanted) & F.col("token").isin(tokens)).select("token", "doc_id")
