"""Exact deduplication against a persistent digest index.

The index is a Parquet table bucketed and sorted by digest. New rows are
reduced to (digest, row), deduplicated among themselves, and anti-joined with
the index by sort-merge; the index side is read in its buckets and not
shuffled. What is new is appended. Texts never go through a shuffle unless the
rows to drop are too many to broadcast.
"""

from __future__ import annotations

import hashlib
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm.common import documents, fresh, join_checked, materialize, scratch_path

BUCKETS = 64
#: Files a bucket from which the index is written anew.
COMPACT = 16


def digest(text: Column) -> Column:
    """SHA-256 of the UTF-8 bytes; NULL for NULL."""
    return F.unhex(F.sha2(text.cast("binary"), 256))


class DigestIndex:
    """A bucketed table (digest BINARY, batch STRING) at a path, usable from any session.

    ``buckets`` counts when the index is made and is stored with it: some 100
    million digests a bucket are 5 GB. Every append adds a file to a bucket;
    from COMPACT files on, the index is written anew with one file each, so
    that its sort order holds again.
    """

    def __init__(self, spark: SparkSession, path: str, buckets: int = BUCKETS):
        self.spark, self.path = spark, path.rstrip("/")
        self.name = "quillon_digests_" + hashlib.sha256(self.path.encode()).hexdigest()[:24]
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())
        found = self._read()
        self.buckets, self.version = found or (buckets, 0)
        if not found:
            self._write()
        self._declare()

    def _note(self) -> str:
        return f"{self.path}/_index"

    def _read(self) -> tuple[int, int] | None:
        """(buckets, version), the newest that is whole; versions are directories, and a note is written once its directory is."""
        if not self._fs.exists(self._at(self._note())):
            return None
        notes = [s.getPath().getName() for s in self._fs.listStatus(self._at(self._note()))]
        version, buckets = max(tuple(map(int, n.split("-"))) for n in notes)
        return buckets, version

    def _write(self) -> None:
        self._fs.create(self._at(f"{self._note()}/{self.version}-{self.buckets}"), True).close()

    def _place(self) -> str:
        return f"{self.path}/v{self.version}"

    def _declare(self) -> None:
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")
        self.spark.sql(
            f"CREATE TABLE {self.name} (digest BINARY, batch STRING) USING parquet "
            f"CLUSTERED BY (digest) SORTED BY (digest) INTO {self.buckets} BUCKETS LOCATION '{self._place()}'"
        )

    def table(self) -> DataFrame:
        return self.spark.table(self.name)

    def forget(self) -> None:
        """Take the table out of the session's catalog; its files stay."""
        self.spark.sql(f"DROP TABLE IF EXISTS {self.name}")

    def append(self, digests: DataFrame, batch: str) -> None:
        """Add digests that no other batch has; what the same batch added before isn't added again."""
        own = self.table().where(F.col("batch") == batch).select("digest")
        new = digests.select("digest", F.lit(batch).alias("batch")).join(own, "digest", "left_anti")
        new = materialize(new, "digests")  # a table can't be read and appended to in one plan
        self._save(new, self._place(), "append")
        if self._files() >= COMPACT * self.buckets:
            self.compact()

    def _save(self, rows: DataFrame, path: str, mode: str) -> None:
        (
            rows.repartition(self.buckets, "digest").write.mode(mode).format("parquet").option("path", path)
            .bucketBy(self.buckets, "digest").sortBy("digest").saveAsTable(self.name)
        )

    def _files(self) -> int:
        return self._fs.getContentSummary(self._at(self._place())).getFileCount()

    def compact(self) -> None:
        """Write the index anew, a sorted file a bucket. The old files go once the new ones are noted; a failure before leaves the old ones in use."""
        old, rows = self._place(), self.spark.read.schema("digest binary, batch string").parquet(self._place())
        self.version += 1
        self._fs.delete(self._at(self._place()), True)  # left over from a compaction that failed
        self._declare()
        self._save(rows, self._place(), "append")
        self._write()
        self._fs.delete(self._at(old), True)


def deduplicate(docs: DataFrame, index: DigestIndex, batch: str | None = None, carry: list[str] | None = None, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows whose text neither the index nor an earlier row has; the index then has them too.

    Of rows with the same text the one with the smallest id stays (NULL ids
    last; among equal ids, one of them). Equal means equal byte for byte: case
    and white space count; empty texts equal one another. Rows with NULL text
    have nothing to compare and all stay. Columns other than id and text don't
    matter and are returned as they are; ``carry`` limits the columns returned,
    and the digest is then added as ``digest``. An empty table gives an empty
    one. A batch that is run again under its name gives the same rows again:
    it ignores what it appended itself. Without a name it is a batch of its
    own, compared with all that the index has.
    """
    batch = uuid.uuid4().hex if batch is None else batch
    row, dig = fresh(docs, "_row", "_digest")
    kept = [c for c in docs.columns if carry is None or c in carry]
    held = materialize(
        docs.select(*kept, *([] if ident in kept else [ident]), digest(F.col(text)).alias(dig), F.monotonically_increasing_id().alias(row)), "rows"
    )
    own = held.where(F.col(dig).isNotNull()).select(F.col(dig).alias("digest"), F.col(ident).alias("_id"), F.col(row).alias("_at")).repartition(index.buckets, "digest")
    first = own.groupBy("digest").agg(F.min(F.struct(F.col("_id").isNull(), F.col("_id"), F.col("_at"))).alias("_first"))
    before = index.table().where(F.col("batch") != batch).select("digest")
    new = materialize(first.join(before.hint("merge"), "digest", "left_anti").select("digest", F.col("_first._at").alias(row)), "new")
    index.append(new, batch)
    # The rows to drop are fewer than those to keep, and are what a broadcast can hold.
    drop = materialize(held.where(F.col(dig).isNotNull()).select(row).join(new.select(row).hint("merge"), row, "left_anti"), "drop")
    out = join_checked(held, drop, row, "left_anti")
    return out.select(*kept, *([F.lower(F.hex(dig)).alias("digest")] if carry is not None else []))


def exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Over all documents with a new index: (doc_id, digest) of each document that stays."""
    index = DigestIndex(spark, scratch_path(spark, "index"))
    out = deduplicate(documents(spark, sf_dir), index, carry=["doc_id"])
    index.forget()
    return out


SQL = "SELECT min(doc_id) AS doc_id, sha256(text) AS digest FROM documents WHERE text IS NOT NULL GROUP BY text UNION ALL SELECT doc_id, NULL FROM documents WHERE text IS NULL"
