"""Shared pieces: scratch tables in the cluster's shared folder, size-checked joins, key columns."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of keys up to which a join side is broadcast (some 16 bytes of payload each); beyond it both sides are shuffled.
BROADCAST_ROWS = 2_000_000

#: Scratch tables by who asked for them.
_made: dict[str, list[tuple[SparkSession, str]]] = {}
_owners = ["operators"]


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir.

    Only where it is unset and the session runs in one local JVM is a temporary
    folder used; on a cluster the setting is required.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local")) or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    own = f"file://{tempfile.mkdtemp(prefix='quillon-')}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder; :func:`release` deletes it, at the latest when the program ends."""
    path = f"{shared_dir(spark)}/quillon/{uuid.uuid4().hex}-{name}"
    _made.setdefault(_owners[-1], []).append((spark, path))
    return path


@contextmanager
def owned(by: str) -> Iterator[None]:
    """Scratch tables made inside belong to ``by``."""
    _owners.append(by)
    try:
        yield
    finally:
        _owners.pop()


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Write a table to the shared folder and read it again: its lineage ends there.

    The files survive the loss of executors, and what the write assigned
    (row ids, for one) is fixed from then on.
    """
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(by: str) -> None:
    """Delete the scratch tables of ``by``. Call it once results that depend on them are written."""
    for spark, path in _made.pop(by, []):
        try:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session may have ended
            continue


@atexit.register
def _release_all() -> None:
    for by in list(_made):
        release(by)


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names that the table doesn't have, whatever its case sensitivity."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def join_checked(df: DataFrame, keys: DataFrame, on: str, how: str, limit: int = BROADCAST_ROWS) -> DataFrame:
    """Join with a small or large table of keys: broadcast if it has at most ``limit`` rows, else shuffle both."""
    small = keys.limit(limit + 1).count() <= limit
    return df.join(F.broadcast(keys) if small else keys.hint("merge"), on, how)


def words(text: Column) -> Column:
    """The non-empty pieces between white space; NULL text has none."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda w: w != "")


def word_count(text: Column) -> Column:
    """How many pieces :func:`words` gives."""
    return F.size(words(text)).cast("long")


def word_hashes(text: Column) -> Column:
    """64-bit hashes of the words, in text order."""
    return F.transform(words(text), lambda w: F.xxhash64(w))


def row_key(df: DataFrame, ident: str = "doc_id", text: str = "text") -> Column:
    """A string that identifies a row for seeded draws: its id, or its content where the id is NULL."""
    return F.coalesce(F.col(ident).cast("string"), F.concat(F.lit("text:"), F.md5(F.col(text).cast("binary"))), F.lit("null"))


def unit_interval(key: Column, seed: int) -> Column:
    """A number in [0, 1) from 48 bits of a keyed digest: same key and seed, same number, on any engine."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary"))
    return F.conv(F.substring(digest, 1, 12), 16, 10).cast("double") / F.lit(float(1 << 48))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
