"""Tables of a run and the shared scratch folder.

Intermediate tables are written as Parquet below the folder named by
``spark.checkpoint.dir``.  On a cluster that setting must name storage all
machines share, and without it nothing runs; only a local session (tests) takes a
temporary folder of this machine.
"""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows of at most a few numbers that may be broadcast: a few MB, whatever the input's size.
BROADCAST_ROWS = 100_000

_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
    if not _local:
        _local.append("file://" + tempfile.mkdtemp(prefix="placewright-"))
    return _local[0]


def stash(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared scratch folder and read it back (cuts lineage)."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/placewright-{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _made.append((spark, path))
    return spark.read.schema(df.schema).parquet(path)


def if_small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` (a written table of a few numbers a row), to be broadcast if it has at most ``rows`` rows.

    Beyond that a join with it is a shuffled one; as the table is written, nothing
    stands between its exchange and the join, and adaptive execution can split a
    key that holds many rows of the other side.
    """
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def likely(rows: DataFrame, column: str, names: DataFrame, most: int = 1 << 20) -> DataFrame:
    """``rows`` whose ``column`` (a long) is in that column of ``names``, a written table, and a few hundredths of the others.

    For a join that follows: most others are left out before they are exchanged.  Three bits
    of a word of 64 for every four names, at most ``most`` words (about 16 MB), are broadcast;
    with more than 4 million names more of the others stay, and no wanted row is ever left out.
    """
    words = min(max(names.count() // 4, 1), most)
    place = F.pmod(F.xxhash64(column), F.lit(words)).alias("__place")
    three = [F.pmod(F.xxhash64(column, F.lit(i)), F.lit(64)).cast("int").alias(f"__bit{i}") for i in range(3)]
    mask = F.expr("shiftleft(1L, __bit0) | shiftleft(1L, __bit1) | shiftleft(1L, __bit2)")
    bits = names.select(place, *three).groupBy("__place").agg(F.bit_or(mask).alias("__word"))
    found = rows.select("*", place, *three).join(F.broadcast(bits), "__place").filter(F.col("__word").bitwiseAND(mask) == mask)
    return found.select(*rows.columns)


def hold_small_batches(spark: SparkSession, size: int = 2 << 20) -> None:
    """Arrow batches of about ``size`` bytes for all that ``spark`` runs from now on.

    For lazy results, which are written after the call that made them: Python workers
    outlive a stage and keep what its largest batches took.
    """
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


@contextmanager
def small_batches(spark: SparkSession, size: int = 4 << 20) -> Iterator[None]:
    """Arrow batches of about ``size`` bytes for what is written inside the block.

    Rows that hold long lists or texts otherwise fill batches of 64 MB, several
    times over in the executors' memory outside the heap.
    """
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, size)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def drop_scratch(spark: SparkSession | None = None) -> None:
    """Delete the scratch tables of ``spark`` (all sessions if none is given)."""
    for owner, path in list(_made):
        if spark is not None and owner is not spark:
            continue
        _made.remove((owner, path))
        try:
            jvm = owner.sparkContext._jvm
            target = jvm.org.apache.hadoop.fs.Path(path)
            target.getFileSystem(owner.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
        except Exception:  # the session has ended: its folder is the cluster's to clear
            pass


atexit.register(drop_scratch)


def id_and_text(docs: DataFrame) -> DataFrame:
    """Only the two columns the text operators read, whatever else ``docs`` holds."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
