"""What the operators share: tables, shared scratch folders, shipping of code, files of any store."""

from __future__ import annotations

import io
import os
import sys
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{str(sf_dir).rstrip('/')}/{name}.parquet")


def scratch_root(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; a folder of our own only where it names none."""
    set_by_cluster = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if set_by_cluster:
        return set_by_cluster.rstrip("/")
    if not spark.sparkContext.master.partition("[")[0] == "local":
        raise RuntimeError("a cluster names its shared folder in spark.checkpoint.dir")
    own = f"file://{tempfile.gettempdir()}/kinlink-{os.getpid()}"
    spark.conf.set("spark.checkpoint.dir", own)
    return own


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under scratch_root, deleted when the application ends."""
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    folder = jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return path


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Writes df to a scratch table and reads it back: cuts the lineage, survives the loss of any executor."""
    path = f"{scratch(df.sparkSession, name)}/t"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, once an application."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    top = Path(__file__).resolve().parent.parent
    packed = io.BytesIO()
    with zipfile.ZipFile(packed, "w") as z:
        for p in sorted(top.rglob("*.py")):
            z.write(p, str(p.relative_to(top.parent)))
    uri = f"{scratch(spark, 'code')}/kinlink_code.zip"
    store, path = open_store(uri)
    store.create_dir(path.rpartition("/")[0], recursive=True)
    with store.open_output_stream(path) as out:
        out.write(packed.getvalue())
    spark.sparkContext.addPyFile(uri)
    _shipped.add(app)


def open_store(uri: str):
    """(pyarrow filesystem, path) of a URI of any store that pyarrow knows."""
    from pyarrow import fs

    if "://" not in uri and not uri.startswith("file:"):
        return fs.LocalFileSystem(), uri
    if uri.startswith("file:"):
        return fs.LocalFileSystem(), "/" + uri[5:].lstrip("/")
    return fs.FileSystem.from_uri(uri)


def give_back() -> None:
    """Returns what a worker has freed to the system: workers live on after their task, beside the executor's own memory."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    if sys.platform == "linux":
        ctypes.CDLL(None).malloc_trim(0)


def tidy(run):
    """A function for mapInArrow that gives back its memory when it ends."""

    def tidied(batches):
        yield from run(batches)
        give_back()

    return tidied


def no_clash(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of df has, in any letter case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        while n.lower() in taken:
            n = f"_{n}"
        taken.add(n.lower())
        out.append(n)
    return out


def named(column: str) -> str:
    """A column's name as Spark reads it whole, dots, blanks and back quotes included."""
    return "`" + column.replace("`", "``") + "`"


def columns_of(df: DataFrame) -> list[Column]:
    return [F.col(named(c)) for c in df.columns]


def spread_join(many: DataFrame, one: DataFrame, key: str, *, by: str, n: str) -> DataFrame:
    """many joined with one on key; one has a row a key and tells in n how many rows of many hold it.

    A key that holds more than a share of all rows, half of what a task has on average, is dealt to several tasks by the
    column by, and its row of one goes to each. There are fewer such keys than shares, so their list is broadcast."""
    shares = 2 * int(many.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    total = one.agg(F.sum(n)).first()[0] or 0
    hot = F.broadcast(one.where(F.col(n) * shares > total).select(key, F.ceil(F.col(n) * shares / max(total, 1)).cast("int").alias("_parts")))
    dealt = many.join(hot, key, "left").withColumn("_part", F.pmod(F.xxhash64(by), F.coalesce("_parts", F.lit(1))).cast("int")).drop("_parts")
    every = one.drop(n).join(hot, key, "left").withColumn("_part", F.explode(F.sequence(F.lit(0), F.coalesce("_parts", F.lit(1)) - 1))).drop("_parts")
    return dealt.join(every, [key, "_part"]).drop("_part")


FILTER_HASHES, BITS_EACH, FEWEST_BITS, MOST_BITS = 4, 64, 1 << 18, 1 << 24  # a filter has at most 2 MB


class Sieve:
    """A Bloom filter of 64-bit hashes, the column h of a table: a constant that goes with the tasks.

    Its size follows their number n up to MOST_BITS; beyond, it lets more through, and what it lets through is always
    told apart exactly afterwards."""

    def __init__(self, hashes: DataFrame, n: int):
        self.bits = min(MOST_BITS, max(FEWEST_BITS, 1 << (BITS_EACH * n).bit_length()))
        places = hashes.select(F.explode(F.array(*self._places(F.col("h")))).alias("b"))
        made = places.groupBy(F.shiftright("b", 6).alias("i")).agg(F.bit_or(F.expr("shiftleft(1L, b & 63)")).alias("bits"))
        every = hashes.sparkSession.range(self.bits // 64).select(F.col("id").cast("int").alias("i")).join(made, "i", "left").select("i", F.coalesce("bits", F.lit(0).cast("bigint")).alias("bits"))
        listed = every.agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("i", "bits"))), lambda x: x["bits"].cast("string")), ",")).first()[0]
        self.table = F.split(F.lit(listed), ",").cast("array<bigint>")  # folded to a literal, where a list of literals would take an expression a long

    def _places(self, h: Column) -> list[Column]:
        return [F.shiftrightunsigned(h, 12 * k).bitwiseAND(F.lit(self.bits - 1)).cast("int") for k in range(FILTER_HASHES)]

    def may_hold(self, h: Column) -> Column:
        out = None
        for b in self._places(h):
            hit = F.getbit(F.get(self.table, F.shiftright(b, 6)), b.bitwiseAND(F.lit(63))) == 1
            out = hit if out is None else out & hit
        return out


def _small(few: DataFrame, most_bytes: int) -> DataFrame:
    """few, a written table of keys, to be broadcast if it is counted to be small enough."""
    return F.broadcast(few) if few.count() * 64 <= most_bytes else few


def only_in(many: DataFrame, few: DataFrame, key: str, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of many whose key is in few; they are not moved while the keys are few."""
    return many.join(_small(few.select(key), most_bytes), key, "left_semi")


def not_in(many: DataFrame, few: DataFrame, key: str, most_bytes: int = 32 << 20) -> DataFrame:
    """The rows of many whose key is not in few; they are not moved while the keys are few."""
    return many.join(_small(few.select(key), most_bytes), key, "left_anti")
