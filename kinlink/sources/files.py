"""Readers and writers. Spark's own commit protocol makes writes whole; a folder is done when it has _SUCCESS."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterable

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

RECORD = "entity_id string, business_name string, business_address string, country string"


def read_records(spark: SparkSession, *paths: str) -> DataFrame:
    """Tab-separated records with a header, no quoting; empty fields as empty strings, other columns dropped."""
    raw = spark.read.option("sep", "\t").option("header", True).option("quote", "").option("inferSchema", False).csv(list(paths))
    return raw.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("entity_id", "business_name", "business_address", "country")))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """n and line of a text file, or of a folder's parts in the order of their names, from 0.

    A line's number is its place in its split and the lines of the splits before, of which there is a row a split."""
    lines = spark.read.text(path).select("value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("begin"), F.monotonically_increasing_id().alias("id"))
    splits = lines.groupBy("file", "begin").agg(F.count("*").alias("lines"), F.min("id").alias("first"))
    before = Window.orderBy("file", "begin").rowsBetween(Window.unboundedPreceding, -1)  # a row a split
    placed = splits.select("file", "begin", (F.coalesce(F.sum("lines").over(before), F.lit(0)) - F.col("first")).alias("shift"))
    return lines.join(F.broadcast(placed), ["file", "begin"]).select((F.col("id") + F.col("shift")).alias("n"), F.col("value").alias("line"))


def gold_pairs(lists: DataFrame, ids: str = "source1_entity_id", matched: str = "matched_entity_ids") -> DataFrame:
    """s1_id and cand_id, one a row, from comma-joined lists; blanks are no ids."""
    return lists.select(F.col(ids).alias("s1_id"), F.explode(F.split(F.coalesce(matched, F.lit("")), ",")).alias("cand_id")).where("cand_id <> ''").distinct()


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """gold_pairs of a file with a header, of whatever parts; of an id's rows the last counts."""
    fields = F.split("line", "\t")
    rows = numbered_lines(spark, path).where("n > 0").select("n", F.get(fields, F.lit(0)).alias("source1_entity_id"), F.get(fields, F.lit(1)).alias("matched"))
    return gold_pairs(rows.groupBy("source1_entity_id").agg(F.max_by("matched", "n").alias("matched_entity_ids")))


def exists(spark: SparkSession, path: str) -> bool:
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def is_done(spark: SparkSession, path: str) -> bool:
    return exists(spark, f"{path}/_SUCCESS")


def stage(spark: SparkSession, path: str, make, columns: list[str] | None = None) -> DataFrame:
    """The Parquet table at a path, made first if it is not done; columns: what is read of it."""
    if not is_done(spark, path):
        make().write.mode("overwrite").parquet(path)
    read = spark.read.parquet(path)
    return read.select(*columns) if columns else read


def write_records(records: DataFrame, path: str) -> None:
    """What read_records reads: tab-separated parts, each with the header, nothing quoted."""
    plain = records.select(*(F.regexp_replace(F.coalesce(c, F.lit("")), r"[\t\r\n]", " ").alias(c) for c in ("entity_id", "business_name", "business_address", "country")))
    plain.write.mode("overwrite").option("sep", "\t").option("header", True).option("quote", "\u0000").option("emptyValue", "").option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)


def scratch(spark: SparkSession) -> str:
    """A fresh folder in the shared one of spark.checkpoint.dir (on one machine without it, a temporary one), deleted when the application ends."""
    root = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.partition("[")[0] != "local":
            raise RuntimeError("a cluster names its shared folder in spark.checkpoint.dir")
        root = f"file://{tempfile.gettempdir()}/kinlink-{os.getpid()}"
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{root.rstrip('/')}/matching-{uuid.uuid4().hex}")
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(folder)
    return folder.toString()


def written(df: DataFrame) -> DataFrame:
    """df by way of a table in a scratch folder."""
    return written_parts([df])


CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def written_parts(parts: Iterable[DataFrame]) -> DataFrame:
    """Tables of one schema by way of a table in a scratch folder, one after the other: the shuffle files of each are deleted before the next is begun."""
    folder, paths = None, []
    for df in parts:
        spark, schema = df.sparkSession, df.schema
        folder = folder or scratch(spark)
        paths.append(f"{folder}/t{len(paths)}")
        before = spark.conf.get(CLEANUP, None)
        spark.conf.set(CLEANUP, "true")
        try:
            df.write.option("compression", "zstd").parquet(paths[-1])
        finally:
            spark.conf.set(CLEANUP, before) if before is not None else spark.conf.unset(CLEANUP)
    return spark.read.schema(schema).parquet(*paths)


def write_bucketed_index(index: DataFrame, table: str, buckets: int) -> None:
    """The index as a table bucketed and sorted by key: joins on key then shuffle the other side only."""
    index.write.mode("overwrite").bucketBy(buckets, "key").sortBy("key").saveAsTable(table)


def write_lists(lists: DataFrame, path: str) -> None:
    """Tab-separated, in order of source1_entity_id, nothing quoted; the parts one behind the other are a file with one header."""
    number = F.coalesce(F.substring_index("source1_entity_id", "-", -1).cast("long"), F.lit(0))
    body = lists.select(F.lit(1).alias("part"), number.alias("number"), F.col("source1_entity_id").alias("id"), F.concat_ws("\t", *lists.columns).alias("value"))
    head = lists.sparkSession.createDataFrame([(0, 0, "", "\t".join(lists.columns))], "part int, number long, id string, value string")
    head.unionByName(body).orderBy("part", "number", "id").select("value").write.mode("overwrite").text(path)


def join_parts(spark: SparkSession, folder: str, path: str) -> None:
    """Writes a folder's parts as one file, streamed from store to store; whole or not at all."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    source, target, half = (jvm.org.apache.hadoop.fs.Path(p) for p in (folder, path, f"{path}.tmp"))
    store, out_store = source.getFileSystem(conf), target.getFileSystem(conf)
    parts = sorted(s.getPath().toString() for s in store.listStatus(source) if s.getPath().getName().startswith("part-"))
    out = out_store.create(half, True)
    for p in parts:
        part = store.open(jvm.org.apache.hadoop.fs.Path(p))
        jvm.org.apache.hadoop.io.IOUtils.copyBytes(part, out, 1 << 20, False)
        part.close()
    out.close()
    out_store.delete(target, False)
    out_store.rename(half, target)


def write_settings(spark: SparkSession, path: str, rows: list[dict]) -> None:
    spark.createDataFrame(rows).coalesce(1).write.mode("overwrite").json(path)


def read_settings(spark: SparkSession, path: str) -> list[dict]:
    return [r.asDict() for r in spark.read.json(path).collect()]  # a row or a few


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
