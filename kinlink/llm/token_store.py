"""Token ids as Parquet lists in ascending order of documents.

A file holds doc_id, start (ids before the document in this file) and n_tokens delta-encoded, and ids as a list of
unsigned 32-bit numbers, dictionary-encoded, in row groups of bounded tokens with page indexes. A reader takes the
metadata columns without the ids, or the ids of some documents from the row groups that hold them. The manifest
tells each file's place among all ids.

Documents are dealt by range of (doc_id, text hash) and sorted within tasks; equal rows aside, no key is too
frequent to be split. Each text is encoded once: files count from zero, and the manifest, one row a file, adds them up.

Defined results: a null or empty text has the end id alone. Null doc_ids come first. Rows with equal doc_ids are
ordered by their text's hash. An empty table gives no files and an empty manifest. Other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinlink.llm.common import named, open_store, scratch, ship, table, tidy
from kinlink.llm.tokens import encoder

AT_ONCE = 256
FILE = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), pa.field("ids", pa.list_(pa.field("element", pa.uint32())))])
MANIFEST = "part long, number long, file string, n_docs long, n_tokens long, first_doc long, last_doc long"


def _writer(folder: str, vocabulary: str, end_id: int, group_tokens: int, file_tokens: int, page_bytes: int):
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = encoder(vocabulary, end_id).encode, TaskContext.get()
        name = f"{folder}/ids-{task.partitionId():06d}-{task.taskAttemptId()}"
        store, path = open_store(folder)
        store.create_dir(path, recursive=True)
        closed: list[tuple] = []
        out, stream, n_docs, n_tokens, first = None, None, 0, 0, None
        group: list[tuple] = []
        held = 0

        def flush() -> None:
            nonlocal group, held
            if group:
                ids = pa.array(np.frombuffer(b"".join(x[2] for x in group), "<u4"), pa.uint32())
                ends, total = [0], 0
                for x in group:
                    total += len(x[2]) // 4
                    ends.append(total)
                columns = [pa.array([x[0] for x in group], pa.int64()), pa.array([x[1] for x in group], pa.int64()), pa.array([len(x[2]) // 4 for x in group], pa.int64())]
                out.write_table(pa.table([*columns, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), ids).cast(FILE.field("ids").type)], schema=FILE), row_group_size=1 << 40)
                group, held = [], 0

        def close(last) -> None:
            nonlocal out
            flush()
            out.close()
            stream.close()
            closed.append((task.partitionId(), len(closed), f"{name}-{len(closed):05d}.parquet", n_docs, n_tokens, first, last))
            out = None

        last = None
        for batch in batches:
            pairs = (x for at in range(0, batch.num_rows, AT_ONCE) for x in zip(batch.column(0).slice(at, AT_ONCE).to_pylist(), encode(batch.column(1).slice(at, AT_ONCE).to_pylist())))
            for last, ids in pairs:
                if out is None:
                    stream = open_store(f"{name}-{len(closed):05d}.parquet")
                    stream = stream[0].open_output_stream(stream[1])
                    out = pq.ParquetWriter(
                        stream, FILE, compression="zstd", use_dictionary=["ids.list.element"], dictionary_pagesize_limit=1 << 20, data_page_size=page_bytes, write_page_index=True,
                        column_encoding={c: "DELTA_BINARY_PACKED" for c in ("doc_id", "start", "n_tokens")},
                    )
                    n_docs, n_tokens, first = 0, 0, last
                group.append((last, n_tokens, ids))
                n_docs, n_tokens, held = n_docs + 1, n_tokens + len(ids) // 4, held + len(ids) // 4
                if held >= group_tokens:
                    flush()
                if n_tokens >= file_tokens:
                    close(last)
        if out is not None:
            close(last)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(c), t) for c, t in zip(zip(*closed) if closed else [()] * 7, [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 4])],
            [x.split()[0] for x in MANIFEST.split(", ")],
        )

    return write


def write_tokens(
    docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", vocabulary: str = "byte_bpe_50k.json", end_id: int = 2,
    group_tokens: int = 1 << 20, file_tokens: int = 1 << 28, page_bytes: int = 1 << 16,
) -> DataFrame:
    """Writes the ids of all documents under folder; returns the manifest with each file's first place among all ids (base)."""
    spark = docs.sparkSession
    ship(spark)
    own = docs.select(F.col(named(key)).cast("long").alias("key"), F.col(named(text)).cast("string").alias("text"))
    order = [F.col("key").asc_nulls_first(), F.xxhash64("text")]
    dealt = own.repartitionByRange(*order).sortWithinPartitions(*order)
    dealt.mapInArrow(tidy(_writer(folder, vocabulary, end_id, group_tokens, file_tokens, page_bytes)), MANIFEST).write.parquet(f"{folder}/manifest")
    manifest = spark.read.schema(MANIFEST).parquet(f"{folder}/manifest")
    before = Window.orderBy("part", "number").rowsBetween(Window.unboundedPreceding, -1)  # one row a file
    return manifest.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)))


def _reader(ids_as: str, group_of: int):
    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        wanted = ["doc_id", "start", "n_tokens"] + (["ids"] if ids_as != "none" else [])
        for batch in batches:
            for uri, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                store, path = open_store(uri)
                with store.open_input_file(path) as source:
                    file = pq.ParquetFile(source)
                    for g in range(file.num_row_groups):
                        t = file.read_row_group(g, columns=wanted, use_threads=False).combine_chunks()  # a task has one core
                        columns = {"doc_id": t["doc_id"], "start": pa.array(t["start"].to_numpy() + base, pa.int64()), "n_tokens": t["n_tokens"]}
                        if ids_as != "none":
                            lists = t["ids"].chunk(0) if t["ids"].num_chunks else pa.array([], FILE.field("ids").type)
                            values, ends = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False), lists.offsets.to_numpy()
                            texts = [values[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]
                            columns |= {"ids_crc32": pa.array([zlib.crc32(x) for x in texts], pa.int64())} if ids_as == "crc32" else {"ids": pa.array(texts, pa.binary())}
                        done = pa.table(columns).combine_chunks()
                        yield from done.to_batches(max_chunksize=group_of)

    return read


def read_tokens(manifest: DataFrame, *, ids: str = "bytes") -> DataFrame:
    """All documents of the files: doc_id, start, n_tokens, and by ids their bytes (ids), their crc32 (ids_crc32) or, with "none", only the metadata columns."""
    ship(manifest.sparkSession)
    more = {"bytes": ", ids binary", "crc32": ", ids_crc32 long", "none": ""}[ids]
    files = manifest.select("file", "base")
    return files.repartition(max(1, manifest.count())).mapInArrow(tidy(_reader(ids, 1 << 14)), "doc_id long, start long, n_tokens long" + more)


def document_ids(spark: SparkSession, files: DataFrame, doc_id: int) -> DataFrame:
    """The ids of one document: files by their first and last doc_id, then pages by their indexes."""
    paths = [r.file for r in files.where((F.col("first_doc").isNull() | (F.col("first_doc") <= doc_id)) & (F.col("last_doc") >= doc_id)).select("file").collect()]  # one or two files
    if not paths:
        return spark.createDataFrame([], "doc_id long, ids array<long>")
    return spark.read.parquet(*paths).where(F.col("doc_id") == doc_id).select("doc_id", "ids")


def op9_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Writes the ids of all documents and reads the files back."""
    return read_tokens(write_tokens(table(spark, sf_dir, "documents"), scratch(spark, "tokens")), ids="crc32")
