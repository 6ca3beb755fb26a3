"""Token-ID files: Parquet list columns in ascending document order.

Each file holds one row per document: ``doc_id``, ``local_start`` (ids of the documents before it in
the same file), ``n_tokens`` and ``tokens`` (a list of ids). The list is dictionary encoded, the
counters are written without a dictionary by the second writer version and so delta encoded; row
groups and pages have set sizes, and Parquet's column and offset indexes let a reader fetch a few
documents' tokens, or metadata alone, without decoding the rest.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import bounded_batches, joined, picked
from .tokens import ENCODED_BYTES, crc, encoder


@dataclass(frozen=True)
class Layout:
    """Sizes in bytes; ``rows_per_page`` bounds how many documents a selective read decodes."""

    row_group: int = 16 << 20
    page: int = 256 << 10
    rows_per_page: int = 256
    #: Ids in a dictionary hardly shrink further, so a cheap codec does.
    codec: str = "snappy"


def encode_documents(docs: DataFrame, tokenizer: str, end_id: int, id_col: str = "doc_id", text_col: str = "text", files: int | None = None) -> DataFrame:
    """``doc_id, local_start, n_tokens, tokens, shard``: rows in ascending ``doc_id`` within ascending shards.

    A null text is an empty one and yields the end id alone. Null ids come first. Repeated ids are
    all kept, ordered by text. An empty table gives no rows. Other columns are ignored.
    """
    bounded_batches(docs.sparkSession)
    rows = picked(docs, id_col, text_col)
    ranged = rows.repartitionByRange(files, "doc_id") if files else rows.repartitionByRange("doc_id")

    def run(batches):
        import numpy as np
        import pyarrow as pa
        from pyspark import TaskContext

        shard, start, enc = TaskContext.get().partitionId(), 0, encoder(tokenizer)
        for batch in joined(batches, ENCODED_BYTES):
            found, ends = enc.encode_column(batch.column(1))
            values = np.insert(found, ends[1:], end_id).view("<i4")
            offsets = ends + np.arange(len(ends))
            tokens = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values))
            arrays = [batch.column(0), pa.array(start + offsets[:-1]), pa.array(np.diff(offsets)), tokens, pa.array(np.full(batch.num_rows, shard, np.int32))]
            made = pa.RecordBatch.from_arrays(arrays, names=["doc_id", "local_start", "n_tokens", "tokens", "shard"])
            start += int(offsets[-1])
            for at in range(0, batch.num_rows, 64):
                yield made.slice(at, 64)

    return ranged.sortWithinPartitions("doc_id", "text").mapInArrow(run, "doc_id long, local_start long, n_tokens long, tokens array<int>, shard int")


def write(encoded: DataFrame, path: str, layout: Layout = Layout()) -> None:
    """Write what ``encode_documents`` made; one file for each shard that has rows."""
    (
        encoded.write.option("compression", layout.codec)
        .option("parquet.writer.version", "v2")
        .option("parquet.block.size", layout.row_group)
        .option("parquet.page.size", layout.page)
        .option("parquet.page.row.count.limit", layout.rows_per_page)
        .option("parquet.enable.dictionary", "false")
        .option("parquet.enable.dictionary#tokens.list.element", "true")
        .option("parquet.dictionary.page.size", 1 << 20)
        .parquet(path)
    )


SCHEMA = "doc_id long, local_start long, n_tokens long, tokens array<int>, shard int"


def _with_starts(rows: DataFrame) -> DataFrame:
    """``start`` over all documents: each file's first id, one small row for each file, plus its own counter."""
    shards = rows.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    bases = shards.select("shard", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    return rows.join(F.broadcast(bases), "shard").withColumn("start", F.col("base") + F.col("local_start"))


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, shard`` of every document, without reading a token page."""
    return _with_starts(spark.read.schema(SCHEMA).parquet(path)).select("doc_id", "start", "n_tokens", "shard")


def read(spark: SparkSession, path: str) -> DataFrame:
    """``doc_id, start, n_tokens, tokens``; a filter on ``doc_id`` reaches the page indexes."""
    return _with_starts(spark.read.schema(SCHEMA).parquet(path)).select("doc_id", "start", "n_tokens", "tokens")


def checksums(tokens: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of rows with ``tokens``; the crc is over little-endian ids."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            lists = batch.column("tokens")
            values = lists.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            ends = np.asarray(lists.offsets)
            sums = [crc(values[a:b].tobytes()) for a, b in zip(ends[:-1], ends[1:])]
            kept = [batch.column(n) for n in ("doc_id", "start", "n_tokens")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(sums, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return tokens.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
