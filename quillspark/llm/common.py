"""Helpers that the operators of this subpackage share."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts reach Python a few megabytes at a time, however long they are.
BATCH_ROWS, BATCH_BYTES = 1000, 4 << 20
#: Where the different words of many texts are looked up once, batches are joined to about so many bytes.
JOINED_BYTES = 16 << 20

# The white space of the word patterns, as a regular expression class.
SPACES = r"\x20\x09-\x0D"


def bounded_batches(spark: SparkSession) -> None:
    """Bound the Arrow batches by bytes as well as by rows, unless the session already says otherwise."""
    conf = spark.conf
    if conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def joined(batches, size: int = JOINED_BYTES):
    """The same rows in fewer Arrow batches: those that together have up to ``size`` bytes are one; none is cut, empty ones are left out."""
    import pyarrow as pa

    held, n = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and n + batch.nbytes > size:
            yield pa.concat_batches(held)
            held, n = [], 0
        held.append(batch)
        n += batch.nbytes
    if held:
        yield pa.concat_batches(held)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def picked(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, so that no other column can clash with what an operator adds."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def fresh(name: str, columns: list[str]) -> str:
    """``name`` with as many underscores before it as no column needs to clash with it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def column(name: str) -> Column:
    """The column of exactly this name, whatever signs it holds."""
    return F.col("`" + name.replace("`", "``") + "`")


def tokenizer_path() -> str:
    """The default vocabulary file; operators take the path as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def held_out(id_col: str, modulus: int, remainder: int) -> Column:
    """Whether the crc32 of the id as text has this remainder; a null id counts as held out."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def labelled(docs: DataFrame, labels: DataFrame, label_col: str, unseen: Column, max_rows: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``text, label`` of at most about ``max_rows`` labelled documents that are not held out.

    The labels are chosen first, by a hash of their id, so the side that is broadcast has at most
    ``max_rows`` rows of two numbers, and documents are never shuffled. Null labels are left out, an id
    with several labels has the smallest, and of documents with equal texts and labels one is used.
    """
    known = labels.filter(~unseen & F.col(label_col).isNotNull()).select(F.col(id_col).cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    chosen = known.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    return picked(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("text", "label").dropDuplicates()
