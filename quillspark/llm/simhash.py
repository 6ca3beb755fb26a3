"""SimHash near-duplicates by deletion-variant signatures.

A 64-bit fingerprint is cut into two 32-bit segments. Two fingerprints that differ in at most two bits
have a segment that differs in at most one, so they agree on one of that segment's 32 variants with
one bit as a wildcard. Variants are the join keys; candidates are verified on all 64 bits. Only
distinct fingerprints are indexed, so copies cost nothing. A bucket of up to ``BUCKET`` fingerprints
is compared within one row and yields a spanning forest of its links rather than all of them; the
members of a larger one are indexed by all variants with two wildcards of the whole fingerprint,
whose buckets hold four at most.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from ..session import Scratch
from .common import bounded_batches, fresh, picked
from .components import connected
from .tokens import texts

SEED = 42
#: The most fingerprints that are compared pair by pair in one place.
BUCKET = 1024
#: Fingerprints that differ in at most so many bits are linked; the index is made for this number.
DISTANCE = 2


def fingerprint(text: str | None, words: int = 3) -> int:
    """The 64 majority bits of the XXH64 of all word shingles, repeats included; 0 without words."""
    import numpy as np
    import xxhash

    found = text.encode().lower().split() if text else []
    if not found:
        return 0
    shingles = [b" ".join(s) for s in zip(*[found[i:] for i in range(words)])] if len(found) >= words else [b" ".join(found)]
    hashed = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 16):
        part = np.array([hashed(s, SEED) for s in shingles[at : at + (1 << 16)]], "<u8")
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(shingles), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fp`` (the 64 bits as a signed long) for every row."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t, words) for t in texts(batch.column(1))], "<u8").view("<i8")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], names=["doc_id", "fp"])

    return picked(docs, id_col, text_col).mapInArrow(run, "doc_id long, fp long")


def variants(distinct: DataFrame) -> DataFrame:
    """``segment, key, fp``: 64 one-wildcard variants of each fingerprint; ``segment`` tells which."""
    bit = F.col("segment") % 32
    half = F.when(F.col("segment") < 32, F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF))).otherwise(F.shiftrightunsigned("fp", 32))
    exploded = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("segment"))
    cleared = half.bitwiseAND(F.bitwise_not(F.call_function("shiftleft", F.lit(1).cast("long"), bit)))
    # The number of the variant (6 bits) above the segment (32 bits): one long is the whole key.
    return exploded.select((F.col("segment").cast("long") * (1 << 32) + cleared).alias("key"), "fp")


def links(distinct: DataFrame, scratch: Scratch) -> DataFrame:
    """Edges ``a, b`` that connect the same fingerprints as all pairs within ``DISTANCE`` bits would."""
    # Few bytes become 64 times as many, so they are dealt to all tasks first; adaptive execution would leave one or two.
    width = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    index = variants(distinct.repartition(width))
    keys = scratch.keep(index.groupBy("key").agg(F.count("*").alias("n"), F.min("fp").alias("lo"), F.max("fp").alias("hi")).filter("n > 1"), "keys")
    near = F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= DISTANCE
    pairs = keys.filter("n = 2").select(F.col("lo").alias("a"), F.col("hi").alias("b")).filter(near)
    members = scratch.keep(index.join(keys.filter("n > 2").select("key", "n"), "key"), "members")
    gathered = members.filter(F.col("n") <= BUCKET).groupBy("key").agg(F.collect_list("fp").alias("fps")).select("fps")

    def forest(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            a: list[int] = []
            b: list[int] = []
            for fps in batch.column(0).to_pylist():
                own = np.array(fps, np.int64).view(np.uint64)
                left = np.ones(len(own), bool)
                for start in range(len(own)):
                    if not left[start]:
                        continue
                    queue = [start]
                    left[start] = False
                    while queue:
                        at = queue.pop()
                        close = np.flatnonzero(left & (np.bitwise_count(own ^ own[at]) <= DISTANCE))
                        left[close] = False
                        queue += close.tolist()
                        a += [fps[at]] * len(close)
                        b += [fps[j] for j in close]
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    within = gathered.mapInArrow(forest, "a long, b long")
    return pairs.unionByName(within).unionByName(_crowded(members.filter(F.col("n") > BUCKET).select("fp").distinct()))


def _crowded(distinct: DataFrame) -> DataFrame:
    """Edges among the members of crowded buckets: equal under two wildcards means within two bits."""
    one = F.lit(1).cast("long")
    masked = distinct.select("fp", F.explode(F.sequence(F.lit(0), F.lit(62))).alias("i")).select("fp", "i", F.explode(F.sequence(F.col("i") + 1, F.lit(63))).alias("j"))
    mask = F.call_function("shiftleft", one, F.col("i")).bitwiseOR(F.call_function("shiftleft", one, F.col("j")))
    keyed = masked.select("i", "j", F.col("fp").bitwiseAND(F.bitwise_not(mask)).alias("rest"), "fp")
    least = keyed.groupBy("i", "j", "rest").agg(F.min("fp").alias("a"), F.collect_set("fp").alias("others")).filter("size(others) > 1")
    return least.select("a", F.explode("others").alias("b")).filter("a <> b")


def _rooted(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """``fp, least, root``: each distinct fingerprint, its smallest id and its component."""
    classes = rows.groupBy("fp").agg(F.min("doc_id").alias("least"))
    edges = links(classes.select("fp"), scratch)
    roots = connected(edges).select(F.col("node").alias("fp"), "root")
    return classes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """``doc_id, fingerprint, component_id`` for every row.

    ``fingerprint`` is 16 lowercase hex digits; ``component_id`` is the smallest id that links reach.
    Null and empty texts have fingerprint zero and are linked like any other; ids that are null get
    their component's smallest id, or null if there is none. Repeated rows stay repeated. An empty
    table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "simhash")
    rows = scratch.keep(fingerprints(docs, id_col, text_col, words), "fingerprints")
    rooted = _rooted(rows, scratch)
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return rows.join(named, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def representatives(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3) -> DataFrame:
    """One row of ``docs``, all columns, for each component: that of its smallest id.

    Rows with a null id are kept only where their component has no other id. Of the rows that repeat
    the chosen id and fingerprint one stays; a fingerprint has one component, so ids may be null or
    repeat. Numbers are matched, not texts. Null texts are empty ones, texts of any length are read
    whole, and an empty table gives no rows.
    """
    scratch = Scratch(docs.sparkSession, "representatives")
    rooted = _rooted(scratch.keep(fingerprints(docs, id_col, text_col, words), "fingerprints"), scratch)
    first = F.min(F.struct(F.col("least").isNull(), "least", "fp")).alias("first")
    chosen = scratch.keep(rooted.groupBy("root").agg(first).select(F.col("first.least").alias("least"), F.col("first.fp").alias("fp")), "chosen")
    own, where = fresh("fingerprint_of_row", docs.columns), docs.columns.index(text_col)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = [f - (1 << 64) if f >> 63 else f for f in (fingerprint(t, words) for t in texts(batch.column(where)))]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fps, pa.int64())], names=[*batch.schema.names, own])

    known = docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(own, LongType())]))
    kept = known.join(chosen, known[id_col].cast("long").eqNullSafe(chosen["least"]) & (known[own] == chosen["fp"]), "left_semi")
    return kept.dropDuplicates([own]).select(*docs.columns)
