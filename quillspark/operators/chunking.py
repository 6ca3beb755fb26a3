"""Documents to chunks, as folds over arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X

STRINGS = "array<string>"
PIECES = "array<struct<section:string,text:string>>"


def nonempty(strings: Column) -> Column:
    return F.filter(F.transform(strings, X.strip), lambda s: s != "")


def sentence_pieces(text: Column) -> Column:
    """Sentences between full stops or line ends, stripped, none empty."""
    return nonempty(F.split(F.replace(text, F.lit("\n"), F.lit("。")), "。"))


def pack(pieces: Column, size: int, joint: str = "\n") -> Column:
    """Pieces joined greedily while no longer than ``size``; a longer piece stays whole."""
    start = F.struct(F.lit(None).cast("string").alias("cur"), F.array().cast(STRINGS).alias("done"))

    def step(a: Column, p: Column) -> Column:
        fits = F.length(a["cur"]) + len(joint) + F.length(p) <= size
        cur = F.when(a["cur"].isNull(), p).when(fits, F.concat(a["cur"], F.lit(joint), p)).otherwise(p)
        done = F.when(a["cur"].isNull() | fits, a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"])))
        return F.struct(cur.alias("cur"), done.alias("done"))

    return F.aggregate(pieces, start, step, lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(a["cur"]))))


def pack_sections(pieces: Column, size: int, overlap: int) -> Column:
    """Like ``pack`` within each section; a chunk that overflows starts with the last one's tail."""
    start = F.struct(F.lit(None).cast("string").alias("cur"), F.lit("").alias("section"), F.array().cast(PIECES).alias("done"))

    def step(a: Column, p: Column) -> Column:
        none = a["cur"].isNull()
        same = ~none & (a["section"] == p["section"])
        fits = same & (F.length(a["cur"]) + 1 + F.length(p["text"]) <= size)
        tail = F.when(F.lit(overlap) > 0, F.concat(F.substring(a["cur"], -overlap, overlap), F.lit("\n"), p["text"])).otherwise(p["text"]) if overlap else p["text"]
        cur = F.when(fits, F.concat(a["cur"], F.lit("\n"), p["text"])).when(same, tail).otherwise(p["text"])
        closed = F.concat(a["done"], F.array(F.struct(a["section"].alias("section"), a["cur"].alias("text"))))
        return F.struct(cur.alias("cur"), p["section"].alias("section"), F.when(none | fits, a["done"]).otherwise(closed).alias("done"))

    last = lambda a: F.when(a["cur"].isNull(), a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(a["section"].alias("section"), a["cur"].alias("text")))))
    return F.aggregate(pieces, start, step, last)


def long_paragraph(text: Column, size: int = 500) -> Column:
    """A paragraph over ``size`` characters cut after sentence ends and packed with spaces; else itself."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(pack(nonempty(F.split(text, r"(?<=[。！？!?])")), size, " "))


def markdown_pieces(text: Column, size: int = 500) -> Column:
    """Paragraphs with the path of headings above them.

    A heading replaces those of its level and below; its line joins the paragraph that directly
    follows, and is dropped if a blank line comes first.
    """
    lines = F.split(F.coalesce(text, F.lit("")), "\n")
    # A blank line after the last one closes the last paragraph.
    lines = F.concat(lines, F.array(F.lit("")))
    start = F.struct(
        F.array().cast("array<string>").alias("path"),
        F.lit("").alias("head"),
        F.array().cast("array<string>").alias("para"),
        F.array().cast(PIECES).alias("done"),
    )

    def step(a: Column, raw: Column) -> Column:
        line = X.strip(raw)
        marks = F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 1)
        title = X.strip(F.regexp_extract(line, r"^(#{1,6})\s+(.+)$", 2))
        heading, blank = marks != "", line == ""
        body = F.array_join(a["para"], "\n")
        text_ = F.when(a["head"] == "", body).otherwise(F.concat(a["head"], F.lit("\n"), body))
        closed = F.when(F.size(a["para"]) == 0, a["done"]).otherwise(F.concat(a["done"], F.array(F.struct(F.array_join(a["path"], "/").alias("section"), text_.alias("text")))))
        none = F.array().cast("array<string>")
        return F.struct(
            F.when(heading, F.concat(F.slice(a["path"], F.lit(1), F.least(F.length(marks) - 1, F.size(a["path"]))), F.array(title))).otherwise(a["path"]).alias("path"),
            F.when(heading, line).when(blank, F.lit("")).otherwise(a["head"]).alias("head"),
            F.when(heading | blank, none).otherwise(F.concat(a["para"], F.array(line))).alias("para"),
            F.when(heading | blank, closed).otherwise(a["done"]).alias("done"),
        )

    whole = F.aggregate(lines, start, step, lambda a: a["done"])
    return F.flatten(F.transform(whole, lambda p: F.transform(long_paragraph(p["text"], size), lambda t: F.struct(p["section"].alias("section"), t.alias("text")))))


def legacy_chunks(text: Column, size: int = 500) -> Column:
    """A text up to ``size`` whole; a longer one packed from its sentences with full stops."""
    return F.when(F.length(text) <= size, F.array(text)).otherwise(pack(nonempty(F.split(text, "。")), size, "。"))


def fixed_chunks(text: Column, size: int = 500) -> Column:
    """Slices of ``size`` characters; none of an empty text."""
    n = F.length(text)
    return F.when(n == 0, F.array().cast(STRINGS)).otherwise(F.transform(F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int")), lambda i: F.substring(text, i * size + 1, F.lit(size))))


def chunks(docs: DataFrame, mode: str, size: int = 500, overlap: int = 80, title: str = "title", text: str = "text") -> DataFrame:
    """Rows of ``docs`` exploded to ``chunk_index, total_chunks, section_path, content, chunk_id, source_id``.

    Modes: ``sentence``, ``markdown``, ``legacy``, ``fixed``. A text without pieces becomes one chunk
    of its stripped whole; an empty or null one has none.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    plain = lambda strings: F.transform(strings, lambda s: F.struct(F.lit("").alias("section"), s.alias("text")))
    made = {
        "sentence": lambda: plain(pack(sentence_pieces(body), size)),
        "markdown": lambda: pack_sections(markdown_pieces(body, 500), size, overlap),
        "legacy": lambda: plain(legacy_chunks(body, size)),
        "fixed": lambda: plain(fixed_chunks(body, size)),
    }[mode]()
    rows = docs.withColumn("_chunks", made)
    whole = F.when(X.strip(body) == "", F.array().cast(PIECES)).otherwise(F.array(F.struct(F.lit("").alias("section"), X.strip(body).alias("text"))))
    rows = rows.withColumn("_chunks", F.when((F.size("_chunks") == 0) | (X.strip(body) == ""), whole).otherwise(F.col("_chunks")))
    rows = rows.withColumn("source_id", X.source_id(F.col(title), body)).withColumn("total_chunks", F.size("_chunks"))
    rows = rows.select("*", F.posexplode("_chunks").alias("chunk_index", "_c")).drop("_chunks")
    rows = rows.withColumns({"section_path": F.col("_c.section"), "content": F.col("_c.text")}).drop("_c")
    return rows.withColumn("chunk_id", X.chunk_id(F.col("source_id"), F.col("section_path"), F.col("chunk_index")))
