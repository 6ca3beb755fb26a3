"""Documents, uploads, skills and stored tables as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X

MAX_UPLOAD = 10 << 20
DOCUMENT = "title STRING, content STRING"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def json_batch(spark: SparkSession, path: str) -> DataFrame:
    """``title, content`` of files that hold ``{"documents": [...]}``; a missing title gets a stand-in."""
    rows = spark.read.schema(f"documents ARRAY<STRUCT<{DOCUMENT.replace(' STRING', ': STRING')}>>").json(path, multiLine=True)
    return rows.select(F.inline("documents"))


def uploads(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    """``title, content, error`` of uploaded files.

    A ``.json`` file is a list of documents, any other one a document titled by its name without the
    last suffix. Files over 10 MB and JSON that is no list give a row with ``error`` and no content.
    """
    read = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)
    name = F.element_at(F.split("path", "/"), -1)
    rows = read.select(F.url_decode(name).alias("name"), "length", F.make_valid_utf8(F.col("content").cast("string")).alias("body"))
    is_json = F.lower("name").endswith(".json")
    listed = F.from_json("body", f"ARRAY<STRUCT<{DOCUMENT.replace(' STRING', ': STRING')}>>")
    error = F.when(F.col("length") > MAX_UPLOAD, "too_large").when(is_json & (~X.strip(F.col("body")).startswith("[") | listed.isNull()), "bad_json")
    whole = F.array(F.struct(F.regexp_replace("name", r"\.[^.]*$", "").alias("title"), F.replace(F.col("body"), F.lit("�"), F.lit("")).alias("content")))
    failed = F.array(F.struct(F.col("name").alias("title"), F.lit(None).cast("string").alias("content")))
    docs = F.when(error.isNotNull(), failed).when(is_json, listed).otherwise(whole)
    return rows.select(F.explode(docs).alias("d"), error.alias("error")).select(F.coalesce("d.title", F.lit("untitled")).alias("title"), "d.content", "error")


def html_pages(pages: DataFrame) -> DataFrame:
    """``page_id, title, content``: the title element and the text without tags."""
    title = X.strip(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1))
    body = F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>", " "), r"(?s)<[^>]*>", " ")
    return pages.select("page_id", title.alias("title"), X.strip(F.regexp_replace(body, r"\s+", " ")).alias("content"))


def front_matter(text: Column) -> tuple[Column, Column]:
    """The ``key: value`` lines between two ``---`` lines as a map, and what follows; no end, no map."""
    block = F.regexp_extract(text, r"(?s)^---\s*\n(.*?)\n---\s*(?:\n|$)", 1)
    held = text.rlike(r"(?s)^---\s*\n.*?\n---\s*(?:\n|$)")
    keys = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^\s*([^:\n]+?)\s*:(.*)$"), F.lit(1)), F.lower)
    values = F.transform(F.regexp_extract_all(block, F.lit(r"(?m)^\s*([^:\n]+?)\s*:(.*)$"), F.lit(2)), lambda v: F.regexp_replace(X.strip(v), "^[\"']|[\"']$", ""))
    return F.map_from_arrays(keys, values), F.when(held, F.regexp_replace(text, r"(?s)^---\s*\n.*?\n---\s*(?:\n|$)", "")).otherwise(text)


def listed(value: Column) -> Column:
    """Comma-separated items, stripped, none empty."""
    return F.filter(F.transform(F.split(F.coalesce(value, F.lit("")), ","), X.strip), lambda s: s != "")


def skills(files: DataFrame) -> DataFrame:
    """``ord, name, description, content, keywords, agents, enabled`` from ``path, text``.

    ``SKILL.md`` files come first, each kind in path order; ``README.md`` and dotfiles are skipped, as
    are bodies that are empty. The name is the given one, else the first heading, else the folder's or
    file's; a first heading that only repeats it is dropped.
    """
    file = F.element_at(F.split("path", "/"), -1)
    folder = F.coalesce(F.try_element_at(F.split("path", "/"), F.lit(-2)), F.lit(""))
    wanted = files.filter(~file.startswith(".") & (F.lower(file) != "readme.md") & F.lower(file).rlike(r"\.(md|txt)$"))
    meta, body = front_matter(F.col("text"))
    rows = wanted.select("path", file.alias("file"), folder.alias("folder"), meta.alias("meta"), X.strip(body).alias("body"))
    heading = X.strip(F.regexp_extract("body", r"(?m)^#{1,6}\s+(.+)$", 1))
    fallback = F.when(F.col("file") == "SKILL.md", F.col("folder")).otherwise(F.regexp_replace("file", r"\.[^.]*$", ""))
    given = F.try_element_at("meta", F.lit("name"))
    rows = rows.withColumn("name", F.coalesce(F.nullif(given, F.lit("")), F.nullif(heading, F.lit("")), fallback))
    rows = rows.withColumn("content", X.strip(F.when(heading == F.col("name"), F.regexp_replace("body", r"^#{1,6}\s+.+(\n|$)", "")).otherwise(F.col("body"))))
    enabled = ~F.lower(F.coalesce(F.try_element_at("meta", F.lit("enabled")), F.lit("true"))).isin("false", "0", "no", "off")
    from pyspark.sql.window import Window

    order = F.row_number().over(Window.orderBy((F.col("file") != "SKILL.md").cast("int"), "path"))
    return rows.filter("content <> ''").select(
        order.alias("ord"),
        "name",
        F.coalesce(F.try_element_at("meta", F.lit("description")), F.lit("")).alias("description"),
        "content",
        listed(F.try_element_at("meta", F.lit("keywords"))).alias("keywords"),
        listed(F.try_element_at("meta", F.lit("agents"))).alias("agents"),
        enabled.alias("enabled"),
    )


def hit_rows(responses: DataFrame) -> DataFrame:
    """Rows of a vector store's parallel arrays ``ids, documents, metadatas, distances``; score 1 - distance."""
    zipped = F.arrays_zip("ids", "documents", "metadatas", "distances")
    rows = responses.select("query_id", F.posexplode(zipped).alias("pos", "z"))
    return rows.select("query_id", F.col("pos"), F.col("z.ids").alias("chunk_id"), F.col("z.documents").alias("content"), F.coalesce(F.col("z.metadatas")["title"], F.lit("")).alias("title"), F.round(1 - F.col("z.distances"), 4).alias("score"))
