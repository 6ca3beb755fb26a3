"""Lexical and vector retrieval, fusion, de-duplication and ranking, for all queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import text as X
from ..session import Scratch

#: Sides of joins up to this many rows are broadcast after being counted; larger ones are shuffled.
BROADCAST_ROWS = 200_000


def small(df: DataFrame, rows: int = BROADCAST_ROWS) -> DataFrame:
    """``df`` with a broadcast hint if it has few enough rows; counted up to the bound only."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def top(df: DataFrame, by: list[str], order: list[Column], k: int, name: str = "rank") -> DataFrame:
    """The first ``k`` rows of each group with their rank from 1."""
    return df.withColumn(name, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(name) <= k)


def query_terms(queries: DataFrame, id_col: str, text_col: str, tokens=X.tokens, distinct: bool = True) -> DataFrame:
    """``query_id, token``: tokens of each query, once each unless ``distinct`` is false."""
    found = tokens(F.col(text_col))
    return queries.select(F.col(id_col).alias("query_id"), F.explode(F.array_distinct(found) if distinct else found).alias("token"))


#: The token that every document has once in its postings, so that corpus statistics need no pass of their own.
EVERY = ""


def postings(docs: DataFrame, id_col: str, text_col: str, terms: DataFrame, tokens=X.tokens, distinct_length: bool = True) -> tuple[DataFrame, DataFrame]:
    """``doc_id, token, tf, dl`` of the asked terms, and one row of corpus statistics ``n, avgdl``.

    Documents are read and tokenised once: lengths are taken within the row, a row under ``EVERY``
    stands for the document itself, and what some query asks for is written to the shared folder, so
    shuffles and files grow with the matches. The length of a document is its number of distinct
    tokens, unless ``distinct_length`` is false; the mean is over documents with tokens.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), tokens(F.col(text_col)).alias("tokens"))
    length = F.size(F.array_distinct("tokens")) if distinct_length else F.size("tokens")
    # What is taken of the whole list comes first: beside an explode it would be taken again for each token.
    each = rows.select("doc_id", "tokens", length.alias("dl")).select("doc_id", "dl", F.explode(F.concat("tokens", F.array(F.lit(EVERY)))).alias("token"))
    every = docs.sparkSession.range(1).select(F.lit(EVERY).alias("token"))
    asked = small(terms.select("token").distinct().unionByName(every))
    held = each.join(asked, "token").groupBy("doc_id", "token", "dl").agg(F.count("*").alias("tf"))
    found = Scratch(docs.sparkSession, "postings").keep(held, "asked")
    whole = found.filter(F.col("token") == EVERY)
    stats = whole.agg(F.coalesce(F.sum("tf"), F.lit(0)).alias("n"), F.coalesce(F.sum(F.when(F.col("dl") > 0, F.col("dl") * F.col("tf"))) / F.sum(F.when(F.col("dl") > 0, F.col("tf"))), F.lit(1.0)).alias("avgdl"))
    return found.filter(F.col("token") != EVERY), stats


def bm25(queries: DataFrame, docs: DataFrame, k1: float = 1.2, b: float = 0.75, query_id: str = "item_id", query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text", tokens=X.tokens, distinct_length: bool = True, distinct_terms: bool = True) -> DataFrame:
    """``query_id, doc_id, score`` of every pair that shares a term; scores have six decimals."""
    terms = query_terms(queries, query_id, query_text, tokens, distinct_terms)
    hits, stats = postings(docs, doc_id, doc_text, terms, tokens, distinct_length)
    df = hits.groupBy("token").agg(F.count("*").alias("df"))
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    # Terms, at most as many as the queries have, take their weight along; hits are scored as they are met.
    weighted = terms.join(df.crossJoin(F.broadcast(stats)), "token").select("query_id", "token", idf.alias("idf"), "avgdl")
    part = F.col("idf") * F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))
    scored = hits.join(small(weighted), "token").select("query_id", "doc_id", part.alias("part"))
    return scored.groupBy("query_id", "doc_id").agg(F.round(F.sum("part"), 6).alias("score")).filter("score > 0")


def tf_cosine(queries: DataFrame, docs: DataFrame, query_id: str = "item_id", query_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """``query_id, doc_id, score``: cosine of coarse term counts, four decimals, positive ones only.

    Norms are taken within the row; an occurrence of an asked term adds that term's count in the query
    to the dot product, so nothing is shuffled but partial sums.
    """
    own = queries.select(F.col(query_id).alias("query_id"), X.coarse_tokens(F.col(query_text)).alias("tokens"))
    own = own.select("query_id", "tokens", F.sqrt(X.sum_of_squares(F.col("tokens"))).alias("qn")).select("query_id", "qn", F.explode("tokens").alias("token"))
    q = own.groupBy("query_id", "qn", "token").agg(F.count("*").alias("qtf"))
    rows = docs.select(F.col(doc_id).alias("doc_id"), X.coarse_tokens(F.col(doc_text)).alias("tokens"))
    each = rows.select("doc_id", "tokens", F.sqrt(X.sum_of_squares(F.col("tokens"))).alias("dn")).select("doc_id", "dn", F.explode("tokens").alias("token"))
    dots = each.join(small(q), "token").groupBy("query_id", "doc_id", "qn", "dn").agg(F.sum("qtf").alias("dot"))
    return dots.select("query_id", "doc_id", F.round(F.col("dot") / (F.col("qn") * F.col("dn")), 4).alias("score")).filter("score > 0")


def knn(queries: DataFrame, vectors: DataFrame, k: int, measure=X.cosine, block: int = 2048) -> DataFrame:
    """``query_id, vec_id, score, rank``: exact nearest neighbours but the query itself.

    Both sides have ``vec_id, embedding``. Queries are compared in blocks of a bounded number, each
    broadcast against all vectors; ``rank`` breaks ties by id.
    """
    out = None
    for part in in_blocks(queries, "vec_id", block) or [queries]:
        own = part.select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q"))
        scored = vectors.select("vec_id", "embedding").join(F.broadcast(own), F.col("vec_id") != F.col("query_id"))
        scored = scored.select("query_id", "vec_id", F.round(measure(F.col("q"), F.col("embedding")), 4).alias("score"))
        part = top(scored, ["query_id"], [F.desc("score"), F.asc("vec_id")], k)
        out = part if out is None else out.unionByName(part)
    return out


def rrf(vector_hits: DataFrame, lexical_hits: DataFrame, k: int = 60, weight: float = 0.5) -> DataFrame:
    """Weighted reciprocal rank fusion of two hit lists ``query_id, doc_id, pos``.

    A document that the vector list repeats counts once at its last position; one that the lexical
    list repeats counts each time, always at its last position.
    """
    v = vector_hits.groupBy("query_id", "doc_id").agg(F.max("pos").alias("vpos"))
    t = lexical_hits.groupBy("query_id", "doc_id").agg(F.max("pos").alias("lpos"), F.count("*").alias("times"))
    both = v.join(t, ["query_id", "doc_id"], "full_outer")
    score = F.coalesce(weight / (k + F.col("vpos")), F.lit(0.0)) + F.coalesce(F.col("times") * weight / (k + F.col("lpos")), F.lit(0.0))
    sources = F.array_compact(F.array(F.when(F.col("lpos").isNotNull(), F.lit("bm25")), F.when(F.col("vpos").isNotNull(), F.lit("vector"))))
    return both.select("query_id", "doc_id", F.round(score, 6).alias("fusion_score"), sources.alias("retrieval_sources"))


def linear_fusion(lexical: DataFrame, vector: DataFrame, lexical_weight: float = 0.45, vector_weight: float = 0.55, k: int = 10) -> DataFrame:
    """Both scores over their query's maximum, weighted; the first ``k``, then those above zero."""
    w = Window.partitionBy("query_id")
    left = lexical.select("query_id", "doc_id", (F.col("score") / F.max("score").over(w)).alias("l"))
    right = vector.select("query_id", "doc_id", (F.greatest(F.col("score"), F.lit(0.0)) / F.max("score").over(w)).alias("v"))
    both = left.join(right, ["query_id", "doc_id"], "full_outer")
    score = lexical_weight * F.coalesce("l", F.lit(0.0)) + vector_weight * F.coalesce("v", F.lit(0.0))
    scored = both.select("query_id", "doc_id", F.round(score, 4).alias("score"))
    return top(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k).filter("score > 0")


def strength(fusion: Column, score: Column) -> Column:
    """The first finite one of the two, else zero."""

    def finite(c: Column) -> Column:
        return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)

    return F.coalesce(finite(fusion), finite(score), F.lit(0.0))


def rank_order(fusion: Column, score: Column, *ties: Column) -> list[Column]:
    """Descending fusion score, then score, then the ties. A missing score sorts as one of -1 does."""
    return [F.coalesce(-fusion, F.lit(1.0)), F.coalesce(-score, F.lit(1.0)), *ties]


def dedupe(df: DataFrame, key: list[Column], order: list[Column], by: list[str] | None = None) -> DataFrame:
    """The first row of each key, within each group of ``by`` if given."""
    keys = [*(F.col(c) for c in by or []), *key]
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_n = 1").drop("_n")


def idf_weights(docs: DataFrame, doc_id: str, doc_text: str, terms: DataFrame) -> DataFrame:
    """``token, idf`` of the asked terms."""
    hits, stats = postings(docs, doc_id, doc_text, terms)
    df = hits.groupBy("token").agg(F.count("*").alias("df")).crossJoin(F.broadcast(stats))
    return df.select("token", F.log(1 + (F.greatest("n", F.lit(1)) - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def rerank_scores(hits: DataFrame, queries: DataFrame, docs: DataFrame, section_col: str, query_id: str = "item_id", query_text: str = "text") -> DataFrame:
    """The deterministic stand-in for a reranking model over ``query_id, doc_id`` hits.

    0.45 of the idf of query tokens in the content, 0.30 of those in the section, 0.25 of tokens of two
    or more characters that occur in the content as they are written.
    """
    terms = query_terms(queries, query_id, query_text)
    idf = idf_weights(docs, "doc_id", "text", terms)
    weighted = terms.join(small(idf), "token", "left").na.fill(0.0, ["idf"])
    pairs = hits.select("query_id", "doc_id").join(docs.select("doc_id", "text", F.col(section_col).alias("section")), "doc_id")
    held = pairs.select("query_id", "doc_id", "text", X.tokens(F.col("text")).alias("content"), X.tokens(F.col("section")).alias("title"))
    terms_of = weighted.groupBy("query_id").agg(F.collect_list(F.struct("token", "idf")).alias("terms"))
    joined = held.join(small(terms_of), "query_id")

    def total(condition) -> Column:
        return F.aggregate(F.filter("terms", condition), F.lit(0.0), lambda s, t: s + t["idf"])

    score = (
        0.45 * total(lambda t: F.array_contains(F.col("content"), t["token"]))
        + 0.30 * total(lambda t: F.array_contains(F.col("title"), t["token"]))
        + 0.25 * total(lambda t: (F.length(t["token"]) >= 2) & F.col("text").contains(t["token"]))
    )
    return joined.select("query_id", "doc_id", F.round(score, 4).alias("rerank_score"))


def holders(items: DataFrame, docs: DataFrame, item_id: str = "item_id", item_text: str = "text", doc_id: str = "doc_id", doc_text: str = "text") -> DataFrame:
    """``query_id, doc_id``: the documents that hold an item's whole text.

    A text that holds the item holds three words of its inside, too, which are the key of an equality
    join whose candidates are verified. Items of fewer than five words have no such key; they are
    compared with every document, a block of them at a time.
    """

    def shingles(words: Column) -> Column:
        at = F.when(F.size(words) < 3, F.array().cast("array<int>")).otherwise(F.sequence(F.lit(0), F.size(words) - 3))
        return F.array_distinct(F.transform(at, lambda i: F.concat_ws(" ", words[i], words[i + 1], words[i + 2])))

    own = items.select(F.col(item_id).alias("query_id"), F.col(item_text).alias("q"), F.split(item_text, " ").alias("w")).filter("q IS NOT NULL")
    keyed = own.filter(F.size("w") >= 5).select("query_id", "q", F.concat_ws(" ", F.col("w")[1], F.col("w")[2], F.col("w")[3]).alias("key"))
    texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(doc_text).alias("text"))
    # The words are held by a one-member array, or each window would split the text anew.
    windows = F.transform(F.array(F.split("text", " ")), shingles)[0]
    found = texts.withColumn("key", F.explode(windows)).join(small(keyed), "key").filter(F.col("text").contains(F.col("q"))).select("query_id", "doc_id")
    for block in in_blocks(own.filter(F.size("w") < 5).select("query_id", "q"), "query_id"):
        found = found.unionByName(texts.join(F.broadcast(block), F.col("text").contains(F.col("q"))).select("query_id", "doc_id"))
    return found.distinct()


def in_blocks(df: DataFrame, key: str, rows: int = 2048) -> list[DataFrame]:
    """``df`` in as many parts, by a hash of ``key``, as have some ``rows`` rows each; none for no rows."""
    blocks = -(-df.count() // rows)
    return [df.filter(F.pmod(F.xxhash64(key), F.lit(blocks)) == i) for i in range(blocks)]


def plain_tokens(text: Column) -> Column:
    """Latin words, CJK characters, and bigrams of all CJK characters whatever lies between them."""

    def paired(c: Column) -> Column:
        return F.when(F.size(c) < 2, c).otherwise(F.concat(c, F.transform(F.sequence(F.lit(1), F.size(c) - 1), lambda i: F.concat(c[i - 1], c[i]))))

    latin = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))
    cjk = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit("[一-鿿]"), F.lit(0))
    return F.array_distinct(F.concat(latin, F.transform(F.array(cjk), paired)[0]))


def overlap_topk(queries: DataFrame, chunks: DataFrame, k: int = 5, section: str = "section") -> DataFrame:
    """``query_id, doc_id, score, rank`` by shared tokens: 0.55 and 0.25 for each in the content, 0.20 for each in the section.

    Chunks that share a token are found by an equality join on tokens. The others all have 0.55 and
    rank by id, so of them the ``k`` with the smallest ids that share none are enough for any query:
    each query takes them from its hits plus ``k`` more of the smallest ids.
    """
    asked = queries.select(F.col("item_id").alias("query_id"), F.explode(plain_tokens(F.col("text"))).alias("token"))
    each = lambda name, part: chunks.select("doc_id", F.explode(plain_tokens(F.col(name))).alias("token"), F.lit(part).alias("part"))
    parts = each("text", 25).unionByName(each(section, 20))
    shared = parts.join(small(asked), "token").groupBy("query_id", "doc_id").agg(F.sum("part").alias("n"))
    scored = shared.select("query_id", "doc_id", F.round(0.55 + F.col("n") / 100, 4).alias("score"))
    best = top(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
    # A query with k hits or more shows no other chunk; one with fewer leaves out at most k - 1 ids of these.
    first = chunks.select("doc_id").orderBy("doc_id").limit(2 * k)
    rest = queries.select(F.col("item_id").alias("query_id")).crossJoin(F.broadcast(first)).join(best.select("query_id", "doc_id"), ["query_id", "doc_id"], "left_anti")
    both = best.select("query_id", "doc_id", "score").unionByName(rest.withColumn("score", F.lit(0.55)))
    return top(both.dropDuplicates(["query_id", "doc_id"]), ["query_id"], [F.desc("score"), F.asc("doc_id")], k)
