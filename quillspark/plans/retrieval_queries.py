"""Queries over documents, benchmark items, embeddings and pages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions import text as X
from ..operators import chunking, classify, evaluation, lexical, pipeline, retrieval
from ..sources import readers, sinks
from ..sources.readers import table
from ..session import Scratch
from .registry import query

# --- SQL building blocks -------------------------------------------------------------------------

CJK = "'^[一-鿿]$'"


def tok(m: str) -> str:
    """SQL for the tokens of a list of matches."""
    pairs = f"list_filter(range(2, len({m}) + 1), lambda i: regexp_matches({m}[i], {CJK}) AND regexp_matches({m}[i - 1], {CJK}))"
    return f"list_concat(list_transform({m}, lambda t: lower(t)), list_transform({pairs}, lambda i: {m}[i - 1] || {m}[i]))"


MATCHES = "regexp_extract_all(text, '[A-Za-z0-9_]+|[一-鿿]')"
TOKENS = f"""dm AS (SELECT doc_id, {MATCHES} AS m FROM documents), dt AS (SELECT doc_id, {tok('m')} AS toks FROM dm),
qm AS (SELECT item_id AS query_id, {MATCHES} AS m FROM benchmark), qt AS (SELECT query_id, {tok('m')} AS toks FROM qm)"""
BM25 = f"""{TOKENS},
tf AS (SELECT doc_id, token, count(*) AS tf FROM (SELECT doc_id, unnest(toks) AS token FROM dt) GROUP BY ALL),
dl AS (SELECT doc_id, count(*) AS dl FROM tf GROUP BY doc_id),
st AS (SELECT (SELECT count(*) FROM documents) AS n, (SELECT avg(dl) FROM dl) AS avgdl),
df AS (SELECT token, count(*) AS df FROM tf GROUP BY token),
qd AS (SELECT DISTINCT query_id, token FROM (SELECT query_id, unnest(toks) AS token FROM qt)),
bm AS (SELECT query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score
    FROM qd JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), st GROUP BY ALL),
bmr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM bm WHERE score > 0)"""
COSINE = """qtf AS (SELECT query_id, token, count(*) AS qtf FROM (SELECT query_id, unnest(toks) AS token FROM qt) WHERE NOT regexp_matches(token, '^[一-鿿]{2}$') GROUP BY ALL),
dtf AS (SELECT * FROM tf WHERE NOT regexp_matches(token, '^[一-鿿]{2}$')),
cs AS (SELECT query_id, doc_id, round(sum(tf * qtf) / (any_value(qn) * any_value(dn)), 4) AS score FROM qtf JOIN dtf USING (token)
    JOIN (SELECT query_id, sqrt(sum(qtf * qtf)) AS qn FROM qtf GROUP BY ALL) USING (query_id) JOIN (SELECT doc_id, sqrt(sum(tf * tf)) AS dn FROM dtf GROUP BY ALL) USING (doc_id) GROUP BY ALL),
csr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM cs WHERE score > 0)"""
FUSED = """ff AS (SELECT coalesce(b.query_id, c.query_id) AS query_id, coalesce(b.doc_id, c.doc_id) AS doc_id,
    round(coalesce(0.5 / (60 + c.rank), 0) + coalesce(0.5 / (60 + b.rank), 0), 6) AS fusion_score
    FROM (SELECT * FROM bmr WHERE rank <= 20) b FULL JOIN (SELECT * FROM csr WHERE rank <= 20) c ON b.query_id = c.query_id AND b.doc_id = c.doc_id),
ffr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY fusion_score DESC, doc_id) AS rank FROM ff)"""
LABELS = """lb AS (SELECT item_id AS query_id, doc_id, lang FROM benchmark b JOIN documents d ON contains(d.text, b.text)),
qs AS (SELECT item_id AS query_id, coalesce(min(lang), 'none') AS category, CASE WHEN count(lang) = 0 THEN 'no_answer' ELSE 'factoid' END AS query_type FROM benchmark b LEFT JOIN lb ON lb.query_id = b.item_id GROUP BY ALL)"""


def metrics_sql(name: str, ranked: str) -> str:
    """CTE ``name`` of the per-query metrics of a ranked list ``query_id, doc_id, rank``."""
    return f"""{name}h AS (SELECT query_id, min(rank) AS fr, sum((rank <= 3)::INT) AS top3, sum(2 / log2(rank + 1)) AS dcg FROM {ranked} JOIN lb USING (query_id, doc_id) WHERE rank <= 10 GROUP BY ALL),
{name}i AS (SELECT query_id, sum(2 / log2(i + 1)) AS idcg FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY doc_id) AS i FROM lb) WHERE i <= 10 GROUP BY ALL),
{name}n AS (SELECT query_id, count(*) AS n FROM {ranked} WHERE rank <= 10 GROUP BY ALL),
{name} AS (SELECT query_id, category, query_type,
    CASE WHEN query_type = 'no_answer' THEN 1.0 ELSE coalesce((fr <= 5)::INT, 0) END::DOUBLE AS recall_at_5, CASE WHEN query_type = 'no_answer' THEN 1.0 ELSE coalesce((fr <= 10)::INT, 0) END::DOUBLE AS recall_at_10,
    round(coalesce(top3, 0) / 3, 6)::DOUBLE AS precision_at_3, round(coalesce(1 / fr, 0), 6)::DOUBLE AS mrr_at_10, round(coalesce(dcg / idcg, 0), 6)::DOUBLE AS ndcg_at_10,
    0.0::DOUBLE AS duplicate_top3, (query_type = 'no_answer' AND coalesce(n, 0) > 0)::INT::DOUBLE AS no_answer_false_positive, coalesce(fr, 0)::INT AS first_relevant_rank
    FROM qs LEFT JOIN {name}h USING (query_id) LEFT JOIN {name}i USING (query_id) LEFT JOIN {name}n USING (query_id))"""


MEANS = ", ".join(f"coalesce(round(avg({'CASE WHEN query_type = ' + chr(39) + 'no_answer' + chr(39) + ' THEN ' + m + ' END' if m == 'no_answer_false_positive' else m}), 4), 0) AS {m}" for m in evaluation.METRICS)

# --- tokens and lexical search -------------------------------------------------------------------


@query(f"WITH {TOKENS} SELECT doc_id, len(toks)::BIGINT AS n_tokens, len(list_distinct(toks))::BIGINT AS n_distinct, md5(array_to_string(toks, ' ')) AS digest FROM dt")
def tokenize_docs(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "documents").select("doc_id", X.tokens(F.col("text")).alias("t"))
    return rows.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"), F.md5(F.array_join("t", " ")).alias("digest"))


@query(f"WITH {BM25} SELECT token, df, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 6) AS idf FROM df, st")
def token_df_idf(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    df = docs.select(F.explode(F.array_distinct(X.tokens(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    return df.crossJoin(F.broadcast(n)).select("token", "df", F.round(F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)), 6).alias("idf"))


def _bm25(spark: SparkSession, sf: str, k: int) -> DataFrame:
    scored = retrieval.bm25(table(spark, sf, "benchmark"), table(spark, sf, "documents"))
    return retrieval.top(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


def _cosine(spark: SparkSession, sf: str, k: int) -> DataFrame:
    scored = retrieval.tf_cosine(table(spark, sf, "benchmark"), table(spark, sf, "documents"))
    return retrieval.top(scored, ["query_id"], [F.desc("score"), F.asc("doc_id")], k)


@query(f"WITH {BM25} SELECT * FROM bmr WHERE rank <= 10")
def bm25_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _bm25(spark, sf, 10)


@query(f"WITH {BM25}, {COSINE} SELECT * FROM csr WHERE rank <= 10")
def tf_cosine_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _cosine(spark, sf, 10)


_PLAIN = r"trim(regexp_replace(lower(text), '[!-/:-@\[-`{-~\s]+', ' ', 'g'))"
_GRAMS = "list_filter(list_concat(string_split(p, ' '), list_concat(list_transform(range(1, len(c)), lambda i: trim(c[i] || c[i + 1])), list_transform(range(1, len(c) - 1), lambda i: trim(c[i] || c[i + 1] || c[i + 2])))), lambda t: t <> '')"


@query(
    f"""WITH p AS (SELECT item_id, p, string_split(p, '') AS c FROM (SELECT item_id, {_PLAIN} AS p FROM benchmark)),
    g AS (SELECT item_id, {_GRAMS} AS toks FROM p), u AS (SELECT item_id, unnest(toks) AS token FROM g),
    tf AS (SELECT item_id AS doc_id, token, count(*) AS tf FROM u GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY ALL),
    dl AS (SELECT item_id AS doc_id, len(toks) AS dl FROM g), st AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
    s AS (SELECT u.item_id AS query_id, doc_id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM u JOIN tf USING (token) JOIN df USING (token) JOIN dl USING (doc_id), st GROUP BY ALL),
    m AS (SELECT query_id, doc_id, round(score / max(score) OVER (PARTITION BY query_id), 4) AS score FROM s WHERE score > 0)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM m) WHERE rank <= 5"""
)
def bm25_grams_topk(spark: SparkSession, sf: str) -> DataFrame:
    """The other variant: character grams, total lengths, repeated query terms, scores over the maximum."""
    from pyspark.sql.window import Window

    items = table(spark, sf, "benchmark")
    scored = retrieval.bm25(items, items, k1=1.5, doc_id="item_id", tokens=X.word_grams, distinct_length=False, distinct_terms=False)
    shared = scored.withColumn("score", F.round(F.col("score") / F.max("score").over(Window.partitionBy("query_id")), 4))
    return retrieval.top(shared, ["query_id"], [F.desc("score"), F.asc("doc_id")], 5)


# --- vectors -------------------------------------------------------------------------------------

_KNN = """WITH s AS (SELECT q.vec_id AS query_id, v.vec_id, round({0}, 4) AS score FROM embeddings q JOIN embeddings v ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10"""


def _knn(spark: SparkSession, sf: str, measure) -> DataFrame:
    vectors = table(spark, sf, "embeddings")
    return retrieval.knn(vectors.filter("vec_id % 50 = 0"), vectors, 10, measure)


@query(_KNN.format("list_cosine_similarity(q.embedding::DOUBLE[], v.embedding::DOUBLE[])"))
def vector_knn_topk(spark: SparkSession, sf: str) -> DataFrame:
    return _knn(spark, sf, X.cosine)


@query(_KNN.format("1 - list_sum(list_transform(list_zip(q.embedding::DOUBLE[], v.embedding::DOUBLE[]), lambda z: (z[1] - z[2]) * (z[1] - z[2])))"))
def l2_knn_scores(spark: SparkSession, sf: str) -> DataFrame:
    """One less the squared distance, whatever its sign."""
    return _knn(spark, sf, lambda a, b: 1 - X.dot(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double"))))


def _gram_sql(low: str) -> str:
    return f"{low}list_concat(c, list_concat(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2])))"


_CHARS = r"SELECT conv_id, turn, string_split(regexp_replace(lower(text), '^\s+|\s+$', '', 'g'), '') AS c FROM conversations"


@query(
    f"""WITH c AS ({_CHARS}), g AS (SELECT conv_id, turn, unnest(CASE WHEN len(array_to_string(c, '')) = 0 THEN [''] ELSE list_distinct({_gram_sql('')}) END) AS g FROM c)
    SELECT conv_id, turn, ('0x' || substr(md5(g), 7, 2))::INT AS cell, sum(CASE WHEN ('0x' || substr(md5(g), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS weight FROM g GROUP BY ALL HAVING weight <> 0"""
)
def hash_ngram_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """Signed hashed 1- to 3-grams, as the cells that are not zero."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.distinct_grams(F.col("text"))).alias("g"))
    return rows.groupBy("conv_id", "turn", X.md5_cell(F.col("g")).alias("cell")).agg(F.sum(X.md5_sign(F.col("g"))).alias("weight")).filter("weight <> 0")


@query(
    f"""WITH c AS ({_CHARS}), g AS (SELECT conv_id, turn, unnest({_gram_sql('')}) AS g FROM c),
    h AS (SELECT conv_id, turn, list_reduce(list_prepend(0::BIGINT, list_transform(string_split(g, ''), lambda x: unicode(x)::BIGINT)), lambda h, x: (h * 31 + x) % 4294967296) AS h FROM g)
    SELECT conv_id, turn, (h % 256)::INT AS cell, sum(CASE WHEN h % 2 = 0 THEN 1 ELSE -1 END)::BIGINT AS weight FROM h GROUP BY ALL HAVING weight <> 0"""
)
def polynomial_hash_embedding(spark: SparkSession, sf: str) -> DataFrame:
    """The other variant: the 31-polynomial hash over all grams, repeats included."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.explode(X.grams(X.strip(F.lower(F.col("text"))), 1, 3)).alias("g"))
    hashed = rows.select("conv_id", "turn", X.polynomial_hash(F.col("g")).alias("h"))
    sign = F.when(F.col("h") % 2 == 0, 1).otherwise(-1)
    return hashed.groupBy("conv_id", "turn", (F.col("h") % 256).cast("int").alias("cell")).agg(F.sum(sign).alias("weight")).filter("weight <> 0")


# --- fusion, ranking, de-duplication -------------------------------------------------------------


def _fused(spark: SparkSession, sf: str, k: int) -> DataFrame:
    hits = retrieval.rrf(_cosine(spark, sf, 20).withColumnRenamed("rank", "pos"), _bm25(spark, sf, 20).withColumnRenamed("rank", "pos"))
    return retrieval.top(hits, ["query_id"], [F.desc("fusion_score"), F.asc("doc_id")], k)


@query(f"WITH {BM25}, {COSINE}, {FUSED} SELECT * FROM ffr WHERE rank <= 10")
def rrf_fusion(spark: SparkSession, sf: str) -> DataFrame:
    return _fused(spark, sf, 10).select("query_id", "doc_id", "fusion_score", "rank")


@query(
    f"""WITH {BM25}, {COSINE}, f AS (SELECT coalesce(b.query_id, c.query_id) AS query_id, coalesce(b.doc_id, c.doc_id) AS doc_id, round(0.45 * coalesce(b.l, 0) + 0.55 * coalesce(c.v, 0), 4) AS score
    FROM (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS l FROM bm WHERE score > 0) b FULL JOIN (SELECT query_id, doc_id, score / max(score) OVER (PARTITION BY query_id) AS v FROM cs WHERE score > 0) c ON b.query_id = c.query_id AND b.doc_id = c.doc_id)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM f) WHERE rank <= 10 AND score > 0"""
)
def linear_fusion(spark: SparkSession, sf: str) -> DataFrame:
    queries, docs = table(spark, sf, "benchmark"), table(spark, sf, "documents")
    return retrieval.linear_fusion(retrieval.bm25(queries, docs), retrieval.tf_cosine(queries, docs))


@query("SELECT doc_id, lang, source FROM documents")
def dedup_chunk_id(spark: SparkSession, sf: str) -> DataFrame:
    """A second import of the same ids adds nothing."""
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source")
    again = docs.withColumn("pos", F.lit(1)).unionByName(docs.withColumn("pos", F.lit(2)))
    return retrieval.dedupe(again, [F.col("doc_id")], [F.asc("pos")]).drop("pos")


@query(r"SELECT sha1(regexp_replace(lower(text), '\s+', '', 'g')) AS content_key, min(doc_id) AS doc_id, count(*) AS copies FROM documents GROUP BY 1")
def dedup_content_hash(spark: SparkSession, sf: str) -> DataFrame:
    """The first of each content without case and white space; copies are combined before the shuffle."""
    keyed = table(spark, sf, "documents").select("doc_id", X.content_key(F.col("text")).alias("content_key"))
    return keyed.groupBy("content_key").agg(F.min("doc_id").alias("doc_id"), F.count("*").alias("copies"))


@query("SELECT lang, source, md5(text) AS digest, min(doc_id) AS doc_id FROM documents GROUP BY ALL")
def dedup_full_row(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").select("doc_id", "lang", "source", F.md5("text").alias("digest"))
    return docs.groupBy("lang", "source", "digest").agg(F.min("doc_id").alias("doc_id"))


@query(
    """WITH r AS (SELECT doc_id, source, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 7) / 100.0 END::DOUBLE AS fusion_score, CASE WHEN doc_id % 5 <> 0 THEN (doc_id % 11) / 4.0 - 2 END::DOUBLE AS score FROM documents)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY coalesce(-fusion_score, 1.0), coalesce(-score, 1.0), doc_id) AS rank FROM r) WHERE rank <= 10"""
)
def deterministic_rank(spark: SparkSession, sf: str) -> DataFrame:
    """Missing scores sort as -1 would."""
    d = F.col("doc_id")
    rows = table(spark, sf, "documents").select("doc_id", "source", F.when(d % 3 != 0, (d % 7) / 100.0).alias("fusion_score"), F.when(d % 5 != 0, (d % 11) / 4.0 - 2).alias("score"))
    return retrieval.top(rows, ["source"], retrieval.rank_order(F.col("fusion_score"), F.col("score"), F.asc("doc_id")), 10)


@query(
    f"""WITH {BM25}, hits AS (SELECT query_id, doc_id FROM bmr WHERE rank <= 20),
    qi AS (SELECT query_id, token, coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)), 0) AS idf FROM qd LEFT JOIN df USING (token), st),
    ts AS (SELECT doc_id, text, toks, list_transform(regexp_extract_all(source || ' ' || lang, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS stoks FROM documents JOIN dt USING (doc_id)),
    rr AS (SELECT query_id, doc_id, round(0.45 * coalesce(sum(idf) FILTER (list_contains(toks, token)), 0) + 0.30 * coalesce(sum(idf) FILTER (list_contains(stoks, token)), 0) + 0.25 * coalesce(sum(idf) FILTER (len(token) >= 2 AND contains(text, token)), 0), 4) AS rerank_score
    FROM hits JOIN ts USING (doc_id) JOIN qi USING (query_id) GROUP BY ALL)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rerank_score DESC, doc_id) AS rank FROM rr) WHERE rank <= 5"""
)
def rerank_proxy(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("section", F.concat_ws(" ", "source", "lang"))
    scored = retrieval.rerank_scores(_bm25(spark, sf, 20), table(spark, sf, "benchmark"), docs, "section")
    return retrieval.top(scored, ["query_id"], [F.desc("rerank_score"), F.asc("doc_id")], 5)


@query(f"WITH {BM25} SELECT query_id, doc_id, score FROM bmr WHERE rank <= 5 AND score >= 20")
def min_score_filter(spark: SparkSession, sf: str) -> DataFrame:
    """The threshold comes after the cut to the first five."""
    hits = _bm25(spark, sf, 5)
    return hits.filter(retrieval.strength(F.lit(None).cast("double"), F.col("score")) >= 20).select("query_id", "doc_id", "score")


REWRITE_QUERIES = ("退款多久到账", "怎么取消订单和支付", "登录报401和500", "hello 429", "积分密码物流", "")


def _rewrite_sql() -> str:
    cases = [f"CASE WHEN contains(query, '{k}') THEN replace(query, '{k}', '{v}') END" for k, vs in K.REWRITES.items() for v in vs]
    rows = ", ".join(f"({i - len(REWRITE_QUERIES)}, '{q}')" for i, q in enumerate(REWRITE_QUERIES))
    return f"""WITH q AS (SELECT item_id AS query_id, text AS query FROM benchmark UNION ALL SELECT * FROM (VALUES {rows})),
    f AS (SELECT query_id, query, list_filter([{', '.join(cases)}], lambda x: x IS NOT NULL AND x <> query) AS fs FROM q),
    d AS (SELECT query_id, query, list_filter(fs, lambda x, i: list_position(fs, x) = i)[1:3] AS fs FROM f),
    a AS (SELECT query_id, list_prepend(query, fs) AS qs FROM d)
    SELECT query_id, (generate_subscripts(qs, 1) - 1)::INT AS ord, unnest(qs) AS query FROM a"""


@query(_rewrite_sql())
def rewrite_expand(spark: SparkSession, sf: str) -> DataFrame:
    own = spark.createDataFrame([(i - len(REWRITE_QUERIES), q) for i, q in enumerate(REWRITE_QUERIES)], "query_id long, query string")
    return classify.rewrites(table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query")).unionByName(own))


# --- chunks and ids ------------------------------------------------------------------------------

_FOLD = "list_reduce(list_transform(ps, lambda p: {{'cur': p, 'done': []::VARCHAR[]}}), lambda a, p: CASE WHEN len(a.cur) + 1 + len(p.cur) <= 500 THEN {{'cur': a.cur || {0} || p.cur, 'done': a.done}} ELSE {{'cur': p.cur, 'done': list_append(a.done, a.cur)}} END)"
_CHUNK_OUT = "SELECT doc_id, (generate_subscripts(cs, 1) - 1)::INT AS chunk_index, len(cs)::INT AS total_chunks, md5(unnest(cs)) AS digest FROM {0}"


def _titled(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select("doc_id", "text", F.concat_ws("-", "source", F.col("doc_id").cast("string")).alias("title"))


def _chunk_digests(spark: SparkSession, sf: str, mode: str) -> DataFrame:
    return chunking.chunks(_titled(spark, sf), mode).select("doc_id", "chunk_index", "total_chunks", F.md5("content").alias("digest"))


@query(
    rf"""WITH pp AS (SELECT doc_id, text, list_filter(list_transform(string_split(replace(text, chr(10), '。'), '。'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ps FROM documents WHERE regexp_replace(text, '[\s。]', '', 'g') <> ''),
    f AS (SELECT doc_id, {_FOLD.format('chr(10)')} AS r FROM pp), c AS (SELECT doc_id, list_append(r.done, r.cur) AS cs FROM f) {_CHUNK_OUT.format('c')}"""
)
def chunk_sentence(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_digests(spark, sf, "sentence")


@query(
    rf"""WITH pp AS (SELECT doc_id, text, list_filter(list_transform(string_split(text, '。'), lambda s: regexp_replace(s, '^\s+|\s+$', '', 'g')), lambda s: s <> '') AS ps FROM documents WHERE text <> ''),
    f AS (SELECT doc_id, text, {_FOLD.format("'。'")} AS r FROM pp), c AS (SELECT doc_id, CASE WHEN len(text) <= 500 THEN [text] ELSE list_append(r.done, r.cur) END AS cs FROM f) {_CHUNK_OUT.format('c')}"""
)
def chunk_legacy(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_digests(spark, sf, "legacy")


@query(f"WITH c AS (SELECT doc_id, list_transform(range(0, (len(text) - 1) // 500 + 1), lambda i: substr(text, i * 500 + 1, 500)) AS cs FROM documents WHERE text <> '') {_CHUNK_OUT.format('c')}")
def chunk_fixed(spark: SparkSession, sf: str) -> DataFrame:
    return _chunk_digests(spark, sf, "fixed")


@query()
def chunk_markdown(spark: SparkSession, sf: str) -> DataFrame:
    """Sections by headings, with overlap; compared with plain Python in the tests."""
    return chunking.chunks(_titled(spark, sf), "markdown").select("doc_id", "chunk_index", "total_chunks", "section_path", F.md5("content").alias("digest"))


@query(
    """WITH s AS (SELECT doc_id, text, 'src-' || substr(sha1('title:' || lower(source || '-' || doc_id)), 1, 20) AS source_id FROM documents WHERE text <> ''),
    c AS (SELECT *, unnest(range(0, (len(text) - 1) // 500 + 1)) AS i FROM s)
    SELECT doc_id, i::INT AS chunk_index, source_id, 'chk-' || substr(sha1(source_id || '::' || '::' || i || '::v1'), 1, 24) AS chunk_id, md5('t_' || i || '_' || substr(substr(text, i * 500 + 1, 500), 1, 50)) AS legacy_id FROM c"""
)
def chunk_ids(spark: SparkSession, sf: str) -> DataFrame:
    made = chunking.chunks(_titled(spark, sf), "fixed")
    return made.select("doc_id", "chunk_index", "source_id", "chunk_id", X.legacy_chunk_id(F.lit("t"), F.col("chunk_index"), F.col("content")).alias("legacy_id"))


@query("SELECT doc_id, 'src-' || substr(sha1(CASE WHEN doc_id % 2 = 0 THEN 'title:' || lower(source || ' ' || lang) ELSE text END), 1, 20) AS source_id FROM documents")
def source_ids(spark: SparkSession, sf: str) -> DataFrame:
    title = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit(" "), F.upper("source"), F.lit("  "), F.col("lang"))).otherwise("  ")
    return table(spark, sf, "documents").select("doc_id", X.source_id(title, F.col("text")).alias("source_id"))


@query("SELECT doc_id, CASE WHEN lang = 'en' THEN 'new' ELSE 'old' END AS version, n_chars FROM documents")
def upsert_chunks(spark: SparkSession, sf: str) -> DataFrame:
    """All documents as they were, and those in English twice anew; the later of the two stays."""
    docs = table(spark, sf, "documents").select("doc_id", "n_chars", "lang")
    old = docs.withColumns({"version": F.lit("old"), "n": F.lit(0)})
    new = docs.filter("lang = 'en'")
    twice = new.withColumns({"version": F.lit("stale"), "n": F.lit(1)}).unionByName(new.withColumns({"version": F.lit("new"), "n": F.lit(2)}))
    return sinks.upserted(old, twice, "doc_id", "n").select("doc_id", "version", "n_chars")


@query(
    r"""SELECT page_id, regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '^\s+|\s+$', '', 'g') AS title,
    md5(regexp_replace(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style|title)[^>]*>.*?</(script|style|title)>', ' ', 'g'), '(?s)<[^>]*>', ' ', 'g'), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')) AS digest FROM pages"""
)
def upload_pages(spark: SparkSession, sf: str) -> DataFrame:
    return readers.html_pages(table(spark, sf, "pages")).select("page_id", "title", F.md5("content").alias("digest"))


# --- retrieval evaluation ------------------------------------------------------------------------


def _labels(spark: SparkSession, sf: str) -> DataFrame:
    """Documents that hold an item's text, with their language; written once, as several metrics use them."""
    docs = table(spark, sf, "documents")
    return Scratch(spark, "labels").keep(retrieval.holders(table(spark, sf, "benchmark"), docs).join(docs.select("doc_id", "lang"), "doc_id").select("query_id", "doc_id", "lang"), "held")


def _metrics(spark: SparkSession, sf: str, ranked: DataFrame, labels: DataFrame) -> DataFrame:
    kinds = labels.groupBy("query_id").agg(F.min("lang").alias("lang"))
    queries = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id")).join(kinds, "query_id", "left")
    queries = queries.select("query_id", F.coalesce("lang", F.lit("none")).alias("category"), F.when(F.col("lang").isNull(), "no_answer").otherwise("factoid").alias("query_type"))
    results = ranked.select("query_id", F.col("rank").alias("pos"), F.col("doc_id").alias("source_id"), F.col("doc_id").cast("string").alias("key"))
    return evaluation.query_metrics(queries, results, labels.select("query_id", F.col("doc_id").alias("source_id"), F.lit(2).alias("grade")))


@query(f"WITH {BM25}, {LABELS}, {metrics_sql('qm1', 'bmr')} SELECT * FROM qm1")
def ir_query_metrics(spark: SparkSession, sf: str) -> DataFrame:
    return _metrics(spark, sf, _bm25(spark, sf, 10), _labels(spark, sf))


@query(f"WITH {BM25}, {LABELS}, {metrics_sql('qm1', 'bmr')} SELECT grouping_id(category, query_type)::BIGINT AS gid, category, query_type, count(*) AS n, {MEANS} FROM qm1 GROUP BY GROUPING SETS ((), (category), (query_type))")
def ir_summary_sets(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.summary(_metrics(spark, sf, _bm25(spark, sf, 10), _labels(spark, sf)))


@query(
    rf"""WITH {BM25}, f AS (SELECT item_id AS query_id, regexp_replace(lower(unnest(string_split(text, '.'))), '\s+', '', 'g') AS fact FROM benchmark),
    a AS (SELECT query_id, string_agg(regexp_replace(lower(text), '\s+', '', 'g'), '' ORDER BY rank) AS alltext FROM bmr JOIN documents USING (doc_id) WHERE rank <= 5 GROUP BY ALL)
    SELECT query_id, count(*) AS n_facts, round(avg(coalesce(contains(alltext, fact), FALSE)::INT), 6) AS coverage FROM f LEFT JOIN a USING (query_id) WHERE fact <> '' GROUP BY ALL"""
)
def ir_fact_coverage(spark: SparkSession, sf: str) -> DataFrame:
    """Facts are the sentences of an item."""
    facts = table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.split("text", r"\.")).alias("fact"))
    results = _bm25(spark, sf, 5).join(table(spark, sf, "documents").select("doc_id", "text"), "doc_id").select("query_id", F.col("rank").alias("pos"), F.col("text").alias("content"))
    return evaluation.fact_coverage(facts, results)


def _variants(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Metrics of vector search alone, of lexical search alone, and of both fused.

    Labels and the best hits of either search are found once for all of them, and the metrics written,
    as reports use them several times.
    """
    labels = _labels(spark, sf)
    hits = lexical.best_hits(table(spark, sf, "benchmark"), table(spark, sf, "documents"), 20)
    one = {m: hits.filter(F.col("measure") == m).drop("measure") for m in ("cosine", "bm25")}
    fused = retrieval.rrf(*(h.withColumnRenamed("rank", "pos") for h in one.values()))
    ranked = {"r1": one["cosine"], "lexical": one["bm25"], "r3": retrieval.top(fused, ["query_id"], [F.desc("fusion_score"), F.asc("doc_id")], 10)}
    scratch = Scratch(spark, "variants")
    return {name: scratch.keep(_metrics(spark, sf, r, labels), name) for name, r in ranked.items()}


_BOTH = f"{BM25}, {COSINE}, {FUSED}, {LABELS}, {metrics_sql('mv', 'csr')}, {metrics_sql('ml', 'bmr')}, {metrics_sql('mf', 'ffr')}"


@query(f"WITH {_BOTH} SELECT variant, count(*) AS n, {MEANS} FROM (SELECT 'r1' AS variant, * FROM mv UNION ALL SELECT 'lexical', * FROM ml UNION ALL SELECT 'r3', * FROM mf) GROUP BY variant")
def variant_experiment(spark: SparkSession, sf: str) -> DataFrame:
    rows = None
    for name, metrics in _variants(spark, sf).items():
        one = evaluation.summary(metrics).filter("gid = 3").select(F.lit(name).alias("variant"), "n", *evaluation.METRICS)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def _deltas(found: dict[str, DataFrame]) -> DataFrame:
    held = {k: v.withColumn("cluster", F.col("query_id") % 10) for k, v in found.items()}
    return evaluation.paired_delta(held["r3"], held["r1"], "mrr_at_10")


_DELTA = f"{_BOTH}, dd AS (SELECT query_id, query_id % 10 AS cluster, round(mf.mrr_at_10 - mv.mrr_at_10, 6) AS delta FROM mf JOIN mv USING (query_id))"


@query(f"WITH {_DELTA} SELECT * FROM dd")
def paired_delta(spark: SparkSession, sf: str) -> DataFrame:
    return _deltas(_variants(spark, sf))


_BOOT = f"""{_DELTA}, cl AS (SELECT cluster, sum(delta) AS s, count(*) AS n, row_number() OVER (ORDER BY cluster) - 1 AS c FROM dd GROUP BY cluster),
tt AS (SELECT count(*) AS k, sum(s) AS s_all, sum(n) AS n_all FROM cl),
dr AS (SELECT r, i, ((r * k + i + 20260808) * 48271 % 2147483647 * 48271 % 2147483647) % k AS c FROM (SELECT unnest(range(2000)) AS r), tt, LATERAL (SELECT unnest(range(k)) AS i)),
ms AS (SELECT r, round(sum(s) / sum(n), 9) AS m FROM dr JOIN cl USING (c) GROUP BY r), rk AS (SELECT m, row_number() OVER (ORDER BY m, r) - 1 AS p FROM ms),
ci AS (SELECT round(s_all / n_all, 6) AS mean_delta, k AS clusters, (SELECT round(max(m), 6) FROM rk WHERE p = 49) AS ci_low, (SELECT round(max(m), 6) FROM rk WHERE p = 1949) AS ci_high FROM tt)"""


@query(f"WITH {_BOOT} SELECT * FROM ci")
def bootstrap_ci(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.bootstrap(_deltas(_variants(spark, sf)))


@query(
    f"""WITH {_BOOT}, a AS (SELECT {MEANS} FROM mf), b AS (SELECT {MEANS} FROM mv),
    c AS (SELECT a.recall_at_5 >= 0.9 AS recall_at_5_gte_90, round(a.recall_at_5 - b.recall_at_5, 6) >= 0.05 AS recall_at_5_vs_r1_gte_5pp, ci_low > 0 AS recall_at_5_ci_above_zero, round(a.mrr_at_10 - b.mrr_at_10, 6) >= -0.02 AS mrr_not_down_over_2pp,
    round(a.ndcg_at_10 - b.ndcg_at_10, 6) >= -0.02 AS ndcg_not_down_over_2pp, a.no_answer_false_positive <= 0.05 AS no_answer_fpr_lte_5, a.duplicate_top3 = 0 AS top3_duplicate_zero, TRUE AS p95_latency_within_1_2x FROM a, b, ci)
    SELECT *, recall_at_5_gte_90 AND recall_at_5_vs_r1_gte_5pp AND recall_at_5_ci_above_zero AND mrr_not_down_over_2pp AND ndcg_not_down_over_2pp AND no_answer_fpr_lte_5 AND top3_duplicate_zero AND p95_latency_within_1_2x AS passed FROM c"""
)
def acceptance_report(spark: SparkSession, sf: str) -> DataFrame:
    """Gates on the fused variant against the vector one; latencies are inputs."""
    found = _variants(spark, sf)
    whole = {k: evaluation.summary(v).filter("gid = 3") for k, v in found.items()}
    return evaluation.acceptance(whole["r3"], whole["r1"], evaluation.bootstrap(_deltas(found)), 310.7, 280.7)


# --- whole pipelines -----------------------------------------------------------------------------

_RERANKED = f"""{BM25}, {COSINE}, {FUSED},
qi AS (SELECT query_id, token, coalesce(ln(1 + (n - df + 0.5) / (df + 0.5)), 0) AS idf FROM qd LEFT JOIN df USING (token), st),
ts AS (SELECT doc_id, text, toks, list_transform(regexp_extract_all(source || ' ' || lang, '[A-Za-z0-9_]+'), lambda t: lower(t)) AS stoks FROM documents JOIN dt USING (doc_id)),
rr AS (SELECT query_id, doc_id, round(0.45 * coalesce(sum(idf) FILTER (list_contains(toks, token)), 0) + 0.30 * coalesce(sum(idf) FILTER (list_contains(stoks, token)), 0) + 0.25 * coalesce(sum(idf) FILTER (len(token) >= 2 AND contains(text, token)), 0), 4) AS rs
    FROM ff JOIN ts USING (doc_id) JOIN qi USING (query_id) GROUP BY ALL),
pl AS (SELECT query_id, doc_id, fusion_score AS strength, count(*) OVER (PARTITION BY query_id) AS n, ffr.rank AS place, rs FROM ffr JOIN rr USING (query_id, doc_id)),
po AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY CASE WHEN n > 5 THEN -rs ELSE 0 END, place) AS pos FROM pl)"""


def _searched(spark: SparkSession, sf: str, name: str, min_score: float = 0.0) -> DataFrame:
    docs = table(spark, sf, "documents").withColumn("section", F.concat_ws(" ", "source", "lang"))
    return pipeline.search(table(spark, sf, "benchmark"), docs, pipeline.VARIANTS[name], k=5, min_score=min_score)


@query(f"WITH {_RERANKED} SELECT query_id, doc_id, strength, pos FROM po WHERE pos <= 5 AND strength >= 0.01")
def retrieval_pipeline(spark: SparkSession, sf: str) -> DataFrame:
    """The full hybrid variant with rewriting, reranking and a threshold."""
    return _searched(spark, sf, "r4", 0.01)


@query(f"WITH {BM25}, {COSINE}, {FUSED} SELECT query_id, doc_id, fusion_score AS strength, rank AS pos FROM ffr WHERE rank <= 5")
def hybrid_search(spark: SparkSession, sf: str) -> DataFrame:
    """Hybrid recall without rewriting or reranking."""
    return _searched(spark, sf, "r3")


@query("SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(f"'{x}'" if isinstance(x, str) else str(x) for x in vars(v).values()) + ")" for v in pipeline.VARIANTS.values()) + ") AS t(name, chunk_mode, overlap, cosine, stable_ids, dedup_mode, hybrid, rewrite, rerank, fallback)")
def variant_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return pipeline.variant_rows(spark)


@query(f"""WITH {BM25}, h AS (SELECT query_id, rank, '  ' || rank || '. 标题: ' || source || chr(10) || '   内容: ' || substr(text, 1, 600) AS line FROM bmr JOIN documents USING (doc_id) WHERE rank <= 3 AND trim(text) <> '')
SELECT query_id, count(*) AS n, sum(len(line))::BIGINT AS chars FROM h GROUP BY query_id""")
def knowledge_context(spark: SparkSession, sf: str) -> DataFrame:
    """Size of each query's numbered context: its lines, and their characters without the scores."""
    docs = table(spark, sf, "documents").select("doc_id", F.col("source").alias("title"), F.col("text").alias("content"))
    hits = _bm25(spark, sf, 3).join(docs, "doc_id").select("query_id", F.col("rank").alias("pos"), "title", "content", F.lit("").alias("score"))
    made = pipeline.knowledge_context(hits)
    lines = F.regexp_count("context", F.lit(r"(?m)^[1-3]\. 标题: "))
    # The heading and the score lines are not counted, two blanks stand before each number instead.
    chars = F.length("context") - F.length(F.lit("[知识库检索结果]\n")) - lines * (F.length(F.lit("   相关度: \n")) - 2) - (lines - 1)
    return made.select("query_id", lines.cast("long").alias("n"), chars.cast("long").alias("chars"))


_LATIN = "list_distinct(regexp_extract_all(lower({0}), '[a-z0-9]+'))"


@query(
    f"""WITH q AS (SELECT item_id AS query_id, {_LATIN.format('text')} AS q FROM benchmark), c AS (SELECT page_id AS doc_id, {_LATIN.format('html')} AS c, {_LATIN.format('url')} AS s FROM pages),
    x AS (SELECT query_id, doc_id, round(0.55 + 0.25 * len(list_intersect(q, c)) + 0.20 * len(list_intersect(q, s)), 4)::DOUBLE AS score FROM q, c)
    SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM x) WHERE rank <= 5"""
)
def overlap_topk(spark: SparkSession, sf: str) -> DataFrame:
    """Token overlap with pages, their address as the section."""
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("doc_id"), F.col("html").alias("text"), F.col("url").alias("section"))
    return retrieval.overlap_topk(table(spark, sf, "benchmark"), pages)
