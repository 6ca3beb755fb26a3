"""The queries of this subpackage, as ``name -> (spark, sf_dir) -> DataFrame``, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import Scratch
from . import decontamination, lm_scores, packing, pii, quality_model, quality_rules, secrets, simhash, token_files, toxicity
from .common import held_out, labelled, table, tokenizer_path


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path(), capacity=1024, end_id=2)


def toxicity_lexicon(spark: SparkSession, sf_dir: str, docs: DataFrame | None = None) -> toxicity.Lexicon:
    """Learnt from labelled rows whose id is not held out."""
    how = toxicity.Training()
    docs = table(spark, sf_dir, "documents") if docs is None else docs
    rows = labelled(docs, table(spark, sf_dir, "labels"), "toxic", held_out("doc_id", 3, 1), how.max_rows)
    return toxicity.learn(Scratch(spark, "toxicity").keep(rows, "training"), label_col="label", how=how)


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = toxicity.score(table(spark, sf_dir, "documents"), toxicity_lexicon(spark, sf_dir), threshold=0.7)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", "predicted")


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"), words=3)


def op4_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = Scratch(spark, "tokens").path + "/files"
    token_files.write(token_files.encode_documents(table(spark, sf_dir, "documents"), tokenizer_path(), end_id=0), path)
    return token_files.checksums(token_files.read(spark, path))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every row's findings, by a ledger that first met an earlier state of the table, half of its rows."""
    docs = table(spark, sf_dir, "documents")
    ledger = secrets.Ledger(spark, Scratch(spark, "ledger").path)
    ledger.scan(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(2)) == 0))
    ledger.scan(docs)  # scans the blobs that are new since then
    return secrets.digest(secrets.by_path(ledger, docs))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = quality_rules.judge(table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of all documents, a network fitted on labelled rows whose id is not held out, a score for every row."""
    docs, how = table(spark, sf_dir, "documents"), quality_model.Training()
    rows = labelled(docs, table(spark, sf_dir, "labels"), "quality", held_out("doc_id", 5, 0), how.max_rows)
    scored = quality_model.score(docs, quality_model.learn(Scratch(spark, "quality").keep(rows, "training"), docs, how), threshold=0.3)
    return scored.select("doc_id", held_out("doc_id", 5, 0).alias("held_out"), "score", "predicted")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The target corpus is every document that is labelled good and not toxic; all rows are scored.

    Labels grow with the documents, so they are never broadcast: the join shuffles at every size.
    """
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    good = table(spark, sf_dir, "labels").filter("quality = 1 AND toxic = 0").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    flagged = docs.join(good.hint("merge"), docs["doc_id"] == good["good_id"], "left")
    return lm_scores.cross_entropy_difference(flagged, F.col("good_id").isNotNull())


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strict and added spans of every row, told in the contract's digest columns."""
    return pii.digest(pii.find(table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_best_fit_packing,
        op2_toxicity,
        op3_simhash,
        op4_token_files,
        op5_secret_scans,
        op6_quality_rules,
        op7_decontamination,
        op8_quality_model,
        op9_lm_scores,
        op10_pii,
    )
}

def _secrets_sql() -> str:
    """The same rules for an engine without possessive repeats and look-behind; where one is needed, the character before is matched and skipped."""
    parts = []
    for i, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("(?<![0-9a-f])", "").replace(",}+", ",}").replace("(?<![A-Za-z0-9_-])", "(?:^|[^A-Za-z0-9_-])").replace("'", "''")
        parts.append(f"SELECT r, '{r.kind}' AS kind, {i} AS ord, {r.base} AS base, {r.least} AS least, string_split_regex(text, '{pattern}') AS g, regexp_extract_all(text, '{pattern}', 0) AS m, regexp_extract_all(text, '{pattern}', {r.group}) AS p FROM d WHERE regexp_matches(text, '{pattern}')")
    total = "list_sum(list_transform({0}, lambda s: len(s)))"
    return f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents), h AS ({" UNION ALL ".join(parts)}),
    e AS (SELECT *, unnest(range(1, len(m) + 1)) AS i FROM h),
    s AS (SELECT r, kind, ord, base, ({total.format('g[1:i]')} + coalesce({total.format('m[1:i - 1]')}, 0) + skip)::BIGINT AS a, len(m[i]) - skip AS n
        FROM (SELECT *, (kind = 'web_token' AND NOT starts_with(m[i], 'eyJ'))::INT AS skip FROM e) WHERE len(p[i]) >= least),
    t AS (SELECT r, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
        string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) AS spans, coalesce(string_agg(kind || ':' || a || ':' || (a + n), ',' ORDER BY a, ord) FILTER (base), '') AS own FROM s GROUP BY r)
    SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(own, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN t USING (r)"""


WORD = r"[^\x20\x09-\x0D]+"

ORACLE_SQL: dict[str, str] = {
    "op5_secret_scans": _secrets_sql(),
    "op6_quality_rules": rf"""
        WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
        w AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT r, regexp_extract_all(text, '{WORD}') AS ws FROM d)),
        g AS (SELECT r, i, w, lead(w, 1) OVER o AS w1, lead(w, 2) OVER o AS w2 FROM w WINDOW o AS (PARTITION BY r ORDER BY i)),
        h AS (SELECT r, i, count(*) OVER (PARTITION BY r, w, w1, w2) AS n FROM g WHERE w2 IS NOT NULL),
        c AS (SELECT r, count(DISTINCT j) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS j FROM h WHERE n > 1) GROUP BY r),
        l AS (SELECT r, count(*) AS n, count(DISTINCT s) AS u FROM (SELECT r, unnest(string_split(text, chr(10))) AS s FROM d) WHERE regexp_matches(s, '{WORD}') GROUP BY r),
        m AS (SELECT d.doc_id, d.text, len(regexp_extract_all(text, '{WORD}')) AS n_words, len(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
            len(text) - len(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.u, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
            FROM d LEFT JOIN l USING (r) LEFT JOIN c USING (r)),
        b AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
            NOT (base_failed OR 10 * n_symbols > n_words OR word_chars < 2 * n_words OR word_chars > 24 * n_words OR (n_lines >= 4 AND 10 * n_dup_lines > 9 * n_lines)
                OR 2 * len(regexp_replace(text, '[^\p{{Lu}}]', '', 'g')) > word_chars OR 2 * len(regexp_replace(text, '[^0-9]', '', 'g')) > word_chars) AS kept
        FROM b""",
}
