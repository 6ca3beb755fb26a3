"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the SHA-256 of its text. The ledger remembers which rule
versions have scanned which blob, and what they found. A scan hashes the history, drops copies before
the shuffle, scans each blob only with the rule versions it has not met, appends to the ledger, and
joins the findings back to all paths. Only built-in expressions are used.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import column, fresh


@dataclass(frozen=True)
class Rule:
    """Leftmost non-overlapping matches of ``pattern`` whose ``group`` has ``least`` characters or more."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 0
    version: int = 1
    base: bool = False

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans at the same place are listed. A minimum that holds for a maximal run of
#: one character class is part of its pattern; the one for ``assign`` is not, since a match that is too
#: short uses up its text.
RULES = (
    Rule("assign", r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", group=2, least=6, base=True),
    Rule("access", r"AKIA[A-Z0-9]{16,}", base=True),
    Rule("hex", r"(?<![0-9a-f])[0-9a-f]{24,}", base=True),
    Rule("private_key", r"-----BEGIN (?:[A-Z]{2,10} )?PRIVATE KEY(?: BLOCK)?-----"),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}+\.[A-Za-z0-9_-]{8,}"),
    Rule("map_key", r"AIza[A-Za-z0-9_-]{35}"),
)


def blob_of(text: Column) -> Column:
    """A text's address; a null text is an empty one."""
    return F.sha2(F.coalesce(text, F.lit("")), 256)


class Ledger:
    """The tables ``scanned(blob, rules)`` and ``findings(blob, kind, rule, start, end)`` below ``path``.

    Each scan appends one folder to both; the findings go first, so a scan that broke off is repeated
    and its findings, which are the same, are read once.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _read(self, name: str, schema: str) -> DataFrame | None:
        try:
            return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(f"{self.path}/{name}")
        except AnalysisException as e:
            if e.getCondition() == "PATH_NOT_FOUND":
                return None
            raise

    def scanned(self) -> DataFrame | None:
        return self._read("scanned", "blob string, rules array<string>")

    def findings(self, rules: tuple[Rule, ...]) -> DataFrame:
        """What these rule versions found, each finding once."""
        found = self._read("findings", FINDINGS)
        if found is None:
            return self.spark.createDataFrame([], FINDINGS)
        return found.filter(F.col("rule").isin([r.key for r in rules])).distinct()

    def pending(self, history: DataFrame, text_col: str, rules: tuple[Rule, ...]) -> DataFrame:
        """``blob, text, pending``: each unseen text once, with the rule versions it has yet to meet."""
        every = F.array(*[F.lit(r.key) for r in rules])
        text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
        rows = history.select(blob_of(text).alias("blob"), text.alias("text"))
        scanned = self.scanned()
        if scanned is None:
            return rows.groupBy("blob").agg(F.first("text").alias("text")).withColumn("pending", every)
        met = scanned.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_set("rules"))).alias("met"))
        # Copies go before the shuffle and texts are dealt once, by the address that the ledger is joined on.
        once = rows.groupBy("blob").agg(F.first("text").alias("text")).join(met, "blob", "left")
        return once.select("blob", "text", F.when(F.col("met").isNull(), every).otherwise(F.array_except(every, "met")).alias("pending")).filter(F.size("pending") > 0)

    def scan(self, history: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> None:
        """Bring the ledger up to date with every version in ``history``: only pending pairs are scanned and noted."""
        run = uuid.uuid4().hex
        pending = self.pending(history, text_col, rules)
        hits(pending, rules).write.parquet(f"{self.path}/findings/{run}")
        pending.select("blob", F.col("pending").alias("rules")).write.parquet(f"{self.path}/scanned/{run}")


FINDINGS = "blob string, kind string, rule string, start long, end long"


def hits(pending: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Findings of ``blob, text, pending``: positions in code points, end exclusive.

    The matches and the text between them are split by the same expression, so their lengths alternate
    and a running sum of them gives the positions.
    """
    text = F.col("text")

    def lengths(strings: Column) -> Column:
        return F.transform(strings, lambda s: F.length(s))

    def hit(rule: Rule) -> Column:
        found = F.arrays_zip(
            lengths(F.split(text, rule.pattern, -1)).alias("gap"),
            lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))).alias("match"),
            lengths(F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))).alias("part"),
        )
        row = F.struct(F.lit(rule.kind).alias("kind"), F.lit(rule.key).alias("rule"), F.lit(rule.least).alias("least"), found.alias("found"))
        return F.when(F.array_contains("pending", rule.key) & text.rlike(rule.pattern), row)

    each = pending.select("blob", F.explode(F.array_compact(F.array(*[hit(r) for r in rules]))).alias("h"))
    rows = each.select("blob", "h.kind", "h.rule", "h.least", F.posexplode("h.found").alias("at", "f"))
    before = Window.partitionBy("blob", "kind").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce(F.sum(F.col("f.gap") + F.col("f.match")).over(before), F.lit(0)) + F.col("f.gap")
    placed = rows.select("blob", "kind", "rule", "least", "f", start.alias("start")).filter(F.col("f.match").isNotNull() & (F.col("f.part") >= F.col("least")))
    return placed.select("blob", "kind", "rule", F.col("start").cast("long").alias("start"), (F.col("start") + F.col("f.match")).cast("long").alias("end"))


def by_path(ledger: Ledger, history: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``doc_id, spans`` for every row of ``history``: ``spans`` is its findings in listing order, maybe none.

    ``spans`` has structs ``start, ord, kind, end, base``. Null texts are empty, null ids stay,
    repeated rows stay repeated, and an empty history gives no rows.
    """
    order = F.create_map(*[x for i, r in enumerate(rules) for x in (F.lit(r.kind), F.lit(i))])
    base = F.col("kind").isin([r.kind for r in rules if r.base])
    span = F.struct("start", order[F.col("kind")].alias("ord"), "kind", "end", base.alias("base"))
    found = ledger.findings(rules).groupBy("blob").agg(F.sort_array(F.collect_list(span)).alias("spans"))
    paths = history.select(F.col(id_col).cast("long").alias("doc_id"), blob_of(F.col(text_col).cast("string")).alias("blob"))
    return paths.join(found, "blob", "left").select("doc_id", F.coalesce("spans", F.array().cast(found.schema["spans"].dataType)).alias("spans"))


def digest(spans: DataFrame) -> DataFrame:
    """Counts and listings of ``by_path`` rows."""

    def listed(array: Column) -> Column:
        return F.array_join(F.transform(array, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    def count(kind: str) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    own = F.filter("spans", lambda s: s["base"])
    return spans.select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


#: More spans than these are cut out of the list of a text's characters: each cut of the text walks it anew.
FEW = 32


def redacted(text: Column, spans: Column, characters: Column) -> Column:
    """The text with ``spans`` (``start, end``, in order and apart from each other) replaced by ``[SECRET]``.

    ``characters`` is the list of the text's characters where there are more than ``FEW`` spans; it must
    be a column, so that it is made once.
    """

    def cut(piece) -> Column:
        def before(s: Column, i: Column) -> Column:
            at = F.when(i > 0, spans[i - 1]["end"]).otherwise(F.lit(0).cast("long"))
            return F.concat(piece(at, s["start"] - at), F.lit("[SECRET]"))

        last = F.element_at(spans, -1)["end"]
        return F.concat(F.array_join(F.transform(spans, before), ""), piece(last, F.length(text) - last))

    plain = cut(lambda at, n: F.substring(text, (at + 1).cast("int"), n.cast("int")))
    listed = cut(lambda at, n: F.array_join(F.slice(characters, (at + 1).cast("int"), n.cast("int")), ""))
    return F.when(F.size(spans) <= FEW, plain).otherwise(listed)


def runs(findings: DataFrame) -> DataFrame:
    """``blob, start, end`` of each run of findings that overlap or touch one another's inside."""
    w = Window.partitionBy("blob").orderBy("start", "end")
    reach = F.max("end").over(w.rowsBetween(Window.unboundedPreceding, -1))
    first = (reach.isNull() | (F.col("start") >= reach)).cast("int")
    numbered = findings.select("blob", "start", "end", first.alias("first")).withColumn("run", F.sum("first").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy("blob", "run").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("run")


def with_redactions(ledger: Ledger, docs: DataFrame, text_col: str = "text", chars_col: str = "n_chars", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns of ``docs``, with secrets in the text redacted and its length counted anew.

    Only blobs with findings are joined in; a null text stays null; repeated rows stay; texts of any
    length are read whole; an empty table gives no rows. Columns of any name stay as they are.
    """
    blob, spans = fresh("blob", docs.columns), fresh("spans", docs.columns)
    found = runs(ledger.findings(rules)).groupBy("blob").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias(spans)).withColumnRenamed("blob", blob)
    joined = docs.withColumn(blob, blob_of(F.col(text_col).cast("string"))).join(found, blob, "left")
    letters = fresh("letters", joined.columns)
    joined = joined.withColumn(letters, F.when(F.size(spans) > FEW, F.split(text_col, "")))
    own = F.col(spans)
    columns = {c: column(c) for c in docs.columns} | {text_col: F.when(own.isNull(), F.col(text_col)).otherwise(redacted(F.col(text_col), own, F.col(letters)))}
    if chars_col in docs.columns:
        gone = F.aggregate(own, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"] - len("[SECRET]"))
        columns[chars_col] = F.when(own.isNull(), F.col(chars_col)).otherwise(F.length(text_col) - gone).cast(docs.schema[chars_col].dataType)
    return joined.select(*[c.alias(name) for name, c in columns.items()])
