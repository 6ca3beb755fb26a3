"""Intent, urgency, gating and routing of messages, as expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions import text as X
from .retrieval import small


def _best(text: Column, patterns: dict[str, tuple[str, ...]]) -> Column:
    """A struct of the pattern with the highest score, the first of equal ones; null without a hit."""
    scored = F.array(*[F.struct(F.lit(name).alias("intent"), X.hits(text, words).alias("n")) for name, words in patterns.items()])

    def better(a: Column, b: Column) -> Column:
        return F.when(b["n"] > a["n"], b).otherwise(a)

    best = F.aggregate(scored, F.struct(F.lit("other").alias("intent"), F.lit(0).alias("n")), better)
    return F.transform(F.array(best), lambda b: F.when(b["n"] > 0, F.struct(b["intent"].alias("intent"), F.least(F.lit(1.0), 0.5 + 0.25 * (b["n"] - 1)).alias("confidence"))))[0]


def pattern_intent(message: Column) -> Column:
    """Intent and confidence by keywords: specific ones first, generic ones only if none of those hit."""
    text = F.lower(message)
    other = F.struct(F.lit("other").alias("intent"), F.lit(0.0).cast("double").alias("confidence"))
    return F.coalesce(_best(text, K.SPECIFIC_PATTERNS), _best(text, K.GENERIC_PATTERNS), other)


def share_intent(message: Column) -> Column:
    """The other rule: hits over the length of the list, all lists together; of equal shares the first list wins."""
    text = F.lower(message)
    lists = K.SHARE_PATTERNS
    scored = F.array(*[F.struct(F.lit(k).alias("intent"), (X.hits(text, w) / len(w)).alias("score")) for k, w in lists.items()])
    return F.aggregate(scored, F.struct(F.lit("other").alias("intent"), F.lit(0.0).alias("score")), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))


def urgency(message: Column, intent: Column) -> Column:
    """The most urgent level with a keyword in the text; else escalations are high, complaints medium, others low."""
    text = F.lower(message)
    out = None
    for level, words in K.URGENCY.items():
        held = X.any_of(text, words)
        out = F.when(held, level) if out is None else out.when(held, level)
    return out.when(intent.isin("escalation", "human_handoff"), "high").when(intent == "complaint", "medium").otherwise("low")


def intent_group(intent: Column) -> Column:
    """The coarse intent that a fine one belongs to."""
    out = intent
    for fine, coarse in K.INTENT_GROUPS.items():
        out = F.when(intent == fine, coarse).otherwise(out)
    return out


def vote(model: Column, near: Column, pattern: Column, failed: Column, embedding: bool = True, threshold: float = 0.5) -> Column:
    """Weighted vote of three ``intent, confidence`` structs.

    If the model failed, the embedding decides, then the pattern. A generic winner below 0.8 yields to
    a specific pattern of 0.5 or more; below the threshold the intent is ``other`` with its score.
    """
    sources = [(model, 0.7), (near, 0.2), (pattern, 0.1)] if embedding else [(model, 0.85), (pattern, 0.15)]
    rows = F.array(*[F.struct(s["intent"].alias("intent"), (s["confidence"] * w).alias("w")) for s, w in sources])

    def total(all_: Column) -> Column:
        return F.transform(all_, lambda a: F.struct(a["intent"].alias("intent"), F.aggregate(F.filter(all_, lambda b: b["intent"] == a["intent"]), F.lit(0.0), lambda s, b: s + b["w"]).alias("w")))

    first = F.aggregate(total(rows), F.struct(F.lit("other").alias("intent"), F.lit(-1.0).alias("w")), lambda a, b: F.when(b["w"] > a["w"], b).otherwise(a))

    def verdict(best: Column) -> Column:
        refined = best["intent"].isin(*K.GENERIC_INTENTS) & pattern["intent"].isin(*K.SPECIFIC_PATTERNS) & (pattern["confidence"] >= 0.5) & (best["w"] < 0.8)
        return (
            F.when(refined, _pair(pattern["intent"], F.greatest(best["w"], pattern["confidence"])))
            .when(best["w"] < threshold, _pair(F.lit("other"), best["w"]))
            .otherwise(_pair(best["intent"], best["w"]))
        )

    usable = lambda s: (s["intent"] != "other") & (s["confidence"] > 0)
    fallback = F.when(usable(near), _pair(near["intent"], near["confidence"])).when(usable(pattern), _pair(pattern["intent"], pattern["confidence"])).otherwise(_pair(F.lit("other"), F.lit(0.0)))
    return F.when(failed, fallback).otherwise(F.transform(F.array(first), verdict)[0])


def _pair(intent: Column, confidence: Column) -> Column:
    return F.struct(intent.alias("intent"), F.round(confidence, 6).alias("confidence"))


def knowledge_gate(message: Column, intent: Column) -> Column:
    """Whether to ask the knowledge base, and why: by intent, else by length and the first keyword."""
    plain = X.collapse(F.coalesce(message, F.lit("")))
    word = F.filter(F.array(*[F.lit(w) for w in K.BUSINESS_WORDS]), lambda w: plain.contains(w))
    reason = (
        F.when(intent.isin(*K.ALWAYS_SEARCH, *K.NEVER_SEARCH), F.concat(F.lit("intent:"), intent))
        .when(F.length(plain) < 4, "fallback:text_too_short")
        .when(F.size(word) > 0, F.concat(F.lit("fallback:keyword:"), F.element_at(word, 1)))
        .otherwise("fallback:no_business_signal")
    )
    asked = F.coalesce(intent.isin(*K.ALWAYS_SEARCH), F.lit(False)) | reason.startswith("fallback:keyword:")
    return F.struct(asked.alias("search"), reason.alias("reason"))


def needs_clarification(message: Column, intent: Column, confidence: Column) -> Column:
    return (intent == "other") & (F.length(X.strip(message)) > 2) & (confidence < 0.5)


def escalated(response: Column, urgency_: Column, intent: Column) -> Column:
    return X.any_of(response, K.ESCALATION_WORDS) | (urgency_ == "critical") | intent.isin("escalation", "human_handoff")


# The domain of each intent.
GENERAL_INTENTS = ("query", "order_status", "logistics", "request", "complaint", "greeting", "feedback", "other")
TECHNICAL_INTENTS = ("technical", "technical_login", "technical_crash")
BILLING_INTENTS = ("billing", "account", "account_security", "refund", "invoice", "payment_issue")


def domain_scores(message: Column, intent: Column, entities: Column) -> Column:
    """Scores of the three domains in order of declaration, as an array of ``agent, score``."""
    text = F.lower(message)

    def has(kind: str) -> Column:
        return F.coalesce(F.size(entities[kind]) > 0, F.lit(False)).cast("int")

    def by(intents) -> Column:
        return F.coalesce(intent.isin(*intents), F.lit(False)).cast("int")

    general = 0.1 + 0.55 * by(GENERAL_INTENTS) + F.least(F.lit(0.35), 0.12 * X.hits(text, K.GENERAL_WORDS)) + 0.1 * has("order_id")
    technical = 0.75 * by(TECHNICAL_INTENTS) + F.least(F.lit(0.45), 0.18 * X.hits(text, K.TECHNICAL_WORDS)) + 0.2 * has("error_code")
    billing = 0.75 * by(BILLING_INTENTS) + F.least(F.lit(0.45), 0.18 * X.hits(text, K.BILLING_WORDS)) + 0.15 * has("amount")
    named = (("general", general), ("technical", technical), ("billing", billing))
    return F.array(*[F.struct(F.lit(n).alias("agent"), F.round(s.cast("double"), 3).alias("score")) for n, s in named])


def route(message: Column, intent: Column, entities: Column, urgency_: Column, confidence: Column) -> Column:
    """``primary, supporting, confidence``: the best domain, and other special ones of 0.45 or more."""
    handed = intent.isin("escalation", "human_handoff")

    def decide(scores: Column) -> Column:
        best = F.aggregate(scores, F.struct(F.lit("general").alias("agent"), F.lit(-1.0).alias("score")), lambda a, b: F.when(b["score"] > a["score"], b).otherwise(a))

        def chosen(b: Column) -> Column:
            rest = F.filter(scores, lambda s: (s["agent"] != b["agent"]) & (s["agent"] != "general") & (s["score"] >= 0.45))
            return F.struct(b["agent"].alias("primary"), F.transform(rest, lambda s: s["agent"]).alias("supporting"), F.least(b["score"], F.lit(1.0)).alias("confidence"))

        return F.transform(F.array(best), chosen)[0]

    alone = lambda c: F.struct(F.lit("general").alias("primary"), F.array().cast("array<string>").alias("supporting"), c.cast("double").alias("confidence"))
    scored = F.transform(F.array(domain_scores(message, intent, entities)), decide)[0]
    return F.when(urgency_ == "critical", alone(F.lit(1.0))).when(handed, alone(F.greatest(confidence, F.lit(0.8)))).otherwise(scored)


def rewrites(queries: DataFrame, rules: dict[str, tuple[str, ...]] = K.REWRITES, id_col: str = "query_id", text_col: str = "query", most: int = 3) -> DataFrame:
    """``query_id, ord, query``: the query itself at 0, then up to ``most`` distinct rewritten forms in rule order."""
    forms = [F.when(F.col(text_col).contains(k), F.replace(F.col(text_col), F.lit(k), F.lit(v))) for k, vs in rules.items() for v in vs]
    new = F.filter(F.array_distinct(F.array_compact(F.array(*forms))), lambda q: q != F.col(text_col))
    return queries.select(F.col(id_col).alias("query_id"), F.posexplode(F.concat(F.array(F.col(text_col)), F.slice(new, 1, most))).alias("ord", "query"))


def hashed_cells(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys, cell, weight``: the cells, not zero, of the 256-wide vector of signed hashed distinct 1- to 3-grams."""
    grams = X.distinct_grams(F.col(text))
    each = rows.select(*keys, F.explode(grams).alias("g"))
    return each.groupBy(*keys, X.md5_cell(F.col("g")).alias("cell")).agg(F.sum(X.md5_sign(F.col("g"))).alias("weight")).filter("weight <> 0")


def learnt(templates: DataFrame, corrections: DataFrame) -> DataFrame:
    """``intent, ord, text``: the templates with corrected messages put in, each new text of an intent once.

    ``corrections``: seq, intent, text. What an intent has already is not put in again; new texts come
    after all templates, in the order of ``seq``.
    """
    new = corrections.groupBy("intent", "text").agg(F.min("seq").alias("seq")).join(templates.select("intent", "text"), ["intent", "text"], "left_anti")
    last = templates.agg(F.coalesce(F.max("ord"), F.lit(-1)).alias("last"))
    placed = new.crossJoin(F.broadcast(last)).select("intent", (F.col("last") + 1 + F.col("seq")).cast("int").alias("ord"), "text")
    return templates.select("intent", "ord", "text").unionByName(placed)


def template_nearest(messages: DataFrame, templates: DataFrame) -> DataFrame:
    """Nearest template category by cosine of hashed gram vectors: ``id, intent, confidence``.

    ``templates``: intent, ord, text; a small rule table. A category counts by its best template; of
    equal categories the first by ``ord`` wins; a message like none is ``other`` with 0.
    """
    m = hashed_cells(messages, ["id"], "text")
    t = hashed_cells(templates, ["intent", "ord"], "text")
    norm = lambda df, keys: df.groupBy(*keys).agg(F.sqrt(F.sum(F.col("weight") * F.col("weight"))).alias("norm"))
    dots = m.withColumnRenamed("weight", "w").join(small(t), "cell").groupBy("id", "intent", "ord").agg(F.sum(F.col("w") * F.col("weight")).alias("dot"))
    norms = small(norm(t, ["intent", "ord"]).withColumnRenamed("norm", "tnorm"))
    scored = dots.join(norm(m, ["id"]), "id").join(norms, ["intent", "ord"]).withColumn("score", F.round(F.col("dot") / (F.col("norm") * F.col("tnorm")), 6))
    best = scored.filter("score > 0").groupBy("id").agg(F.min_by(F.struct("intent", "score"), F.struct((-F.col("score")).alias("s"), "ord")).alias("b"))
    return messages.select("id").join(best, "id", "left").select("id", F.coalesce("b.intent", F.lit("other")).alias("intent"), F.coalesce("b.score", F.lit(0.0)).alias("confidence"))


def skills_for(messages: DataFrame, skills: DataFrame, agent: str, block: int = 3200, budget: int = 5000) -> DataFrame:
    """``id, ord, skill, text``: skills that match each message, cut to a block and a total budget in order.

    ``skills``: ord, name, content, keywords, agents, enabled. A block that would pass the budget is cut
    to what is left and marked; the ones after it are left out.
    """
    from pyspark.sql.window import Window

    text = F.lower(F.col("message"))
    apt = (F.size("agents") == 0) | F.array_contains("agents", agent)
    hit = (F.size("keywords") == 0) | F.exists("keywords", lambda k: text.contains(F.lower(k)))
    rows = messages.join(F.broadcast(skills.filter("enabled")), apt & hit)
    rows = rows.withColumn("body", F.concat(F.lit("## "), F.col("name"), F.lit("\n"), F.substring("content", 1, block)))
    before = F.coalesce(F.sum(F.length("body")).over(Window.partitionBy("id").orderBy("ord").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    left = F.lit(budget) - before
    cut = F.when(F.length("body") <= left, F.col("body")).otherwise(F.concat(F.substring(F.col("body"), F.lit(1), left.cast("int")), F.lit("\n...")))
    return rows.withColumn("_left", left).filter("_left > 0").select("id", "ord", F.col("name").alias("skill"), cut.alias("text"))


def plain_gate(message: Column) -> Column:
    """The plainer gate: greetings never ask, other texts of four characters or with a business word do."""
    text = F.lower(F.coalesce(message, F.lit("")))
    return ~F.trim(text).isin(*K.GREETINGS) & ((F.length(text) >= 4) | X.any_of(text, K.GATE_WORDS))


def table_route(intent: Column, urgency_: Column) -> Column:
    """The agent by intent alone: critical and handed-over requests escalate, unknown intents are general."""
    return (
        F.when((urgency_ == "critical") | intent.isin("escalation", "human_handoff"), "escalation")
        .when(intent.isin(*TECHNICAL_INTENTS), "technical")
        .when(intent.isin(*BILLING_INTENTS), "billing")
        .otherwise("general")
    )


def collaborators(message: Column, intent: Column) -> Column:
    """The special domains that the intent or a word calls in, in order."""
    text = F.lower(message)
    technical = intent.isin(*TECHNICAL_INTENTS) | X.any_of(text, K.TECHNICAL_CALLS)
    billing = intent.isin(*BILLING_INTENTS) | X.any_of(text, K.BILLING_CALLS)
    return F.array_compact(F.array(F.when(technical, F.lit("technical")), F.when(billing, F.lit("billing"))))


def plain_vote(model: Column, near: Column, pattern: Column, failed: Column, threshold: float = 0.35) -> Column:
    """The plainer vote: no refinement, a failed model leaves the pattern, confidence is the model's.

    Of equal sums the source named first wins.
    """
    rows = F.array(*[F.struct(s["intent"].alias("intent"), (s["confidence"] * w).alias("w")) for s, w in ((model, 0.7), (near, 0.2), (pattern, 0.1))])

    def best(all_: Column) -> Column:
        sums = F.transform(all_, lambda a: F.struct(a["intent"].alias("intent"), F.aggregate(F.filter(all_, lambda b: b["intent"] == a["intent"]), F.lit(0.0), lambda s, b: s + b["w"]).alias("w")))
        return F.aggregate(sums, F.struct(F.lit("other").alias("intent"), F.lit(-1.0).alias("w")), lambda a, b: F.when(b["w"] > a["w"], b).otherwise(a))

    first = F.transform(F.array(rows), best)[0]
    return F.when(failed, pattern["intent"]).otherwise(F.transform(F.array(first), lambda b: F.when(b["w"] >= threshold, b["intent"]).otherwise("other"))[0])


def valid_search(query: Column, top_k: Column) -> Column:
    """Whether a search request may run: some text, and from 1 to 50 results."""
    return F.coalesce((X.strip(query) != "") & top_k.between(1, 50), F.lit(False))


def parameter_error(params: Column, required: list[str], kinds: dict[str, str]) -> Column:
    """What is wrong with a JSON object of parameters: the first missing one or wrong type; null if nothing.

    A boolean passes as a number, as it does for the rule's own type test.
    """
    pattern = {"string": r'^"', "number": r"^(-?[0-9]|true|false)", "integer": r"^(-?[0-9]+$|true|false)", "boolean": r"^(true|false)", "array": r"^\[", "object": r"^\{"}
    held = F.json_object_keys(params)
    error = None
    for name in required:
        missing = ~F.array_contains(held, name)
        error = F.when(missing, f"missing {name}") if error is None else error.when(missing, f"missing {name}")
    typed = F.from_json(params, "map<string,variant>")
    for name, kind in kinds.items():
        wrong = F.array_contains(held, name) & ~F.to_json(typed[name]).rlike(pattern[kind])
        error = F.when(wrong, f"type {name}") if error is None else error.when(wrong, f"type {name}")
    return error
