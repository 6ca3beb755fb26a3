"""Queries that classify, route and budget messages, and evaluate classifiers and dialogues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import terms as K
from ..functions import text as X
from ..operators import classify, evaluation, memory
from ..sources.readers import table
from .registry import query

#: Messages that exercise what the conversations of the tables do not hold.
MESSAGES = (
    "订单号 AB-1234 明天申请退款500元，页面错误 500",
    "报错500 无法登录",
    "转人工客服 紧急",
    "hello",
    "hi",
    "为什么重复扣款？支付失败 ¥12.50",
    "my order #99887 delivery status please, refund 20 usd now",
    "应用崩溃 crash error E_CONN-42",
    "太差 等了很久 2024-05-06",
    "",
    "快递什么时候到？订单状态",
    "horrible! password reset, need supervisor soon",
)


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


MSG = f"""msg AS (SELECT conv_id * 100 + turn AS id, text FROM conversations UNION ALL SELECT * FROM (VALUES {', '.join(f'({-i - 1}, {_quoted(m)})' for i, m in enumerate(MESSAGES))}))"""


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """``id, text`` of the conversations' turns and of the fixed messages."""
    own = spark.createDataFrame([(-i - 1, m) for i, m in enumerate(MESSAGES)], "id long, text string")
    return table(spark, sf, "conversations").select((F.col("conv_id") * 100 + F.col("turn")).alias("id"), "text").unionByName(own)


def _hits(words, text: str = "lower(text)") -> str:
    return "(" + " + ".join(f"contains({text}, {_quoted(w)})::INT" for w in words) + ")"


def _best(name: str, patterns: dict) -> str:
    return f"[{', '.join(_hits(w) for w in patterns.values())}] AS {name}"


def _names(patterns: dict) -> str:
    return f"[{', '.join(_quoted(k) for k in patterns)}]"


PATTERN = f"""{MSG}, pn AS (SELECT *, {_best('sp', K.SPECIFIC_PATTERNS)}, {_best('gp', K.GENERIC_PATTERNS)} FROM msg),
pat AS (SELECT id, text, CASE WHEN list_max(sp) > 0 THEN {_names(K.SPECIFIC_PATTERNS)}[list_position(sp, list_max(sp))] WHEN list_max(gp) > 0 THEN {_names(K.GENERIC_PATTERNS)}[list_position(gp, list_max(gp))] ELSE 'other' END AS intent,
    CASE WHEN list_max(sp) > 0 THEN least(1.0, 0.5 + 0.25 * (list_max(sp) - 1)) WHEN list_max(gp) > 0 THEN least(1.0, 0.5 + 0.25 * (list_max(gp) - 1)) ELSE 0.0 END::DOUBLE AS confidence FROM pn)"""
URGENT = "CASE " + " ".join(f"WHEN {_hits(w)} > 0 THEN '{level}'" for level, w in K.URGENCY.items()) + " WHEN intent IN ('escalation', 'human_handoff') THEN 'high' WHEN intent = 'complaint' THEN 'medium' ELSE 'low' END"


def patterned(spark: SparkSession, sf: str) -> DataFrame:
    rows = messages(spark, sf).withColumn("p", classify.pattern_intent(F.col("text")))
    return rows.select("id", "text", F.col("p.intent").alias("intent"), F.col("p.confidence").alias("confidence"))


@query(f"WITH {PATTERN} SELECT id, intent, confidence FROM pat")
def pattern_intent(spark: SparkSession, sf: str) -> DataFrame:
    return patterned(spark, sf).select("id", "intent", "confidence")


#: Written out apart from the lists that the operator uses.
SHARE = """[(contains(t, '投诉')::INT + contains(t, '经理')::INT + contains(t, '转人工')::INT + contains(t, 'supervisor')::INT) / 4,
    (contains(t, '太差')::INT + contains(t, '糟糕')::INT + contains(t, 'horrible')::INT + contains(t, '等了很久')::INT) / 4,
    (contains(t, '?')::INT + contains(t, '？')::INT + contains(t, '怎么')::INT + contains(t, '什么')::INT + contains(t, 'status')::INT) / 5,
    (contains(t, '帮我')::INT + contains(t, '需要')::INT + contains(t, 'please')::INT + contains(t, 'help')::INT) / 4,
    (contains(t, '你好')::INT + contains(t, '嗨')::INT + contains(t, 'hello')::INT + contains(t, 'hi')::INT) / 4,
    (contains(t, '退款')::INT + contains(t, '扣款')::INT + contains(t, '发票')::INT + contains(t, 'refund')::INT) / 4,
    (contains(t, '崩溃')::INT + contains(t, '报错')::INT + contains(t, 'error')::INT + contains(t, 'crash')::INT + contains(t, '500')::INT + contains(t, '401')::INT) / 6,
    (contains(t, '密码')::INT + contains(t, '邮箱')::INT + contains(t, '账户')::INT + contains(t, 'password')::INT) / 4]"""


@query(f"""WITH {MSG}, h AS (SELECT id, {SHARE} AS s FROM (SELECT id, lower(text) AS t FROM msg))
    SELECT id, CASE WHEN list_max(s) > 0 THEN ['escalation', 'complaint', 'query', 'request', 'greeting', 'billing', 'technical', 'account'][list_position(s, list_max(s))] ELSE 'other' END AS intent, round(list_max(s), 6) AS score FROM h""")
def share_intent(spark: SparkSession, sf: str) -> DataFrame:
    rows = messages(spark, sf).withColumn("s", classify.share_intent(F.col("text")))
    return rows.select("id", F.col("s.intent").alias("intent"), F.round("s.score", 6).alias("score"))


@query(f"WITH {PATTERN} SELECT id, {URGENT} AS urgency FROM pat")
def urgency(spark: SparkSession, sf: str) -> DataFrame:
    return patterned(spark, sf).select("id", classify.urgency(F.col("text"), F.col("intent")).alias("urgency"))


_GROUPED = "CASE intent " + " ".join(f"WHEN '{a}' THEN '{b}'" for a, b in K.INTENT_GROUPS.items()) + " ELSE intent END"


@query(f"WITH {PATTERN} SELECT {_GROUPED} AS intent_group, count(*) AS n, round(avg(confidence), 6) AS confidence FROM pat GROUP BY 1")
def intent_group(spark: SparkSession, sf: str) -> DataFrame:
    return patterned(spark, sf).groupBy(classify.intent_group(F.col("intent")).alias("intent_group")).agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def _uniq(expr: str) -> str:
    trimmed = f"list_transform({expr}, lambda s: regexp_replace(s, '^\\s+|\\s+$', '', 'g'))"
    return f"list_filter({trimmed}, lambda x, i: list_position({trimmed}, x) = i)"


ENTITY = rf"""ent AS (SELECT id, text, {_uniq(r"regexp_extract_all(text, '(?i)(?:订单号?|order(?:_id)?|#)\s*[:：#]?\s*([A-Za-z0-9_-]{4,32})', 1)")} AS order_id,
{_uniq(r"regexp_extract_all(text, '(今天|明天|昨天|本周|这周|下周|[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?)', 1)")} AS date,
{_uniq(r"regexp_extract_all(text, '(?i)((?:¥|￥)\s*[0-9]+(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?\s*(?:元|块|rmb|cny|usd|美元))', 1)")} AS amount FROM msg)"""


@query(f"WITH {MSG}, {ENTITY} SELECT id, array_to_string(order_id, ',') AS order_id, array_to_string(date, ',') AS date, array_to_string(amount, ',') AS amount FROM ent")
def entities(spark: SparkSession, sf: str) -> DataFrame:
    """Order ids, dates and amounts; error codes need look-behind and are tested against plain Python."""
    rows = messages(spark, sf).withColumn("e", X.entities(F.col("text")))
    return rows.select("id", *[F.array_join(F.col("e")[k], ",").alias(k) for k in ("order_id", "date", "amount")])


@query()
def error_codes(spark: SparkSession, sf: str) -> DataFrame:
    rows = messages(spark, sf).withColumns({"e": X.entities(F.col("text")), "s": X.simple_entities(F.col("text"))})
    return rows.select("id", F.array_join(F.col("e")["error_code"], ",").alias("error_code"), F.array_join(F.col("s")["error_code"], ",").alias("plain_code"))


TEMPLATES = tuple((intent, 3 * i + j, text) for i, (intent, texts) in enumerate(K.TEMPLATES.items()) for j, text in enumerate(texts))


_CELLS = "{0} AS (SELECT {1}, ('0x' || substr(md5(g), 7, 2))::INT AS cell, sum(CASE WHEN ('0x' || substr(md5(g), 9, 2))::INT % 2 = 0 THEN 1 ELSE -1 END) AS w FROM (SELECT {1}, unnest(list_distinct(list_concat(c, list_concat(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))))) AS g FROM (SELECT {1}, string_split(regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g'), '') AS c FROM {2})) GROUP BY ALL HAVING w <> 0)"


@query(
    f"""WITH {MSG}, tpl(intent, ord, text) AS (VALUES {', '.join(f"('{k}', {o}, {_quoted(t)})" for k, o, t in TEMPLATES)}), {_CELLS.format('mc', 'id', 'msg')}, {_CELLS.format('tc', 'intent, ord', 'tpl')},
    d AS (SELECT id, intent, ord, round(sum(mc.w * tc.w) / (any_value(mn) * any_value(tn)), 6) AS score FROM mc JOIN tc USING (cell) JOIN (SELECT id, sqrt(sum(w * w)) AS mn FROM mc GROUP BY ALL) USING (id) JOIN (SELECT intent, ord, sqrt(sum(w * w)) AS tn FROM tc GROUP BY ALL) USING (intent, ord) GROUP BY ALL),
    b AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, ord) AS r FROM d WHERE score > 0)
    SELECT id, coalesce(intent, 'other') AS intent, coalesce(score, 0) AS confidence FROM msg LEFT JOIN (SELECT id, intent, score FROM b WHERE r = 1) USING (id)"""
)
def template_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """Nearest template by hashed n-gram cosine."""
    rows = spark.createDataFrame(TEMPLATES, "intent string, ord int, text string")
    return classify.template_nearest(messages(spark, sf), rows)


_ALL_GRAMS = "list_distinct(list_concat(list_concat(list_transform(range(1, len(s) + 1), lambda i: substr(s, i, 1)), list_transform(range(1, len(s)), lambda i: substr(s, i, 2))), list_transform(range(1, len(s) - 1), lambda i: substr(s, i, 3))))"


@query(
    f"""WITH {MSG}, g AS (SELECT id, {_ALL_GRAMS} AS g FROM (SELECT id, regexp_replace(lower(text), '^\\s+|\\s+$', '', 'g') AS s FROM msg)),
    tpl(template, ord, text) AS (VALUES {', '.join(f"('{k}', {o}, {_quoted(t)})" for k, o, t in TEMPLATES)}),
    t AS (SELECT template, ord, {_ALL_GRAMS} AS tg FROM (SELECT template, ord, lower(text) AS s FROM tpl)),
    j AS (SELECT id, template, ord, coalesce(len(list_intersect(g, tg)) / nullif(len(list_distinct(list_concat(g, tg))), 0), 0) AS score FROM g, t)
    SELECT id, template, round(max(score), 6) AS score FROM j GROUP BY id, template"""
)
def jaccard_intent(spark: SparkSession, sf: str) -> DataFrame:
    """Jaccard similarity of 1- to 3-grams with the best template of each intent of a fixed small table."""
    own = lambda c: F.array_distinct(X.grams(X.strip(F.lower(c)), 1, 3))
    t = spark.createDataFrame([(k, x) for k, _, x in TEMPLATES], "template string, t string").select("template", own(F.col("t")).alias("tg"))
    rows = messages(spark, sf).select("id", own(F.col("text")).alias("g")).join(F.broadcast(t))
    return rows.groupBy("id", "template").agg(F.round(F.max(X.jaccard(F.col("g"), F.col("tg"))), 6).alias("score"))


_W = "list_sum([CASE WHEN {0} = mi THEN mc * 0.7 ELSE 0 END, CASE WHEN {0} = ei THEN ec * 0.2 ELSE 0 END, CASE WHEN {0} = intent THEN confidence * 0.1 ELSE 0 END])"


@query(
    f"""WITH {PATTERN}, v AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'query' ELSE 'billing' END AS mi, (abs(id) % 10) / 10.0 AS mc, CASE WHEN id % 3 = 0 THEN 'query' ELSE 'refund' END AS ei, 0.6 AS ec, id % 7 = 0 AS failed FROM pat),
    w AS (SELECT *, round({_W.format('mi')}, 9) AS a, round({_W.format('ei')}, 9) AS b, round({_W.format('intent')}, 9) AS c FROM v),
    x AS (SELECT *, greatest(a, b, c) AS best, CASE WHEN a = greatest(a, b, c) THEN mi WHEN b = greatest(a, b, c) THEN ei ELSE intent END AS bi FROM w),
    y AS (SELECT *, bi IN {K.GENERIC_INTENTS} AND intent IN {tuple(K.SPECIFIC_PATTERNS)} AND confidence >= 0.5 AND best < 0.8 AS refined FROM x)
    SELECT id, CASE WHEN failed THEN ei WHEN refined THEN intent WHEN best < 0.5 THEN 'other' ELSE bi END AS intent, round(CASE WHEN failed THEN 0.6 WHEN refined THEN greatest(best, confidence) ELSE best END, 6)::DOUBLE AS confidence FROM y"""
)
def intent_vote(spark: SparkSession, sf: str) -> DataFrame:
    """Model and embedding answers are made up from the id; the pattern's is real."""
    i = F.col("id")
    pair = lambda a, c: F.struct(a.alias("intent"), F.lit(c).cast("double").alias("confidence") if isinstance(c, float) else c.cast("double").alias("confidence"))
    model = pair(F.when(i % 2 == 0, "query").otherwise("billing"), (F.abs(i) % 10) / 10.0)
    near = pair(F.when(i % 3 == 0, "query").otherwise("refund"), 0.6)
    rows = patterned(spark, sf).withColumn("v", classify.vote(model, near, F.struct("intent", "confidence"), i % 7 == 0))
    return rows.select("id", F.col("v.intent").alias("intent"), F.col("v.confidence").alias("confidence"))


_COLLAPSED = r"regexp_replace(regexp_replace(lower(text), '\s+', ' ', 'g'), '^\s+|\s+$', '', 'g')"
_WORDS = f"[{', '.join(_quoted(w) for w in K.BUSINESS_WORDS)}]"
GATE = f"""gate AS (SELECT id, intent IN {K.ALWAYS_SEARCH} OR (intent NOT IN {K.NEVER_SEARCH} AND len(c) >= 4 AND len(ws) > 0) AS search,
    CASE WHEN intent IN {K.ALWAYS_SEARCH + K.NEVER_SEARCH} THEN 'intent:' || intent WHEN len(c) < 4 THEN 'fallback:text_too_short' WHEN len(ws) > 0 THEN 'fallback:keyword:' || ws[1] ELSE 'fallback:no_business_signal' END AS reason
    FROM (SELECT *, list_filter({_WORDS}, lambda w: contains(c, w)) AS ws FROM (SELECT *, {_COLLAPSED} AS c FROM pat)))"""


@query(f"WITH {PATTERN}, {GATE} SELECT * FROM gate")
def knowledge_gate(spark: SparkSession, sf: str) -> DataFrame:
    rows = patterned(spark, sf).withColumn("g", classify.knowledge_gate(F.col("text"), F.col("intent")))
    return rows.select("id", F.col("g.search").alias("search"), F.col("g.reason").alias("reason"))


@query(f"WITH {PATTERN}, {GATE} SELECT CASE WHEN NOT search THEN 'skipped' WHEN id % 5 = 0 THEN 'degraded' WHEN id % 4 = 0 THEN 'empty' WHEN id % 3 = 0 THEN 'error' ELSE 'used' END AS status, count(*) AS n FROM gate GROUP BY 1")
def knowledge_status(spark: SparkSession, sf: str) -> DataFrame:
    """Counts of outcomes; which searches failed or were empty is made up from the id."""
    rows = patterned(spark, sf).withColumn("g", classify.knowledge_gate(F.col("text"), F.col("intent")))
    i = F.col("id")
    status = F.when(~F.col("g.search"), "skipped").when(i % 5 == 0, "degraded").when(i % 4 == 0, "empty").when(i % 3 == 0, "error").otherwise("used")
    return rows.groupBy(status.alias("status")).agg(F.count("*").alias("n"))


@query(f"WITH {PATTERN} SELECT id, intent = 'other' AND len(regexp_replace(text, '^\\s+|\\s+$', '', 'g')) > 2 AND confidence < 0.5 AS clarify FROM pat")
def clarify(spark: SparkSession, sf: str) -> DataFrame:
    return patterned(spark, sf).select("id", classify.needs_clarification(F.col("text"), F.col("intent"), F.col("confidence")).alias("clarify"))


@query(f"WITH {PATTERN} SELECT id, {_hits(K.ESCALATION_WORDS, 'text')} > 0 OR ({URGENT}) = 'critical' OR intent IN ('escalation', 'human_handoff') AS escalated FROM pat")
def escalation(spark: SparkSession, sf: str) -> DataFrame:
    rows = patterned(spark, sf)
    return rows.select("id", classify.escalated(F.col("text"), classify.urgency(F.col("text"), F.col("intent")), F.col("intent")).alias("escalated"))


_SCORES = f"""sc AS (SELECT pat.*, {URGENT.replace('text', 'pat.text')} AS urg,
    round(0.1 + 0.55 * (intent IN {classify.GENERAL_INTENTS})::INT + least(0.35, 0.12 * {_hits(K.GENERAL_WORDS, 'lower(pat.text)')}) + 0.1 * (len(order_id) > 0)::INT, 3)::DOUBLE AS g,
    round(0.75 * (intent IN {classify.TECHNICAL_INTENTS})::INT + least(0.45, 0.18 * {_hits(K.TECHNICAL_WORDS, 'lower(pat.text)')}), 3)::DOUBLE AS t,
    round(0.75 * (intent IN {classify.BILLING_INTENTS})::INT + least(0.45, 0.18 * {_hits(K.BILLING_WORDS, 'lower(pat.text)')}) + 0.15 * (len(amount) > 0)::INT, 3)::DOUBLE AS b FROM pat JOIN ent USING (id))"""


@query(
    f"""WITH {PATTERN}, {ENTITY}, {_SCORES}, p AS (SELECT *, CASE WHEN g >= t AND g >= b THEN 'general' WHEN t >= b THEN 'technical' ELSE 'billing' END AS top FROM sc)
    SELECT id, CASE WHEN urg = 'critical' OR intent IN ('escalation', 'human_handoff') THEN 'general' ELSE top END AS primary_agent,
    CASE WHEN urg = 'critical' OR intent IN ('escalation', 'human_handoff') THEN '' ELSE array_to_string(list_filter([CASE WHEN top <> 'technical' AND t >= 0.45 THEN 'technical' END, CASE WHEN top <> 'billing' AND b >= 0.45 THEN 'billing' END], lambda x: x IS NOT NULL), ',') END AS supporting,
    CASE WHEN urg = 'critical' THEN 1.0 WHEN intent IN ('escalation', 'human_handoff') THEN greatest(confidence, 0.8) ELSE least(1.0, greatest(g, t, b)) END::DOUBLE AS confidence FROM p"""
)
def routing_decision(spark: SparkSession, sf: str) -> DataFrame:
    """Routed by intent, keywords, amounts and order ids; error codes are left out, as in the SQL."""
    rows = patterned(spark, sf)
    found = F.map_concat(F.map_filter(X.entities(F.col("text")), lambda k, _: k != "error_code"), F.create_map(F.lit("error_code"), F.array().cast("array<string>")))
    decided = rows.withColumn("r", classify.route(F.col("text"), F.col("intent"), found, classify.urgency(F.col("text"), F.col("intent")), F.col("confidence")))
    return decided.select("id", F.col("r.primary").alias("primary_agent"), F.array_join("r.supporting", ",").alias("supporting"), F.col("r.confidence").alias("confidence"))


SKILLS = ((1, "refunds", "x" * 4000, ["退款", "Refund"], ["billing"], True), (2, "crashes", "y" * 100, ["crash", "崩溃"], [], True), (3, "always", "z" * 2500, [], [], True), (4, "off", "w", [], [], False))


@query(
    f"""WITH {MSG}, sk AS (SELECT * FROM (VALUES (1, 'refunds', repeat('x', 4000), ['退款', 'refund']), (2, 'crashes', repeat('y', 100), ['crash', '崩溃']), (3, 'always', repeat('z', 2500), []::VARCHAR[])) AS t(ord, name, content, keywords)),
    m AS (SELECT id, ord, name, '## ' || name || chr(10) || substr(content, 1, 3200) AS body FROM msg, sk WHERE len(keywords) = 0 OR len(list_filter(keywords, lambda k: contains(lower(text), k))) > 0),
    b AS (SELECT *, 5000 - coalesce(sum(len(body)) OVER (PARTITION BY id ORDER BY ord ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS l FROM m)
    SELECT id, ord, name AS skill, CASE WHEN len(body) <= l THEN len(body) ELSE l + 4 END::INT AS n_chars FROM b WHERE l > 0"""
)
def skill_match_budget(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame(SKILLS, "ord int, name string, content string, keywords array<string>, agents array<string>, enabled boolean")
    return classify.skills_for(messages(spark, sf).withColumnRenamed("text", "message"), rows, "billing").select("id", "ord", "skill", F.length("text").alias("n_chars"))


# --- evaluation of classifiers and dialogues -----------------------------------------------------

_CASES = "cases AS (SELECT quality::VARCHAR AS truth, CASE WHEN n_chars > 1000 THEN '1' WHEN n_chars > 200 THEN '0' ELSE 'short' END AS pred FROM labels JOIN documents USING (doc_id))"
_PRF = f"""{_CASES}, sd AS (SELECT truth AS label, 1 AS t, 0 AS p, (truth = pred)::INT AS tp FROM cases UNION ALL SELECT pred, 0, 1, 0 FROM cases),
prf AS (SELECT label, sum(t)::BIGINT AS support, sum(p)::BIGINT AS predicted, round(coalesce(sum(tp) / nullif(sum(p), 0), 0), 4) AS precision, round(coalesce(sum(tp) / nullif(sum(t), 0), 0), 4) AS recall, round(coalesce(2 * sum(tp) / nullif(sum(p) + sum(t), 0), 0), 4) AS f1 FROM sd GROUP BY label)"""


def _cases(spark: SparkSession, sf: str) -> DataFrame:
    both = table(spark, sf, "labels").join(table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")
    return both.select(F.col("quality").cast("string").alias("truth"), F.when(F.col("n_chars") > 1000, "1").when(F.col("n_chars") > 200, "0").otherwise("short").alias("pred"))


@query(f"WITH {_PRF} SELECT * FROM prf")
def intent_prf(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.per_class(_cases(spark, sf)).drop("tp")


@query(f"WITH {_PRF} SELECT (SELECT count(*) FROM cases) AS n, (SELECT round(avg((truth = pred)::INT), 4) FROM cases) AS accuracy, (SELECT round(avg(f1), 4) FROM prf) AS macro_f1")
def macro_f1(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.classifier_report(_cases(spark, sf))


_TURNS = "tr AS (SELECT conv_id AS case_id, turn, role <> 'system' AS expected_ok, least(1.0, len(text) / 200.0)::DOUBLE AS helpfulness, ((turn % 3) / 2.0)::DOUBLE AS relevance, CASE WHEN turn % 2 = 0 THEN 0.9 END::DOUBLE AS accuracy FROM conversations)"


def _turns(spark: SparkSession, sf: str) -> DataFrame:
    t = F.col("turn")
    scores = F.create_map(F.lit("helpfulness"), F.least(F.lit(1.0), F.length("text") / 200.0), F.lit("relevance"), (t % 3) / 2.0)
    full = F.when(t % 2 == 0, F.map_concat(scores, F.create_map(F.lit("accuracy"), F.lit(0.9)))).otherwise(scores)
    return table(spark, sf, "conversations").select(F.col("conv_id").alias("case_id"), "turn", (F.col("role") != "system").alias("expected_ok"), full.alias("scores"))


@query(f"WITH {_TURNS}, c AS (SELECT case_id, round(avg((helpfulness + relevance + coalesce(accuracy, 0)) / (2 + (accuracy IS NOT NULL)::INT)), 6) AS overall, arg_max(expected_ok, turn) AS last_ok FROM tr GROUP BY 1) SELECT *, overall >= 0.75 AND last_ok AS passed FROM c")
def eval_pass_rate(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.pass_report(_turns(spark, sf))


_MEANS = "SELECT 'helpfulness' AS metric, round(avg(helpfulness), 4) AS value FROM {0} UNION ALL SELECT 'relevance', round(avg(relevance), 4) FROM {0} UNION ALL SELECT 'accuracy', round(avg(accuracy), 4) FROM {0}"


@query(f"WITH {_TURNS} {_MEANS.format('tr')}")
def eval_mean_scores(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.mean_scores(_turns(spark, sf))


@query(
    f"""WITH {_TURNS}, a AS (SELECT * FROM tr WHERE case_id % 2 = 0), b AS (SELECT * FROM tr WHERE case_id % 2 = 1), x AS ({_MEANS.format('a')}), y AS ({_MEANS.format('b')})
    SELECT x.metric, x.value AS current, y.value AS previous, round((x.value - y.value) / y.value, 6) AS change FROM x JOIN y USING (metric) WHERE y.value > 0 AND round((x.value - y.value) / y.value, 6) < -0.001"""
)
def regressions(spark: SparkSession, sf: str) -> DataFrame:
    """Even cases as the current run, odd ones as the baseline; a tenth of a per cent counts."""
    turns = _turns(spark, sf)
    now, before = (evaluation.mean_scores(turns.filter(F.col("case_id") % 2 == i)) for i in (0, 1))
    return evaluation.regressions(now, before, drop=0.001)


@query(f"WITH {_TURNS}, m AS ({_MEANS.format('tr')}), r(metric, threshold) AS (VALUES ('relevance', 0.8::DOUBLE), ('accuracy', 0.8::DOUBLE), ('completeness', 0.8::DOUBLE), ('helpfulness', 0.99::DOUBLE)) SELECT metric, coalesce(value, 1.0) AS value, threshold FROM r LEFT JOIN m USING (metric) WHERE coalesce(value, 1.0) < threshold")
def recommendations(spark: SparkSession, sf: str) -> DataFrame:
    return evaluation.recommendations(evaluation.mean_scores(_turns(spark, sf)), {"relevance": 0.8, "accuracy": 0.8, "completeness": 0.8, "helpfulness": 0.99})


# --- memory over conversations -------------------------------------------------------------------


@query("SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn)::INT AS pos FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d FROM conversations) WHERE d <= 5")
def working_memory(spark: SparkSession, sf: str) -> DataFrame:
    return memory.recent(table(spark, sf, "conversations").select("conv_id", "turn", "role"), ["conv_id"], ["turn"], 5)


@query()
def running_summary(spark: SparkSession, sf: str) -> DataFrame:
    """Summaries of conversations, cut to their last 1500 characters as they grow."""
    return memory.running_summary(table(spark, sf, "conversations"), ["conv_id"], ["turn"], "text")


@query(
    """WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS d FROM conversations),
    a AS (SELECT conv_id, max(CASE WHEN turn = 0 THEN left(text, 50) END) AS s, string_agg(role || ': ' || text, chr(10) ORDER BY turn) FILTER (d <= 3) AS h, count(*) AS n FROM m GROUP BY conv_id)
    SELECT conv_id, n::INT AS n, md5(CASE WHEN coalesce(s, '') <> '' THEN '[summary]' || chr(10) || s || chr(10) || chr(10) ELSE '' END || '[history]' || chr(10) || h || chr(10) || chr(10) || '[profile]' || chr(10) || 'turns=' || n) AS digest FROM a"""
)
def history_tail(spark: SparkSession, sf: str) -> DataFrame:
    """Prompt parts of each conversation: the front of its first turn, its last three messages, a profile."""
    turns = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    last = memory.recent(turns, ["conv_id"], ["turn"], 3).groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("turn", F.concat(F.col("role"), F.lit(": "), F.col("text")).alias("line")))).alias("lines"))
    whole = turns.groupBy("conv_id").agg(F.max(F.when(F.col("turn") == 0, F.substring("text", 1, 50))).alias("summary"), F.count("*").cast("int").alias("n"))
    text = memory.prompt_text(F.col("summary"), F.transform("lines", lambda s: s["line"]), F.concat(F.lit("turns="), F.col("n").cast("string")))
    return whole.join(last, "conv_id").select("conv_id", "n", F.md5(text).alias("digest"))


@query()
def context_budget(spark: SparkSession, sf: str) -> DataFrame:
    """Contexts of at most 2000 characters from each conversation."""
    turns = F.sort_array(F.collect_list(F.struct("turn", F.concat_ws(": ", "role", "text").alias("line"))))
    rows = table(spark, sf, "conversations").groupBy(F.col("conv_id").alias("id")).agg(F.transform(turns, lambda t: t["line"]).alias("recent"), F.max("text").alias("summary"))
    ready = rows.select("id", "recent", F.slice("recent", 1, 3).alias("history"), F.create_map(F.lit("lang"), F.lit("en"), F.lit("n"), F.size("recent").cast("string")).alias("profile"), "summary", F.repeat(F.lit("k"), 900).alias("knowledge"))
    return memory.context_budget(ready, 2000).withColumn("digest", F.md5("context")).drop("context")


# --- the plainer variants ------------------------------------------------------------------------


@query(f"WITH {MSG} SELECT id, trim(lower(text)) NOT IN {K.GREETINGS} AND (len(text) >= 4 OR {_hits(K.GATE_WORDS)} > 0) AS search FROM msg")
def plain_gate(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("id", classify.plain_gate(F.col("text")).alias("search"))


@query(f"WITH {PATTERN} SELECT id, CASE WHEN ({URGENT}) = 'critical' OR intent IN ('escalation', 'human_handoff') THEN 'escalation' WHEN intent IN {classify.TECHNICAL_INTENTS} THEN 'technical' WHEN intent IN {classify.BILLING_INTENTS} THEN 'billing' ELSE 'general' END AS agent FROM pat")
def table_route(spark: SparkSession, sf: str) -> DataFrame:
    return patterned(spark, sf).select("id", classify.table_route(F.col("intent"), classify.urgency(F.col("text"), F.col("intent"))).alias("agent"))


@query(f"WITH {PATTERN} SELECT id, concat_ws(',', CASE WHEN intent IN {classify.TECHNICAL_INTENTS} OR {_hits(K.TECHNICAL_CALLS)} > 0 THEN 'technical' END, CASE WHEN intent IN {classify.BILLING_INTENTS} OR {_hits(K.BILLING_CALLS)} > 0 THEN 'billing' END) AS agents FROM pat")
def collaboration_targets(spark: SparkSession, sf: str) -> DataFrame:
    return patterned(spark, sf).select("id", F.array_join(classify.collaborators(F.col("text"), F.col("intent")), ",").alias("agents"))


@query(
    f"""WITH {PATTERN}, v AS (SELECT *, CASE WHEN id % 2 = 0 THEN 'query' ELSE 'billing' END AS mi, (abs(id) % 10) / 10.0 AS mc, CASE WHEN id % 3 = 0 THEN 'query' ELSE 'refund' END AS ei, 0.6 AS ec, id % 7 = 0 AS failed FROM pat),
    w AS (SELECT *, round({_W.format('mi')}, 9) AS a, round({_W.format('ei')}, 9) AS b, round({_W.format('intent')}, 9) AS c FROM v)
    SELECT id, CASE WHEN failed THEN intent WHEN greatest(a, b, c) < 0.35 THEN 'other' WHEN a = greatest(a, b, c) THEN mi WHEN b = greatest(a, b, c) THEN ei ELSE intent END AS intent FROM w"""
)
def plain_vote(spark: SparkSession, sf: str) -> DataFrame:
    i = F.col("id")
    model = F.struct(F.when(i % 2 == 0, "query").otherwise("billing").alias("intent"), ((F.abs(i) % 10) / 10.0).alias("confidence"))
    near = F.struct(F.when(i % 3 == 0, "query").otherwise("refund").alias("intent"), F.lit(0.6).alias("confidence"))
    return patterned(spark, sf).select("id", classify.plain_vote(model, near, F.struct("intent", "confidence"), i % 7 == 0).alias("intent"))


@query(f"WITH {MSG} SELECT id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') <> '' AND abs(id) % 60 BETWEEN 1 AND 50 AS valid FROM msg")
def valid_search(spark: SparkSession, sf: str) -> DataFrame:
    return messages(spark, sf).select("id", classify.valid_search(F.col("text"), F.abs("id") % 60).alias("valid"))


@query(
    """WITH a AS (SELECT conv_id AS request_id, turn AS ord, role AS agent, text, role = 'system' AS e FROM conversations)
    SELECT request_id, md5(string_agg('[' || agent || ' - ' || CASE WHEN ord = 0 THEN '主处理' ELSE '辅助处理' END || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY ord)) AS digest, bool_or(e) AS escalated FROM a GROUP BY request_id"""
)
def merged_answers(spark: SparkSession, sf: str) -> DataFrame:
    from ..operators import pipeline

    rows = table(spark, sf, "conversations").select(F.col("conv_id").alias("request_id"), F.col("turn").alias("ord"), F.col("role").alias("agent"), F.col("text").alias("content"), (F.col("role") == "system").alias("escalate"))
    return pipeline.merged_answers(rows).select("request_id", F.md5("content").alias("digest"), "escalated")


PARAMS = ('{"query": "a", "top_k": 3}', '{"top_k": 3}', '{"query": 1}', '{"query": "a", "top_k": "x"}', '{"query": "a", "top_k": true}', '{"query": "a", "other": []}')
_WRONG = (None, "missing query", "type query", "type top_k", None, None)


@query("SELECT * FROM (VALUES " + ", ".join(f"({i}, {_quoted(w) if w else 'NULL'})" for i, w in enumerate(_WRONG)) + ") AS t(i, error)")
def parameter_errors(spark: SparkSession, sf: str) -> DataFrame:
    rows = spark.createDataFrame([*enumerate(PARAMS)], "i int, params string")
    return rows.select("i", classify.parameter_error(F.col("params"), ["query"], {"query": "string", "top_k": "integer"}).alias("error"))
