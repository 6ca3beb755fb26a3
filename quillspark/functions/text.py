"""Column expressions over text: tokens, n-grams, hashes, entities, keyword scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Token pattern (ASCII words, single CJK characters).
TOKEN = r"[A-Za-z0-9_]+|[一-鿿]"
CJK = r"^[一-鿿]$"


def strip(text: Column) -> Column:
    """Without ASCII white space at either end."""
    return F.regexp_replace(text, r"^\s+|\s+$", "")


def collapse(text: Column) -> Column:
    """Lower case, inner runs of white space as one space, none at the ends."""
    return strip(F.regexp_replace(F.lower(text), r"\s+", " "))


def content_form(text: Column) -> Column:
    """Lower case without any white space."""
    return F.regexp_replace(F.lower(text), r"\s+", "")


_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def tokens(text: Column) -> Column:
    """Lower-case words and CJK characters, then the bigrams of CJK characters that follow each other.

    Only a word between two CJK characters parts them; signs and spaces do not. Null gives an empty
    list. Texts without a CJK character, whose list is plain, skip the search for bigrams.
    """
    found = F.regexp_extract_all(F.translate(F.coalesce(text, F.lit("")), _UPPER, _LOWER), F.lit("[a-z0-9_]+|[一-鿿]"), F.lit(0))

    def paired(m: Column) -> Column:
        at = F.when(F.size(m) > 1, F.sequence(F.lit(1), F.size(m) - 1)).otherwise(F.array().cast("array<int>"))
        both = F.filter(at, lambda i: m[i].rlike(CJK) & m[i - 1].rlike(CJK))
        return F.concat(m, F.transform(both, lambda i: F.concat(m[i - 1], m[i])))

    return F.when(text.rlike("[一-鿿]"), F.transform(F.array(found), paired)[0]).otherwise(found)


def coarse_tokens(text: Column) -> Column:
    """``tokens`` without the two-character CJK bigrams."""
    return F.when(text.rlike("[一-鿿]"), F.filter(tokens(text), lambda t: ~t.rlike("^[一-鿿]{2}$"))).otherwise(tokens(text))


def sum_of_squares(items: Column) -> Column:
    """The sum of the squared counts of an array's members, by one walk over it in order."""
    start = F.struct(F.lit("").alias("last"), F.lit(0).cast("long").alias("run"), F.lit(0).cast("long").alias("total"))

    def step(a: Column, t: Column) -> Column:
        run = F.when(a["last"] == t, a["run"] + 1).otherwise(F.lit(1).cast("long"))
        return F.struct(t.alias("last"), run.alias("run"), (a["total"] + 2 * run - 1).alias("total"))

    return F.aggregate(F.array_sort(items), start, step, lambda a: a["total"])


def grams(text: Column, low: int, high: int) -> Column:
    """All substrings of ``low`` to ``high`` characters, shorter ones first, with repeats."""

    def all_of(c: Column) -> Column:
        def of(n: int) -> Column:
            last = F.size(c) - n
            made = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda i: F.concat(*[c[i + k] for k in range(n)]))
            return F.when(last < 0, F.array().cast("array<string>")).otherwise(made)

        return F.concat(*[of(n) for n in range(low, high + 1)])

    return F.transform(F.array(F.filter(F.split(text, ""), lambda c: c != "")), all_of)[0]


def distinct_grams(text: Column) -> Column:
    """The distinct 1- to 3-grams of the trimmed lower-case text; an empty text has the empty gram alone."""
    found = F.array_distinct(grams(strip(F.lower(F.coalesce(text, F.lit("")))), 1, 3))
    return F.when(F.size(found) == 0, F.array(F.lit(""))).otherwise(found)


def word_grams(text: Column) -> Column:
    """Words of punctuation-free lower-case text, then its trimmed 2- and 3-character grams, none empty."""
    plain = strip(F.regexp_replace(F.lower(text), r"[!-/:-@\[-`{-~\s]+", " "))
    words = F.split(plain, " ")
    return F.filter(F.concat(words, F.transform(grams(plain, 2, 3), strip)), lambda t: t != "")


def md5_cell(gram: Column) -> Column:
    """The cell of a 256-wide hashed vector: the fourth byte of the MD5."""
    return F.conv(F.substring(F.md5(gram), 7, 2), 16, 10).cast("int")


def md5_sign(gram: Column) -> Column:
    """1 if the fifth byte of the MD5 is even, else -1."""
    return F.when(F.conv(F.substring(F.md5(gram), 9, 2), 16, 10).cast("int") % 2 == 0, 1).otherwise(-1)


def polynomial_hash(text: Column) -> Column:
    """The 31-polynomial string hash modulo 2**32, over code points of the basic plane."""
    codes = F.transform(F.split(text, ""), lambda c: F.ascii(c).cast("long"))
    return F.aggregate(codes, F.lit(0).cast("long"), lambda h, c: F.pmod(h * 31 + c, F.lit(1 << 32)))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine similarity; 0 where either vector is zero."""
    return F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all distinct members; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b)).cast("double")), F.lit(0.0))


# Entity patterns, in both engines' common regular expressions.
ENTITIES = {
    "order_id": (r"(?i)(?:订单号?|order(?:_id)?|#)\s*[:：#]?\s*([A-Za-z0-9_-]{4,32})", 1),
    "date": (r"(今天|明天|昨天|本周|这周|下周|[0-9]{4}[-/.年][0-9]{1,2}[-/.月][0-9]{1,2}日?)", 1),
    "amount": (r"(?i)((?:¥|￥)\s*[0-9]+(?:\.[0-9]{1,2})?|[0-9]+(?:\.[0-9]{1,2})?\s*(?:元|块|rmb|cny|usd|美元))", 1),
}
ERROR_CODE = r"(?<![\p{L}\p{N}_])([45][0-9]{2}|[A-Z][A-Z0-9_-]{2,16})(?![\p{L}\p{N}_])"


def entities(text: Column) -> Column:
    """A map of distinct, stripped entities by kind; error codes are not order ids; products stay empty."""
    found = {k: F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(p), F.lit(g)), strip)) for k, (p, g) in ENTITIES.items()}
    codes = F.array_distinct(F.regexp_extract_all(text, F.lit(ERROR_CODE), F.lit(1)))
    found["error_code"] = F.array_except(codes, found["order_id"])
    found["product"] = F.array().cast("array<string>")
    return F.create_map(*[x for k in ("order_id", "product", "date", "amount", "error_code") for x in (F.lit(k), found[k])])


def simple_entities(text: Column) -> Column:
    """The plainer rules: long numbers, error codes, amounts and dates, repeats kept."""
    pattern = {
        "order_id": r"#?[0-9]{5,}",
        "error_code": r"(?<![\p{L}\p{N}_])[45][0-9]{2}(?![\p{L}\p{N}_])",
        "amount": r"[0-9]+(?:\.[0-9]{1,2})?(?:元|块)",
        "date": r"[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}",
    }
    return F.create_map(*[x for k, p in pattern.items() for x in (F.lit(k), F.regexp_extract_all(text, F.lit(p), F.lit(0)))])


def hits(text: Column, keywords) -> Column:
    """How many of the keywords the text contains."""
    total = F.lit(0)
    for k in keywords:
        total = total + text.contains(k).cast("int")
    return total


def any_of(text: Column, keywords) -> Column:
    return F.coalesce(hits(text, keywords) > 0, F.lit(False))


def json_list(raw: Column) -> Column:
    """Integers of the outermost JSON list in a model's answer, or null."""
    return F.from_json(F.regexp_extract(raw, r"(?s)\[.*\]", 0), "array<int>")


def strict_indices(raw: Column, n_items: Column, top_k: Column) -> Column:
    """A rerank answer's indices: integers only, in range, none twice, cut to ``top_k``; else null."""
    inner = F.regexp_extract(raw, r"(?s)^[^\[]*\[([^\[\]]*)\][^\]]*$", 1)
    parts = F.transform(F.split(inner, ","), strip)
    valid = raw.contains("[") & F.forall(parts, lambda p: p.rlike("^[0-9]{1,9}$"))
    numbers = F.transform(parts, lambda p: p.try_cast("int"))
    good = valid & F.forall(numbers, lambda i: (i >= 0) & (i < n_items)) & (F.size(F.array_distinct(numbers)) == F.size(numbers))
    return F.when(good, F.slice(numbers, F.lit(1), top_k))


def lenient_indices(raw: Column, n_items: Column) -> Column:
    """A rerank answer's indices in range; repeats and short lists are allowed, no list gives none."""
    return F.coalesce(F.filter(json_list(raw), lambda i: (i >= 0) & (i < n_items)), F.array().cast("array<int>"))


def source_id(title: Column, content: Column) -> Column:
    """A stable id from the title, or from the content where the title is blank."""
    blank = F.coalesce(strip(title), F.lit("")) == ""
    return F.concat(F.lit("src-"), F.substring(F.sha1(F.when(blank, F.coalesce(content, F.lit(""))).otherwise(F.concat(F.lit("title:"), collapse(title)))), 1, 20))


def chunk_id(source: Column, section: Column, index: Column) -> Column:
    """A stable id that does not depend on the chunk's content."""
    return F.concat(F.lit("chk-"), F.substring(F.sha1(F.concat_ws("::", source, section, index.cast("string"), F.lit("v1"))), 1, 24))


def legacy_chunk_id(title: Column, index: Column, text: Column) -> Column:
    return F.md5(F.concat_ws("_", title, index.cast("string"), F.substring(text, 1, 50)))


def content_key(text: Column) -> Column:
    return F.sha1(content_form(text))


def total_input_tokens(provider: Column, plain: Column, read: Column, write: Column, miss: Column) -> Column:
    """Input tokens by provider: one adds cache reads and writes; others report the sum, or read plus miss."""
    zero = F.lit(0)
    added = F.coalesce(plain, zero) + F.coalesce(read, zero) + F.coalesce(write, zero)
    return F.when(provider == "anthropic", added).otherwise(F.coalesce(plain, F.coalesce(read, zero) + F.coalesce(miss, zero)))


def cache_status(provider: Column, read: Column, write: Column, miss: Column) -> Column:
    """Whether a call hit the prompt cache, as far as its counters tell."""
    known = F.coalesce(read, write, miss).isNotNull()
    return F.when(~known, "unknown").when(F.coalesce(read, F.lit(0)) > 0, "hit").when((F.coalesce(write, F.lit(0)) > 0) | (F.coalesce(miss, F.lit(0)) > 0), "miss").otherwise("ineligible")
