"""Secret scans by patterns and by linking the parts of a credential. DataFrame functions alone.

Strong finds (assignments, access keys, long hexadecimal runs) are reported wherever they stand. Weak ones are parts of a
credential that prove nothing alone: a name that may be an account's, a token with mixed characters, an endpoint. They
are reported where the other parts stand within the same scope: at most SCOPE code points between the end of the one and
the start of the other. An interval join finds them: a part is dealt to all cells, as wide as a scope, that it touches, and
looked for in those that it touches when it is widened by a scope at both ends.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

#: Code points between parts that belong together, from the end of one to the start of the next.
SCOPE = 200

# The patterns of strong finds. The runs of 24 or 20 characters are the longest at their place, so asking for
# the length in the pattern finds what a filter behind it would.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
# Weak parts: an account's name, a token that mixes letters and digits, an endpoint.
ACCOUNT = r"""\b(?i:user(?:name)?|login|account|client_?id|access_?(?:key_?)?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.@=-]{3,}"""
TOKEN = r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z+/_=-]*[0-9])(?=[0-9+/_=-]*[A-Za-z])[A-Za-z0-9+/_=-]{16,}+"
ENDPOINT = r"""\b(?i:https?|ftps?|s3|jdbc:[a-z0-9]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[^\x00-\x20"'<>]{3,}"""
#: kind: its place among kinds that start together, its pattern, its role in a credential, whether it is strong.
KINDS = {
    "assign": (0, ASSIGN, "secret", True),
    "access": (1, ACCESS, "id", True),
    "hex": (2, HEX, "secret", True),
    "weak_id": (3, ACCOUNT, "id", False),
    "weak_secret": (4, TOKEN, "secret", False),
    "endpoint": (5, ENDPOINT, "endpoint", False),
}
SPAN = "array<struct<start:int,order:int,kind:string,end:int>>"


def spans(text: Column, kind: str) -> Column:
    """All leftmost non-overlapping finds of a kind, as code-point spans. What lies between finds and the finds themselves
    give the positions; only texts with a find are split."""
    order, pattern, _, _ = KINDS[kind]
    size = F.lit(0)
    if kind == "assign":
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"), F.regexp_extract_all(text, F.lit(pattern), F.lit(2)).alias("value"))
        good = lambda x: F.length(x["value"]) >= 6
    else:
        parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))
        good = lambda x: F.lit(True)
    none = F.array().cast(SPAN)

    def add(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        end = start + F.coalesce(F.length(x["hit"]), size)
        span = F.struct(start.alias("start"), F.lit(order).alias("order"), F.lit(kind).alias("kind"), end.alias("end"))
        found = F.when(x["hit"].isNotNull() & good(x), F.concat(acc["found"], F.array(span).cast(SPAN))).otherwise(acc["found"])
        return F.struct(end.alias("at"), found.alias("found"))

    first = F.struct(F.lit(0).alias("at"), none.alias("found"))
    return F.when(text.rlike(pattern), F.aggregate(parts, first, add, lambda acc: acc["found"])).otherwise(none)


def printed(found: Column) -> Column:
    """kind:start:end in order, joined by commas."""
    return F.array_join(F.transform(F.array_sort(found), lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _parts(rows: DataFrame, found: Column) -> DataFrame:
    role = F.create_map(*[F.lit(x) for k, (_, _, role, _) in KINDS.items() for x in (k, role)])
    out = rows.select("key", F.explode(found).alias("span")).distinct()
    return out.select("key", "span", F.col("span.start").alias("start"), F.col("span.end").alias("end"), role[F.col("span.kind")].alias("role"))


def _cells(low: Column, high: Column) -> Column:
    """The cells that an interval touches."""
    cell = lambda at: F.floor(at / F.lit(SCOPE))
    return F.explode(F.sequence(cell(low), cell(high)))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_assign, n_access, n_hex, base (spans of strong finds as text), base_sha256, spans.

    Null text: an empty one, without a find. Rows that share a doc_id are scanned each (links stay within a text). Null
    doc_ids come back null. Other columns are ignored.
    """
    text = F.coalesce("text", F.lit(""))
    key = F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("none")), F.xxhash64(text), F.length(text))
    rows = docs.select("doc_id", key.alias("key"), *(spans(text, k).alias(k) for k in KINDS))
    rows = common.materialize(rows, "finds")
    every = _parts(rows, F.concat(*KINDS))
    weak = _parts(rows, F.concat(*(k for k, x in KINDS.items() if not x[3])))

    def beside(parts: DataFrame, role: str) -> DataFrame:
        """Those parts that have one of another role within a scope."""
        start, end = F.col("start"), F.col("end")
        mine = parts.select("*", _cells(start, end).alias("cell"))
        near = every.filter(F.col("role") == role).select(F.col("key").alias("k"), start.alias("from"), end.alias("to"), _cells(start - SCOPE, end + SCOPE).alias("c"))
        meet = (F.col("key") == F.col("k")) & (F.col("cell") == F.col("c")) & (start - F.col("to") <= SCOPE) & (F.col("from") - end <= SCOPE)
        return mine.join(near, meet, "left_semi").select(parts.columns).distinct()

    def only(role: str) -> DataFrame:
        return weak.filter(F.col("role") == role)

    # a weak token that a strong find covers is no find of its own
    linked = beside(only("id"), "secret").unionAll(beside(only("secret"), "id")).unionAll(beside(beside(only("endpoint"), "id"), "secret"))
    linked = linked.groupBy("key").agg(F.collect_set("span").alias("linked"))
    out = rows.join(linked, "key", "left")
    strong = F.concat(*(k for k, x in KINDS.items() if x[3]))
    inside = lambda s: F.exists(strong, lambda b: (b["start"] <= s["start"]) & (s["end"] <= b["end"]))
    added = F.filter(F.coalesce("linked", F.array().cast(SPAN)), lambda s: ~inside(s))
    base = printed(strong)
    return out.select("doc_id", F.size("assign").cast("long").alias("n_assign"), F.size("access").cast("long").alias("n_access"), F.size("hex").cast("long").alias("n_hex"), base.alias("base"), F.sha2(base.cast("binary"), 256).alias("base_sha256"), printed(F.concat(strong, added)).alias("spans"))
