"""Secret scans: base patterns, and credentials whose parts stand apart.

DataFrame operations only.  Places of matches come from the pieces between them:
``split`` and ``regexp_extract_all`` cut a text by the same leftmost matches, so the
lengths of pieces and matches add up to code-point offsets.  Weak candidates
(identifiers, random-looking strings, endpoints) are reported only where a
complementary part is near: an interval join of the parts of a document within
scopes of ``SCOPE`` code points links identifiers and endpoints with secrets: weak
parts are in all scopes that they and ``SCOPE`` around them touch, others in all that
they touch, so parts of any length meet wherever their gap is within ``SCOPE``.  Only parts are shuffled, never text.

Defined cases: null and empty texts have no spans; rows that repeat a doc_id are
scanned each by itself; a null doc_id stays null; an empty table gives no rows; further columns, clashing
names included, are ignored.  Spans are sorted by start, then kind as in ``KINDS``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize, plain

#: Kinds in the order of ties; the first three are the base patterns.
KINDS = ("assign", "access", "hex", "identifier", "secret", "endpoint")
SCOPE = 200

# The base patterns as Java regular expressions.  Runs that are too
# short can't hold a longer one, so two of them state their least length at once.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Weak candidates.
IDENTIFIER = r"""(?i:(?:user(?:name|_?id)?|login|account|client_?id|access_?key_?id))["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}"""
SECRET = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{16,}+"
ENDPOINT = r"""[a-z][a-z0-9+.-]{1,15}://[^\x20\x09-\x0D"'<>]+"""


def _quoted(pattern: str) -> str:
    return "r'" + pattern.replace("'", r"\x27") + "'"


def spans(kind: str, pattern: str, guard: str = "true", group: int = 0, least: int = 0) -> str:
    """SQL array of (start, kind number, end) of the matches in ``text``; ``group`` must have ``least`` characters."""
    rx, k = _quoted(pattern), KINDS.index(kind)
    step = f"named_struct('at', acc.at + char_length(x.p) + char_length(x.m), 'got', IF(char_length(x.g) >= {least}, concat(acc.got, array(struct(acc.at + char_length(x.p) AS start, {k} AS kind, acc.at + char_length(x.p) + char_length(x.m) AS end))), acc.got))"
    zero = "named_struct('at', 0, 'got', cast(array() AS array<struct<start:int,kind:int,end:int>>))"
    matches = f"regexp_extract_all(text, {rx}, 0)"
    groups = f"regexp_extract_all(text, {rx}, {group})" if group else matches
    # The last piece has no match: arrays_zip pads with null, the filter drops it.
    zipped = f"filter(arrays_zip(split(text, {rx}, -1) AS p, {matches} AS m, {groups} AS g), x -> x.m IS NOT NULL)".replace(" AS p,", ",").replace(" AS m,", ",").replace(" AS g)", ")")
    zipped = f"transform({zipped.replace('x.m IS', 'x[`1`] IS')}, x -> struct(x.`0` AS p, x.`1` AS m, x.`2` AS g))".replace("x[`1`]", "x.`1`")
    found = f"aggregate({zipped}, {zero}, (acc, x) -> {step}, acc -> acc.got)"
    return f"CASE WHEN {guard} THEN {found} ELSE {zero}.got END"


def _list(array: str) -> str:
    names = ", ".join(f"'{k}'" for k in KINDS)
    return f"array_join(transform({array}, x -> concat_ws(':', element_at(array({names}), x.kind + 1), x.start, x.end)), ',')"


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_assign, n_access, n_hex, n_linked, base_sha256, spans."""
    texts = plain(docs, "doc_id", "text").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    assign = spans("assign", ASSIGN, r"rlike(text, r'(?i:passw|secret|token|api_?key)')", 2, 8)
    found = texts.select(
        F.monotonically_increasing_id().alias("row"), "doc_id",
        F.expr(assign).alias("assign"), F.expr(spans("access", ACCESS, "contains(text, 'AKIA')")).alias("access"),
        F.expr(spans("hex", HEX, f"rlike(text, {_quoted(HEX)})")).alias("hex"),
        F.expr(spans("identifier", IDENTIFIER, r"rlike(text, r'(?i:user|login|account|client_?id|access_?key)')")).alias("identifier"),
        F.expr(spans("secret", SECRET, f"rlike(text, {_quoted(SECRET)})")).alias("secret"),
        F.expr(spans("endpoint", ENDPOINT, "contains(text, '://')")).alias("endpoint"),
    )
    base = F.array_sort(F.concat("assign", "access", "hex"))
    found = materialize(found.select("row", "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in KINDS[:3]], base.alias("base"), F.concat("identifier", "secret", "endpoint").alias("weak")))

    parts = found.where("size(weak) > 0").select("row", F.explode(F.concat("base", "weak")).alias("s")).select("row", "s.*")
    # Identifiers and endpoints complement secrets.
    parts = parts.withColumn("secret", F.col("kind").isin(0, 2, 4))
    touched = lambda lo, hi: F.explode(F.expr(f"sequence(cast(floor(({lo}) / {scope}) AS int), cast(floor(({hi}) / {scope}) AS int))")).alias("scope")
    weak = parts.where("kind > 2").select("row", "start", "kind", "end", "secret", touched(f"start - {scope}", f"end + {scope}"))
    other = parts.select("row", F.col("secret").alias("other"), F.col("start").alias("from"), F.col("end").alias("to"), touched("start", "end"))
    linked = weak.join(other, ["row", "scope"]).where((F.col("secret") != F.col("other")) & (F.col("from") - F.col("end") <= scope) & (F.col("start") - F.col("to") <= scope))
    added = linked.groupBy("row").agg(F.collect_set(F.struct("start", "kind", "end")).alias("added"))
    out = found.join(added, "row", "left").withColumn("added", F.coalesce("added", F.expr("cast(array() AS array<struct<start:int,kind:int,end:int>>)")))
    return out.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.size("added").cast("bigint").alias("n_linked"),
        F.sha2(F.expr(_list("base")), 256).alias("base_sha256"), F.expr(_list("array_sort(concat(base, added))")).alias("spans"),
    )
