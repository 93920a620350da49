"""Scalar functions of columns: authors, dates, offsets, messages, paths, thresholds, layout values."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds that options may name.
ARTIFACT_TYPES = ("function", "file", "feature")
DEPENDENCY_TYPES = ("co-change", "dsm", "feature_call", "semantic", "none")
QUALITY_TYPES = ("corrective", "defect")
COMMUNICATION_TYPES = ("mail", "jira", "mail+jira")
#: Ordered states of a figure of merit.
STATUS = ("good", "warn", "bad", "error")


def one_of(value: str, allowed: tuple[str, ...]) -> str:
    """``value`` if it is allowed; otherwise an error that lists what is."""
    if value not in allowed:
        raise ValueError(f"{value!r} is none of {', '.join(allowed)}")
    return value


# ---------------------------------------------------------------- persons
def strip_parentheses(name: Column) -> Column:
    """"(name)" without its parentheses."""
    return F.regexp_replace(F.trim(name), r"^\((.*)\)$", "$1")


def repair_author(header: Column) -> Column:
    """A sender header as struct (name, email): obfuscated " at " undone, quotes and separators dropped, "via list" removed.

    Without an address the e-mail is a hash of the header; without a name it is the local part with dots as spaces.
    """
    h = F.regexp_replace(F.trim(header), r"\s+at\s+(?=[\w.-]+\.[A-Za-z]{2,}\b)", "@")
    h = F.regexp_replace(F.regexp_replace(h, r'[",;]', " "), r"\s+via\s+[^<]*", " ")
    mail = F.lower(F.regexp_extract(h, r"([\w.+-]+@[\w-]+(?:\.[\w-]+)+)", 1))
    rest = F.trim(F.regexp_replace(F.regexp_replace(h, r"[<(]?\s*[\w.+-]+@[\w-]+(?:\.[\w-]+)+\s*[>)]?", " "), r"\s+", " "))
    name = strip_parentheses(F.trim(F.regexp_replace(rest, r"[<>]", "")))
    local = F.initcap(F.regexp_replace(F.substring_index(mail, "@", 1), r"[._+-]+", " "))
    return F.struct(F.when(name != "", name).when(mail != "", local).otherwise(F.lit(None)).alias("name"), F.when(mail != "", mail).otherwise(F.concat(F.hex(F.xxhash64(header)), F.lit("@unknown"))).alias("email"))


def decompose_address(address: Column) -> Column:
    """"Name <mail>" or "Last, First <mail>" as struct (name, email), e-mail in lower case; without one a hash stands for it."""
    clean = F.regexp_replace(F.trim(address), r"[\"']", "")
    name = F.trim(F.regexp_extract(clean, r"^([^<]*)<", 1))
    name = F.when(name.contains(","), F.concat_ws(" ", F.trim(F.substring_index(name, ",", -1)), F.trim(F.substring_index(name, ",", 1)))).otherwise(name)
    mail = F.lower(F.trim(F.regexp_extract(clean, r"<([^>]+)>", 1)))
    return F.struct(F.when(name != "", name).otherwise(clean).alias("name"), F.when(mail != "", mail).otherwise(F.concat(F.hex(F.xxhash64(address)), F.lit("@unknown"))).alias("email"))


def reveal_address(text: Column) -> Column:
    """Words "dot" and "at" of a spelled-out e-mail address as "." and "@", joined."""
    parts = F.transform(F.split(F.trim(text), r"\s+"), lambda x: F.when(F.lower(x) == "dot", ".").when(F.lower(x) == "at", "@").otherwise(x))
    return F.array_join(parts, "")


# ---------------------------------------------------------------- dates
def offset_minutes(offset: Column) -> Column:
    """A signed hhmm offset in minutes (the sign holds for the minutes, too)."""
    o = offset.cast("int")
    return 60 * F.try_divide(o, F.lit(100)).cast("int") + o % 100


def parse_date(text: Column) -> Column:
    """Mail dates in three forms, with or without zone, as struct (utc, offset); missing ones are (null, 0)."""
    clean = F.trim(F.regexp_replace(F.regexp_replace(text, r"^[A-Za-z]{3},?\s+", ""), r"\s*\([^)]*\)\s*$", ""))
    zone = F.regexp_extract(clean, r"([+-]\d{4})$", 1)
    local = F.trim(F.regexp_replace(clean, r"\s*[+-]\d{4}$", ""))
    at = F.coalesce(*[F.try_to_timestamp(local, F.lit(f)) for f in ("d MMM yyyy HH:mm:ss", "MMM d HH:mm:ss yyyy", "yyyy-MM-dd HH:mm:ss")])
    minutes = F.coalesce(offset_minutes(F.nullif(zone, F.lit(""))), F.lit(0))
    utc = F.timestamp_seconds(F.unix_seconds(at) - 60 * minutes).cast("timestamp_ntz")
    return F.struct(utc.alias("utc"), F.when(at.isNotNull(), F.coalesce(F.nullif(zone, F.lit("")).cast("int"), F.lit(0))).otherwise(0).alias("offset"))


def parse_git_date(text: Column) -> Column:
    """"yyyy-MM-dd HH:mm:ss +hhmm" as the instant in UTC without zone."""
    return F.try_to_timestamp(F.trim(text), F.lit("yyyy-MM-dd HH:mm:ss Z")).cast("timestamp_ntz")


def date_or_epoch(at: Column) -> Column:
    """A missing date is the start of the epoch."""
    return F.coalesce(at, F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"))


def zones_of_offset(commits: DataFrame, at: str, minutes: str, zones: list[str]) -> DataFrame:
    """``zones``: the names of a literal list whose offset at that instant is nearest, joined by ";"."""
    shift = lambda z: F.unix_seconds(F.from_utc_timestamp(F.col(at).cast("timestamp"), z)) / 60 - F.unix_seconds(F.col(at).cast("timestamp")) / 60
    gaps = F.array(*[F.struct(F.abs(shift(z) - F.col(minutes)).alias("gap"), F.lit(z).alias("zone")) for z in zones])
    least = F.array_min(F.transform(gaps, lambda g: g["gap"]))
    return commits.withColumn("zones", F.array_join(F.transform(F.filter(gaps, lambda g: g["gap"] == least), lambda g: g["zone"]), ";"))


# ---------------------------------------------------------------- messages and names
def is_corrective(message: Column) -> Column:
    """Whether a message contains bug, fix, error or fail anywhere, in any case."""
    return F.lower(message).rlike("bug|fix|error|fail")


def issue_ids(message: Column) -> Column:
    """Issue ids such as ABC-12 in a message."""
    return F.regexp_extract_all(message, F.lit("([A-Z]+-[0-9]+)"), 1)


def split_identifier(name: Column) -> Column:
    """Words of an identifier: camelCase and underscores split, other marks removed, lower case."""
    s = F.regexp_replace(name, r"([a-z0-9])([A-Z])", "$1_$2")
    s = F.regexp_replace(F.regexp_replace(s, r"([A-Z]+)([A-Z][a-z])", "$1_$2"), r"[^A-Za-z0-9]+", "_")
    return F.array_remove(F.split(F.lower(s), "_"), "")


def subject_tokens(subject: Column, stop: tuple[str, ...] = ()) -> Column:
    """Tokens of a subject without marks, numbers, patch tags and stop words."""
    s = F.regexp_replace(F.lower(subject), r"\[[^\]]*\]|[^a-z\s]", " ")
    return F.array_except(F.array_remove(F.split(F.trim(s), r"\s+"), ""), F.array(*[F.lit(x) for x in (*stop, "patch", "re")]))


def short_hash_label(number: Column, start: Column, end: Column) -> Column:
    """"001--abcdef-7fbd3d": number and the first six of both hashes."""
    return F.concat(F.lpad(number.cast("string"), 3, "0"), F.lit("--"), F.substring(start, 1, 6), F.lit("-"), F.substring(end, 1, 6))


# ---------------------------------------------------------------- measures
def safe_log(x: Column) -> Column:
    """Natural logarithm; 0 for what is not positive."""
    return F.when(x > 0, F.ln(x)).otherwise(0.0)


def author_similarity(a: Column, b: Column) -> Column:
    """Mean of paired fractions of two maps where both are above 0; 0 without such."""
    common = F.filter(F.map_keys(a), lambda k: (F.coalesce(F.try_element_at(a, k), F.lit(0.0)) > 0) & (F.coalesce(F.try_element_at(b, k), F.lit(0.0)) > 0))
    total = F.aggregate(common, F.lit(0.0), lambda s, k: s + F.try_element_at(a, k) + F.try_element_at(b, k))
    return F.coalesce(F.try_divide(total, 2 * F.size(common)), F.lit(0.0))


def touch_similarity(fractions: Column, touched: Column) -> Column:
    """Greatest fraction among the subsystems that a commit touches; 0 without any."""
    return F.coalesce(F.array_max(F.transform(touched, lambda k: F.coalesce(F.try_element_at(fractions, k), F.lit(0.0)))), F.lit(0.0))


def degree_class(x: Column) -> Column:
    """Low up to a quarter, High from a half, Medium between."""
    return F.when(x >= 0.5, "High").when(x > 0.25, "Medium").otherwise("Low")


def status_of(x: Column, warn: float, bad: float, rising: bool = True) -> Column:
    """State of a measure by its thresholds; error for null."""
    a, b = (x >= bad, x >= warn) if rising else (x <= bad, x <= warn)
    return F.when(x.isNull(), STATUS[3]).when(a, STATUS[2]).when(b, STATUS[1]).otherwise(STATUS[0])


def combined_status(*status: Column) -> Column:
    """State at the rounded mean of the states' numbers."""
    number = lambda s: F.array_position(F.array(*[F.lit(x) for x in STATUS]), s) - 1
    total = number(status[0])
    for s in status[1:]:
        total = total + number(s)
    return F.element_at(F.array(*[F.lit(x) for x in STATUS]), (F.bround(total / len(status)) + 1).cast("int"))


def font_size(x: Column, largest: Column) -> Column:
    """Size of a word in a cloud: 10 + 30 * 5 ^ log10(x / largest)."""
    return 10 + 30 * F.pow(F.lit(5.0), F.log10(F.try_divide(x, largest)))


def interleave(a: Column, b: Column) -> Column:
    """(a1, b1, a2, b2, ...)."""
    return F.flatten(F.zip_with(a, b, lambda x, y: F.array(x, y)))
