"""Parsers of the text that tools write: git, mail boxes, blame, feature lists, line counters, issue exports.

Each takes lines or whole texts as columns and stays in the JVM; files are read by
``spark.read.text`` (``wholetext`` for blocks) on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Endings of implementation files, fixed values; the last has no dot.
SOURCE_ENDINGS = (
    ".c", ".cc", ".cpp", ".cxx", ".cs", ".asmx", ".m", ".mm", ".js", ".coffee", ".java", ".j", ".jav", ".php", ".py", ".sh", ".rb",
    ".d", ".php4", ".php5", ".inc", ".phtml", ".f", ".for", ".f90", ".idl", ".ddl", ".odl", ".tcl", "sql",
)
#: Tags of a commit message that link persons, fixed values.
TAG_TYPES = ("Signed-off-by", "Acked-by", "CC", "Reviewed-by", "Reported-by", "Tested-by", "Patch")


def git_log(lines: DataFrame, line: str = "value") -> DataFrame:
    """Lines "committer-time hash author-time" as (hash, commit_date, author_date), latest first by date and hash."""
    c = F.split(F.trim(line), r"\s+")
    at = lambda k: F.timestamp_seconds(F.try_element_at(c, F.lit(k)).cast("bigint")).cast("timestamp_ntz")
    rows = lines.where(F.col(line).rlike(r"^\s*\d+\s+[0-9a-f]{7,40}\s+\d+\s*$"))
    return rows.select(F.try_element_at(c, F.lit(2)).alias("hash"), at(1).alias("commit_date"), at(3).alias("author_date")).orderBy(F.desc("commit_date"), "hash")


def shortstat(text: Column) -> Column:
    """"3 files changed, 5 insertions(+), 2 deletions(-)" as struct (files, added, deleted); absent parts are 0."""
    n = lambda p: F.coalesce(F.nullif(F.regexp_extract(text, p, 1), F.lit("")).cast("int"), F.lit(0))
    return F.struct(n(r"(\d+) files? changed").alias("files"), n(r"(\d+) insertions?\(\+\)").alias("added"), n(r"(\d+) deletions?\(-\)").alias("deleted"))


def commit_message(text: Column) -> Column:
    """A message as struct (lines, bytes, tags): lines without tags and blanks, and a map of tag to persons."""
    lines = F.transform(F.split(text, "\n"), lambda x: F.trim(x))
    tag = r"^(?i)(" + "|".join(TAG_TYPES) + r"):\s*(.+)$"
    body = F.filter(lines, lambda x: (x != "") & ~x.rlike(tag))

    def persons(kind: str) -> Column:
        mark = f"^(?i){kind}:"
        return F.transform(F.filter(lines, lambda x: x.rlike(mark)), lambda x: F.trim(F.regexp_replace(x, mark, "")))

    tags = F.map_from_arrays(F.array(*[F.lit(t) for t in TAG_TYPES]), F.array(*[persons(t) for t in TAG_TYPES]))
    return F.struct(F.size(body).alias("lines"), F.coalesce(F.aggregate(body, F.lit(0), lambda a, x: a + F.octet_length(x)), F.lit(0)).alias("bytes"), tags.alias("tags"))


def blame(text: DataFrame, content: str = "value", keys: tuple[str, ...] = ()) -> DataFrame:
    """Porcelain blame of whole files as (keys, line, commit, source): lines are numbered from 0 as in the final file."""
    lines = text.select(*keys, F.posexplode(F.split(content, "\n")).alias("pos", "l"))
    head = F.col("l").rlike(r"^[0-9a-f]{40} \d+ \d+")
    w = Window.partitionBy(*keys).orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    runs = lines.withColumn("head", F.last(F.when(head, F.col("l")), ignorenulls=True).over(w)).where(F.startswith("l", F.lit("\t")))
    parts = F.split("head", " ")
    return runs.select(*keys, (parts[2].cast("int") - 1).alias("line"), parts[0].alias("commit"), F.substring("l", 2, 1 << 30).alias("source"))


def changed_files(lines: DataFrame, line: str = "value") -> DataFrame:
    """Status and name lines ("M\\tpath") as distinct source files of the statuses A, C, M, R, T and B."""
    f = lines.where(F.col(line).rlike(r"^[ACMRTB]\d*\t")).select(F.element_at(F.split(line, "\t"), -1).alias("file"))
    return f.where(F.lower("file").rlike("(" + "|".join(x.replace(".", r"\.") for x in SOURCE_ENDINGS) + ")$")).distinct()


def numstat(rows: DataFrame, keys: tuple[str, ...] = ("file",), order: str = "seq") -> DataFrame:
    """Numstat rows (stat "added\\tdeleted\\tfile", seq) with the running number of lines of each file; binary files are skipped."""
    p = F.split("stat", "\t")
    n = rows.where(F.col("stat").rlike(r"^\d+\t\d+\t")).select("*", p[0].cast("bigint").alias("added"), p[1].cast("bigint").alias("deleted"), p[2].alias("file"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("loc", F.sum(F.col("added") - F.col("deleted")).over(w))


def feature_rows(lines: DataFrame, line: str = "value") -> DataFrame:
    """Feature rows (file, start, end, kind, expression, features) of a CSV whose first line may name the separator ("sep=,")."""
    p = F.split(F.regexp_replace(line, '"', ""), ",")
    rows = lines.where(~F.col(line).rlike(r'^"?sep=') & ~F.col(line).rlike("(?i)^\"?filename"))
    return rows.select(p[0].alias("file"), p[1].cast("int").alias("start"), p[2].cast("int").alias("end"), p[3].alias("kind"), p[4].alias("expression"), F.split(p[5], ";").alias("features")).where("start IS NOT NULL AND end IS NOT NULL")


def lines_of_features(ranges: DataFrame, last_line: DataFrame, keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Features and innermost expression of each line: (keys, line, features, expression); lines outside are Base_Feature.

    ``ranges`` has (keys, start, end, features, expression), ``last_line`` (keys, last_line).
    Ranges that overlap without nesting, or end before they start, are an error.
    """
    checked = ranges.withColumn("start", F.when(F.col("start") <= F.col("end"), F.col("start")).otherwise(F.raise_error(F.lit("a feature range ends before it starts")).cast("int")))
    w = Window.partitionBy(*keys).orderBy("start", F.desc("end"))
    flat = checked.select(*keys, "start", "end", "features", "expression")
    a, b = flat.select(*keys, F.col("start").alias("s1"), F.col("end").alias("e1")), flat.select(*keys, F.col("start").alias("s2"), F.col("end").alias("e2"))
    crossing = a.join(b, list(keys)).where("s1 < s2 AND s2 <= e1 AND e1 < e2").groupBy(*keys).agg(F.count("*").alias("bad"))
    ok = flat.withColumn("depth", F.row_number().over(w)).join(crossing, list(keys), "left").withColumn("depth", F.when(F.col("bad").isNull(), F.col("depth")).otherwise(F.raise_error(F.lit("feature ranges overlap")).cast("int")))
    each = ok.select(*keys, F.explode(F.sequence("start", "end")).alias("line"), "features", "expression", "depth")
    found = each.groupBy(*keys, "line").agg(F.array_sort(F.array_distinct(F.flatten(F.collect_list("features")))).alias("features"), F.max_by("expression", "depth").alias("expression"))
    spine = last_line.select(*keys, F.explode(F.sequence(F.lit(1), F.col("last_line"))).alias("line"))
    return spine.join(found, [*keys, "line"], "left").select(*keys, "line", F.coalesce("features", F.array(F.lit("Base_Feature"))).alias("features"), F.coalesce("expression", F.lit("Base_Feature")).alias("expression"))


def mailbox(text: DataFrame, content: str = "value") -> DataFrame:
    """Whole mail boxes as mails (message_id, in_reply_to, references, author, date, subject, body); quotes, diffs and signatures go."""
    mails = text.select(F.explode(F.split(content, r"(?m)^From \S+.*$")).alias("m")).where("trim(m) <> ''")
    head = F.regexp_replace(F.substring_index("m", "\n\n", 1), r"\n[ \t]+", " ")
    header = lambda name: F.nullif(F.trim(F.regexp_extract(head, rf"(?im)^{name}:[ \t]*(.*)$", 1)), F.lit(""))
    body = F.substring(F.col("m"), F.length(F.substring_index("m", "\n\n", 1)) + F.lit(1), F.length("m"))
    body = F.regexp_replace(F.regexp_replace(body, r"(?s)\n-- ?\n.*$", "\n"), r"(?s)\ndiff (?:--git|-[a-z]).*$", "\n")
    body = F.regexp_replace(F.regexp_replace(body, r"(?m)^>.*$\n?", ""), r"(?m)^Signed-off-by:.*$\n?", "")
    body = F.regexp_replace(body, r"^\s+|\s+$", "")
    return mails.select(header("Message-ID").alias("message_id"), header("In-Reply-To").alias("in_reply_to"), F.regexp_extract_all(F.coalesce(header("References"), F.lit("")), F.lit(r"(<[^>]+>)"), 1).alias("references"), header("From").alias("author"), header("Date").alias("date"), header("Subject").alias("subject"), body.alias("body"))


def reply_edges(mails: DataFrame) -> DataFrame:
    """Who answers whom: mails joined to the mail they reply to; (from_id, to_id, weight) by author."""
    parent = F.coalesce("in_reply_to", F.when(F.size("references") > 0, F.element_at("references", -1)))
    child = mails.select(F.col("author").alias("from_id"), parent.alias("parent"))
    up = mails.select(F.col("message_id").alias("parent"), F.col("author").alias("to_id"))
    return child.join(up, "parent").where("from_id <> to_id").groupBy("from_id", "to_id").agg(F.count("*").alias("weight"))


def line_counter(lines: DataFrame, line: str = "value") -> DataFrame:
    """Report lines "ansic: 1,234 (56.7%)" as (language, lines, fraction), the fraction of all lines."""
    pattern = r"^\s*([A-Za-z0-9+#_-]+):\s+([\d,]+)\s+\([\d.]+%\)"
    rows = lines.where(F.col(line).rlike(pattern)).select(F.regexp_extract(line, pattern, 1).alias("language"), F.regexp_replace(F.regexp_extract(line, pattern, 2), ",", "").cast("bigint").alias("lines"))
    return rows.withColumn("fraction", F.col("lines") / F.sum("lines").over(Window.partitionBy()))


def cost_metrics(text: Column) -> Column:
    """Report text as struct (person_months, total_cost, schedule_months, developers); absent parts are null."""
    n = lambda p: F.regexp_replace(F.nullif(F.regexp_extract(text, p, 1), F.lit("")), ",", "").cast("double")
    return F.struct(
        n(r"\(Person-Years|Person-Months\)\s*=\s*[\d.,]+\s*\(([\d.,]+)\)").alias("person_months"), n(r"Total Estimated Cost to Develop\s*=\s*\$\s*([\d.,]+)").alias("total_cost"),
        n(r"Schedule Estimate, Years \(Months\)\s*=\s*[\d.,]+\s*\(([\d.,]+)\)").alias("schedule_months"), n(r"Average Number of Developers[^=]*=\s*([\d.,]+)").alias("developers"),
    )


def issue_comments(text: DataFrame, content: str = "value") -> DataFrame:
    """Issue exports (XML text) as (issue, type, author, at): one row for each creation and comment."""
    items = text.select(F.explode(F.regexp_extract_all(content, F.lit(r"(?s)<item>(.*?)</item>"), 1)).alias("i"))
    one = lambda tag: F.nullif(F.regexp_extract("i", rf"<{tag}[^>]*>([^<]*)</{tag}>", 1), F.lit(""))
    head = items.select(one("key").alias("issue"), one("type").alias("type"), one("reporter").alias("author"), one("created").alias("at"), "i")
    comments = F.regexp_extract_all("i", F.lit(r"(<comment [^>]*>)"), 1)
    more = head.select("issue", "type", F.explode(comments).alias("c")).select("issue", "type", F.regexp_extract("c", r'author="([^"]*)"', 1).alias("author"), F.regexp_extract("c", r'created="([^"]*)"', 1).alias("at"))
    return head.drop("i").union(more)


def sql_objects(text: DataFrame, content: str = "value", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Line ranges of CREATE and DROP statements by object: (keys, name, start_line, end_line), from 0."""
    lines = text.select(*keys, F.posexplode(F.split(content, "\n")).alias("line", "l"))
    pattern = r"(?i)^\s*(?:create|drop)\s+(?:or\s+replace\s+)?(?:table|view|procedure|function|index|trigger)\s+(?:if\s+(?:not\s+)?exists\s+)?[`\"\[]?([\w.]+)"
    w = Window.partitionBy(*keys).orderBy("line")
    starts = lines.withColumn("name", F.nullif(F.regexp_extract("l", pattern, 1), F.lit("")))
    last = lines.groupBy(*keys).agg(F.max("line").alias("last"))
    s = starts.where("name IS NOT NULL").withColumn("next", F.lead("line").over(w))
    return s.join(last, list(keys)).select(*keys, "name", F.col("line").alias("start_line"), F.coalesce(F.col("next") - 1, "last").alias("end_line"))


def pajek(lines: DataFrame, line: str = "value") -> DataFrame:
    """Edges (from_id, to_id, weight) of a Pajek file's arc and edge rows, given with their line number ``n``."""
    section = F.last(F.when(F.startswith(F.trim(line), F.lit("*")), F.lower(F.regexp_extract(F.trim(line), r"^\*(\w+)", 1))), ignorenulls=True).over(Window.partitionBy(F.lit(0)).orderBy("n"))
    p = F.split(F.trim(line), r"\s+")
    rows = lines.withColumn("section", section).where(F.col("section").isin("arcs", "edges") & F.col(line).rlike(r"^\s*\d+\s+\d+"))
    return rows.select(p[0].cast("bigint").alias("from_id"), p[1].cast("bigint").alias("to_id"), F.coalesce(F.get(p, F.lit(2)).cast("double"), F.lit(1.0)).alias("weight"))


def module_dependencies(rows: DataFrame, prefix: str) -> DataFrame:
    """Dependency rows (From File, To File, References) as edges without a path prefix and without loops."""
    strip = lambda c: F.regexp_replace(F.col(c), "^" + prefix.replace(".", r"\."), "")
    return rows.select(strip("From File").alias("from_id"), strip("To File").alias("to_id"), F.col("References").cast("bigint").alias("weight")).where("from_id <> to_id")


def entity_tags(lines: DataFrame, line: str = "value") -> DataFrame:
    """Tag lines "name<TAB>file<TAB>line;\\"<TAB>kind" of functions and types as (file, start_line, entity), lines from 0."""
    p = F.split(line, "\t")
    rows = lines.where(~F.startswith(line, F.lit("!")) & F.col(line).rlike(r'^[^\t]+\t[^\t]+\t\d+;"\t[a-z]'))
    number = F.regexp_extract(p[2], r"^(\d+)", 1).cast("int") - 1
    return rows.where(p[3].isin("f", "c", "s", "m")).select(p[1].alias("file"), number.alias("start_line"), p[0].alias("entity"))


def function_bodies(text: DataFrame, content: str = "value") -> DataFrame:
    """Function members of documentation XML as (file, entity, start_line, end_line), lines from 0; those without a body are left out."""
    member = F.explode(F.regexp_extract_all(content, F.lit(r'(?s)<memberdef kind="function".*?</memberdef>'), 0))
    m = text.select(member.alias("m"))
    one = lambda p: F.regexp_extract("m", p, 1)
    number = lambda p: F.nullif(one(p), F.lit("")).cast("int") - 1
    rows = m.select(one(r'bodyfile="([^"]*)"').alias("file"), one(r"<name>([^<]*)</name>").alias("entity"), number(r'bodystart="(\d+)"').alias("start_line"), number(r'bodyend="(\d+)"').alias("end_line"))
    return rows.where("start_line IS NOT NULL AND end_line IS NOT NULL")


def community_file(lines: DataFrame, line: str = "value") -> DataFrame:
    """Communities of a file with "#module k ..." lines, each followed by its members; lines have their number ``n``: (community, vertex)."""
    w = Window.partitionBy(F.lit(0)).orderBy("n")
    head = F.last(F.nullif(F.regexp_extract(line, r"^#module\s+(\d+)", 1), F.lit("")), ignorenulls=True).over(w)
    rows = lines.withColumn("community", head).where(~F.startswith(line, F.lit("#")))
    return rows.select(F.col("community").cast("bigint").alias("community"), F.explode(F.split(F.trim(line), r"\s+")).alias("v")).select("community", F.col("v").cast("bigint").alias("vertex"))


def posting_counts(rows: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Daily rates (keys, day, rate, spam) as posts and their running number: (keys, day, posts, total)."""
    w = Window.partitionBy(*keys).orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    p = rows.select(*keys, "day", (F.col("rate") + F.col("spam")).alias("posts"))
    return p.withColumn("total", F.sum("posts").over(w))


def messages_since(counts: DataFrame, since: str, keys: tuple[str, ...] = ()) -> DataFrame:
    """Messages after a day: greatest running number less that of the last posting at or before the day, or of the first after it."""
    at = F.lit(since).cast("date")
    base = F.coalesce(F.max(F.when(F.col("day") <= at, F.col("total"))), F.min("total"))
    return counts.groupBy(*keys).agg((F.max("total") - base).alias("messages"))


def line_counts(files: DataFrame, content: str = "value", keys: tuple[str, ...] = ("file",)) -> DataFrame:
    """Lines of each file's text; a last line without a break counts, an empty file has none."""
    breaks = F.char_length(content) - F.char_length(F.replace(content, F.lit("\n"), F.lit("")))
    open_end = F.when((F.char_length(content) > 0) & ~F.endswith(content, F.lit("\n")), 1).otherwise(0)
    return files.select(*keys, (breaks + open_end).cast("bigint").alias("lines"))
