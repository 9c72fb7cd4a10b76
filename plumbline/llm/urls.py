"""URL filtering by a sort-merge range join, with DataFrame functions only.

A rule is a host and a path prefix; it fits the host and its subdomains. The canonical key of a url at one of
its parent hosts is that host with its labels reversed, then a separator, then the path; that of a rule is
built alike, so a rule is the interval of all keys that it is a prefix of, and such intervals nest. Keys of urls and starts of
rules are sorted together, dealt by ranges and cut into blocks of BLOCK. Each block is swept in order with a stack of active
rules: a key closes the rules that it has left, a rule's start opens it, and a url gets the rule on top. The stack that a block
starts with comes from the rules that are prefixes of its first key. The longest match over the parent hosts wins.

Only distinct (host, path) pairs are swept, and only at parent hosts that have rules. Ranges and blocks are filled by count, so no
host fills a task, and each rule is sent once. The rule hosts are broadcast below BROADCAST_HOSTS of them (counted first), else
joined by shuffle.

Cases: a url that is null or lacks "://" has an empty host and path and gets the default verdict; repeated urls get equal rows; of
rules equally long at different hosts the one of the longer host wins; of two rules with the same host and path a block beats an
allow; without rules all get the default; an empty table gives an empty table; very long urls are keys like any other; other columns
are kept, whatever their names, but for host, path, rule and verdict, which are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower, col, fields, stash, whole_row

BROADCAST_HOSTS = 100_000
BLOCK = 256  # a power of two
_SEP = "\u0001"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path."""
    at = F.instr(url, "://")
    rest = F.substring(url, at + 3, F.length(url))
    there = at > 0
    host = F.when(there, ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))).otherwise("")
    path = F.when(there, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)).otherwise("")
    return host, path


def _reversed(labels: Column) -> Column:
    return F.array_join(F.reverse(labels), ".")


def rule_table(spark: SparkSession, rules: list[tuple[str, str]]) -> DataFrame:
    """Rules given as (action, host + path), such as ("block", "com/en/")."""
    rows = [(v, r.partition("/")[0].lower(), "/" + r.partition("/")[2]) for v, r in rules]
    return spark.createDataFrame(rows, "verdict string, host string, path string")


def _key(host: Column, path: Column) -> Column:
    return F.concat(_reversed(F.split(host, r"\.", -1)), F.lit(_SEP), path)


def _swept(points: DataFrame, rules: DataFrame) -> DataFrame:
    """host, path (of a url) and hit: the innermost rule (host, path, verdict) that its key lies in at one of its parents, or null."""
    rule = F.struct("key", F.struct("host", "path", "verdict").alias("rule"))
    none = rules.select(F.lit(None).alias("x"), rule.alias("r")).schema["r"].dataType["rule"].dataType
    starts = rules.select("key", F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"), F.lit(None).cast("string").alias("path"), F.struct("host", "path", "verdict").alias("rule"))
    events = starts.unionByName(points.select("key", F.lit(1).alias("kind"), "host", "path", F.lit(None).cast(none).alias("rule")))
    # The place in the sorted whole: the partition in the high bits, then the row, so blocks never span partitions.
    block = F.shiftright(F.monotonically_increasing_id(), BLOCK.bit_length() - 1).alias("block")
    dealt = stash(events.repartitionByRange("key", "kind").sortWithinPartitions("key", "kind").select(block, "*"), "events")
    blocks = dealt.groupBy("block").agg(F.array_sort(F.collect_list(F.struct("key", "kind", "host", "path", "rule"))).alias("events"), F.min(F.struct("key", "kind")).alias("first"))
    # Rules around a block's first event: those whose key is a prefix of its key; if it is a rule's start, that one opens by itself.
    ends = F.sequence(F.instr("first.key", _SEP), F.length("first.key") + F.col("first.kind") - 1)
    heads = dealt.groupBy("block").agg(F.min(F.struct("key", "kind")).alias("first")).filter(F.instr("first.key", _SEP) < F.length("first.key") + F.col("first.kind"))
    around = heads.select("block", F.explode(F.transform(ends, lambda n: F.substring(F.col("first.key"), F.lit(1), n))).alias("key"))
    stacks = around.join(rules, "key").groupBy(F.col("block").alias("of")).agg(F.array_sort(F.collect_list(rule)).alias("stack"))  # sorted: outermost first
    both = blocks.join(stacks, F.col("block") == F.col("of"), "left")
    stack = F.coalesce("stack", F.array().cast(T.ArrayType(T.StructType([T.StructField("key", T.StringType()), T.StructField("rule", none)]))))
    both = both.select("events", stack.alias("stack"))
    active = lambda stack, e: F.filter(stack, lambda r: F.startswith(e["key"], r["key"]))
    found = lambda stack, e: F.struct(e["host"].alias("host"), e["path"].alias("path"), F.try_element_at(stack, F.lit(-1))["rule"].alias("hit"))
    opened = lambda stack, e: F.concat(stack, F.array(F.struct(e["key"].alias("key"), e["rule"].alias("rule"))))
    nothing = F.filter(F.transform(F.slice("events", 1, 1), lambda e: found(F.col("stack"), e)), lambda x: F.lit(False))

    def step(s: Column, e: Column) -> Column:
        rest = active(s["stack"], e)
        return F.struct(F.when(e["kind"] == 0, opened(rest, e)).otherwise(rest).alias("stack"), F.when(e["kind"] == 0, s["out"]).otherwise(F.concat(s["out"], F.array(found(rest, e)))).alias("out"))

    sweep = F.aggregate("events", F.struct(F.col("stack").alias("stack"), nothing.alias("out")), step, lambda s: s["out"])
    closing = F.transform("events", lambda e: found(active(F.col("stack"), e), e))  # a block without starts only closes rules
    out = F.when(F.exists("events", lambda e: e["kind"] == 0), sweep).otherwise(closing)
    return both.select(F.explode(out).alias("x")).select("x.*")


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", url_col: str = "url") -> DataFrame:
    """pages with host, path, rule and verdict (columns of these names in pages are replaced)."""
    one = rules.groupBy("host", "path").agg(F.max("verdict").alias("verdict"))  # "block" sorts after "allow"
    one = stash(one.withColumn("key", _key(F.col("host"), F.col("path"))), "rules")
    host, path = split_url(col(url_col))
    named = pages.select(whole_row(pages).alias("row"), host.alias("host"), path.alias("path"))
    urls = named.select("host", "path").distinct()
    labels = F.split("host", r"\.", -1)
    parents = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda d: F.array_join(F.slice(labels, F.size(labels) - d + 1, d), "."))
    points = urls.filter("host <> ''").select("host", "path", F.explode(parents).alias("parent"))
    rule_hosts = one.select(F.col("host").alias("parent")).distinct()
    if rule_hosts.limit(BROADCAST_HOSTS + 1).count() <= BROADCAST_HOSTS:
        rule_hosts = F.broadcast(rule_hosts)
    points = points.join(rule_hosts, "parent", "left_semi").withColumn("key", _key(F.col("parent"), F.col("path")))
    length = F.struct((F.length("hit.host") + F.length("hit.path")).alias("n"), F.length("hit.host").alias("m"), F.concat("hit.host", "hit.path").alias("rule"), F.col("hit.verdict").alias("verdict"))
    hits = _swept(points, one).filter("hit is not null").select("host", "path", length.alias("hit")).groupBy("host", "path").agg(F.max("hit").alias("hit"))
    hits = hits.select(F.col("host").alias("hit_host"), F.col("path").alias("hit_path"), "hit")
    rest = [c for c in pages.columns if c not in ("host", "path", "rule", "verdict")]
    joined = named.join(hits, (F.col("host") == F.col("hit_host")) & (F.col("path") == F.col("hit_path")), "left")
    return joined.select(*fields("row", rest), "host", "path", F.col("hit.rule").alias("rule"), F.coalesce("hit.verdict", F.lit(default)).alias("verdict"))
