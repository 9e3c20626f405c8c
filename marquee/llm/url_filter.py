"""URL rules by a sort-merge range join on reversed-host keys.

A host's key is its labels reversed, each with a dot behind it:
``blog.example.net`` becomes ``net.example.blog.``.  All hosts below a rule's
host are then the keys that begin with the rule's key, the interval from
``net.example.`` to below ``net.example/`` ('/' is the character after '.').
Such intervals are nested or apart.  Urls and interval ends are sorted
together; between two neighbouring ends the same nested rules are active, so
each end carries its stack of active rules and each url takes the stack of the
last end before it.  Of the stack the longest rule whose path begins the url's
path decides.

Rows are dealt by range of (key, path, page), so one hot host is split over many
tasks; a task that begins inside an interval takes the stack from the last end
of the tasks before it, a running value over one row per task.

Defined results: host and path of a null url or one without ``://`` are empty;
a url that no rule fits has a null rule and the default verdict; of two rules
with one host and path a blocking one wins; rules with an empty or null host fit
nothing; repeated pages are separate rows; further columns pass through
untouched; without rules every url has the default verdict.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from marquee.llm.staging import staged

DEFAULT_VERDICT = "allow"
STACK = "array<struct<size int, host_size int, host string, path string, verdict string>>"


def lower_ascii(text: Column) -> Column:
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, in lower case; path: then up to ``?``, ``#`` or the end."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return lower_ascii(host), F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)


def host_key(host: Column) -> Column:
    return F.when(host == "", F.lit("")).otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.", -1)), "."), F.lit(".")))


def rules_table(spark: SparkSession, rules: list[tuple[str, str, str]]) -> DataFrame:
    """(host, path, verdict) rules as a table."""
    return spark.createDataFrame(rules, "host string, path string, verdict string")


def interval_ends(rules: DataFrame) -> DataFrame:
    """key, stack: the rules that are active from this key on, up to the next row's key."""
    rules = (rules.filter("host <> ''").groupBy(lower_ascii(F.col("host")).alias("host"), F.coalesce("path", F.lit("")).alias("path"))
             .agg(F.max("verdict").alias("verdict")))  # 'block' sorts behind 'allow'
    hosts = rules.groupBy("host").agg(F.collect_list(F.struct(
        (F.length("host") + F.length("path")).alias("size"), F.length("host").alias("host_size"), "host", "path", "verdict")).alias("own"))
    hosts = hosts.select(host_key(F.col("host")).alias("key"), "own")
    # rules of the host and of every host above it, found by the key's own prefixes
    labels = F.slice(F.split("key", r"\."), 1, F.size(F.split("key", r"\.")) - 1)
    above = hosts.select("key", F.explode(F.transform(
        F.sequence(F.lit(1), F.size(labels)), lambda n: F.concat(F.array_join(F.slice(labels, 1, n), "."), F.lit(".")))).alias("upper"))
    active = above.join(hosts.select(F.col("key").alias("upper"), "own"), "upper")
    opens = active.groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))
    closing = active.filter("upper <> key").groupBy("key").agg(F.flatten(F.collect_list("own")).alias("stack"))
    closes = hosts.select("key").join(closing, "key", "left").select(
        F.concat(F.expr("substring(key, 1, length(key) - 1)"), F.lit("/")).alias("key"),
        F.coalesce("stack", F.array().cast(STACK)).alias("stack"))
    return opens.select("key", F.col("stack").cast(STACK)).unionByName(closes)


def judge_urls(pages: DataFrame, rules: DataFrame, *, url: str = "url", default: str = DEFAULT_VERDICT) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    parts = sorted({"host", "path", "rule", "verdict"} & set(pages.columns))
    keep = F.struct(*[F.col(f"`{c}`") for c in pages.columns if c not in parts])
    host, path = host_and_path(F.col(url))
    urls = pages.select(keep.alias("_row"), host.alias("host"), path.alias("path")).withColumn("key", host_key(F.col("host")))
    ends = interval_ends(rules)
    both = urls.select("key", "path", F.lit(1).alias("kind"), "host", "_row", F.lit(None).cast(STACK).alias("stack")).unionByName(
        ends.select("key", F.lit("").alias("path"), F.lit(0).alias("kind"), F.lit(None).cast("string").alias("host"),
                    F.lit(None).cast(urls.schema["_row"].dataType).alias("_row"), "stack"))
    tasks = int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # a hash as last sort column lets a range end inside a key and path that many rows share
    dealt = both.withColumn("_spread", F.xxhash64("_row")).repartitionByRange(tasks, "key", "kind", "path", "_spread").drop("_spread")
    # written, so that both readers below see the same tasks
    dealt = staged(dealt.withColumn("_part", F.spark_partition_id()), "sorted-urls")
    order = Window.partitionBy("_part").orderBy("key", "kind", "path").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    swept = dealt.withColumn("_active", F.last("stack", ignorenulls=True).over(order))
    # stack at the end of every task, handed to the tasks that follow: one row per task
    lasts = dealt.filter("kind = 0").groupBy("_part").agg(F.max_by("stack", "key").alias("_stack"))
    numbers = pages.sparkSession.range(tasks).select(F.col("id").cast("int").alias("_part"))
    before = numbers.join(lasts, "_part", "left").select("_part", F.last("_stack", ignorenulls=True).over(
        Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    swept = swept.filter("kind = 1").join(F.broadcast(before), "_part", "left")
    fitting = F.filter(F.coalesce("_active", "_before"), lambda r: F.startswith(F.col("path"), r["path"]))
    best = F.array_max(fitting)
    return swept.withColumn("_best", best).select(
        "_row.*", "host", "path",
        F.concat(F.col("_best.host"), F.when(F.col("_best.path") == "", F.lit("/")).otherwise(F.col("_best.path"))).alias("rule"),
        F.coalesce(F.col("_best.verdict"), F.lit(default)).alias("verdict"))
