"""URL filters over time: dated list entries become validity intervals, joined to captures as of their fetch.

Only DataFrame functions. A list is a log: each entry adds or removes a value at a time. An added value is valid from
its time until the value's next entry. A capture's URL gives the values that could list it: its host, each domain that
holds the host, and the path prefixes of the host, as deep as any entry of the list. An equi-join on the value and the
interval that holds the fetch time give the entries that were active when the capture was made.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import common as C

#: Values of a list that may be sent to every task; a longer list is joined by a shuffle, whose hot values Spark splits.
MOST_VALUES = 100_000
HOST = r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@]+)"
PATH = r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)"


def host_of(url: Column) -> Column:
    """The lower-cased host less a final dot; null without one."""
    h = F.regexp_replace(C.lower_ascii(F.regexp_extract(url, HOST, 1)), r"\.$", "")
    return F.when(h != "", h)


def intervals(entries: DataFrame) -> DataFrame:
    """For each listed value: value, depth (of a path prefix, else 0), spans (structs of begin, end, category).

    entries: kind (host, domain or prefix), value, action (add or remove), at, category. Entries with a null kind,
    value, action or time do not count; repeated ones count once; at one time a removal comes last.
    """
    own = entries.select(F.concat_ws(":", "kind", C.lower_ascii(F.col("value"))).alias("value"), "action", F.col("at").cast("timestamp").alias("at"), F.col("category"), F.col("kind"))
    own = own.where(F.col("kind").isin("host", "domain", "prefix") & F.col("value").isNotNull() & F.col("at").isNotNull() & F.col("action").isin("add", "remove")).distinct()
    order = Window.partitionBy("value").orderBy("at", "action", F.col("category").asc_nulls_first())
    spans = own.withColumn("end", F.lead("at").over(order)).where(F.col("action") == "add").where(F.col("end").isNull() | (F.col("end") > F.col("at")))
    depth = F.when(F.col("kind") == "prefix", F.size(F.split("value", "/")) - 1).otherwise(0)
    return spans.withColumn("depth", depth).groupBy("value", "depth").agg(F.array_sort(F.collect_list(F.struct(F.col("at").alias("begin"), "end", "category"))).alias("spans"))


def values_of(url: Column, deepest: int) -> Column:
    """The values that could list a URL, each with how specific it is: longer domains, then the host, then prefixes."""
    host = host_of(url)
    labels = F.split(host, r"\.")
    n = F.size(labels)
    domains = F.transform(F.sequence(F.lit(1), n), lambda i: F.struct(F.concat(F.lit("domain:"), F.array_join(F.slice(labels, n - i + 1, i), ".")).alias("value"), i.alias("rank")))
    out = [domains, F.array(F.struct(F.concat(F.lit("host:"), host).alias("value"), F.lit(1000).alias("rank")))]
    if deepest:
        parts = F.filter(F.split(F.regexp_extract(url, PATH, 1), "/"), lambda p: p != "")
        depth = F.least(F.size(parts), F.lit(deepest))
        prefixes = F.transform(F.sequence(F.lit(1), depth), lambda i: F.struct(F.concat(F.lit("prefix:"), host, F.lit("/"), C.lower_ascii(F.array_join(F.slice(parts, 1, i), "/"))).alias("value"), (i + 1000).alias("rank")))
        out.append(F.when(depth > 0, prefixes).otherwise(F.array().cast("array<struct<value:string,rank:int>>")))
    return F.when(host.isNotNull(), F.concat(*out))


def evaluate(captures: DataFrame, entries: DataFrame, id_col: str = "page_id", url_col: str = "url", at_col: str = "fetched_at", most: int = MOST_VALUES) -> DataFrame:
    """id_col, host, n_active, blocked, rule, category and listed_at for each capture.

    n_active counts the listed values active at the fetch; rule is the most specific of them (the deepest path prefix,
    then the host, then the longest domain), with its category and the time since when it was listed. A capture with a
    null or malformed URL or a null time matches nothing. Captures keep their number, whether ids repeat or are null;
    an empty list blocks nothing.
    """
    listed = C.checkpoint(intervals(entries))
    known = listed.agg(F.count("*").alias("n"), F.max("depth").alias("deepest")).first()
    side = listed.select("value", "spans")
    side = F.broadcast(side) if known["n"] <= most else side
    own = captures.select(captures[id_col].alias("k0"), captures[url_col].cast("string").alias("url"), captures[at_col].cast("timestamp").alias("t")).withColumn("row", F.monotonically_increasing_id())
    each = own.select("row", "k0", "t", host_of(F.col("url")).alias("host"), F.explode_outer(values_of(F.col("url"), known["deepest"] or 0)).alias("v")).select("row", "k0", "t", "host", "v.*")
    joined = each.join(side, "value", "left")
    now = F.filter("spans", lambda s: (s["begin"] <= F.col("t")) & (s["end"].isNull() | (F.col("t") < s["end"])))
    hit = joined.withColumn("span", F.get(now, F.lit(0)))
    best = F.max(F.when(F.col("span").isNotNull(), F.struct("rank", "value", F.col("span.category").alias("category"), F.col("span.begin").alias("begin")))).alias("best")
    out = hit.groupBy("row", "k0", "host").agg(F.count("span").alias("n_active"), best)
    return out.select(F.col("k0").alias(id_col), "host", "n_active", (F.col("n_active") > 0).alias("blocked"), F.col("best.value").alias("rule"), F.col("best.category").alias("category"), F.col("best.begin").alias("listed_at"))


def sample_list(hosts: DataFrame) -> DataFrame:
    """A dated list over the given hosts (a column host), by a rule over their digests, for queries and tests.

    A sixteenth of the hosts is listed as host, some of those removed and listed again later; others are listed as
    domain for good, or below one path.
    """
    digest = F.md5(F.col("host"))
    part = lambda k: F.conv(F.substring(digest, 1 + 3 * k, 3), 16, 10).cast("int")
    day = lambda d: F.timestamp_seconds(F.lit(1_704_067_200) + d.cast("long") * 86_400)
    a, b, c = part(0), part(1) % 600, part(2)
    entry = lambda kind, value, action, at, category: F.struct(F.lit(kind).alias("kind"), value.alias("value"), F.lit(action).alias("action"), at.alias("at"), F.lit(category).alias("category"))
    host = F.col("host")
    rows = [
        F.when(a % 16 == 0, entry("host", host, "add", day(b), "spam")),
        F.when((a % 16 == 0) & (c % 2 == 0), entry("host", host, "remove", day(b + 30 + c % 60), "spam")),
        F.when((a % 16 == 0) & (c % 4 == 0), entry("host", host, "add", day(b + 120), "malware")),
        F.when(a % 16 == 1, entry("domain", host, "add", day(b), "adult")),
        F.when(a % 8 == 2, entry("prefix", F.concat(host, F.lit("/en")), "add", day(b), "ads")),
    ]
    return hosts.select(F.explode(F.array(*rows)).alias("e")).where(F.col("e").isNotNull()).select("e.*")
