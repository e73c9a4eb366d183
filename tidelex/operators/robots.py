"""robots.txt: rules of the group that applies to an agent, and the longest matching prefix.

A group applies if its agent equals ours (case does not matter); without one, ``*`` does. Groups of one agent
are merged; each ``User-agent`` line begins a group of its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidelex.functions.text import lower_ascii, trim_blank


def directives(bodies: DataFrame, agent: str) -> DataFrame:
    """(host, line, key, value) of the lines that apply, of bodies(host, body)."""
    lines = bodies.select("host", F.posexplode(F.split("body", "\n")).alias("line", "raw"))
    text = trim_blank(F.regexp_replace("raw", "#.*$", ""))
    pairs = lines.select("host", "line", lower_ascii(trim_blank(F.regexp_extract(text, "^([^:]*):", 1))).alias("key"), trim_blank(F.regexp_extract(text, "^[^:]*:(.*)$", 1)).alias("value"), text.contains(":").alias("ok")).where("ok").drop("ok")
    order = Window.partitionBy("host").orderBy("line")
    of = F.last(F.when(F.col("key") == "user-agent", lower_ascii(F.col("value"))), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, 0))
    ours = agent.lower()
    exact = F.max((F.col("of") == ours).cast("int")).over(Window.partitionBy("host"))
    marked = pairs.withColumn("of", of).where(F.col("of").isNotNull()).withColumn("exact", exact)
    wanted = F.when(F.col("exact") == 1, F.lit(ours)).otherwise("*")
    return marked.where((F.col("of") == wanted) & (F.col("key") != "user-agent")).select("host", "line", "key", "value")


def rules(bodies: DataFrame, agent: str) -> DataFrame:
    """(host, line, prefix, allow)."""
    found = directives(bodies, agent).where(F.col("key").isin("allow", "disallow") & (F.col("value") != ""))
    return found.select("host", "line", F.col("value").alias("prefix"), (F.col("key") == "allow").alias("allow"))


def delays(bodies: DataFrame, agent: str) -> DataFrame:
    """(host, delay): the last crawl-delay that is a number."""
    found = directives(bodies, agent).where("key = 'crawl-delay'").withColumn("delay", F.regexp_extract("value", "^([0-9]*\\.?[0-9]+)", 1).try_cast("double")).where("delay IS NOT NULL")
    return found.groupBy("host").agg(F.max_by("delay", "line").alias("delay"))


def allowed(urls: DataFrame, rules_: DataFrame) -> DataFrame:
    """(host, path, allowed) of urls(host, path): the longest prefix decides, Allow on ties, all is allowed without a rule."""
    hits = urls.select("host", "path").distinct().join(rules_.select("host", "prefix", "allow"), "host").where("startswith(path, prefix)")
    best = hits.groupBy("host", "path").agg(F.max_by("allow", F.struct(F.length("prefix"), "allow")).alias("allow"))
    return urls.join(best, ["host", "path"], "left").select("host", "path", F.coalesce("allow", F.lit(True)).alias("allowed"))
