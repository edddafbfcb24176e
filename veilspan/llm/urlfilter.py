"""URL lists that change over time, joined to captures as of their fetch time.

A list is a log: on some date a domain is added, later removed, added again.  Consecutive
entries of a domain become validity intervals; a capture is judged by the entries that were
active when it was fetched, not by today's list.  Everything is built from column expressions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from veilspan.session import written

from .common import known_small

#: Interval and capture times are cut into buckets of so many seconds, which the join takes as an equality.
BUCKET_SECONDS = 30 * 86400
#: Captures of one (domain, bucket) beyond which it is dealt to several parts, and the most parts;
#: only the list entries of such a domain are repeated, once for each part.
HOT_ROWS, MOST_PARTS = 10_000, 4096


def host(url: Column) -> Column:
    """Lower-case host of a URL, without user, port and final dot; null when there is none."""
    found = F.regexp_extract(F.lower(url), r"^\s*[a-z][a-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:@\s]+)", 1)
    return F.nullif(F.rtrim(found, F.lit(".")), F.lit(""))


def domains(name: Column) -> Column:
    """The host and its parent domains of at least two labels, longest first."""
    parts = F.split(name, r"\.")
    last = F.greatest(F.size(parts) - 1, F.lit(1))
    return F.transform(F.sequence(F.lit(1), last), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))


def intervals(entries: DataFrame, *, domain: str = "domain", action: str = "action", since: str = "since") -> DataFrame:
    """``(domain, valid_from, valid_to)`` for which a domain is listed; ``valid_to`` null: until now.

    ``action`` is ``add`` or ``remove``; other values and null domains or dates are ignored.  Of
    entries of one domain with the same date, a removal wins.  Repeated additions extend an
    interval rather than start one, so intervals of a domain never overlap.

    The window holds the changes of one domain on distinct dates, after grouping, so it is
    bounded by the dates on which a list was published.
    """
    name = F.rtrim(F.lower(F.trim(F.col(domain).cast("string"))), F.lit("."))
    known = entries.select(name.alias("domain"), F.col(action).alias("action"), F.col(since).cast("timestamp").alias("at"))
    known = known.where(F.col("action").isin("add", "remove") & F.col("at").isNotNull() & (F.col("domain") != ""))
    state = known.groupBy("domain", "at").agg(F.min(F.col("action") == "add").alias("on"))
    w = Window.partitionBy("domain").orderBy("at")
    changes = state.withColumn("_was", F.lag("on", 1, False).over(w)).where(F.col("on") != F.col("_was"))
    ends = changes.withColumn("valid_to", F.lead("at").over(w))
    return ends.where("on").select("domain", F.col("at").alias("valid_from"), "valid_to")


def judge(captures: DataFrame, entries: DataFrame, *, url: str = "url", fetched: str = "fetched_at") -> DataFrame:
    """Adds ``blocked``, ``list_domain`` and ``listed_since`` to every capture.

    The most specific domain that was listed at the fetch time decides (the host itself before
    its parents).  A capture without a host or fetch time is not blocked.  Repeated captures are
    judged each, an empty table gives an empty result, an empty list blocks nothing.  Input columns
    of the added names are replaced.

    Distinct pairs of host and time are judged once and joined back by value, so the result does
    not depend on how the captures are read.  A pair and an interval meet on (domain, time bucket,
    part), so neither a common host nor a common parent domain is one task; there are several parts
    only where a domain has many pairs in a bucket.  Intervals of a domain do not overlap, so a pair
    meets at most one interval per domain.
    """
    at, name = F.col(fetched).cast("timestamp"), host(F.col(url))
    plain = captures.drop("blocked", "list_domain", "listed_since")
    pairs = written(plain.select(name.alias("_url_host"), at.alias("_url_at")).where(
        "_url_host is not null and _url_at is not null").distinct())
    bucket = lambda c: F.floor(F.unix_timestamp(c) / BUCKET_SECONDS)
    asked = pairs.select("*", bucket(F.col("_url_at")).alias("bucket"), F.explode(domains(F.col("_url_host"))).alias("domain"))
    # every hot key stands for HOT_ROWS captures, so there are few; they are counted before they are broadcast
    parts = F.least(F.ceil(F.col("count") / HOT_ROWS), F.lit(MOST_PARTS)).cast("int")
    hot = known_small(written(asked.groupBy("domain", "bucket").count().where(F.col("count") > HOT_ROWS).select("domain", "bucket", parts.alias("parts"))))
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("_url_host", "_url_at"), F.col("parts"))).cast("int")
    asked = asked.join(hot, ["domain", "bucket"], "left").withColumn("part", part).drop("parts")
    # intervals are followed from the first capture to the last: two numbers, which fit into the plan
    first, last = pairs.agg(F.min(bucket(F.col("_url_at"))), F.max(bucket(F.col("_url_at")))).first()
    begin = F.greatest(bucket(F.col("valid_from")), F.lit(first))
    end = F.least(F.coalesce(bucket(F.col("valid_to")), F.lit(last)), F.lit(last))
    spread = intervals(entries).withColumns({"_begin": begin, "_end": end}).where("_begin <= _end").select(
        "domain", "valid_from", "valid_to", F.explode(F.sequence("_begin", "_end")).alias("bucket"))
    spread = spread.join(hot, ["domain", "bucket"], "left").select(
        "domain", "valid_from", "valid_to", "bucket", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    met = asked.join(spread, ["domain", "bucket", "part"]).where(
        (F.col("valid_from") <= F.col("_url_at")) & (F.col("valid_to").isNull() | (F.col("_url_at") < F.col("valid_to"))))
    best = written(met.groupBy("_url_host", "_url_at").agg(
        F.max_by(F.struct("domain", "valid_from"), F.length("domain")).alias("_url_hit")))
    return plain.withColumns({"_url_host": name, "_url_at": at}).join(best, ["_url_host", "_url_at"], "left").select(
        *plain.columns, F.col("_url_hit").isNotNull().alias("blocked"),
        F.col("_url_hit.domain").alias("list_domain"), F.col("_url_hit.valid_from").alias("listed_since"))
