"""URL filters by a sort-merge range join over reversed-host keys.

A host's labels, reversed and each ended by a separator, make a key under which a rule's host and all its subdomains
are one interval: the keys that start with the rule's. Urls and rules are cut into ranges of this key (with the path
behind it, so that a host with a third of all rows falls into many ranges), sorted, and swept once: a rule is pushed
when its interval begins and popped when it ends, so the stack holds the nested rules that are active at a url. The
longest of them whose path the url's path starts with wins.

The ranges' bounds come from a sample and only spread the work; a rule goes to every range that its interval meets. A key
that fills several ranges alone (one url, many times) makes one range that is dealt to as many tasks by page, its rules
to each. Rules are a stored table of any size; they are cut into ranges like the urls and never broadcast.

Null urls, and urls without ``://``, have an empty host and path, and no rule: they do not enter the sweep. An empty rule table leaves every url to
the default. Of two rules with the same host and path the one that blocks wins. Repeated urls are judged each.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import narrow, range_of

#: Parts a label from the next one; sorts below all characters of a host.
_END = "\x01"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; empty where there are none."""
    found = F.coalesce(F.instr(url, "://") > 0, F.lit(False))
    rest = F.substring_index(url.substr(F.instr(url, "://") + 3, F.length(url)), "#", 1)
    rest = F.substring_index(rest, "?", 1)
    host = F.translate(F.substring_index(rest, "/", 1), _UPPER, _LOWER)
    path = F.when(F.instr(rest, "/") > 0, rest.substr(F.instr(rest, "/"), F.length(rest))).otherwise("")
    return F.when(found, host).otherwise(""), F.when(found, path).otherwise("")


def host_key(host: Column) -> Column:
    return F.when(host == "", "").otherwise(F.concat(F.array_join(F.reverse(F.split(host, r"\.")), _END), F.lit(_END)))


def filter_urls(pages: DataFrame, rules: DataFrame, default: str = "allow", parts: int = 0) -> DataFrame:
    """pages: page_id, url. rules: host, path, verdict (allow or block). Returns page_id, url, host, path, rule, verdict."""
    spark = pages.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    host, path = split_url(F.col("url"))
    urls = narrow(pages, "page_id", "url").withColumn("host", host).withColumn("path", path)
    urls = urls.withColumn("key", host_key(F.col("host"))).withColumn("sort", F.concat("key", "path"))
    rules = rules.select("host", "path", "verdict").where("host IS NOT NULL AND path IS NOT NULL").groupBy("host", "path").agg(F.max("verdict").alias("verdict")).withColumn("key", host_key(F.col("host")))
    bounds, fans = _bounds(urls, parts)
    out = "page_id long, url string, host string, path string, rule string, verdict string"
    hostless = urls.where("host = ''").select("page_id", "url", "host", "path", F.lit(None).cast("string").alias("rule"), F.lit(default).alias("verdict"))

    def fan(number: Column) -> Column:
        return F.get(F.lit(fans), number)

    u = urls.where("host <> ''").withColumn("range", range_of(F.col("sort"), bounds)).withColumn("deal", F.pmod(F.xxhash64("page_id"), fan(F.col("range"))).cast("int"))
    u = u.select("range", "deal", "key", F.lit(1).alias("kind"), "page_id", "url", "host", "path", F.lit(None).cast("string").alias("verdict"))
    r = rules.withColumn("range", F.explode(F.sequence(range_of(F.col("key"), bounds), range_of(F.concat("key", F.lit("\U0010ffff")), bounds))))
    r = r.withColumn("deal", F.explode(F.sequence(F.lit(0), fan(F.col("range")) - 1)))
    r = r.select("range", "deal", "key", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("page_id"), F.lit(None).cast("string").alias("url"), "host", "path", "verdict")

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stack: list[tuple[str, str, str, str]] = []
        at = None
        for batch in batches:
            out = []
            for x in batch.to_pylist():
                if (x["range"], x["deal"]) != at:
                    at, stack = (x["range"], x["deal"]), []
                while stack and not x["key"].startswith(stack[-1][0]):
                    stack.pop()
                if not x["kind"]:
                    stack.append((x["key"], x["host"], x["path"], x["verdict"]))
                    continue
                fits = [s for s in stack if x["path"].startswith(s[2]) and (x["host"] == s[1] or x["host"].endswith("." + s[1]))]
                best = max(fits, key=lambda s: (len(s[1]) + len(s[2]), len(s[1])), default=None)
                out.append((x["page_id"], x["url"], x["host"], x["path"], best and best[1] + best[2], best[3] if best else default))
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], pa.string() if i else pa.int64()) for i in range(6)], ["page_id", "url", "host", "path", "rule", "verdict"])

    rows = u.unionByName(r).repartition(parts, "range", "deal").sortWithinPartitions("range", "deal", "key", "kind")
    return rows.mapInArrow(sweep, out).unionByName(hostless)


def _bounds(urls: DataFrame, parts: int) -> tuple[list[str], list[int]]:
    """Up to parts - 1 keys that cut the urls about evenly, from about 100 sampled keys for each range, equal ones counted
    where they are; and to how many tasks each range is dealt."""
    urls = urls.where("host <> ''")
    n = urls.count()
    sample = urls.where(F.pmod(F.xxhash64("page_id", "url"), F.lit(max(1, n // (100 * parts)))) == 0)
    found = sorted((r["sort"], r["count"]) for r in sample.groupBy("sort").count().collect())
    total, passed, bounds, fans = sum(c for _, c in found), 0, [], [1]
    for key, count in found:
        # as many ranges as end in this key's share begin with it
        ends = parts * (passed + count) // max(total, 1) - parts * passed // max(total, 1)
        passed += count
        if ends and (passed < total or ends > 1):
            bounds.append(key)
            fans.append(max(1, ends))
    return bounds, fans
