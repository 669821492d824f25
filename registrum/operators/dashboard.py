"""The dashboard's counts and series from one scan of each table: grouping sets count by every series at once, and the row
of no group holds the totals. Rows: part, series, label (null for totals), measure, value."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def series(df: DataFrame, part: str, dimensions: dict[str, Column], measures: dict[str, Column], totals: dict[str, Column]) -> DataFrame:
    """Each measure by each dimension on its own, and each total over all rows. A null label is a group of its own ('')."""
    names = list(dimensions)
    rows = df.select("*", *[F.coalesce(x.cast("string"), F.lit("")).alias(f"d_{n}") for n, x in dimensions.items()])
    keys = [f"d_{n}" for n in names]
    found = rows.groupingSets([[k] for k in keys] + [[]], *keys).agg(F.grouping_id(*keys).alias("g"), *[x.alias(f"m_{n}") for n, x in measures.items()], *[x.alias(f"t_{n}") for n, x in totals.items()])
    full = (1 << len(keys)) - 1
    # an empty table has no row of no group: it is added, its totals are zero
    found = found.join(df.sparkSession.range(1).select(F.lit(full).cast("long").alias("g")), "g", "full")
    # bit i from the left of g is set where key i is left out
    which = reduce(lambda a, i: F.when(F.col("g") == full ^ (1 << len(keys) - 1 - i), names[i]).otherwise(a), range(len(keys)), F.lit("total"))
    label = F.coalesce(*[F.when(F.col("g") == full ^ (1 << len(keys) - 1 - i), F.col(k)) for i, k in enumerate(keys)], F.lit(None).cast("string"))
    pairs = lambda prefix, of: F.array(*[F.struct(F.lit(n).alias("measure"), F.coalesce(F.col(f"{prefix}{n}").cast("double"), F.lit(0.0)).alias("value")) for n in of])
    values = F.when(F.col("g") == full, pairs("t_", totals)).otherwise(pairs("m_", measures))
    out = found.select(which.alias("series"), label.alias("label"), F.explode(values).alias("v"))
    return out.select(F.lit(part).alias("part"), "series", "label", "v.*").where("label IS NULL OR label <> ''")


def _n() -> Column:
    return F.count(F.lit(1))


def documents(docs: DataFrame) -> DataFrame:
    """By status, language, state and month; states with their processed documents."""
    done = F.count_if(F.col("status") == "PROCESSED")
    by = {"status": F.col("status"), "language": F.col("detected_language"), "state": F.col("state_name"), "month": F.date_format("uploaded_at", "yyyy-MM")}
    return series(docs, "documents", by, {"n": _n(), "processed": done}, {"documents": _n(), "processed": done, "failed": F.count_if(F.col("status") == "FAILED"), "processed_pct": F.coalesce(F.round(100 * done / F.nullif(_n(), F.lit(0)), 1), F.lit(0.0))})


def records(rows: DataFrame) -> DataFrame:
    """By status and state (verified ones); mean confidence in percent, duplicates."""
    is_ = lambda s: F.count_if(F.col("status") == s)
    mean = F.round(F.coalesce(F.avg("overall_confidence"), F.lit(0.0)) * 100, 1)
    return series(rows, "records", {"status": F.col("status"), "state": F.col("state")}, {"n": _n(), "verified": is_("VERIFIED")}, {"verified": is_("VERIFIED"), "pending": is_("PENDING"), "duplicates": F.count_if("is_duplicate"), "avg_confidence": mean})


def issues(found: DataFrame) -> DataFrame:
    """Open issues by rule and severity."""
    return series(found, "issues", {"rule": F.col("rule_code"), "severity": F.col("severity")}, {"n": _n()}, {"open": _n()})


def fields(rows: DataFrame, pending: DataFrame) -> DataFrame:
    """Fields to review of pending records (record_id), and corrected ones."""
    mine = pending.select("record_id", F.lit(True).alias("waits"))
    joined = rows.join(mine, "record_id", "left")
    return series(joined, "fields", {"source": F.col("source")}, {"n": _n()}, {"fields_review": F.count_if(F.col("needs_review") & F.coalesce("waits", F.lit(False))), "corrections": F.count_if((F.col("source") == "manual") & (F.col("value") != ""))})


def learned(memory: DataFrame) -> DataFrame:
    return series(memory, "memory", {"field": F.col("field_name")}, {"n": _n()}, {"learned": _n(), "learned_applied": F.coalesce(F.sum("times_applied"), F.lit(0))})


def trend(rows: DataFrame, most: int = 40) -> DataFrame:
    """The latest records' confidence in percent, a bounded sort of its own; label: the record's number."""
    last = rows.orderBy(F.desc("created_at"), F.desc("record_id")).limit(most)
    return last.select(F.lit("records").alias("part"), F.lit("accuracy").alias("series"), F.concat(F.lit("#"), F.col("record_id").cast("string")).alias("label"), F.lit("confidence").alias("measure"), F.round(F.col("overall_confidence") * 100, 1).alias("value"))


def whole(docs: DataFrame, rows: DataFrame, found: DataFrame, field_rows: DataFrame, memory: DataFrame) -> DataFrame:
    parts = [documents(docs), records(rows), issues(found), fields(field_rows, rows.where("status = 'PENDING'")), learned(memory), trend(rows)]
    return reduce(lambda a, b: a.unionByName(b), parts)
