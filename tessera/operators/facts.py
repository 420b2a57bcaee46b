"""The fact store as functions of DataFrames: keys, upserts, lookups, roll-ups, deltas, checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators.filters import visible

KEY = ["metric_code", "entity", "period_type", "period", "channel"]


def dim_key() -> Column:
    """Canonical JSON key; geography is not part of it."""
    return F.to_json(F.struct(F.col("channel"), F.col("entity"), F.col("metric_code").alias("metric"), F.concat("period_type", "period").alias("period")))


def last_wins(facts: DataFrame, order: list[str]) -> DataFrame:
    """One row per key, the last by ``order``; aggregated with a partial step, so a hot key is reduced before the shuffle."""
    rest = [c for c in facts.columns if c not in KEY]
    return facts.groupBy(*KEY).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*KEY, "s.*")


def first_wins(facts: DataFrame, order: list[str]) -> DataFrame:
    """One row per key, the first by ``order``."""
    rest = [c for c in facts.columns if c not in KEY]
    return facts.groupBy(*KEY).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("s")).select(*KEY, "s.*")


def upsert(old: DataFrame, new: DataFrame, order: list[str]) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key."""
    both = old.withColumn("_batch", F.lit(0)).unionByName(new.withColumn("_batch", F.lit(1)))
    return last_wins(both, ["_batch", *order]).drop("_batch")


def delete_by_source(facts: DataFrame, sources: DataFrame) -> DataFrame:
    """Facts of none of the source documents."""
    return facts.join(sources, "source_doc_id", "left_anti")


def lookup(requests: DataFrame, facts: DataFrame, show_all: bool = False) -> DataFrame:
    """Requests with value, unit, source and status found or not_found; hidden facts count as not found."""
    seen = facts if show_all else facts.where(visible(F.col("review_status")))
    got = requests.join(seen.select(*KEY, "value", "unit", "source_doc_id", F.lit(True).alias("_f")), KEY, "left")
    return got.withColumn("status", F.when(F.col("_f"), "found").otherwise("not_found")).drop("_f")


def rollup(parents: DataFrame, facts: DataFrame, also: list[str] | None = None) -> DataFrame:
    """Sum and sources over the children of each parent (parent, child) by metric, period and the columns ``also``; null where nothing is found."""
    kids = facts.withColumnRenamed("entity", "child")
    got = parents.join(kids, "child", "left")
    return got.groupBy("parent", "metric_code", "period_type", "period", *(also or [])).agg(
        F.round(F.sum("value"), 4).alias("total"), F.count("value").alias("n_found"), F.array_sort(F.collect_set("child")).alias("children")
    )


def deltas(facts: DataFrame) -> DataFrame:
    """Difference and percent change to the period before within metric, entity, channel, period type and unit; no percent on 0."""
    w = Window.partitionBy("metric_code", "entity", "channel", "period_type", "unit").orderBy("period")
    out = facts.withColumn("before", F.lag("value").over(w)).withColumn("before_period", F.lag("period").over(w)).where(F.col("before").isNotNull() & F.col("value").isNotNull())
    d = F.col("value") - F.col("before")
    return out.withColumn("delta", F.round(d, 4)).withColumn("pct", F.when(F.col("before") != 0, F.round(d / F.col("before") * 100, 4)))


def verify(a: DataFrame, b: DataFrame, tolerance: float) -> DataFrame:
    """Two channels of (key, value) compared: agreed, conflict (priority 10), only_a or only_b (priority 50)."""
    x = a.select(*KEY, F.col("value").alias("va"), F.lit(True).alias("ia"))
    y = b.select(*KEY, F.col("value").alias("vb"), F.lit(True).alias("ib"))
    both = F.col("ia").isNotNull() & F.col("ib").isNotNull()
    close = F.abs(F.col("va") - F.col("vb")) <= tolerance
    j = x.join(y, KEY, "full_outer")
    return j.select(
        *KEY, "va", "vb",
        F.when(both & close, "agreed").when(both, "conflict").when(F.col("ia").isNotNull(), "only_a").otherwise("only_b").alias("verdict"),
        F.when(both & close, 0).when(both, 10).otherwise(50).alias("priority"),
    )


def unpivot(grid: DataFrame, id_col: str, periods: list[str]) -> DataFrame:
    """A grid with one column per period as long rows (id, period, value), empty cells left out."""
    return grid.unpivot([id_col], periods, "period", "value").where(F.col("value").isNotNull())


def expand(intents: DataFrame) -> DataFrame:
    """Sub-tasks of (qid, entities, metrics, periods) in the order entity, metric, period; an axis that is not enumerated counts once."""
    one = lambda c: F.when(F.size(c) > 0, F.col(c)).otherwise(F.array(F.lit(None).cast("string")))
    out = intents.select("qid", F.posexplode(one("entities")).alias("i", "entity"), "metrics", "periods")
    out = out.select("qid", "i", "entity", F.posexplode(one("metrics")).alias("j", "metric"), "periods")
    out = out.select("qid", "i", "j", "entity", "metric", F.posexplode(one("periods")).alias("k", "period"))
    return out.withColumn("ordinal", F.row_number().over(Window.partitionBy("qid").orderBy("i", "j", "k"))).select("qid", "ordinal", "entity", "metric", "period")
