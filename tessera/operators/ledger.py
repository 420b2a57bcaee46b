"""Review events, ingestion manifests and their metrics as append-only tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def review_state(events: DataFrame, item: str, seq: str, action: str) -> DataFrame:
    """(item, status, decided_seq): the first approve or reject decides, later ones do not count; pending without any."""
    decided = F.col(action).isin("approve", "reject")
    got = events.groupBy(F.col(item).alias("item")).agg(
        F.min_by(F.when(decided, F.col(action)), F.when(decided, F.col(seq))).alias("d"), F.min(F.when(decided, F.col(seq))).alias("decided_seq")
    )
    status = F.when(F.col("d") == "approve", "approved").when(F.col("d") == "reject", "rejected").otherwise("pending")
    return got.select("item", status.alias("status"), "decided_seq")


def illegal(events: DataFrame, item: str, seq: str, action: str) -> DataFrame:
    """Decisions after the deciding one."""
    s = review_state(events, item, seq, action).select(F.col("item").alias(item), "decided_seq")
    return events.join(s, item).where(F.col(action).isin("approve", "reject") & (F.col(seq) > F.col("decided_seq"))).drop("decided_seq")


def apply_decisions(facts: DataFrame, decisions: DataFrame) -> DataFrame:
    """Facts with review_status, value and corrected_by after (fact_id, action, corrected_value, actor); others stay."""
    j = facts.join(decisions, "fact_id", "left")
    return j.withColumn("review_status", F.when(F.col("action") == "approve", "approved").when(F.col("action") == "reject", "rejected").otherwise(F.col("review_status"))).withColumn(
        "value", F.when(F.col("action") == "approve", F.coalesce("corrected_value", "value")).otherwise(F.col("value"))
    ).withColumn("corrected_by", F.when(F.col("corrected_value").isNotNull(), F.col("actor"))).drop("action", "corrected_value", "actor")


def manifest(inputs: DataFrame, batch: str, facts: str, warnings: str, failed: str) -> DataFrame:
    """Totals of every batch."""
    return inputs.groupBy(F.col(batch).alias("batch_id")).agg(
        F.count("*").alias("n_inputs"), F.sum(facts).alias("n_facts"), F.sum(warnings).alias("n_warnings"), F.sum(F.col(failed).cast("int")).alias("n_failed")
    )


def confidence_buckets(facts: DataFrame, conf: str = "confidence") -> DataFrame:
    """One row: facts below 0.5, below 0.8 and the rest; null confidence is in none."""
    c = F.col(conf)
    return facts.agg(
        F.count_if(c < 0.5).alias("low"), F.count_if((c >= 0.5) & (c < 0.8)).alias("mid"), F.count_if(c >= 0.8).alias("high"), F.count_if(c.isNull()).alias("without")
    )


def pending(items: DataFrame, group: str, order: list[str]) -> DataFrame:
    """Open items with their place in the queue of each group: by priority, then ``order``."""
    return items.withColumn("place", F.row_number().over(Window.partitionBy(group).orderBy("priority", *order)))


def enqueue(rows: DataFrame, id_col: str, detail_col: str) -> DataFrame:
    """(item, kind, detail): an item of the queue and a line of the audit for every row."""
    both = F.array(F.struct(F.lit("item").alias("kind"), F.col(detail_col).alias("detail")), F.struct(F.lit("audit").alias("kind"), F.lit("enqueued").alias("detail")))
    return rows.select(F.col(id_col).alias("item"), F.inline(both))
