"""Rules of the publishing model as queries for their violations, and analytics of language-model spending."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def publish_violations(jobs: DataFrame, approvals: DataFrame) -> DataFrame:
    """job_id and rule: no approved approval, no snapshot, or an idempotency key used before."""
    approved = approvals.where("status = 'approved'").select(F.col("approval_id").alias("_a")).distinct()
    rows = jobs.join(approved, F.col("approval_id") == F.col("_a"), "left")
    again = F.row_number().over(Window.partitionBy("idempotency_key").orderBy("job_id")) > 1
    rows = rows.withColumn("_again", again & F.col("idempotency_key").isNotNull())
    broken = F.array_compact(F.array(F.when(F.col("_a").isNull(), F.lit("not_approved")), F.when(F.col("snapshot_before").isNull(), F.lit("no_snapshot")), F.when(F.col("_again"), F.lit("idempotency_key_reused"))))
    return rows.select("job_id", F.explode(broken).alias("rule"))


def check_violations(drafts: DataFrame, approvals: DataFrame) -> DataFrame:
    """Rows that break a CHECK of the model; as in SQL, an unknown check is kept."""
    a = drafts.where("NOT (has_unique_asset = false OR unique_asset_kind IS NOT NULL)").select(F.col("draft_id").alias("id"), F.lit("unique_asset_kind").alias("rule"))
    b = approvals.where("NOT (status = 'pending' OR (reviewer IS NOT NULL AND reviewed_at IS NOT NULL))").select(F.col("approval_id").alias("id"), F.lit("reviewed").alias("rule"))
    return a.unionByName(b)


def over_throttle(jobs: DataFrame, sites: DataFrame) -> DataFrame:
    """Jobs past their site's number of posts a day, in order of time."""
    rows = jobs.join(sites.select("site_id", "max_posts_per_day"), "site_id")
    place = F.row_number().over(Window.partitionBy("site_id", F.to_date("at")).orderBy("at", "job_id"))
    return rows.withColumn("place", place).where(F.col("place") > F.col("max_posts_per_day")).select("job_id", "site_id", "place")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str) -> DataFrame:
    """Rows whose reference finds nothing; a null reference is no reference."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col(parent_key).alias("_p")).distinct(), F.col(key) == F.col("_p"), "left_anti")


def running_spend(calls: DataFrame) -> DataFrame:
    """Adds each call's spend so far in its tenant's month.

    Days are summed first and run on from one to the next, a row a day; calls are ordered within their day only, so a tenant of many
    calls is a task a day and not one.
    """
    day, month = F.to_date("at"), F.date_trunc("month", "at")
    days = calls.groupBy("tenant_id", month.alias("_month"), day.alias("_day")).agg(F.sum("cost_usd").alias("_sum"))
    earlier = Window.partitionBy("tenant_id", "_month").orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)
    days = days.select(F.col("tenant_id").alias("_tenant"), "_day", F.coalesce(F.sum("_sum").over(earlier), F.lit(0)).alias("_before"))
    so_far = Window.partitionBy("tenant_id", "_day").orderBy("at", "call_id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    own = calls.withColumn("_day", day).withColumn("_own", F.coalesce(F.sum("cost_usd").over(so_far), F.lit(0))).withColumnRenamed("_day", "_call_day")
    both = own.join(days, own["tenant_id"].eqNullSafe(days["_tenant"]) & own["_call_day"].eqNullSafe(days["_day"]), "left")
    return both.withColumn("spent", F.col("_before") + F.col("_own")).select(*calls.columns, "spent")


def first_breach(calls: DataFrame, limit: float) -> DataFrame:
    """The first call of each tenant and month after which the limit is passed; spending all of it passes nothing."""
    over = running_spend(calls).where(F.col("spent") > limit).withColumn("month", F.date_format(F.date_trunc("month", "at"), "yyyy-MM"))
    return over.groupBy("tenant_id", "month").agg(F.min_by("call_id", F.struct("at", "call_id")).alias("call_id"), F.min("spent").alias("spent"))


def fallback_rate(calls: DataFrame) -> DataFrame:
    """By provider: calls, those that another provider should have answered, their share, and spending."""
    return calls.groupBy("provider").agg(F.count("*").alias("calls"), F.count("fallback_from").alias("fallbacks"), (F.count("fallback_from") / F.count("*")).alias("fallback_share"), F.sum("cost_usd").alias("cost_usd"))
