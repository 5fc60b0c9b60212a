"""Transfers against the values known then, and what became of the values at fixed horizons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.scalar import DECIMAL, SIGNED, age, age_band, fee_status, lag_status, ratio, to_amount
from ..operators.asof import asof_backward
from .params import Params


def transfers(raw: DataFrame, valuations: DataFrame, cutoff) -> DataFrame:
    """``raw`` (transfer_key, entity_key, transfer_date, fee_text, other columns) with fee, status and the value known at the date."""
    d = raw.withColumn("fee", to_amount(F.col("fee_text"), SIGNED)).withColumn("fee_status", fee_status(F.col("fee_text")))
    d = asof_backward(d, valuations, "entity_key", "transfer_date", "valuation_date", {"matched_date": "valuation_date", "value_at_transfer": "market_value"}, like=raw.select("entity_key", "transfer_date"))
    lag = F.datediff("transfer_date", "matched_date")
    priced = (F.col("fee_status") == "numeric_fee") & (F.col("value_at_transfer") > 0)
    d = d.withColumns({"lag_days": lag, "match_status": lag_status(lag, same_day=True), "fee_vs_value": F.when(priced, F.col("fee") - F.col("value_at_transfer"))})
    d = d.withColumn("fee_premium_pct", ratio("fee_vs_value * 100", "CASE WHEN fee_vs_value IS NOT NULL THEN value_at_transfer END", 4))
    eligible = F.coalesce(F.col("fee_text").rlike(DECIMAL) & (F.col("fee_text").try_cast("decimal(38,10)") > 0), F.lit(False))
    return d.withColumns({"is_fee_analysis_eligible": eligible, "is_historical": F.col("transfer_date") <= cutoff})


def club_match(after: Column, to: Column) -> Column:
    """Whether the club of a later valuation is that of the transfer. The labels are fixed values of the method."""
    unknown = after.isNull() | to.isNull()
    return F.when(unknown, "club_comparison_unavailable").when(after == to, "matches_destination_club").otherwise("different_club_at_post_valuation")


def outcomes(transfer: DataFrame, valuations: DataFrame, entities: DataFrame, snapshot, p: Params, like: DataFrame | None = None) -> DataFrame:
    """One row for each historical transfer and horizon: the latest value after the transfer and up to the target date.

    ``snapshot`` is the last date of the valuations; a horizon that ends later isn't matured.
    ``like`` (an entity and a date) is read to find entities with very many transfers.
    """
    d = transfer.where("is_historical").withColumn("horizon_months", F.explode(F.lit(list(p.horizons))))
    d = d.withColumn("target_date", F.add_months("transfer_date", F.col("horizon_months")))
    d = asof_backward(d, valuations, "entity_key", "target_date", "valuation_date", {"post_date": "valuation_date", "post_value": "market_value"}, after="transfer_date", like=like)
    lag = F.datediff("target_date", "post_date")
    matured = F.col("target_date") <= snapshot
    base = (F.col("value_at_transfer") > 0) & F.col("lag_days").between(0, p.maximum_valuation_lag_days)
    post = (F.col("post_value") > 0) & lag.between(0, p.maximum_target_lag_days)
    # The labels are fixed values of the method.
    status = (
        F.when(F.col("post_date").isNull(), "no_post_valuation").when(~matured, "horizon_not_matured").when(lag > p.maximum_target_lag_days, "post_valuation_too_old")
        .when(F.col("post_value") <= 0, "post_value_nonpositive").otherwise("post_valuation_eligible")
    )
    all_fine = matured & base & post
    d = d.withColumns({"post_lag_days": lag, "is_matured": matured, "has_baseline": base, "has_post_value": post, "is_change_eligible": all_fine, "post_status": status})
    d = d.withColumn("value_change", F.when(F.col("is_change_eligible"), F.col("post_value") - F.col("value_at_transfer")))
    d = d.withColumn("value_growth_pct", ratio("value_change * 100", "CASE WHEN value_change IS NOT NULL THEN value_at_transfer END", 4))
    d = d.join(entities.select("entity_key", "date_of_birth"), "entity_key", "left").withColumn("age_at_transfer", age(F.col("transfer_date"), F.col("date_of_birth"))).drop("date_of_birth")
    return d.withColumn("age_band_at_transfer", age_band(F.col("age_at_transfer")))


def outcome_summary(outcome: DataFrame) -> DataFrame:
    """Counts, coverage and average and median change by horizon and fee status."""
    fine = F.col("is_change_eligible")
    return outcome.groupBy("horizon_months", "fee_status").agg(
        F.count("*").alias("transfers"), F.count_if("is_matured").alias("matured"), F.count_if("has_baseline").alias("with_baseline"),
        F.count_if("has_post_value").alias("with_post_value"), F.count_if(fine).alias("change_eligible"),
        F.sum(F.when(fine, F.col("value_change"))).alias("total_change"), F.percentile(F.when(fine, F.col("value_change")), F.lit(0.5)).alias("median_change"),
        F.percentile(F.when(fine, F.col("value_growth_pct")), F.lit(0.5)).alias("median_growth_pct"),
        F.min(F.when(fine, F.col("post_date"))).alias("earliest_post_date"), F.max(F.when(fine, F.col("post_date"))).alias("latest_post_date"),
    ).withColumn("coverage_pct", F.expr("CAST((2 * change_eligible * 1000000 + transfers) div (2 * transfers) AS DOUBLE) / 10000")).withColumn("average_change", F.expr("CASE WHEN change_eligible > 0 THEN sign(total_change) * CAST((2 * abs(total_change) * 100 + change_eligible) div (2 * change_eligible) AS DOUBLE) / 100 END")).drop("total_change")
