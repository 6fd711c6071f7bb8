"""Lifecycle decisions: which versions and uploads the rules of a bucket expire."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DAY = 86_400


def matches() -> Column:
    """A version against a rule's filter; null criteria match all, sizes are strict, and of tags (key=value, set apart by
    semicolons) the version must have all that the rule names."""
    have_all = F.forall(F.split("rule_tag", ";"), lambda x: F.array_contains(F.split("tag", ";"), x))
    return (
        F.col("key").startswith(F.col("prefix"))
        & F.coalesce(have_all, F.col("rule_tag").isNull())
        & F.coalesce(F.col("size") > F.col("size_gt"), F.lit(True))
        & F.coalesce(F.col("size") < F.col("size_lt"), F.lit(True))
    )


def enabled(rules: DataFrame) -> DataFrame:
    return rules.where(F.col("status") == "Enabled").withColumnRenamed("tag", "rule_tag")


def expiry(mod_time: Column, days: Column) -> Column:
    """UTC midnight of the modification day plus days + 1."""
    return (F.floor(mod_time / DAY) + days + 1) * DAY


def counted(ranked: DataFrame) -> DataFrame:
    """Adds n, the number of versions of the key."""
    return ranked.withColumn("n", F.count("*").over(Window.partitionBy("bucket", "key")))


def _expires(now: int) -> Column:
    return matches() & (F.coalesce(F.col("exp_date"), expiry(F.col("mod_time"), F.col("exp_days"))) <= now)


def _dangles() -> Column:
    return (F.col("n") == 1) & matches()


def _outlived(now: int) -> Column:
    by_count = F.coalesce(F.col("nc_rank") >= F.col("nc_newer"), F.lit(True))
    by_age = F.coalesce(F.col("mod_time") + F.col("nc_days") * DAY <= now, F.lit(True))
    return F.coalesce("nc_days", "nc_newer").isNotNull() & by_count & by_age


def expired_current(ranked: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """(rule, version) pairs: current versions, not markers, past the rule's date or their own expiry by days."""
    return ranked.where(F.col("is_latest") & ~F.col("is_delete_marker")).join(enabled(rules), "bucket").where(_expires(now))


def dangling_markers(ranked: DataFrame, rules: DataFrame) -> DataFrame:
    """Current delete markers that are their key's only version, where a rule whose filter they match asks for it."""
    return counted(ranked).where(F.col("is_latest") & F.col("is_delete_marker")).join(enabled(rules).where("exp_marker"), "bucket").where(_dangles())


def noncurrent(ranked: DataFrame) -> DataFrame:
    """Noncurrent versions with their rank from 0, newest first."""
    return ranked.where(~F.col("is_latest")).withColumn("nc_rank", F.col("rk") - 2)


def expired_noncurrent(ranked: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """Both bounds must hold where both are set; the rule's filter does not apply."""
    return noncurrent(ranked).join(enabled(rules), "bucket").where(_outlived(now))


def actions(ranked: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """(action, rule, version) of all three kinds, in one pass over the ranked versions."""
    both = counted(ranked).withColumn("nc_rank", F.col("rk") - 2).join(enabled(rules), "bucket")
    current, marker = F.col("is_latest"), F.col("is_delete_marker")
    action = F.when(current & ~marker & _expires(now), "expire").when(current & marker & F.col("exp_marker") & _dangles(), "marker").when(~current & _outlived(now), "noncurrent")
    return both.withColumn("action", action).where("action is not null")


def expired_uploads(uploads: DataFrame, rules: DataFrame, now: int) -> DataFrame:
    """Uploads past the abort threshold of the first rule that matches them."""
    both = uploads.join(enabled(rules).where("abort_days is not null"), "bucket").where(F.col("key").startswith(F.col("prefix")))
    first = F.row_number().over(Window.partitionBy("upload_id").orderBy("pos"))
    return both.withColumn("rn", first).where("rn = 1").where(F.col("initiated") + F.col("abort_days") * DAY <= now)


def rule_errors(rules: DataFrame) -> DataFrame:
    """The first error of each rule, if any."""
    error = (
        F.when(F.col("id") == "", "no id")
        .when(F.count("*").over(Window.partitionBy("bucket", "id")) > 1, "duplicate id")
        .when(~F.col("status").isin("Enabled", "Disabled"), "bad status")
        .when(F.coalesce("exp_days", "exp_date", "nc_days", "nc_newer", "abort_days").isNull() & ~F.col("exp_marker"), "no action")
        .when(F.col("exp_days") < 0, "bad days")
        .when(F.col("exp_days").isNotNull() & F.col("exp_date").isNotNull(), "days and date")
        .when(F.coalesce("exp_days", "exp_date").isNotNull() & F.col("exp_marker"), "marker with days or date")
        .when(F.col("exp_date") % DAY != 0, "date is no midnight")
        .when(F.lower("tag").rlike("(^|;)aws:"), "reserved tag")
        .when(F.col("size_gt") >= F.col("size_lt"), "empty size range")
        .when(F.col("abort_days").isNotNull() & (F.col("tag").isNotNull() | F.col("size_gt").isNotNull()), "abort with tag or size")
        .when(F.col("abort_days") <= 0, "bad abort days")
    )
    return rules.select("bucket", "id", error.alias("error"))
