"""Ordered operators that never put a whole group into one task.

A project may hold a third of all rows, so a window partitioned by project alone would run
in one task. Here the group is cut into slices of its integer order column; each slice is
sorted on its own, one summary row per slice is combined, and the summaries are joined back.
Summaries are cut into slices again, so the widest window sees one row per ``span * span``
order values.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SPAN = 4096
_SLICE, _OUTER = "_slice", "_outer"


def _slice(lead: str, span: int) -> Column:
    return F.floor(F.col(lead) / F.lit(span)).cast("long")


def _offsets(totals: DataFrame, group: Sequence[str], span: int) -> DataFrame:
    """Sum of ``_n`` over all earlier slices of the group, per slice (two levels)."""
    totals = totals.withColumn(_OUTER, F.floor(F.col(_SLICE) / span).cast("long"))
    before = Window.partitionBy(*group, _OUTER).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    inner = totals.withColumn("_inside", F.coalesce(F.sum("_n").over(before), F.lit(0)))
    outer_before = Window.partitionBy(*group).orderBy(_OUTER).rowsBetween(Window.unboundedPreceding, -1)
    outer = (
        totals.groupBy(*group, _OUTER)
        .agg(F.sum("_n").alias("_m"))
        .select(*group, _OUTER, F.coalesce(F.sum("_m").over(outer_before), F.lit(0)).alias("_outside"))
    )
    return inner.join(outer, [*group, _OUTER]).select(
        *group, _SLICE, (F.col("_inside") + F.col("_outside")).cast("long").alias("_before")
    )


def running_total(
    df: DataFrame,
    group: Sequence[str],
    lead: str,
    order: Sequence[str],
    value: Column,
    out: str,
    span: int = SPAN,
) -> DataFrame:
    """Running sum of ``value`` in (lead, *order) order within each group."""
    sliced = df.withColumn(_SLICE, _slice(lead, span)).withColumn("_v", value.cast("long"))
    window = Window.partitionBy(*group, _SLICE).orderBy(lead, *order).rowsBetween(Window.unboundedPreceding, 0)
    local = sliced.withColumn("_local", F.sum("_v").over(window))
    totals = sliced.groupBy(*group, _SLICE).agg(F.sum("_v").alias("_n"))
    return (
        local.join(_offsets(totals, group, span), [*group, _SLICE])
        .withColumn(out, (F.col("_local") + F.col("_before")).cast("long"))
        .drop(_SLICE, "_v", "_local", "_before")
    )


def running_max(df: DataFrame, group: Sequence[str], lead: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """Largest ``value`` of all earlier rows of the group in ``lead`` order; null for the first."""
    sliced = df.withColumn(_SLICE, _slice(lead, span)).withColumn("_v", value)
    earlier = lambda order, *keys: Window.partitionBy(*group, *keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    tops = sliced.groupBy(*group, _SLICE).agg(F.max("_v").alias("_top")).withColumn(_OUTER, F.floor(F.col(_SLICE) / span).cast("long"))
    outer = tops.groupBy(*group, _OUTER).agg(F.max("_top").alias("_far")).select(*group, _OUTER, F.max("_far").over(earlier(_OUTER)).alias("_far"))
    before = tops.withColumn("_mid", F.max("_top").over(earlier(_SLICE, _OUTER))).join(outer, [*group, _OUTER]).select(*group, _SLICE, F.greatest("_mid", "_far").alias("_prior"))
    local = sliced.withColumn("_near", F.max("_v").over(earlier(lead, _SLICE)))
    return local.join(before, [*group, _SLICE]).withColumn(out, F.greatest("_near", "_prior")).drop(_SLICE, "_v", "_near", "_prior")


def number_rows(
    df: DataFrame, group: Sequence[str], lead: str, order: Sequence[str] = (), out: str = "row_no", span: int = SPAN
) -> DataFrame:
    """1-based position of each row in (lead, *order) order within its group."""
    return running_total(df, group, lead, order, F.lit(1), out, span)


def carry_last(
    df: DataFrame,
    group: Sequence[str],
    lead: str,
    value: Column,
    out: str,
    keep: Column | None = None,
    inclusive: bool = False,
    span: int = SPAN,
) -> DataFrame:
    """``value`` of the nearest earlier row of the group for which ``keep`` holds.

    With ``keep`` unset this is ``lag``; with ``inclusive`` the row itself counts, which is a
    forward fill. ``lead`` must order the group uniquely.
    """
    held = F.struct(value.alias("v"))
    held = held if keep is None else F.when(keep, held)
    sliced = df.withColumn(_SLICE, _slice(lead, span)).withColumn("_held", held)
    last_row = 0 if inclusive else -1
    window = Window.partitionBy(*group, _SLICE).orderBy(lead).rowsBetween(Window.unboundedPreceding, last_row)
    local = sliced.withColumn("_near", F.last("_held", ignorenulls=True).over(window))
    ends = (
        sliced.groupBy(*group, _SLICE)
        .agg(F.max_by("_held", F.when(F.col("_held").isNotNull(), F.col(lead))).alias("_end"))
        .withColumn(_OUTER, F.floor(F.col(_SLICE) / span).cast("long"))
    )
    before = Window.partitionBy(*group, _OUTER).orderBy(_SLICE).rowsBetween(Window.unboundedPreceding, -1)
    outer_before = Window.partitionBy(*group).orderBy(_OUTER).rowsBetween(Window.unboundedPreceding, -1)
    outer = (
        ends.groupBy(*group, _OUTER)
        .agg(F.max_by("_end", F.when(F.col("_end").isNotNull(), F.col(_SLICE))).alias("_tail"))
        .select(*group, _OUTER, F.last("_tail", ignorenulls=True).over(outer_before).alias("_far"))
    )
    inner = (
        ends.withColumn("_mid", F.last("_end", ignorenulls=True).over(before))
        .join(outer, [*group, _OUTER])
        .select(*group, _SLICE, F.coalesce("_mid", "_far").alias("_prior"))
    )
    return (
        local.join(inner, [*group, _SLICE])
        .withColumn(out, F.coalesce("_near", "_prior")["v"])
        .drop(_SLICE, "_held", "_near", "_prior")
    )


def previous(df: DataFrame, group: Sequence[str], lead: str, value: Column, out: str, span: int = SPAN) -> DataFrame:
    """``lag(value)`` over the group without a group-wide window."""
    return carry_last(df, group, lead, value, out, span=span)


def top_per_group(
    df: DataFrame, group: Sequence[str], order: Sequence[Column], k: int, salt: Sequence[str], fan: int = 32
) -> DataFrame:
    """First ``k`` rows of each group; a large group is first thinned in ``fan`` salted parts."""
    salted = df.withColumn("_salt", F.pmod(F.xxhash64(*salt), F.lit(fan)))
    part = Window.partitionBy(*group, "_salt").orderBy(*order)
    whole = Window.partitionBy(*group).orderBy(*order)
    thinned = salted.withColumn("_r", F.row_number().over(part)).filter(F.col("_r") <= k).drop("_r", "_salt")
    return thinned.withColumn("rank", F.row_number().over(whole)).filter(F.col("rank") <= k)


def content_fingerprint(df: DataFrame, group: Sequence[str], name: Column, digest: Column, salt: str) -> DataFrame:
    """One hash per group over its (name, digest) rows, independent of row order.

    Each row's SHA-256 is read as eight 32-bit numbers; their sums are plain partial
    aggregates, so a group of any size is combined on the map side and never listed.
    """
    row = F.sha2(F.concat_ws("|", F.length(name).cast("string"), name, digest), 256)
    lanes = [
        F.sum(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("decimal(20,0)")).alias(f"_s{i}") for i in range(8)
    ]
    summed = df.groupBy(*group).agg(F.count(F.lit(1)).alias("items"), *lanes)
    joined = F.concat_ws("|", F.lit(salt), F.col("items").cast("string"), *[F.col(f"_s{i}").cast("string") for i in range(8)])
    return summed.select(*group, "items", F.sha2(joined, 256).alias("fingerprint"))
