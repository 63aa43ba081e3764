"""Number text and small formulas."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_number(x: Column) -> Column:
    """Integral values as integers, others with at most two decimals and no trailing zeros."""
    text = F.regexp_replace(F.regexp_replace(F.format_string("%.2f", F.bround(x, 2)), "0+$", ""), r"\.$", "")
    return F.when(x % 1 == 0, F.format_string("%d", x.cast("long"))).otherwise(text)


def plain_number(x: Column) -> Column:
    """Integral values as integers, others as they print."""
    return F.when(x == F.floor(x), x.cast("long").cast("string")).otherwise(x.cast("string"))


def variant_id(chrom: Column, pos: Column, ref: Column, alt: Column) -> Column:
    return F.concat_ws("-", chrom, pos, ref, alt)


def min_max(x: Column, low: Column, high: Column) -> Column:
    """Linear from 0.1 at low to 1 at high; 1 where low equals high."""
    return F.when(high == low, F.lit(1.0)).otherwise((x - low) / (high - low) * 0.9 + 0.1)


def deviations_kept(avg_len: Column, min_len: Column, n_sites: int | Column, power: int = 25) -> Column:
    """How many standard deviations below a site's best score are kept: 0.2 for the longest averages, 3 for the shortest."""
    x = (avg_len - n_sites) / (min_len - n_sites)
    return F.pow(x, F.lit(float(power - 1))) * 2.8 + 0.2
