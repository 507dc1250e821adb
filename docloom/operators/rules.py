"""Rule-based findings in section texts: obligations, prohibitions and numeric bounds."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

PROHIBITED = r"(?i)(?:^|[^a-z])(?:must not|shall not|may not|can not|cannot|never)(?:[^a-z]|$)"
REQUIRED = r"(?i)(?:^|[^a-z])(?:must|shall|required)(?:[^a-z]|$)"
_NEGATED = r"(?i)(?:must|shall)\s+not"


def modal_conflicts(sections: DataFrame, group: str, order: str, key: str) -> DataFrame:
    """(group, required_in, prohibited_in): groups with an obligation and a prohibition, and the first section of each.

    'must' and 'shall' followed by 'not' are no obligations. First means the
    smallest (order, key); both are minima, so groups of any size combine early.
    """
    text = F.regexp_replace(F.col("text"), _NEGATED, " ")
    first = lambda cond: F.min(F.when(cond, F.struct(order, key)))[key]
    rows = sections.where(F.col(group).isNotNull() & F.col("text").isNotNull())
    found = rows.groupBy(group).agg(first(text.rlike(REQUIRED)).alias("required_in"), first(F.col("text").rlike(PROHIBITED)).alias("prohibited_in"))
    return found.where("required_in IS NOT NULL AND prohibited_in IS NOT NULL")


def numeric_bounds(sections: DataFrame, group: str) -> DataFrame:
    """(group, lowest_limit, highest_wait, conflict): upper bounds ('not exceed N') against waits ('wait N') of a group.

    Numbers over 64 bits count as the greatest number of 64 bits.
    """
    numbers = lambda pattern: F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), lambda x: F.coalesce(x.try_cast("long"), F.lit((1 << 63) - 1)))
    rows = sections.where(F.col(group).isNotNull() & F.col("text").isNotNull()).select(group, F.array_min(numbers(r"not exceed ([0-9]+)")).alias("limit"), F.array_max(numbers(r"wait ([0-9]+)")).alias("wait"))
    found = rows.groupBy(group).agg(F.min("limit").alias("lowest_limit"), F.max("wait").alias("highest_wait"))
    return found.where("lowest_limit IS NOT NULL AND highest_wait IS NOT NULL").withColumn("conflict", F.col("highest_wait") > F.col("lowest_limit"))
