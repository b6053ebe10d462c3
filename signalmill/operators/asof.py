"""As-of values without a window over a whole session: buckets of time, carried values between them, a fill within each.

Rows are dealt by session and bucket, so a session of any length fills many tasks. In its bucket each row takes the last value up to it; the
last row of a bucket has what the bucket hands on; these rows, one for each bucket, meet by session in order; and what came before a bucket fills what
its first rows still lack. The rows themselves are shuffled once, which both their fill and the buckets' last rows use.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scratch import unused

#: Seconds of a bucket, unless another length is asked for.
BUCKET_S = 600.0


def last_known(rows: DataFrame, columns: Sequence[str], order: Sequence[Column | str], keys: Sequence[str] = ("session_id",), bucket_s: float = BUCKET_S) -> DataFrame:
    """The rows with each of the columns at its last value that isn't null, up to and with the row, in the given order; the order's first column is t in
    seconds. Rows with a null key take values of their own bucket only."""
    slot = unused(rows, "slot")
    dealt = rows.withColumn(slot, F.floor(F.col("t") / bucket_s)).repartition(*keys, slot)
    at = [*keys, slot]
    local = Window.partitionBy(*at).orderBy(*order)
    upto = local.rowsBetween(Window.unboundedPreceding, 0)
    final = unused(rows, "final")
    filled = dealt.withColumns({**{c: F.last(c, ignorenulls=True).over(upto) for c in columns}, final: F.lead(F.lit(1)).over(local).isNull()})
    earlier = Window.partitionBy(*keys).orderBy(slot).rowsBetween(Window.unboundedPreceding, -1)
    # read under other names, as both come from the same rows
    names = {c: unused(rows, f"{c}_before") for c in columns}
    # always true: with all columns asked for, the last rows come from the same exchange as the rows, which then are computed once
    ends = filled.filter(F.col(final) & (F.hash(*rows.columns) >= -(2**31))).select(*at, *columns)
    before = ends.select(*(F.col(k).alias(unused(rows, f"{k}_of")) for k in at), *(F.last(c, ignorenulls=True).over(earlier).alias(names[c]) for c in columns))
    same = [filled[k] == before[unused(rows, f"{k}_of")] for k in at]
    joined = filled.join(before, same, "left")
    return joined.select(*(F.coalesce(filled[c], before[names[c]]).alias(c) if c in columns else filled[c] for c in rows.columns))
