"""The row before and after, also where one key holds a large part of all rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def beside(df: DataFrame, keys: list[str], order: list[str], want: dict[str, tuple[str, int]], bucket: Column | None = None) -> DataFrame:
    """Add columns with a value of the previous (-1) or next (+1) row of the key.

    want: new column -> (column, -1 or +1). Without bucket it is one sorted window per key. With bucket, a
    non-decreasing function of the first order column, each (key, bucket) is sorted on its own and only the first
    and last row of a bucket meet those of the other buckets, so no task ever sorts a whole key. A key without a
    neighbour gets null.
    """
    if bucket is None:
        w = Window.partitionBy(*keys).orderBy(*order)
        return df.withColumns({new: (F.lag(c) if step < 0 else F.lead(c)).over(w) for new, (c, step) in want.items()})
    parts = [*keys, "_bucket"]
    inner = Window.partitionBy(*parts).orderBy(*order)
    cols = sorted({c for c, _ in want.values()})
    own = df.withColumn("_bucket", bucket).withColumns({
        "_first": F.lag(F.lit(1)).over(inner).isNull(),
        "_last": F.lead(F.lit(1)).over(inner).isNull(),
        **{new: (F.lag(c) if step < 0 else F.lead(c)).over(inner) for new, (c, step) in want.items()},
    })
    value = F.struct(*order, *[F.col(c).alias(f"_v_{c}") for c in cols])
    outer = Window.partitionBy(*keys).orderBy("_bucket")
    ends = (
        own.filter("_first or _last").groupBy(*parts)
        .agg(F.max(F.when(F.col("_first"), value)).alias("_head"), F.max(F.when(F.col("_last"), value)).alias("_tail"))
        .withColumns({"_before": F.lag("_tail").over(outer), "_after": F.lead("_head").over(outer)})
        .select(*parts, "_before", "_after")
    )
    on = [F.col(f"o.{k}").eqNullSafe(F.col(f"e.{k}")) for k in parts]
    both = own.alias("o").join(ends.alias("e"), on, "left")
    edge = {-1: ("_first", "_before"), 1: ("_last", "_after")}
    out = [F.col(f"o.{c}") for c in df.columns]
    for new, (c, step) in want.items():
        flag, side = edge[step]
        out.append(F.when(F.col(f"o.{flag}"), F.col(f"e.{side}")[f"_v_{c}"]).otherwise(F.col(f"o.{new}")).alias(new))
    return both.select(*out)
