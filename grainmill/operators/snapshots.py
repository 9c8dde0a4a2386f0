"""What changed between full snapshots, by content-defined chunks of the sorted keys."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.ids import row_digest
from grainmill.session import broadcast_if_small, cut

#: Ids of a chunk on average. A chunk is discarded if none of its ids changed: with four that is 47 % of the rows of the sf0.1 tables (16: 10 %).
MEAN_CHUNK = 4
#: The attributes by which two states of a node differ.
STATE = ["type", "layer", "title", "summary", "confidence", "source", "is_active"]


def _label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number the chunks of a partition that is sorted by id: a new one begins where a boundary id is first met."""
    chunk, last = 0, None
    for b in batches:
        ids, edge = b.column("id"), b.column("boundary")
        if not b.num_rows:
            continue
        before = pa.concat_arrays([pa.array([last], ids.type), ids.slice(0, len(ids) - 1)])
        fresh = pc.fill_null(pc.not_equal(ids, before), True)
        steps = pc.cumulative_sum(pc.cast(pc.and_(edge, fresh), pa.int64()))
        labels = pc.add(steps, chunk)
        chunk, last = labels[-1].as_py(), ids[-1].as_py()
        yield pa.RecordBatch.from_arrays(
            [b.column("part"), labels, b.column("snapshot_id"), ids, b.column("digest")],
            ["part", "chunk", "snapshot_id", "id", "digest"],
        )


def states(snapshots: DataFrame, columns: list[str] = STATE) -> DataFrame:
    """(snapshot_id, id, digest): of an id repeated in a snapshot the highest version, then the latest updated_at holds.

    Rows without snapshot_id or with a null or empty id don't count. Where version and time are equal too, the
    greatest digest holds, so the result doesn't depend on row order.
    """
    return (
        snapshots.filter("snapshot_id is not null and id is not null and id <> ''")
        .select("snapshot_id", "id", F.struct("version", "updated_at", row_digest(*[F.col(c) for c in columns]).alias("digest")).alias("s"))
        .groupBy("snapshot_id", "id").agg(F.max("s").alias("s"))
        .select("snapshot_id", "id", F.col("s.digest").alias("digest"))
    )


def chunked(rows: DataFrame, mean_chunk: int = MEAN_CHUNK) -> DataFrame:
    """Sort all snapshots by id together and cut the ids into chunks where an id's hash says so.

    Boundaries depend on ids alone, so an added or removed id disturbs only its own chunk. The labelled rows are
    written to the shared folder once: range bounds are sampled and must not be drawn twice.
    """
    ranged = (
        rows.withColumn("boundary", F.pmod(F.xxhash64("id"), F.lit(mean_chunk)) == 0)
        .repartitionByRange("id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("id")
    )
    return cut(ranged.mapInArrow(_label, "part int, chunk long, snapshot_id string, id string, digest string"))


def changes(snapshots: DataFrame, columns: list[str] = STATE, mean_chunk: int = MEAN_CHUNK) -> DataFrame:
    """(snapshot_id, id, change): added, removed or changed ids from each snapshot to the next.

    Digests of the chunks of neighbouring snapshots are compared first; only rows of chunks that differ are joined.
    Values differ exactly (null equals null, null is not ''). The first snapshot and an empty table give no rows;
    version and updated_at only choose between repeated rows.
    """
    labelled = chunked(states(snapshots, columns), mean_chunk)
    order = Window.orderBy("snapshot_id")  # one row per snapshot, whatever their size
    pairs = labelled.select("snapshot_id").distinct().withColumn("before", F.lag("snapshot_id").over(order)).filter("before is not null")
    later, earlier = broadcast_if_small(pairs), broadcast_if_small(pairs.withColumnRenamed("snapshot_id", "pair"))
    digests = labelled.groupBy("snapshot_id", "part", "chunk").agg(
        F.count("*").alias("n"), F.bit_xor(F.xxhash64("id", "digest")).alias("x"), F.bit_xor(F.xxhash64("digest", "id")).alias("y"))
    side = digests.select("snapshot_id", "part", "chunk", F.struct("n", "x", "y").alias("d"))
    new = side.join(later, "snapshot_id").select(F.col("snapshot_id").alias("pair"), "part", "chunk", F.col("d").alias("after"))
    old = side.join(earlier, F.col("snapshot_id") == F.col("before")).select("pair", "part", "chunk", F.col("d").alias("was"))
    open_chunks = new.join(old, ["pair", "part", "chunk"], "full").filter(~F.col("after").eqNullSafe(F.col("was"))).select("pair", "part", "chunk")
    sides = (
        labelled.join(later, "snapshot_id").select(F.col("snapshot_id").alias("pair"), "part", "chunk", "id", "digest", F.lit(True).alias("now"))
        .unionByName(
            labelled.join(earlier, F.col("snapshot_id") == F.col("before"))
            .select("pair", "part", "chunk", "id", "digest", F.lit(False).alias("now")))
        .join(open_chunks, ["pair", "part", "chunk"], "left_semi")
    )
    both = sides.groupBy("pair", "id").agg(
        F.max(F.when(F.col("now"), F.col("digest"))).alias("after"), F.max(F.when(~F.col("now"), F.col("digest"))).alias("was"))
    change = F.when(F.col("was").isNull(), "added").when(F.col("after").isNull(), "removed").when(F.col("was") != F.col("after"), "changed")
    return both.withColumn("change", change).filter("change is not null").select(F.col("pair").alias("snapshot_id"), "id", "change")
