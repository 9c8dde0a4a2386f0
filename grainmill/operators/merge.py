"""Writes as set operations: upserts, versioned writes with conflicts, soft deletes, replay."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.schema import NODE_DEFAULTS
from grainmill.session import cut


def current(nodes: DataFrame, *columns: str) -> DataFrame:
    """One row per id with the named columns (all if none): the row of the highest version; rows without id don't count.

    Rows of the same version count once; if they differ, the greatest values hold. The choice is made map-side before the
    shuffle, on the named columns alone.
    """
    want = [c for c in (columns or nodes.columns) if c not in ("id", "version")]
    out = nodes.filter("id is not null").select("id", F.struct("version", *want).alias("r")).groupBy("id").agg(F.max("r").alias("r")).select("id", "r.*")
    return out.select(*[c for c in (columns or nodes.columns)])


def upsert(cur: DataFrame, upd: DataFrame, keys: list[str], defaults: Mapping[str, object] = NODE_DEFAULTS) -> DataFrame:
    """cur with the rows of upd: the columns that upd has are overwritten, nulls included; the others keep their value, or the
    default in a new row. Both sides have unique keys; rows with a null key are dropped from upd."""
    upd = upd.dropna(subset=keys).withColumn("_new", F.lit(True))
    on = [F.col(f"c.{k}") == F.col(f"u.{k}") for k in keys]
    both = cur.alias("c").join(upd.alias("u"), on, "full_outer")

    def value(c: str) -> Column:
        if c in keys:
            return F.coalesce(F.col(f"c.{c}"), F.col(f"u.{c}")).alias(c)
        kind = cur.schema[c].dataType
        if c in upd.columns:
            return F.when(F.col("u._new"), F.col(f"u.{c}").cast(kind)).otherwise(F.col(f"c.{c}")).alias(c)
        if c in defaults:
            return F.when(F.col(f"c.{keys[0]}").isNull(), F.lit(defaults[c]).cast(kind)).otherwise(F.col(f"c.{c}")).alias(c)
        return F.col(f"c.{c}")

    return both.select(*[value(c) for c in cur.columns])


def last_writes(writes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """One row per key: the last by order; used before upsert where a batch writes a key twice."""
    rest = [c for c in writes.columns if c not in (*keys, *order)]
    return writes.groupBy(*keys).agg(F.max(F.struct(*order, *rest)).alias("w")).select(*keys, *[F.col(f"w.{c}").alias(c) for c in (*order, *rest)])


def versioned_writes(writes: DataFrame, base: DataFrame | None = None, order: list[str] | None = None) -> DataFrame:
    """(id, seq, expected_version, actual_version, applied, version) of every write, in order per id, and its other columns.

    writes: (id, expected_version, <order>, ...). A write with an expected version that isn't the current one is a conflict and
    changes nothing, unless the node doesn't exist yet; any other raises the version by one (new nodes get 1). base: (id, version)
    of the nodes there are. Writes without id are dropped; repeated rows are writes of their own.

    Ids without any expected version are numbered by a window. What a conditional write does depends on all before it, so the
    other ids are folded in one sorted pass that holds only the current version, not the group: an id with very many writes
    costs a task time but no memory.
    """
    order = order or ["patch_ts"]
    made = ["seq", "actual_version", "applied", "version"]
    rest = [c for c in writes.columns if c not in ("id", "expected_version", *made)]
    w = writes.filter("id is not null").select("id", F.col("expected_version").cast("int").alias("expected_version"), *rest)
    have = (base.select("id", F.col("version").cast("int").alias("_base")) if base is not None else w.select("id", F.lit(None).cast("int").alias("_base")).limit(0))
    rows = w.join(have, "id", "left")
    conditional = w.filter("expected_version is not null").select("id").distinct()
    columns = ["id", "seq", "expected_version", "actual_version", "applied", "version", *rest]

    numbered = Window.partitionBy("id").orderBy(*order)
    first = F.coalesce("_base", F.lit(0))
    free = rows.join(conditional, "id", "left_anti").withColumn("seq", F.row_number().over(numbered).cast("long")).withColumns({
        "actual_version": F.when((F.col("seq") > 1) | F.col("_base").isNotNull(), (first + F.col("seq") - 1).cast("int")), "applied": F.lit(True), "version": (first + F.col("seq")).cast("int")})

    sorted_rows = rows.join(conditional, "id", "left_semi").repartition("id").sortWithinPartitions("id", *order).select("id", "expected_version", "_base", *rest)
    kinds = dict(sorted_rows.dtypes)

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, now, seq = None, None, 0
        for b in batches:
            ids, expected, start = (b.column(c).to_pylist() for c in ("id", "expected_version", "_base"))
            seqs, actual, applied, after = [], [], [], []
            for i, e, s in zip(ids, expected, start):
                if i != last:
                    last, now, seq = i, s, 0
                seq += 1
                seqs.append(seq)
                actual.append(now)
                ok = e is None or now is None or e == now
                applied.append(ok)
                if ok:
                    now = (now or 0) + 1
                after.append(now)
            yield pa.RecordBatch.from_arrays(
                [b.column("id"), pa.array(seqs, pa.int64()), b.column("expected_version"), pa.array(actual, pa.int32()), pa.array(applied, pa.bool_()), pa.array(after, pa.int32()), *[b.column(c) for c in rest]],
                columns)

    schema = "id string, seq long, expected_version int, actual_version int, applied boolean, version int" + "".join(f", `{c}` {kinds[c]}" for c in rest)
    return free.select(*columns).unionByName(sorted_rows.mapInArrow(fold, schema))


def write_nodes(nodes: DataFrame, writes: DataFrame, order: list[str] | None = None, at: str = "patch_ts") -> tuple[DataFrame, DataFrame, DataFrame]:
    """(nodes, patches, conflicts) after conditional writes to nodes with unique ids.

    writes: (id, expected_version, <at>, <order>, attributes of nodes). Accepted writes (see versioned_writes) are applied in order:
    the attributes given are overwritten, nulls included, version is raised by one each, updated_at becomes the write's time.
    New nodes are active and have their first write's time as created_at; what is soft-deleted stays so. patches: the accepted
    writes, for the log. conflicts: see conflicts. The writes are decided once and stored, since all three come from them.
    """
    order = order or [at]
    given = [c for c in nodes.columns if c in writes.columns and c not in ("id", "version", "created_at", "updated_at")]
    done = cut(versioned_writes(writes, nodes.select("id", "version"), order))
    accepted = done.filter("applied")
    last = (
        accepted.groupBy("id").agg(F.max(F.struct("seq", "version", F.col(at).alias("_at"), *given)).alias("w"), F.min(F.struct("seq", F.col(at).alias("_at"))).alias("f"))
        .select("id", "w.version", F.col("w._at").alias("updated_at"), F.col("f._at").alias("_first"), *[F.col(f"w.{c}").alias(c) for c in given]))
    out = upsert(nodes, last.drop("_first"), ["id"])
    if "created_at" in nodes.columns:
        born = last.select("id", "_first").join(nodes.select("id"), "id", "left_anti")
        out = out.join(born, "id", "left").withColumn("created_at", F.coalesce("created_at", F.col("_first").cast(nodes.schema["created_at"].dataType))).select(*nodes.columns)
    return out, accepted.select("id", "seq", "version", *[c for c in done.columns if c not in ("id", "seq", "version", "applied", "actual_version")]), conflicts(done)


def conflicts(done: DataFrame) -> DataFrame:
    """The refused writes, with the version that was expected and the one found."""
    return done.filter("not applied").select("id", "seq", "expected_version", "actual_version")


def soft_delete(nodes: DataFrame, ids: DataFrame, now: Column) -> DataFrame:
    """nodes with the rows of the ids set inactive and their updated_at set; see deleted_flags for what was found."""
    gone = ids.select("id").dropna().distinct().withColumn("_gone", F.lit(True))
    hit = F.col("_gone").isNotNull()
    out = nodes.join(gone, "id", "left").withColumns({
        "is_active": F.when(hit, F.lit(False)).otherwise(F.col("is_active")), "updated_at": F.when(hit, now.cast("timestamp_ntz")).otherwise(F.col("updated_at"))})
    return out.select(*nodes.columns)


def deleted_flags(nodes: DataFrame, ids: DataFrame) -> DataFrame:
    """(id, found) of each id that was to be deleted."""
    known = nodes.select("id").distinct().withColumn("_known", F.lit(True))
    return ids.select("id").dropna().distinct().join(known, "id", "left").select("id", F.col("_known").isNotNull().alias("found"))


def add_edges(edges: DataFrame, new: DataFrame) -> DataFrame:
    """Upsert on (source_id, target_id, rel_type): only the properties of an existing edge are replaced."""
    keys = ["source_id", "target_id", "rel_type"]
    return upsert(edges, new.select(*keys, "properties"), keys, {})


def update_embeddings(nodes: DataFrame, vectors: DataFrame) -> DataFrame:
    """nodes with new embeddings (id, embedding); unknown ids change nothing, nor do version and updated_at change."""
    v = vectors.select("id", F.col("embedding").alias("_new"), F.lit(True).alias("_has"))
    return nodes.join(v, "id", "left").withColumn("embedding", F.when(F.col("_has"), F.col("_new")).otherwise(F.col("embedding"))).select(*nodes.columns)


def replay(snapshot: DataFrame, patches: DataFrame, since: Column | None = None) -> DataFrame:
    """State of the nodes after the patches (patch_ts, id, attributes) later than since: per id the last patch's attributes, and
    the version raised by the number of distinct patches."""
    p = patches.filter("id is not null and patch_ts is not null")
    if since is not None:
        p = p.filter(F.col("patch_ts") > since)
    columns = [c for c in ("type", "layer", "title", "summary", "full_content", "confidence", "source") if c in p.columns]
    last = p.groupBy("id").agg(F.max(F.struct("patch_ts", *columns)).alias("w"), F.count_distinct("patch_ts").alias("n"))
    have = snapshot.select("id", F.col("version").alias("_was"))
    upd = last.join(have, "id", "left").select(
        "id", *[F.col(f"w.{c}").alias(c) for c in columns], (F.coalesce("_was", F.lit(0)) + F.col("n")).cast("int").alias("version"), F.col("w.patch_ts").alias("updated_at"))
    return upsert(snapshot, upd, ["id"])


def ranked(df: DataFrame, keys: list[str], order: list[Column], limit: int, name: str = "rank") -> DataFrame:
    """The first rows of each key with their 0-based rank."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(name, F.row_number().over(w) - 1).filter(F.col(name) < limit)
