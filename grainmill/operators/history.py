"""Full history of changing attributes: insert-only satellites and views that compute the end dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.ids import canonical_json, clean_id, row_digest
from grainmill.operators.neighbours import beside
from grainmill.session import broadcast_if_small, cut

#: Node attributes split by how often they change; each group is a satellite of its own.
NODE_SATELLITES = {"described": ["type", "layer", "title", "source"], "rated": ["summary", "confidence"]}
#: Prefix of the columns that hold a satellite's attributes next to its hash.
ATTRIBUTES = "attributes of "
#: A key with more rows than this is sorted in pieces.
HOT_ROWS = 200_000
#: Pieces of a hot key; each holds about the same number of its rows.
PIECES = 256


def stamp(c: Column) -> Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss.SSSSSS")


def edge_states(edges: DataFrame) -> DataFrame:
    """(source, target, rel, at, until, digest): one row per link and valid_from.

    Rows without a usable id or valid_from don't count; rel_type null counts as ''. Of rows with the same valid_from
    a stated valid_until wins over null, then the latest; likewise a stated state over null, then the greatest.
    """
    return (
        edges.select(
            clean_id(F.col("source_id")).alias("source"), clean_id(F.col("target_id")).alias("target"),
            F.coalesce("rel_type", F.lit("")).alias("rel"), F.col("valid_from").alias("at"), F.col("valid_until").alias("until"),
            canonical_json(F.col("properties")).alias("state"))
        .filter("source is not null and target is not null and at is not null")
        .groupBy("source", "target", "rel", "at").agg(F.max("until").alias("until"), F.max("state").alias("state"))
        .withColumn("digest", row_digest(F.col("state")))
    )


def node_states(patches: DataFrame, satellites: dict[str, list[str]] = NODE_SATELLITES, attributes: bool = True) -> DataFrame:
    """(id, version, at, <satellite>...[, <attribute>...]): the patch that holds for each version, with a hash per satellite.

    Of several patches of a version the one with the latest patch_ts holds (equal times: the greatest hashes).
    Patches without id, version or patch_ts don't count.
    """
    hashes = [row_digest(*[F.col(c) for c in cols]).alias(name) for name, cols in satellites.items()]
    named = [F.struct(*cols).alias(f"{ATTRIBUTES}{name}") for name, cols in satellites.items()] if attributes else []
    return (
        patches.filter("id is not null and id <> '' and version is not null and patch_ts is not null")
        .select("id", "version", F.struct(F.col("patch_ts").alias("at"), *hashes, *named).alias("s"))
        .groupBy("id", "version").agg(F.max("s").alias("s")).select("id", "version", "s.*")
    )


def hot_keys(rows: DataFrame, hot_rows: int) -> DataFrame | None:
    """The keys that occur more than hot_rows times, None if there are none; the rows are the keys alone, counted map-side."""
    hot = cut(rows.dropna().groupBy(*rows.columns).count().filter(F.col("count") > hot_rows).drop("count"))
    return None if hot.isEmpty() else broadcast_if_small(hot)


def _edge_keys(edges: DataFrame) -> DataFrame:
    return edges.select(clean_id(F.col("source_id")).alias("source"), clean_id(F.col("target_id")).alias("target"), F.coalesce("rel_type", F.lit("")).alias("rel"))


def _micros(at: str) -> Column:
    return F.timestamp_diff("MICROSECOND", F.lit("1970-01-01").cast("timestamp_ntz"), F.col(at))


def _bounded(states: DataFrame, hot: DataFrame) -> DataFrame:
    """The hot keys with the times that cut the rows of each into PIECES of about the same number, wherever in time these lie."""
    shares = [i / PIECES for i in range(1, PIECES)]
    return cut(states.join(hot, hot.columns, "left_semi").groupBy(*hot.columns).agg(F.percentile_approx(_micros("at"), shares, 1000).alias("_bounds")))


def _split(df: DataFrame, hot: DataFrame | None, order: str) -> list[tuple[DataFrame, Column | None]]:
    """df without, and only with, the hot keys, and for the latter the piece of a row, which never falls in the order; the latter only if there are any."""
    if hot is None:
        return [(df, None)]
    keys = [c for c in hot.columns if c != "_bounds"]
    cold = df.join(hot.select(*keys), keys, "left_anti")
    if "_bounds" not in hot.columns:  # numbers without gaps to speak of
        return [(cold, None), (df.join(hot, keys, "left_semi"), F.floor(F.col(order) / 10_000))]
    piece = F.size(F.filter("_bounds", lambda x: x < _micros(order)))
    return [(cold, None), (df.join(broadcast_if_small(hot), keys).withColumn("_piece", piece).drop("_bounds"), F.col("_piece"))]


def edge_satellite(edges: DataFrame, hot: DataFrame | None = None, state: bool = True) -> DataFrame:
    """Insert-only satellite of the links, (source, target, rel, at, digest[, state]): a row is appended only where the state's hash
    differs from the row before. state is the JSON with sorted keys, null if there was none.

    A link that ends before its next row begins gets a closing row (digest null), so a gap is a change like any
    other. Hot keys are sorted in pieces.
    """
    states = edge_states(edges) if state else edge_states(edges).drop("state")
    if hot is not None:
        states = cut(states)
        hot = _bounded(states, hot)
    return _edge_satellite(states, hot)


def _edge_satellite(states: DataFrame, hot: DataFrame | None) -> DataFrame:
    keys = ["source", "target", "rel"]
    extra = ["state"] if "state" in states.columns else []
    parts = []
    for df, bucket in _split(states, hot, "at"):
        ends = F.col("until") > F.col("at")
        rows = beside(df, keys, ["at"], {"next_at": ("at", 1), "was": ("digest", -1), "was_at": ("at", -1), "was_until": ("until", -1)}, bucket)
        gap = (F.col("was_until") > F.col("was_at")) & (F.col("was_until") < F.col("at"))
        fresh = F.col("was").isNull() | F.coalesce(gap, F.lit(False)) | (F.col("was") != F.col("digest"))
        opened = F.when(fresh, F.struct(F.col("at"), F.col("digest"), *extra))
        closed = F.when(ends & (F.col("next_at").isNull() | (F.col("until") < F.col("next_at"))), F.struct(F.col("until").alias("at"), *[F.lit(None).cast("string").alias(c) for c in ("digest", *extra)]))
        parts.append(rows.select(*keys, F.explode(F.filter(F.array(opened, closed), lambda x: x.isNotNull())).alias("e")).select(*keys, "e.*"))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


def node_changes(patches: DataFrame, satellites: dict[str, list[str]] = NODE_SATELLITES, hot: DataFrame | None = None, attributes: bool = True) -> DataFrame:
    """(id, version, at, changed, <satellite>...[, attributes]) where the hash of some satellite changed; changed lists these satellites.
    Hot keys are sorted in pieces of 10,000 versions."""
    names = list(satellites)
    parts = []
    states = node_states(patches, satellites, attributes)
    for df, bucket in _split(states if hot is None else cut(states), hot, "version"):
        rows = beside(df, ["id"], ["version"], {f"was_{n}": (n, -1) for n in names}, bucket)
        changed = F.array_compact(F.array(*[F.when(~F.col(n).eqNullSafe(F.col(f"was_{n}")), F.lit(n)) for n in names]))
        parts.append(rows.withColumn("changed", changed).filter(F.size("changed") > 0).select("id", "version", "at", "changed", *[c for c in df.columns if c not in ("id", "version", "at")]))
    return _union(parts)


def _satellite(rows: DataFrame, name: str, satellites: dict[str, list[str]]) -> DataFrame:
    return rows.select("id", "version", "at", F.col(name).alias("digest"), *[F.col(f"`{ATTRIBUTES}{name}`.{c}").alias(c) for c in satellites[name]])


def node_satellites(patches: DataFrame, satellites: dict[str, list[str]] = NODE_SATELLITES, hot_rows: int = HOT_ROWS) -> dict[str, DataFrame]:
    """The insert-only satellites of the nodes, a table (id, version, at, digest, <attributes>) for each: a row only where the hash of
    its attributes differs from that of the version before. All are filters of one stored table."""
    rows = cut(node_changes(patches, satellites, hot_keys(patches.select("id"), hot_rows)))
    return {n: _satellite(rows.filter(F.array_contains("changed", n)), n, satellites) for n in satellites}


def append(satellite: DataFrame, patches: DataFrame, name: str, satellites: dict[str, list[str]] = NODE_SATELLITES) -> tuple[DataFrame, DataFrame]:
    """(rows to append to a satellite, late patches) for patches that have come since it was written.

    Only the last row of each id is read from the satellite; nothing in it changes. Patches whose version isn't above
    that row's can't be told from what the satellite left out as unchanged: they come back as late, and their ids are to be built anew.
    With all patches in the order of their versions, the satellite and the appended rows equal one built of all patches.
    """
    last = satellite.groupBy("id").agg(F.max(F.struct("version", "digest")).alias("last"))
    states = _satellite(node_states(patches, {name: satellites[name]}), name, satellites).join(last, "id", "left")
    order = F.col("version") > F.coalesce("last.version", F.lit(-(2**31)))
    late = patches.join(last.select("id", F.col("last.version").alias("_last")), "id").filter(F.col("version") <= F.col("_last")).select(*patches.columns)
    rows = beside(states.filter(order), ["id"], ["version"], {"was": ("digest", -1)})
    before = F.coalesce("was", "last.digest")
    return rows.filter(before.isNull() | (before != F.col("digest"))).select(*satellite.columns), late


def in_periods(satellite: DataFrame) -> DataFrame:
    """A node satellite with the period in which each row held: from at until the at of the next, null while open."""
    return beside(satellite, ["id"], ["version"], {"until": ("at", 1)})


def _numbered(df: DataFrame, keys: list[str], order: str, open_row: Column, entity: str, entity_key: Column, hot: DataFrame | None) -> DataFrame:
    """The lead-based view: each row holds until the next of its key; keys with a single version are left out."""
    parts = []
    for rows, bucket in _split(df, hot, order):
        ended = beside(rows, keys, [order], {"ends": ("at", 1)}, bucket).filter(open_row)
        if bucket is not None:  # row numbers from the counts of the pieces before
            ended = ended.withColumn("_bucket", bucket)
            sums = Window.partitionBy(*keys).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
            sizes = ended.groupBy(*keys, "_bucket").agg(F.count("*").alias("_n")).withColumn("_base", F.coalesce(F.sum("_n").over(sums), F.lit(0)))
            total = sizes.groupBy(*keys).agg(F.sum("_n").alias("versions"))
            w = Window.partitionBy(*keys, "_bucket").orderBy(order)
            parts.append(
                ended.withColumn("_rn", F.row_number().over(w)).join(sizes, [*keys, "_bucket"]).join(total, keys)
                .withColumn("version_no", (F.col("_base") + F.col("_rn")).cast("int")))
        else:
            w = Window.partitionBy(*keys).orderBy(order)
            last = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
            parts.append(ended.withColumns({"version_no": F.row_number().over(w), "versions": F.count(F.lit(1)).over(last)}))
    return _union([
        p.filter("versions > 1").select(
            F.lit(entity).alias("entity"), entity_key.alias("entity_key"), F.col("version_no").cast("int").alias("version_no"),
            stamp(F.col("at")).alias("valid_from"), F.coalesce(stamp(F.col("ends")), F.lit("")).alias("valid_until"))
        for p in parts
    ])


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def edge_history(edges: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions of every link that has at least two, with the period in which each held; '' while open."""
    keys = ["source", "target", "rel"]
    hot = hot_keys(_edge_keys(edges), hot_rows)
    states = edge_states(edges).drop("state")
    if hot is not None:
        states = cut(states)
        hot = _bounded(states, hot)
    return _numbered(_edge_satellite(states, hot), keys, "at", F.col("digest").isNotNull(), "edge", F.concat_ws("|", *keys), hot)


def node_history(patches: DataFrame, satellites: dict[str, list[str]] = NODE_SATELLITES, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Versions of every node that has at least two; the order is that of version, the times are patch_ts."""
    hot = hot_keys(patches.select("id"), hot_rows)
    return _numbered(node_changes(patches, satellites, hot, attributes=False).drop("changed"), ["id"], "version", F.lit(True), "node", F.col("id"), hot)


def history(edges: DataFrame, patches: DataFrame, hot_rows: int = HOT_ROWS) -> DataFrame:
    """Both histories: (entity, entity_key, version_no, valid_from, valid_until)."""
    return edge_history(edges, hot_rows).unionByName(node_history(patches, hot_rows=hot_rows))
