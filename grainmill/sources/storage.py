"""Reading and writing the stored forms: sessions, patches, snapshots, markdown and plain memory files."""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Mapping

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from grainmill.functions.markup import front_matter, header_value, strip, valid_json
from grainmill.functions.times import iso
from grainmill.operators.documents import rendered
from grainmill.operators.merge import last_writes, upsert
from grainmill.schema import EDGES, LAYERS, NODES, PATCH, RECORDS, empty


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return fs.getRawFileSystem() if fs.getScheme() == "file" else fs, p  # the local checksum layer can't handle colons in names


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def _rename(spark: SparkSession, old: str, new: str) -> None:
    fs, p = _fs(spark, old)
    if not fs.rename(p, _fs(spark, new)[1]):
        raise OSError(f"can't rename {old}")


def _delete(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.delete(p, True)


def _file_system(path: str):
    """The file system of a path, for tasks that read or write files by name, and the path within it."""
    from pyarrow import fs

    local = path.removeprefix("file://").removeprefix("file:")
    return fs.FileSystem.from_uri(path) if "://" in local else (fs.LocalFileSystem(), local)


def _contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(path, value): whole small files, also those whose names hold colons, which the local reader refuses."""
    for b in batches:
        for path in b.column("path").to_pylist():
            files, at = _file_system(path)
            with files.open_input_stream(at) as f:
                yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([f.read().decode("utf-8", "replace")])], ["path", "value"])


# Sessions: JSON lines in a fixed number of buckets by the hash of the session's id, so that any id can be stored, very many
# sessions make no tiny files, and one session is read or dropped without touching the other buckets.

#: Buckets of a folder of sessions; fixed, since the place of a record depends on it.
SESSION_BUCKETS = 256


def _bucket(session_id: Column) -> Column:
    return F.pmod(F.xxhash64(F.coalesce(session_id, F.lit(""))), F.lit(SESSION_BUCKETS)).cast("int")


def append_records(records: DataFrame, folder: str, now: Column) -> None:
    """Append records with session_id; ts is stamped, whatever the caller gave."""
    stamped = records.withColumns({"ts": iso(now.cast("timestamp_ntz")), "bucket": _bucket(F.col("session_id"))})
    stamped.write.mode("append").partitionBy("bucket").json(folder)


def read_sessions(spark: SparkSession, folder: str, session_id: str | None = None) -> DataFrame:
    """Records of all sessions or of one; a session that isn't there gives no rows, a line that isn't JSON raises."""
    if not exists(spark, folder):
        return empty(spark, RECORDS)
    rows = spark.read.schema(T.StructType([*RECORDS, T.StructField("bucket", T.IntegerType())])).option("mode", "FAILFAST").json(folder)
    if session_id is not None:
        rows = rows.filter((F.col("bucket") == _bucket(F.lit(session_id))) & (F.col("session_id") == session_id))
    return rows.select(*RECORDS.fieldNames())


def list_sessions(records: DataFrame) -> DataFrame:
    return records.select("session_id").filter("session_id is not null").distinct()


def delete_session(spark: SparkSession, folder: str, session_id: str) -> bool:
    """Whether there was such a session. Its bucket is written anew without it, then put in the old one's place; no path is made of the id."""
    if read_sessions(spark, folder, session_id).isEmpty():
        return False
    bucket = spark.range(1).select(_bucket(F.lit(session_id))).first()[0]
    old, new, aside = f"{folder}/bucket={bucket}", f"{folder}/.new-{uuid.uuid4().hex}", f"{folder}/.old-{uuid.uuid4().hex}"
    whole = spark.read.text(old)  # lines as they are: fields outside the schema stay
    whole.filter(~F.col("value").isNull() & ~F.get_json_object("value", "$.session_id").eqNullSafe(F.lit(session_id))).write.text(new)
    _rename(spark, old, aside)
    _rename(spark, new, old)
    _delete(spark, aside)
    return True


def session_stream(spark: SparkSession, folder: str) -> DataFrame:
    return spark.readStream.schema(RECORDS).json(folder)


# Patches: JSON lines {node, ts}, one per accepted write, in a directory per month below _log. A patch is called by its time; single
# files of that name, as other writers leave them in the folder itself, are patches too. A name that begins with _ keeps the log from the
# reader of single files.


def patch_name(ts: Column) -> Column:
    """Name of the patch of an ISO time."""
    return F.concat(ts, F.lit("_patch.json"))


def patch_time(name: Column) -> Column:
    """Time in a patch's name, before the first underscore; null if it can't be read."""
    stem = F.substring_index(F.substring_index(name, "/", -1), "_", 1)
    return F.to_timestamp_ntz(F.try_to_timestamp(F.replace(F.when(stem.rlike(r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(\.\d{1,6})?$"), stem), F.lit("T"), F.lit(" "))))


def create_patches(nodes: DataFrame, folder: str, now: Column) -> None:
    """Append {node, ts} documents to the log; now may be a column of nodes and isn't part of the node then."""
    at = "_at"
    rows = nodes.withColumn(at, now.cast("timestamp_ntz"))
    columns = [c for c in nodes.columns if c in PATCH["node"].dataType.fieldNames()]
    docs = rows.select(F.struct(*columns).alias("node"), iso(F.col(at)).alias("ts"), F.date_format(at, "yyyy-MM").alias("month"))
    docs.write.mode("append").partitionBy("month").json(f"{folder}/_log")


def read_patches(spark: SparkSession, folder: str) -> DataFrame:
    """(node, ts, patch_file, patch_ts, broken) of all patches of a folder.

    Documents of the log are lines; single files hold one document over one or more lines, or one per line. Documents that aren't JSON come
    out with nulls and broken set. patch_file is a single file's own name, else made of the document's time.
    """
    fs, p = _fs(spark, folder)
    parts = []
    if fs.exists(p):
        children = [x.getPath().getName() for x in fs.listStatus(p)]
        if "_log" in children:
            parts.append(spark.read.text(f"{folder}/_log").select(F.col("value").alias("d"), F.lit(None).cast("string").alias("file")).filter(strip(F.col("d")) != ""))
        if any(c.endswith(".json") for c in children):
            paths = spark.read.format("binaryFile").option("pathGlobFilter", "*.json").load(folder).select("path")
            files = paths.mapInArrow(_contents, "path string, value string").select("value", F.substring_index("path", "/", -1).alias("file"))
            lines = F.filter(F.split("value", "\n"), lambda x: strip(x) != "")
            parts.append(files.select(F.explode(F.when(valid_json(F.col("value")), F.array("value")).otherwise(lines)).alias("d"), "file"))
    if not parts:
        return spark.createDataFrame([], f"node {PATCH['node'].dataType.simpleString()}, ts string, patch_file string, patch_ts timestamp_ntz, broken boolean")
    docs = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    doc = F.from_json("d", PATCH)
    name = F.coalesce("file", patch_name(doc["ts"]))
    rows = docs.select(doc["node"].alias("node"), doc["ts"].alias("ts"), name.alias("patch_file"), (~valid_json(F.col("d"))).alias("broken"))
    return rows.select("node", "ts", "patch_file", patch_time(F.col("patch_file")).alias("patch_ts"), "broken")


def patches_since(names: DataFrame, since: Column | None = None) -> DataFrame:
    """(patch_file, patch_ts) of distinct names in their order, times at or after since; names without a readable time are skipped if since is given."""
    rows = names.select("patch_file").distinct().withColumn("patch_ts", patch_time(F.col("patch_file")))
    return (rows if since is None else rows.filter(F.col("patch_ts") >= since)).orderBy("patch_file")


def patches_older(names: DataFrame, than: Column) -> DataFrame:
    """Names with a time strictly before `than`; unreadable ones are never among them."""
    return names.select("patch_file").distinct().withColumn("patch_ts", patch_time(F.col("patch_file"))).filter(F.col("patch_ts") < than)


def list_patches(spark: SparkSession, folder: str, since: Column | None = None) -> DataFrame:
    """(patch_file, patch_ts) of the patches of a folder, in order; see patches_since."""
    return patches_since(read_patches(spark, folder), since)


def count_valid(patches: DataFrame) -> DataFrame:
    return patches.agg(F.count_if(~F.col("broken")).alias("n_valid"))


def cleanup_patches(spark: SparkSession, folder: str, than: Column) -> int:
    """Delete the patches strictly older; how many there were. Months that are older as a whole are dropped, the month of `than` is written
    anew without them, single files go one by one. The driver sees the names of the months, and those of single files piece by piece."""
    moment = spark.range(1).select(than.cast("timestamp_ntz").alias("t"), F.date_format(than.cast("timestamp_ntz"), "yyyy-MM").alias("d")).first()
    fs, p = _fs(spark, folder)
    if not fs.exists(p):
        return 0
    n = patches_older(read_patches(spark, folder), than).count()
    children = [x.getPath().getName() for x in fs.listStatus(p)]
    log = f"{folder}/_log"
    months = [x.getPath().getName() for x in fs.listStatus(_fs(spark, log)[1])] if exists(spark, log) else []
    for month in [c for c in months if c.startswith("month=") and c[6:] < moment["d"]]:
        _delete(spark, f"{log}/{month}")
    last = f"month={moment['d']}"
    if last in months:
        old, new, aside = f"{log}/{last}", f"{log}/.new-{uuid.uuid4().hex}", f"{log}/.old-{uuid.uuid4().hex}"
        at = patch_time(patch_name(F.get_json_object("value", "$.ts")))
        spark.read.text(old).filter(at.isNull() | (at >= F.lit(moment["t"]))).write.text(new)
        _rename(spark, old, aside)
        _rename(spark, new, old)
        _delete(spark, aside)
    if any(c.endswith("_patch.json") for c in children):
        files = spark.read.format("binaryFile").option("pathGlobFilter", "*_patch.json").load(folder).select(F.col("path").alias("patch_file"))
        for r in patches_older(files, F.lit(moment["t"])).toLocalIterator():
            _delete(spark, r["patch_file"])
    return n


# Snapshots: a directory per moment, and a pointer file.


def create_snapshot(nodes: DataFrame, edges: DataFrame, folder: str, snapshot: str) -> str:
    """Write both tables, inactive rows included, under the snapshot's id, and point to it; an id that is there already raises."""
    spark = nodes.sparkSession
    nodes.write.mode("errorifexists").parquet(f"{folder}/{snapshot}/nodes.parquet")
    edges.write.mode("errorifexists").parquet(f"{folder}/{snapshot}/edges.parquet")
    spark.createDataFrame([(snapshot,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/latest")
    return snapshot


def open_store(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the store in a folder: those of its latest snapshot, or empty tables of the store's schemas if there is none."""
    if latest_snapshot(spark, folder) is None:
        return empty(spark, NODES), empty(spark, EDGES)
    return read_snapshot(spark, folder)


def latest_snapshot(spark: SparkSession, folder: str) -> str | None:
    if not exists(spark, f"{folder}/latest"):
        return None
    row = spark.read.text(f"{folder}/latest").first()
    return row[0] if row else None


def read_snapshot(spark: SparkSession, folder: str, snapshot: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a snapshot, by default the latest."""
    at = f"{folder}/{snapshot or latest_snapshot(spark, folder)}"
    return spark.read.parquet(f"{at}/nodes.parquet"), spark.read.parquet(f"{at}/edges.parquet")


def snapshot_counts(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return nodes.agg(F.count("*").alias("node_count")).crossJoin(edges.agg(F.count("*").alias("edge_count")))  # one row each


# Markdown.


def read_markdown(spark: SparkSession, folder: str, recursive: bool = True) -> DataFrame:
    """(path, stem, text) of the *.md files below a folder, or directly in it."""
    reader = spark.read.option("pathGlobFilter", "*.md")
    if recursive:
        reader = reader.option("recursiveFileLookup", True)
    rows = reader.text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.regexp_replace(F.col("_metadata.file_name"), r"\.md$", "").alias("stem"), F.col("value").alias("text"))
    return rows


def node_files(spark: SparkSession, base: str) -> DataFrame:
    """(id, type, parents, title, content, path, layer) of the valid files in the layers' directories."""
    out = None
    for layer in LAYERS:
        if not exists(spark, f"{base}/{layer}"):
            continue
        m = front_matter(F.col("text"))
        rows = read_markdown(spark, f"{base}/{layer}", recursive=False).filter(m["valid"]).select(
            *[m[c].alias(c) for c in ("id", "type", "parents", "title")], F.col("text").alias("content"), "path", F.lit(layer).alias("layer"))
        out = rows if out is None else out.unionByName(rows)
    return out if out is not None else spark.createDataFrame([], "id string, type string, parents string, title string, content string, path string, layer string")


def write_texts(files: DataFrame, base: str) -> None:
    """Write (directory, name, content) as files <base>/<directory>/<name>; of rows with the same place the greatest text is written.

    Each task writes the files of its own rows through the file system of the folder, under a hidden name first, so a task
    that is run again leaves whole files only. Rows with a null are left out.
    """
    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, top = _file_system(base)
        for b in batches:
            for folder, name, text in zip(*(b.column(c).to_pylist() for c in ("directory", "name", "content"))):
                fs.create_dir(f"{top}/{folder}", recursive=True)
                hidden = f"{top}/{folder}/.{name}-{uuid.uuid4().hex}"
                with fs.open_output_stream(hidden) as f:
                    f.write(text.encode())
                fs.move(hidden, f"{top}/{folder}/{name}")
            yield b.select(["name"])

    one = files.dropna(subset=["directory", "name", "content"]).groupBy("directory", "name").agg(F.max("content").alias("content"))
    one.mapInArrow(write, "name string").write.format("noop").mode("overwrite").save()


def write_nodes_markdown(nodes: DataFrame, base: str) -> DataFrame:
    """Write nodes (id, layer, parents, title, body) as markdown files <base>/<directory>/<id>.md; (id, message) of each.

    Nodes of which no id is left give their error text and no file.
    """
    done = rendered(nodes)
    write_texts(done.select("directory", F.concat("id", F.lit(".md")).alias("name"), "content"), base)
    return done.select("id", "message")


def imported(files: DataFrame, layer: str = "L1", source: str = "local_import") -> DataFrame:
    """Node rows of markdown files (path, stem, text): id is the file's stem; title and summary come from the header, by default
    the stem and ''. Of files with the same stem the greatest path holds. A file without a header gives its whole text."""
    parts = F.split("text", "---", 3)
    has = F.startswith("text", F.lit("---")) & (F.size(parts) >= 3)
    header = F.when(has, F.try_element_at(parts, F.lit(2))).otherwise(F.lit(""))
    body = F.when(has, F.try_element_at(parts, F.lit(3))).otherwise(F.col("text"))
    rows = files.select(
        F.col("stem").alias("id"), F.lit("Concept").alias("type"), F.lit(layer).alias("layer"), header_value(header, "title", F.col("stem")).alias("title"),
        header_value(header, "summary", F.lit("")).alias("summary"), strip(body).alias("full_content"), F.lit(1.0).cast("float").alias("confidence"), F.lit(source).alias("source"), "path")
    columns = [c for c in rows.columns if c not in ("id", "path")]
    return rows.filter("id is not null").groupBy("id").agg(F.max(F.struct("path", *columns)).alias("w")).select("id", *[F.col(f"w.{c}").alias(c) for c in columns])


def sync(spark: SparkSession, nodes: DataFrame, sources: list[Mapping[str, str]]) -> tuple[DataFrame, DataFrame]:
    """(nodes with all sources' files, counts per source). Each source: type local_markdown (recursive) or github_wiki (a folder that has
    been cloned already, not recursive), path, and target_layer; other types are ignored, missing folders give nothing."""
    rows = None
    for s in sources:
        if s.get("type") not in ("local_markdown", "github_wiki") or not exists(spark, s["path"]):
            continue
        local = s["type"] == "local_markdown"
        got = imported(read_markdown(spark, s["path"], recursive=local), s.get("target_layer") or "L1", "local_import" if local else "github_wiki")
        rows = got if rows is None else rows.unionByName(got)
    if rows is None:
        return nodes, spark.createDataFrame([], "source string, n long")
    one = last_writes(rows, ["id"], ["source"])
    return upsert(nodes, one, ["id"]), ingest_counts(rows)


def ingest_counts(rows: DataFrame) -> DataFrame:
    return rows.groupBy("source").agg(F.count("*").alias("n"))


# Memory files, personas, the social graph.

#: Fixed first contents of the memory files.
MEMORY_FILES = {
    "gene_lock": "# 基因锁 (Gene Lock)\n\n1. 绝对服从指令。\n2. 生产环境操作必须先备份。", "hippocampus": "# Hippocampus\n\n", "long_term": "# Long_term\n\n",
    "todo": "# 任务队列 (To-Do)\n\n",
}


def read_memory(spark: SparkSession, folder: str, kind: str) -> str:
    """Text of a memory file; an unknown kind gives ''. What was never written has its first content."""
    if kind not in MEMORY_FILES:
        return ""
    path = f"{folder}/{kind}"
    if not exists(spark, path):
        return MEMORY_FILES[kind]
    last = spark.read.text(path, wholetext=True).select("value", F.col("_metadata.file_name").alias("n")).orderBy(F.desc("n")).first()
    return last["value"].removesuffix("\n") if last else ""


def write_memory(spark: SparkSession, folder: str, kind: str, content: str, append: bool = False) -> None:
    """Replace or extend (then with a line end) a memory file; an unknown kind does nothing."""
    if kind not in MEMORY_FILES:
        return
    text = read_memory(spark, folder, kind) + content + "\n" if append else content
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/{kind}")


def read_persona(spark: SparkSession, path: str) -> dict:
    """{system_prompt, params}; a missing or broken file gives the empty values."""
    none = {"system_prompt": "", "params": {}}
    if not exists(spark, path):
        return none
    row = spark.read.text(path, wholetext=True).first()
    try:
        got = json.loads(row["value"]) if row else {}
    except ValueError:
        return none
    return none | {k: got[k] for k in none if k in got} if isinstance(got, dict) else none


def update_entities(entities: DataFrame, changes: DataFrame) -> DataFrame:
    """(id, entity) with JSON objects, after the changes (id, change), JSON objects too, at most one per id.

    Values are merged deeply: objects key by key, everything else is replaced, new keys are added; keys come out sorted. Entities
    without a change, and those whose change isn't an object, stay as they are; changes to unknown entities do nothing.
    """
    @F.pandas_udf("string")
    def merged(old: pd.Series, new: pd.Series) -> pd.Series:
        def deep(a: object, b: object) -> object:
            return {**a, **{k: deep(a[k], v) if k in a else v for k, v in b.items()}} if isinstance(a, dict) and isinstance(b, dict) else b

        def one(a: str | None, b: str | None) -> str | None:
            try:
                change = json.loads(b)
                return json.dumps(deep(json.loads(a), change), ensure_ascii=False, sort_keys=True) if isinstance(change, dict) else a
            except (TypeError, ValueError):
                return a

        return pd.Series([one(a, b) for a, b in zip(old, new)], dtype=object)

    rows = entities.select("id", "entity").join(changes.select("id", "change"), "id", "left")
    return rows.select("id", F.when(F.col("change").isNull(), F.col("entity")).otherwise(merged("entity", "change")).alias("entity"))


def update_entity(graph: DataFrame, entity_id: str, change: Mapping[str, object], today: Column) -> DataFrame:
    """A social graph (id, entity, updated), one row per entity with its JSON object, after a deep merge of a change into one
    entity; updated is set in all rows. See update_entities."""
    spark = graph.sparkSession
    one = spark.createDataFrame([(entity_id, json.dumps(change, ensure_ascii=False))], "id string, change string")
    return update_entities(graph, one).withColumn("updated", today)


def empty_nodes(spark: SparkSession) -> DataFrame:
    return empty(spark, NODES)


