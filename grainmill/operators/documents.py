"""Index maps, task lists, message windows and logs over tables of texts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from grainmill.functions.ids import sanitize_id
from grainmill.functions.markup import render, short_uuid, strip, target_directory, task_line, truncated, valid_json
from grainmill.functions.times import iso
from grainmill.operators.neighbours import beside
from grainmill.schema import LAYERS, SUMMARY_COLUMNS

# Texts of the stored formats.
NOT_FOUND = ("[DAG Error] 未找到节点: ", "。")
BAD_ID = "[DAG Error] 非法节点 ID。"
STORED = ("[DAG Success] 节点 '", "' 已固化至 ", "。")
CAPSULE = "\n\n【前置强制要求】请使用 toolkit.read_file 优先读取以下设计蓝图，确保命名、接口和技术约束绝对一致：\n"
REPORT = ("【任务汇报 - ID:", " | 状态:", "】:\n")


def get_nodes(nodes: DataFrame, wanted: DataFrame | None = None, mode: str = "summary") -> DataFrame:
    """Active nodes, all or those wanted (id): ten columns with times as ISO text, or in any other mode all columns."""
    rows = nodes.filter("is_active")
    if wanted is not None:
        rows = rows.join(wanted.select("id").distinct(), "id", "left_semi")
    if mode != "summary":
        return rows
    return rows.select(*[iso(F.col(c)).alias(c) if c.endswith("_at") else F.col(c) for c in SUMMARY_COLUMNS])


def node_index(files: DataFrame) -> DataFrame:
    """(id, title, path) of markdown nodes (id, title, path, layer): where an id occurs twice the later layer wins, then the greater path. Files of other directories aren't nodes."""
    place = F.array_position(F.array(*[F.lit(x) for x in LAYERS]), F.col("layer"))
    return (
        files.filter("id is not null and title is not null").filter(F.col("layer").isin(LAYERS)).groupBy("id").agg(F.max(F.struct(place.alias("p"), "path", "title")).alias("w"))
        .select("id", F.col("w.title").alias("title"), F.col("w.path").alias("path")))


def index_lines(index: DataFrame) -> DataFrame:
    """(id, line): the lines of the map of all nodes, to be ordered by id under a heading of the caller's."""
    return index.select("id", F.concat(F.lit("- ["), F.col("id"), F.lit("]: "), F.col("title")).alias("line"))


def fetch(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(id, content) for each wanted id (raw): the text of its file, cut if long, or an error text if there is no such node."""
    asked = wanted.select(sanitize_id(F.col("id")).alias("id")).distinct()
    have = files.select("id", "content")
    missing = F.concat(F.lit(NOT_FOUND[0]), F.col("id"), F.lit(NOT_FOUND[1]))
    return asked.join(have, "id", "left").select("id", F.when(F.col("content").isNull(), missing).otherwise(truncated(F.col("content"))).alias("content"))


def rendered(nodes: DataFrame) -> DataFrame:
    """(id, directory, content, message) of nodes (id, layer, parents, title, body) as markdown files; an id of which nothing is left gives an error."""
    text = render(F.col("id"), F.col("layer"), F.col("parents"), F.col("title"), F.col("body"))
    clean = sanitize_id(F.col("id"))
    layer = F.coalesce("layer", F.lit("L1_Theorems"))
    return nodes.select(
        clean.alias("id"), target_directory(F.col("layer")).alias("directory"), text.alias("content"),
        F.when(clean == "", BAD_ID).otherwise(F.concat(F.lit(STORED[0]), clean, F.lit(STORED[1]), layer, F.lit(STORED[2]))).alias("message"))


def task_lines(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, line_no, line, pending, done, id, content) of the task lines of each text; line_no counts from 1."""
    lines = texts.select(F.col(key), F.posexplode(F.split("text", "\r\n|\n|\r")).alias("n", "line"))
    t = task_line(F.col("line"))
    return lines.select(key, (F.col("n") + 1).alias("line_no"), "line", *[c.alias(k) for k, c in t.items()]).filter("pending or done")


def pop_tasks(texts: DataFrame, key: str = "doc_id") -> tuple[DataFrame, DataFrame]:
    """The first pending task (key, id, content) of each task list, and the lists with that task ticked off (key, text).

    A list without a pending task gives no task and stays as it is, null included.
    """
    lines = F.split("text", "\r\n|\n|\r")
    at = F.array_position(F.transform(lines, lambda x: F.startswith(strip(x), F.lit("- [ ]"))), F.lit(True))
    rows = texts.select(F.col(key), "text", lines.alias("lines"), at.alias("at"))
    t = task_line(F.element_at("lines", F.col("at").cast("int")))
    tasks = rows.filter("at > 0").select(key, t["id"].alias("id"), t["content"].alias("content"))
    ticked = F.transform("lines", lambda x, i: F.when(i + 1 == F.col("at"), F.regexp_replace(x, r"^(.*?)- \[ \]", "$1- [x]")).otherwise(x))
    rest = rows.select(key, F.when(F.col("at") > 0, F.concat(F.array_join(ticked, "\n"), F.lit("\n"))).otherwise(F.col("text")).alias("text"))
    return tasks, rest


def append_tasks(text: Column, tasks: Column, ids: Column | None = None) -> Column:
    """A task list with one pending line per task; ids: a list as long as the tasks, else short random ids are drawn."""
    pairs = F.arrays_zip(tasks.alias("t"), ids.alias("i")) if ids is not None else None
    if pairs is not None:
        lines = F.transform(pairs, lambda p: F.concat(F.lit("- [ ][id:"), p["i"], F.lit("] "), p["t"]))
    else:
        lines = F.transform(tasks, lambda t: F.concat(F.lit("- [ ][id:"), short_uuid(), F.lit("] "), t))
    return F.concat(text, F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n"))


def capsules(tasks: Column, paths: Column) -> Column:
    """Each task with the paths of the nodes it must read first; without paths the tasks stay as they are."""
    listed = F.array_join(F.transform(paths, lambda p: F.concat(F.lit("  - "), p)), "\n")
    suffix = F.concat(F.lit(CAPSULE), listed)
    return F.transform(tasks, lambda t: F.when(F.size(paths) > 0, F.concat(t, suffix)).otherwise(t))


def report_entry(task_id: Column, status: Column, detail: Column) -> Column:
    return F.concat(F.lit(REPORT[0]), task_id, F.lit(REPORT[1]), status, F.lit(REPORT[2]), detail)


def message_window(messages: DataFrame, keys: list[str], order: list[str], most: int = 7, last: int = 4) -> DataFrame:
    """Of conversations with more than `most` messages the first and the last few; shorter ones whole. pos counts from 1.

    Both ends are found by limited ranks, which are cut map-side, so a conversation with very many messages isn't gathered.
    """
    up = Window.partitionBy(*keys).orderBy(*order)
    down = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order])
    rows = messages.dropna(subset=keys)
    head = rows.withColumn("pos", F.row_number().over(up)).filter(F.col("pos") <= most)
    tail = rows.withColumn("_back", F.row_number().over(down)).filter(F.col("_back") <= last)
    sizes = rows.groupBy(*keys).agg(F.count("*").alias("_n"))
    first = head.join(sizes, keys).filter((F.col("_n") <= most) | (F.col("pos") == 1)).drop("_n")
    rest = tail.join(sizes, keys).filter(F.col("_n") > most).withColumn("pos", (F.col("_n") - F.col("_back") + 1).cast("int")).drop("_n", "_back")
    return first.unionByName(rest)


def repeats(messages: DataFrame, keys: list[str], order: list[str], text: str, bucket: Column | None = None) -> DataFrame:
    """messages with repeated: whether the text equals that of the message before; see beside for bucket."""
    rows = beside(messages.dropna(subset=keys), keys, order, {"_before": (text, -1)}, bucket)
    return rows.withColumn("repeated", F.coalesce(F.col("_before") == F.col(text), F.lit(False))).drop("_before")


def stream_text(chunks: DataFrame, key: str, order: str, line: str = "line") -> DataFrame:
    """(key, content) of server-sent lines: the deltas in order, up to the end mark; other lines and broken JSON are skipped."""
    data = F.when(F.startswith(F.col(line), F.lit("data: ")), F.substring(F.col(line), 7, 1 << 30))
    rows = chunks.select(F.col(key), F.col(order).alias("o"), data.alias("d")).filter("d is not null")
    end = rows.filter("d = '[DONE]'").groupBy(key).agg(F.min("o").alias("end"))
    delta = F.get_json_object("d", "$.choices[0].delta.content")
    parts = rows.join(end, key, "left").filter("end is null or o < end").withColumn("c", delta).filter("c is not null")
    return parts.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("o", "c"))), lambda x: x["c"]), "").alias("content"))


def personas(texts: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, system_prompt, params) of texts that hold a persona's JSON object; params is a JSON object too.

    What is missing, and all of a text that isn't a JSON object, has its empty value: '' and {}.
    """
    good = valid_json(F.col("text")) & F.startswith(strip(F.col("text")), F.lit("{"))
    prompt, params = (F.when(good, F.get_json_object("text", f"$.{k}")) for k in ("system_prompt", "params"))
    return texts.select(key, F.coalesce(prompt, F.lit("")).alias("system_prompt"), F.coalesce(params, F.lit("{}")).alias("params"))


def people(entities: DataFrame, query: str) -> DataFrame:
    """Entities (name, aliases) whose name or an alias contains the query, whatever the case."""
    q = F.lit(query.lower())
    hit = F.contains(F.lower("name"), q) | F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.contains(F.lower(a), q))
    return entities.filter(F.coalesce(hit, F.lit(False)))
