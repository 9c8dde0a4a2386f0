"""Front matter, action tags, task lists and other text formats as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from grainmill.functions.ids import normalise_parents, sanitize_id

# The mark that ends a cut text, the length from which texts are cut, and that from which answers are cut without a mark.
CUT_MARK, CUT_AT, ANSWER_AT = "\n...[已截断]", 1500, 2000
_JSON_LIST = "array<string>"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def front_matter(text: Column) -> dict[str, Column]:
    """id, type, parents, title and body of a markdown node; valid says whether it has a header, an id and a heading."""
    parts = F.split(text, "---", 3)
    header, body = F.try_element_at(parts, F.lit(2)), F.try_element_at(parts, F.lit(3))
    id_ = F.regexp_extract(header, r"id:\s*([a-zA-Z0-9_]+)", 1)
    title = strip(F.regexp_extract(body, r"(?md)^#\s+([^\r\n]+)", 1))
    valid = F.startswith(text, F.lit("---")) & (F.size(parts) >= 3) & (id_ != "") & (title != "")
    return {
        "valid": F.coalesce(valid, F.lit(False)), "id": F.nullif(id_, F.lit("")), "type": F.nullif(strip(F.regexp_extract(header, r"(?md)^type:[ \t]*([^\r\n]*)", 1)), F.lit("")),
        "parents": F.nullif(strip(F.regexp_extract(header, r"(?md)^parents:[ \t]*([^\r\n]*)", 1)), F.lit("")), "title": F.nullif(title, F.lit("")), "body": body,
    }


def header_value(header: Column, key: str, default: Column) -> Column:
    """A key's value in a front-matter header; the default only if the key is absent."""
    pattern = rf"(?md)^{key}:[ \t]*([^\r\n]*)"
    return F.when(header.rlike(pattern), strip(F.regexp_extract(header, pattern, 1))).otherwise(default)


def render(id_: Column, layer: Column, parents: Column, title: Column, body: Column) -> Column:
    """Markdown of a node; null if nothing is left of its id."""
    clean = sanitize_id(id_)
    text = F.concat(
        F.lit("---\nid: "), clean, F.lit("\ntype: "), F.coalesce(layer, F.lit("")), F.lit("\nparents: ["), normalise_parents(parents), F.lit("]\n---\n# "),
        strip(F.coalesce(title, F.lit(""))), F.lit("\n\n"), strip(F.coalesce(body, F.lit(""))), F.lit("\n"))
    return F.when(clean != "", text)


def target_directory(layer: Column) -> Column:
    """Only the engineering layer has its own directory; every other node goes to the theorems."""
    return F.when(layer == "L2_Engineering", "L2_Engineering").otherwise("L1_Theorems")


def truncated(text: Column, at: int = CUT_AT) -> Column:
    return F.when(F.length(text) > at, F.concat(F.substring(text, 1, at), F.lit(CUT_MARK))).otherwise(text)


def answer_cut(text: Column, at: int = ANSWER_AT) -> Column:
    """The first characters of a long answer."""
    return F.substring(text, 1, at)


def without_reasoning(text: Column) -> Column:
    """What follows the last end of reasoning, trimmed; a text without one stays as it is."""
    return F.when(F.contains(text, F.lit("</think>")), strip(F.substring_index(text, "</think>", -1))).otherwise(text)


def fetches(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[ACTION:\s*FETCH\(([^\n]*?)\)\]"), F.lit(1)), lambda x: F.regexp_replace(x, "^[ \"']+|[ \"']+$", ""))


def queries_asked(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?i)\[ACTION:\s*TENTACLE\(([^\n]*?)\)\]"), F.lit(1)), strip)


def writes(text: Column) -> Column:
    """array<struct<id, title, parents, body>> of the write tags that have all four parts."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)\[ACTION:\s*WRITE_NODE\((.*?)\)\]"), F.lit(1))
    parts = F.filter(F.transform(found, lambda x: F.split(x, ";;", 4)), lambda p: F.size(p) == 4)
    return F.transform(parts, lambda p: F.struct(strip(p[0]).alias("id"), strip(p[1]).alias("title"), strip(p[2]).alias("parents"), strip(p[3]).alias("body")))


def valid_json(text: Column) -> Column:
    """Whether the text is one JSON value and nothing else; null counts as not. The parser alone would take what follows a value for granted."""
    listed = F.try_parse_json(F.concat(F.lit("["), text, F.lit("]")))
    return F.coalesce(F.try_parse_json(text).isNotNull() & listed.isNotNull() & F.try_variant_get(listed, "$[1]", "string").isNull(), F.lit(False))


def json_list(text: Column) -> Column:
    """The text as a JSON list, else its part from the first [ to the last ]; null if neither can be read."""
    strict = {"mode": "PERMISSIVE"}
    inner = F.regexp_extract(text, r"(?s)(\[.*\])", 1)
    return F.coalesce(
        F.when(valid_json(text), F.from_json(text, _JSON_LIST, strict)),
        F.when(valid_json(inner), F.from_json(inner, _JSON_LIST, strict)))


def finished(text: Column) -> Column:
    """The tasks of the first finish tag; null if there is none, or none that can be read, or no task in it."""
    tasks = json_list(F.nullif(F.regexp_extract(text, r"(?is)\[ACTION:\s*FINISH\((.*?)\)\]", 1), F.lit("")))
    return F.when(F.size(tasks) > 0, tasks)


def task_line(line: Column) -> dict[str, Column]:
    """pending, done, id and content of a line of a task list; neither pending nor done: not a task."""
    t = strip(line)
    pending, done = F.startswith(t, F.lit("- [ ]")), F.startswith(t, F.lit("- [x]"))
    rest = strip(F.substring(t, 6, 1 << 30))
    tagged = rest.rlike(r"^\[id:[^\]]*\]")
    return {
        "pending": pending, "done": done,
        "id": F.when(tagged, F.regexp_extract(rest, r"^\[id:([^\]]*)\]", 1)).otherwise("unknown"),
        "content": F.when(tagged, strip(F.regexp_replace(rest, r"^\[id:[^\]]*\]", ""))).otherwise(rest),
    }


def external_id(query: Column, epoch: Column) -> Column:
    return F.concat(F.lit("ext_"), F.substring(F.regexp_replace(query, "[^a-zA-Z0-9]", "_"), 1, 15), F.lit("_"), epoch.cast("string"))


def blueprint_id(epoch: Column) -> Column:
    return F.concat(F.lit("bp_"), epoch.cast("string"))


def short_uuid() -> Column:
    return F.substring(F.uuid(), 1, 8)
