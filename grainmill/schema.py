"""Schemas of the stored tables, and the engine's parameters in one place."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

_S, _TS = T.StringType(), T.TimestampNTZType()


def _schema(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in columns.items()])


NODES = _schema(
    id=_S, type=_S, layer=_S, title=_S, summary=_S, full_content=_S, confidence=T.FloatType(), source=_S, version=T.IntegerType(),
    is_active=T.BooleanType(), embedding=T.ArrayType(T.FloatType()), created_at=_TS, updated_at=_TS)
EDGES = _schema(source_id=_S, target_id=_S, rel_type=_S, valid_from=_TS, valid_until=_TS, properties=_S)
#: Session records; ts stays a string, since scoring tells missing, unreadable and valid apart.
RECORDS = _schema(session_id=_S, ts=_S, content=_S, summary=_S, access_count=T.LongType())
PATCH_NODE = _schema(
    id=_S, type=_S, layer=_S, title=_S, summary=_S, full_content=_S, confidence=T.DoubleType(), source=_S, expected_version=T.IntegerType())
PATCH = _schema(node=PATCH_NODE, ts=_S)
PERSONA = _schema(system_prompt=_S, params=T.MapType(_S, _S))

#: What a new node gets where a write doesn't say.
NODE_DEFAULTS = {"version": 1, "is_active": True}
SUMMARY_COLUMNS = ["id", "type", "layer", "title", "summary", "confidence", "source", "version", "created_at", "updated_at"]
#: Layers of the markdown store; a later one wins where an id occurs twice.
LAYERS = ["L0_Axioms", "L1_Theorems", "L2_Engineering"]


def empty(spark: SparkSession, schema: T.StructType) -> DataFrame:
    return spark.createDataFrame([], schema)


@dataclass(frozen=True)
class Parameters:
    """Limits and thresholds of retrieval and consolidation."""

    fts_limit: int = 10
    vector_limit: int = 10
    gate: float = 0.3
    rrf_k: int = 60
    top_k: int = 5
    graph_max_depth: int = 3
    light: float = 0.3
    rem: float = 0.5
    deep: float = 0.7
    promote: float = 0.8
