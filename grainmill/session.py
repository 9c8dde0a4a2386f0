"""Session settings and the two ways in which lineage is cut."""

from __future__ import annotations

import atexit
import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from typing import TypeVar

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

T = TypeVar("T")

#: Settings that the engine counts on; a cluster's own values for the rest are left alone.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(cpus: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches on one machine."""
    b = SparkSession.builder.master(f"local[{cpus}]").appName("grainmill")
    conf = {
        **DEFAULTS,
        "spark.sql.shuffle.partitions": str(shuffle_partitions),
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "8g",
        **conf,
    }
    for k, v in conf.items():
        b = b.config(k, v)
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, named by the cluster in spark.checkpoint.dir.

    Only a session on one machine may go without: it gets a temporary folder. On a cluster that would be a folder that other
    machines can't read, so a missing setting raises there.
    """
    sc = spark.sparkContext
    named = sc.getConf().get("spark.checkpoint.dir", None)
    if named is None and sc.getCheckpointDir() is None and not (sc.master == "local" or sc.master.startswith("local[")):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(named or os.path.join(tempfile.gettempdir(), f"grainmill-{uuid.uuid4().hex}"))
    return named or sc.getCheckpointDir()


def cut(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and go on from the files, so that a lost executor costs nothing that came before.

    A written table is computed once and stored by column, where checkpoint() would compute the last stage twice and store rows. The
    files are removed at the end of the scratch() block they were written in, else when the Python process ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/grainmill-tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"
    _written[0].append((spark, path))
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def store_folder(spark: SparkSession) -> str:
    """A new folder in the shared one for a store that lives as long as the tables of cut()."""
    path = f"{shared_folder(spark)}/grainmill-stores/{uuid.uuid4().hex}"
    _written[0].append((spark, path))
    return path


#: Tables written so far: one list for the process, and one for each open scratch() block, the innermost first.
_written: list[list[tuple[SparkSession, str]]] = [[]]


@contextlib.contextmanager
def scratch() -> Iterator[None]:
    """Remove the tables that cut() writes within the block when it ends; frames built on them must have been used by then.

    A long session runs each query in such a block, so that it doesn't fill the shared folder. Blocks nest; they are for one
    query of a process at a time.
    """
    _written.insert(0, [])
    mine = _written[0]
    try:
        yield
    finally:
        _written[:] = [x for x in _written if x is not mine]
        _remove(mine)


def _remove(tables: list[tuple[SparkSession, str]]) -> None:
    for spark, path in tables:
        try:
            hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(hadoop, True)
        except Exception:  # the session has ended; nothing depends on what is left
            continue


atexit.register(lambda: [_remove(tables) for tables in _written])


def together(*steps: Callable[[], T]) -> list[T]:
    """Results of independent steps that each start Spark jobs of their own, run at the same time."""
    with ThreadPoolExecutor(len(steps)) as pool:
        return [f.result() for f in [pool.submit(s) for s in steps]]


def broadcast_if_small(df: DataFrame, rows: int = 100_000) -> DataFrame:
    """Broadcast df if it has at most so many rows, which is counted first; else leave the join to the planner."""
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")
