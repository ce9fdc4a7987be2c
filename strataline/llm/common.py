"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """Where executors and driver both can read and write: spark.checkpoint.dir; on one machine else a folder under the warehouse."""
    sc = spark.sparkContext
    shared = sc.getConf().get("spark.checkpoint.dir")
    if not shared and not sc.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    return shared or spark.conf.get("spark.sql.warehouse.dir") + "/_checkpoints"


def cut(df: DataFrame) -> DataFrame:
    """df written once to the shared checkpoint folder, so that what follows reads it instead of computing it again.

    The folder is that of shared_folder.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    out = df.checkpoint(eager=True)
    _let_go(df.sparkSession)
    return out


def _let_go(spark: SparkSession) -> None:
    """Spark deletes the shuffle files of a finished job once the JVM's collector finds its plan unused; this lets it look now."""
    spark.sparkContext._jvm.System.gc()


def written(df: DataFrame) -> DataFrame:
    """As cut, but as a compressed Parquet table under the shared folder: for many rows of few columns. It goes when Spark ends."""
    spark = df.sparkSession
    sc = spark.sparkContext
    path = sc._jvm.org.apache.hadoop.fs.Path(f"{shared_folder(spark)}/written-{uuid.uuid4().hex}")
    df.write.option("compression", "zstd").parquet(path.toString())
    path.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(path)
    _let_go(spark)
    out = spark.read.schema(df.schema).parquet(path.toString())
    out.written_at = path
    return out


def discard(table_written: DataFrame) -> None:
    """Deletes a table of written once all that was computed from it has been written too."""
    path, sc = table_written.written_at, table_written.sparkSession.sparkContext
    path.getFileSystem(sc._jsc.hadoopConfiguration()).delete(path, True)


def others(df: DataFrame, *names: str) -> list[str]:
    """df's columns but those of these names (Spark compares names without case)."""
    taken = {n.lower() for n in names}
    return [f"`{c}`" for c in df.columns if c.lower() not in taken]


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """A column name for each stem that df doesn't use (Spark compares names without case)."""
    used = {c.lower() for c in df.columns}
    out = []
    for s in stems:
        while s.lower() in used:
            s = "_" + s
        used.add(s.lower())
        out.append(s)
    return out


def whole_id(df: DataFrame, id_col: str) -> Column:
    """The id column as a long; ids of other types than whole numbers are an error, not rows that fail one by one."""
    if not isinstance(df.schema[id_col].dataType, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.NullType)):
        raise TypeError(f"{id_col} must hold whole numbers of at most 64 bits, not {df.schema[id_col].dataType.simpleString()}")
    return F.col(id_col).cast("long")


def join_split(rows: DataFrame, keys: DataFrame, on: list[str], many: str, total: int, share: int = 1000) -> DataFrame:
    """The equi-join of rows with keys (one row for each key, with how often it stands among rows in column many).

    Keys that hold more than one in share of all rows are fewer than share, whatever the data: they are broadcast, so
    that a hot key's rows stay where they are. All others meet in a shuffle.
    """
    hot = F.col(many) * share > total
    heavy = F.broadcast(keys.where(hot))
    few = F.broadcast(keys.where(hot).select(*on))
    return rows.join(heavy, on).unionByName(rows.join(few, on, "left_anti").join(keys.where(~hot), on))


_STORES: dict[str, dict] = {}


def only(owner: str, store: dict | None = None) -> None:
    """In a Python worker: what other operators' tasks left in its memory goes, so that one at a time remembers words there."""
    for name, other in _STORES.items():
        if name != owner:
            other.clear()
    if store is not None:
        _STORES[owner] = store


def slices(batches, rows: int = 256):
    """Arrow batches in parts of few rows, for what turns them into Python objects."""
    for b in batches:
        for a in range(0, b.num_rows, rows):
            yield b.slice(a, rows)
