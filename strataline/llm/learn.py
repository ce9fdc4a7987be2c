"""What the two classifiers share: labelled rows and their bounded sample."""

from __future__ import annotations

import pickle
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type


def fold(id_col: str, of: int) -> Column:
    """crc32 of the id as text, modulo of."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % of


def labelled_rows(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, chars: int, id_col: str = "doc_id") -> DataFrame | None:
    """place, text, y: at most rows texts with their label (0 or 1), half of each label where there are enough, of at most chars characters in all; None if there are none.

    Which ones is decided by a hash of the id alone, so that the sample is the same wherever the rows lie and texts of
    every length are in it; in that order, that of place, texts are taken while they fit into chars. Rows without a text
    or a label are left out; of repeated ids one row counts.
    """
    marked = labels.where(usable & F.col(label).isin(0, 1)).select(F.col(id_col).alias("i"), F.col(label).cast("int").alias("y")).dropDuplicates(["i"])
    chosen = None
    for y in (0, 1):
        part = marked.where(F.col("y") == y).orderBy(F.xxhash64("i"), "i").limit(rows // 2)
        chosen = part if chosen is None else chosen.unionAll(part)
    texts = docs.where(F.col("text").isNotNull()).select(F.col(id_col).alias("i"), "text")
    # at most rows labels: small whatever the tables' size; their lengths first, so that what comes here is bounded too
    sizes = texts.join(F.broadcast(chosen), "i").groupBy("i").agg(F.max(F.length("text")).alias("n"), F.max("y").alias("y")).collect()
    left, fit = chars, []
    for r in sorted(sizes, key=lambda r: (hash_order(r.i), r.i)):
        if r.n <= left:
            left -= r.n
            fit.append((r.i, r.y, len(fit)))
    if not fit:
        return None
    # through Arrow: rows of Python objects would start a second kind of Python worker on each executor
    held = T.StructType([*marked.schema.fields, T.StructField("place", T.IntegerType())])
    fit = docs.sparkSession.createDataFrame(pa.table([pa.array(c, to_arrow_type(f.dataType)) for c, f in zip(zip(*fit), held)], names=held.names), held)
    longest = F.max(F.struct(F.length("text").alias("n"), "text"))
    return texts.join(F.broadcast(fit), "i").groupBy("place").agg(longest.alias("t"), F.max("y").alias("y")).select("place", F.col("t.text").alias("text"), "y")


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, usable: Column, rows: int, chars: int) -> list[tuple[str, int]]:
    """The texts and labels of labelled_rows in order, on the driver."""
    sample = labelled_rows(docs, labels, label, usable, rows, chars)
    return [(r.text, r.y) for r in sample.orderBy("place").collect()] if sample is not None else []


def trained(sample: DataFrame | None, train: Callable[[list[tuple[str, int]]], object]) -> object:
    """train of labelled_rows' texts and labels in order, run in one task: only the model comes to the driver."""
    if sample is None:
        return train([])

    def run(batches):
        rows = sorted(r for b in batches for r in zip(*(b[c].to_pylist() for c in ("place", "text", "y"))))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(train([(t, y) for _, t, y in rows]))], pa.binary())], names=["model"])

    return pickle.loads(sample.repartition(1).mapInArrow(run, "model binary").first().model)


def hash_order(i) -> int:
    """A fixed shuffle of ids."""
    import zlib

    return zlib.crc32(b"order" + str(i).encode())


_LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))


def lowered(text: str) -> bytes:
    """A text's UTF-8 bytes with A to Z, and nothing else, in lower case."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER)
