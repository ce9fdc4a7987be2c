"""The analysis document: one nested JSON text of a whole analysis, with numbers as base64 of 16-bit planes.

Its parts are made by Spark, each a line of the document, and written by one task in their order, a line at a time.
Reading takes the lines apart again, so that only the parts asked for are decoded.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import planes

#: Fixed values of the format: what numbers of these parts are multiplied by; all others by 100.
SCALES = {"trendP": 10000, "phase": 10, "mhwDays": 10, "mhwDaysEarly": 10, "mhwDaysLate": 10}


def scale_of(name: Column) -> Column:
    out = F.lit(100)
    for k, x in SCALES.items():
        out = F.when(name == k, x).otherwise(out)
    return out


def quantised(value: Column, scale: Column) -> Column:
    """16 bits of value times scale, cut off at their ends; null for null and NaN."""
    x = F.round(value * scale)
    return F.when(value.isNotNull() & ~F.isnan(value), F.greatest(F.lit(-32767), F.least(F.lit(32767), x))).cast("int")


def plane_parts(df: DataFrame, group: str, place: list[str], columns: dict[str, str], key: str | None = None) -> DataFrame:
    """group, member, name, text: each column (name in the document -> column) as a plane in the order of place, by key if there is one."""
    values = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("v")) for n, c in columns.items()])).alias("x")
    member = F.col(key).cast("string") if key else F.lit("")
    rows = df.select(member.alias("member"), *place, values).select("member", *place, "x.name", "x.v")
    plane = planes.to_plane(rows, ["member", "name"], place, quantised(F.col("v"), scale_of(F.col("name"))))
    return plane.select(F.lit(group).alias("group"), "member", "name", F.concat(F.lit('"'), F.col("plane"), F.lit('"')).alias("text"))


def list_parts(df: DataFrame, group: str, order: list[str], columns: list[str], key: str) -> DataFrame:
    """group, member, text: a key's rows as a list of objects (events, for instance), in order."""
    rows = df.groupBy(F.col(key).cast("string").alias("member")).agg(F.array_sort(F.collect_list(F.struct(*order, F.struct(*columns).alias("row")))).alias("rows"))
    return rows.select(F.lit(group).alias("group"), "member", F.lit("").alias("name"), F.to_json(F.transform("rows", lambda s: s["row"])).alias("text"))


def write_document(parts: DataFrame, path: str, head: dict, groups: list[str]) -> None:
    """Writes one JSON document under path: the entries of head, then the groups of parts in the order given.

    A part stands at group.member.name, or one of both if the other is empty. Groups without parts are empty objects.
    """
    spark = parts.sparkSession
    line = lambda *x: F.concat(*x)
    quoted = lambda c: F.to_json(F.array(c))
    bare = lambda c: F.expr(f"substring({c}, 2, length({c}) - 2)")
    p = parts.withColumns({"_m": quoted(F.col("member")), "_n": quoted(F.col("name"))})
    p = p.select("group", "member", "name", F.when(F.col("member") == "", "").otherwise(bare("_m")).alias("m"), F.when(F.col("name") == "", "").otherwise(bare("_n")).alias("n"), "text")
    rank = F.array_position(F.array(*map(F.lit, groups)), F.col("group"))
    body = p.select(rank.alias("at"), F.lit(1).alias("kind"), "member", "name", line(F.lit("@"), F.to_json(F.array("group", "member", "name")), F.lit("@"), "m", F.lit("@"), "n", F.lit("@"), "text").alias("text"))
    edges = [(0, 0, "", "", "{" + "".join(f"{json.dumps(k)}:{json.dumps(v)}," for k, v in head.items()))]
    edges += [(k + 1, 0, "", "", f"{json.dumps(g)}:{{") for k, g in enumerate(groups)]
    edges += [(k + 1, 2, "", "", "}," if k + 1 < len(groups) else "}}") for k in range(len(groups))]
    every = body.unionByName(spark.createDataFrame(edges, "at int, kind int, member string, name string, text string").withColumn("at", F.col("at").cast("long")))

    def joined(batches):
        import pyarrow as pa

        before = None
        for b in batches:
            out = []
            for kind, member, text in zip(*(b[c].to_pylist() for c in ("kind", "member", "text"))):
                if kind != 1:
                    out.append(("}" if before else "") + text)
                    before = None
                    continue
                _, key, m, n, value = text.split("@", 4)
                lead = ("," if before == member else "}," if before else "") if before is not None else ""
                if m and n:
                    out.append(lead + (f"{m}:{{" if before != member else "") + f"{n}:{value}")
                    before = member
                else:
                    out.append(("," if before is not None else "") + f"{m or n}:{value}")
                    before = ""
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.string())], names=["value"])

    # one task writes the text, a sorted line at a time
    every.repartition(1).sortWithinPartitions("at", "kind", "member", "name").mapInArrow(joined, "value string").write.mode("overwrite").text(path)


def read_document(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """The document as one row of a schema in DDL: name only the parts that are wanted."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def document_planes(doc: DataFrame, columns: dict[str, str]) -> DataFrame:
    """name, at, value: the numbers of planes (name in the document -> column of doc) again, null where there are none."""
    rows = doc.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.expr(c).alias("plane")) for n, c in columns.items()])).alias("x")).select("x.*")
    return planes.from_plane(rows, ["name"], "plane", 1.0).select("name", "at", (F.col("value") / scale_of(F.col("name"))).alias("value"))
