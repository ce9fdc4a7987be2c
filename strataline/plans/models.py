"""Boosted trees over orders: which orders are worth much, by features of their lines, terms and buyer. Nations are the blocks.

The trees are grown in rounds that SQL can't state; tests hold them against slow versions.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import boosting
from .climate import _t
from .registry import register

GROUPS = {
    "lines": ["lines", "quantity", "season"],
    "terms": ["discount", "tax", "season"],
    "buyer": ["account", "total", "season"],
    "all": ["lines", "quantity", "discount", "tax", "account", "total", "season"],
}
FEATURES = sorted(GROUPS["all"])
#: Fewer and larger steps than the operator's own 200 of 0.05, for the time of a report.
HOW = {"trees": 6, "rate": 0.3}


def orders(spark: SparkSession, d: str) -> DataFrame:
    """One row per order with lines: nation, worth (1 if its lines cost more than 200,000) and the features."""
    line = _t(spark, d, "lineitem").groupBy("l_orderkey").agg(
        F.count("*").alias("lines"), F.avg("l_quantity").alias("quantity"), F.avg("l_discount").alias("discount"), F.avg("l_tax").alias("tax"),
        F.sum(F.round(F.col("l_extendedprice") * 100).cast("long")).alias("cents"),
    )
    made = _t(spark, d, "orders").join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(line, F.col("o_orderkey") == F.col("l_orderkey"))
    return made.select(
        F.col("o_orderkey").alias("order"), F.col("c_nationkey").alias("nation"), (F.col("cents") > 20_000_000).cast("int").alias("worth"), "lines", "quantity", "discount", "tax",
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("account"), F.col("o_totalprice").alias("total"), F.quarter("o_orderdate").alias("season"),
    )


def _whole(spark: SparkSession, d: str, features: list[str]):
    df = orders(spark, d)
    edges = boosting.bin_edges(df, features, 32)
    rows = boosting.binned(df, features, "worth", edges, ["order"])
    (model,) = boosting.fit(rows, [boosting.Model(tuple(range(len(features))))], edges, **HOW)
    return rows, model, edges


@register("tree_validation")
def tree_validation(spark, d):
    """Area under the curve of blocks that the trees didn't see, by group of features: mean and deviation of repetitions."""
    return boosting.cross_validated(orders(spark, d), GROUPS, "worth", ["nation"], reps=2, folds=5, bins=32, **HOW)


@register("tree_importance")
def tree_importance(spark, d):
    """The features by how much the area falls without them, most important first."""
    rows, model, _ = _whole(spark, d, FEATURES)
    return boosting.permutation_importance(rows, model, FEATURES, repeats=5).orderBy(F.desc("drop"), "feature")


@register("tree_curves")
def tree_curves(spark, d):
    """Partial dependence on the features of lines and terms, 30 points each; the season isn't shown."""
    rows, model, edges = _whole(spark, d, FEATURES)
    return boosting.partial_dependence(rows, model, FEATURES, edges, ["lines", "quantity", "discount", "tax"])
