"""Boxes on a page: overlap, containment, and the words beside a control."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of two boxes struct(x, y, w, h); 0 without area."""
    w = F.greatest(F.lit(0), F.least(a["x"] + a["w"], b["x"] + b["w"]) - F.greatest(a["x"], b["x"]))
    h = F.greatest(F.lit(0), F.least(a["y"] + a["h"], b["y"] + b["h"]) - F.greatest(a["y"], b["y"]))
    union = a["w"] * a["h"] + b["w"] * b["h"] - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def centre(b: Column) -> Column:
    return F.struct((b["x"] + b["w"] / 2).alias("x"), (b["y"] + b["h"] / 2).alias("y"))


def within(inner: Column, outer: Column) -> Column:
    """Whether the middle of one box lies in another."""
    c = centre(inner)
    return c["x"].between(outer["x"], outer["x"] + outer["w"]) & c["y"].between(outer["y"], outer["y"] + outer["h"])


def bounds(points: Column) -> Column:
    """struct(x, y, w, h) of a polygon array<struct<x, y>>."""
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return F.struct(F.array_min(xs).alias("x"), F.array_min(ys).alias("y"), (F.array_max(xs) - F.array_min(xs)).alias("w"), (F.array_max(ys) - F.array_min(ys)).alias("h"))


def low_confidence(words: DataFrame, threshold: float, top: int, by: str = "doc_id") -> DataFrame:
    """The `top` least sure words of every page below a threshold: regions to be read again. Ties by position."""
    order = Window.partitionBy(by, "page").orderBy("conf", "y", "x")
    return words.where(F.col("conf") < threshold).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def control_labels(controls: DataFrame, words: DataFrame, reach: int = 520, most: int = 8) -> DataFrame:
    """(doc_id, page, control_id, label): words right of a control on its row, at most `reach` away, in reading order.

    Rows are cut into bands of the control's own height, so the join is on equal bands and not on all pairs of a page.
    """
    band = 64
    c = controls.select("doc_id", "page", "control_id", "x", "y", "w", "h", F.explode(F.sequence(F.floor((F.col("y") - F.col("h")) / band), F.floor((F.col("y") + 2 * F.col("h")) / band))).alias("band"))
    t = words.select("doc_id", "page", F.col("x").alias("wx"), F.col("y").alias("wy"), F.col("h").alias("wh"), "text", F.floor((F.col("y") + F.col("h") / 2) / band).alias("band"))
    near = c.join(t, ["doc_id", "page", "band"]).where((F.col("wx") >= F.col("x") + F.col("w")) & (F.col("wx") <= F.col("x") + F.col("w") + reach) & (F.abs(F.col("wy") + F.col("wh") / 2 - F.col("y") - F.col("h") / 2) <= F.col("h")))
    order = Window.partitionBy("doc_id", "page", "control_id").orderBy("wy", "wx")
    first = near.withColumn("k", F.row_number().over(order)).where(F.col("k") <= most)
    return first.groupBy("doc_id", "page", "control_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "text"))), lambda x: x["text"]), " ").alias("label"))
