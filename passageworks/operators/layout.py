"""Ordered treemap of collections, groups and passages, and picking from it."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from passageworks.functions.keyed import each_key

BASE_WEIGHT = 30
BANDS = 6


def weights(passages: DataFrame) -> DataFrame:
    """(passage_id, coll, grp, weight): bytes of the text and a base for each passage."""
    return passages.select("passage_id", "coll", "grp", "num", (F.octet_length("text") + BASE_WEIGHT).cast("double").alias("weight"))


def split(items: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Boxes in order: halve where the running weight is nearest to half (of two as near the later), across the longer side, and go on inside."""
    out: list[tuple[float, float, float, float]] = [(x, y, w, h)] * len(items)
    todo = [(0, len(items), x, y, w, h)] if items else []
    sums = [0.0, *accumulate(items)]
    while todo:
        a, b, x, y, w, h = todo.pop()
        if b - a == 1:
            out[a] = (x, y, w, h)
            continue
        whole = sums[b] - sums[a]
        half = sums[a] + whole / 2
        cut = bisect_left(sums, half, a + 1, b)
        cut -= cut > a + 1 and half - sums[cut - 1] < sums[cut] - half
        cut = min(cut, b - 1)
        part = (sums[cut] - sums[a]) / whole if whole else 0.5
        if w >= h:
            todo += [(a, cut, x, y, w * part, h), (cut, b, x + w * part, y, w * (1 - part), h)]
        else:
            todo += [(a, cut, x, y, w, h * part), (cut, b, x, y + h * part, w, h * (1 - part))]
    return out


def stacked(items: list[float], x: float, y: float, w: float, h: float) -> list[tuple[float, float, float, float]]:
    """Boxes one below the other, as high as their part of the weight."""
    sums = [0.0, *accumulate(items)]
    return [(x, y + h * a / sums[-1], w, h * (b - a) / sums[-1]) for a, b in zip(sums, sums[1:], strict=False)]


def boxes(children: DataFrame, keys: list[str], order: str, schema: str, cut: Callable[..., list[tuple[float, float, float, float]]] = split) -> DataFrame:
    """Lay out the children of each parent in the parent's box (px, py, pw, ph); one parent's children at a time."""
    names = [part.split()[0] for part in schema.split(", ")][:-4]

    def place(rows: list[dict]) -> list[tuple]:
        box = rows[0]
        found = cut([r["weight"] for r in rows], box["px"], box["py"], box["pw"], box["ph"])
        return [(*(r[n] for n in names), *b) for r, b in zip(rows, found, strict=True)]

    return each_key(children, keys, [order], place, schema)


def within_parent(children: DataFrame, parents: DataFrame, keys: list[str]) -> DataFrame:
    return children.join(parents.select(*keys, *(F.col(c).alias(f"p{c}") for c in "xywh")), keys)


def treemap(passages: DataFrame, aspect: float = 1.0, sections: DataFrame | None = None) -> DataFrame:
    """(level, coll, grp, passage_id, x, y, w, h) for collections, groups and passages; empty input: no rows.

    ``sections`` (coll, testament, section) groups collections at two upper levels, which have no rows of their own: testaments lie
    one below the other, sections are split like the rest. Without it all collections lie in one. The aspect is clamped to 0.5 to 3.
    """
    wide = min(3.0, max(0.5, aspect))
    kind, grp_kind = dict(passages.dtypes)["coll"], dict(passages.dtypes)["grp"]
    leaf = weights(passages)
    group = leaf.groupBy("coll", "grp").agg(F.sum("weight").alias("weight"), F.min("passage_id").alias("at"))
    coll = group.groupBy("coll").agg(F.sum("weight").alias("weight"), F.min("at").alias("at"))
    kinds = sections if sections is not None else coll.select("coll", F.lit(0).alias("testament"), F.lit(0).alias("section"))
    coll = coll.join(kinds, "coll")
    section = coll.groupBy("testament", "section").agg(F.sum("weight").alias("weight"), F.min("at").alias("at"))
    testament = section.groupBy("testament").agg(F.sum("weight").alias("weight"), F.min("at").alias("at")).withColumns({"root": F.lit(0), "px": F.lit(0.0), "py": F.lit(0.0), "pw": F.lit(wide), "ph": F.lit(1.0)})
    xy = "x double, y double, w double, h double"
    t = boxes(testament, ["root"], "at", f"testament int, {xy}", stacked)
    s = boxes(within_parent(section, t, ["testament"]), ["testament"], "at", f"testament int, section int, {xy}")
    c = boxes(within_parent(coll, s, ["testament", "section"]), ["testament", "section"], "at", f"coll {kind}, {xy}")
    g = boxes(within_parent(group, c, ["coll"]), ["coll"], "at", f"coll {kind}, grp {grp_kind}, {xy}")
    p = boxes(within_parent(leaf, g, ["coll", "grp"]), ["coll", "grp"], "passage_id", f"coll {kind}, grp {grp_kind}, passage_id bigint, {xy}")
    none = lambda name, type_: F.lit(None).cast(type_).alias(name)
    out = c.select(F.lit("collection").alias("level"), "coll", none("grp", grp_kind), none("passage_id", "bigint"), *"xywh")
    out = out.union(g.select(F.lit("group"), "coll", "grp", none("passage_id", "bigint"), *"xywh"))
    return out.union(p.select(F.lit("passage"), "coll", "grp", "passage_id", *"xywh"))


def pick(layout: DataFrame, x: float, y: float) -> DataFrame:
    """Boxes of every level that hold a point; left and top edges belong to a box."""
    return layout.filter((F.col("x") <= x) & (F.lit(x) < F.col("x") + F.col("w")) & (F.col("y") <= y) & (F.lit(y) < F.col("y") + F.col("h")))


def visible(layout: DataFrame, x: float, y: float, w: float, h: float) -> DataFrame:
    """Boxes that meet a viewport."""
    return layout.filter((F.col("x") < x + w) & (F.col("x") + F.col("w") > x) & (F.col("y") < y + h) & (F.col("y") + F.col("h") > y))


def band(heat: Column) -> Column:
    """Heat 0 to 255 as one of six bands."""
    return F.floor(heat / 256 * BANDS).cast("int")
