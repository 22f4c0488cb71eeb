"""Boxes of containment forests against a plain layout, and a container of very many children."""

import random

import pytest
from pyspark.sql import functions as F

from spandrel.operators import treemap as T
from spandrel.operators import views as V
from spandrel.operators.tables import Scratch
from spandrel.operators.treemap import treemap
from spandrel.plans import fixtures as X

SCHEMA = "parent string, child string, name string, is_virtual boolean"


def plain_boxes(items, x, y, w, h):
    """Strips grow child by child; every ratio is taken over the whole strip."""

    def worst(areas, side):
        thick = sum(areas) / side
        return max(max(thick * thick / a, a / thick / thick) for a in areas)

    out, rest = [], sorted(items, key=lambda i: (-i[1], i[0]))
    while rest and w >= 1 and h >= 1:
        side, n = min(w, h), 1
        while n < len(rest) and worst([a for _, a in rest[: n + 1]], side) <= worst([a for _, a in rest[:n]], side) * (1 + 1e-9):
            n += 1
        thick, along = sum(a for _, a in rest[:n]) / side, 0.0
        for id_, a in rest[:n]:
            out.append((id_, x, y + along, thick, a / thick) if w >= h else (id_, x + along, y, a / thick, thick))
            along += a / thick
        x, y, w, h = (x + thick, y, w - thick, h) if w >= h else (x, y + thick, w, h - thick)
        rest = rest[n:]
    return [(i, bx, by, max(2.0, bw), max(2.0, bh)) for i, bx, by, bw, bh in out]


def plain_treemap(rows, weights, cell=2000):
    kids = {}
    for p, c in set(rows):
        if c in weights:
            kids.setdefault(p, []).append(c)
    total = sum(weights[c] for c in kids.get(None, []))
    if not total:
        return []
    width = float(round((total * cell * 4 / 3) ** 0.5))
    out, open_ = [], [(None, 0.0, 0.0, width, float(round(total * cell / width)))]
    while open_:
        p, x, y, w, h = open_.pop()
        s = sum(weights[c] for c in kids[p])
        for box in plain_boxes([(c, weights[c] / s * w * h) for c in kids[p]], x, y, w, h):
            out.append(box)
            i, bx, by, bw, bh = box
            if i in kids and bw - 20 >= 4 and bh - 34 >= 4:
                open_.append((i, bx + 10, by + 24, bw - 20, bh - 34))
    return out


def check(spark, rows):
    shape = spark.createDataFrame([(p, c, "n" * (3 + len(c) * 3), False) for p, c in rows], SCHEMA)
    weights = {r["id"]: r["weight"] for r in V.subtree_weights(shape).collect()}
    got = sorted(tuple(r) for r in treemap(shape).select("id", *"xywh").collect())
    want = sorted(plain_treemap(rows, weights))
    assert [g[0] for g in got] == [w[0] for w in want]
    for g, w in zip(got, want, strict=True):
        assert g[1:] == pytest.approx(w[1:], rel=1e-6, abs=1e-6)
    return got


def test_as_the_plain_layout(spark):
    """Two roots, bushes and chains, names of many lengths, a child of two containers, and a cycle, which has no box."""
    r = random.Random(0)
    rows = [(None, "a"), (None, "b")] + [(r.choice("ab") if i < 40 else f"n{r.randrange(i // 2)}", f"n{i}") for i in range(120)] + [("a", "n110"), ("n9", "x1"), ("x1", "x2"), ("x2", "x1")]
    assert check(spark, rows)


def test_equal_children(spark):
    """Runs longer than a strip, and ties by id."""
    check(spark, [(None, "a")] + [("a", f"k{i:04d}") for i in range(1500)] + [("a", f"longer{i:04d}") for i in range(40)])


def test_no_boxes(spark):
    assert check(spark, []) == []
    assert check(spark, [("x1", "x2"), ("x2", "x1")]) == []


def test_runs_add_up_as_children_do():
    """Strips of runs are those of the same children one by one, whatever the areas."""
    r = random.Random(5)
    for _ in range(60):
        areas = sorted((r.choice([1, 2, 3, 5, 8, 40, r.random() * 50]) for _ in range(r.randrange(1, 90))), reverse=True)
        w, h = r.uniform(5, 60), r.uniform(5, 60)
        areas = [a / sum(areas) * w * h for a in areas]
        own, got = T.Strips(0.0, 0.0, w, h), []
        for a in dict.fromkeys(areas):
            got += own.add(a, areas.count(a))
        got += own.end()
        boxes = [(first + i, x + i * dx, y + i * dy, max(2.0, bw), max(2.0, bh)) for first, n, x, y, dx, dy, bw, bh in got for i in range(n)]
        want = plain_boxes(list(enumerate(areas)), 0.0, 0.0, w, h)
        assert [b[0] for b in boxes] == [b[0] for b in want]
        assert [c for b in boxes for c in b] == pytest.approx([c for b in want for c in b], rel=1e-6, abs=1e-6)


def test_a_huge_container_is_no_group(spark):
    """200,000 children of one container: what is streamed in order are their few weights, and all get boxes that fill it."""
    n = 200_000
    rows = spark.range(n).select(F.lit("top").alias("parent"), F.format_string("c%07d", "id").alias("id"), (F.col("id") % 7 + 3).cast("double").alias("weight"))
    scratch = Scratch(spark)
    children = T.numbered(scratch, rows)
    assert children.agg(F.countDistinct("at"), F.min("at"), F.max("at")).first() == (n, 0, n - 1)
    runs = children.groupBy("parent", "weight").agg(F.count(F.lit(1)).alias("n"))
    runs = runs.withColumn("sum", F.lit(rows.agg(F.sum("weight")).first()[0]))
    assert runs.count() == 7
    side = 4000.0
    box = spark.createDataFrame([("top", 0.0, 0.0, side, side)], "parent string, x double, y double, w double, h double")
    assert T.strips(runs.join(box, "parent")).count() < 2000
    got = T.lay_out(scratch, children, runs, box, 1)
    area, right, low, count = got.agg(F.sum(F.col("w") * F.col("h")), F.max(F.col("x") + F.col("w")), F.max(F.col("y") + F.col("h")), F.count(F.lit(1))).first()
    assert count > 0.99 * n and area == pytest.approx(side * side, rel=0.01) and right <= side + 2 and low <= side + 2


def test_treemap_lies_inside(spark, data):
    """Every box lies inside that of its container, boxes of one container do not overlap, and areas are as their weights."""
    shape = V.structure(X.catalog(spark, data))
    parents = {(r["parent"], r["child"]) for r in shape.select("parent", "child").collect()}
    weights = {r["id"]: r["weight"] for r in V.subtree_weights(shape).collect()}
    boxes = {r["id"]: r for r in treemap(shape).collect()}
    assert {c for p, c in parents if p is None} <= set(boxes)
    groups = {}
    for p, c in parents:
        if c in boxes:
            groups.setdefault(p, []).append(boxes[c])
            if p is not None:
                o, i = boxes[p], boxes[c]
                assert o["x"] <= i["x"] and o["y"] <= i["y"] and i["x"] + i["w"] <= o["x"] + o["w"] + 2 and i["y"] + i["h"] <= o["y"] + o["h"] + 2
    for rows in groups.values():
        large = [b for b in rows if b["w"] > 2 and b["h"] > 2]  # thinner ones are drawn 2 wide
        for i, a in enumerate(large[:40]):
            for b in large[i + 1 : 40]:
                assert min(a["x"] + a["w"], b["x"] + b["w"]) - max(a["x"], b["x"]) < 1e-6 or min(a["y"] + a["h"], b["y"] + b["h"]) - max(a["y"], b["y"]) < 1e-6
        per = [b["w"] * b["h"] / weights[b["id"]] for b in large]
        assert not per or max(per) == pytest.approx(min(per), rel=1e-6)
