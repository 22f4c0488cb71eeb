"""Boxes of a containment forest, squarified (Bruls, Huizing, van Wijk), with no container in one group.

A strip's worst aspect ratio needs only its total, its largest and its smallest area, and where it breaks depends on the
weights in falling order alone. So a container's children are first counted by weight. These runs of equal weights are streamed
past one strip at a time, with nothing held; within a run the break is found by a formula, and a strip leaves one row for each
run in it. A weight is a whole multiple of a fixed step, so a container of total weight T has fewer than sqrt(2 T / step) of them:
five million leaves are a few dozen rows. The children are numbered within their containers by one sort over range partitions, and
each takes its place by its number.

Defined cases: ties go by id; a container without a box, or with less than 4 by 4 inside, shows no children; children that come
when less than 1 is left of either side get no box, nor do weights of 0; nodes without a weight (on a cycle) are left out; a child
of two containers has a box in each; an empty forest has no boxes.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from spandrel.operators.components import side
from spandrel.operators.tables import Scratch
from spandrel.operators.views import BASE_CELL, HEADER, PAD, SLIDER, subtree_weights

#: Ratios this close count as equal, so that a strip grows alike however its total was added up.
TIE = 1 + 1e-9


class Strips:
    """The strips of one container, from runs of equal areas that come in falling order."""

    def __init__(self, x: float, y: float, w: float, h: float):
        self.x, self.y, self.w, self.h = x, y, w, h
        self.at = 0  # children placed or in the open strip
        self.open: list[tuple[int, int, float]] = []  # (first child, children, area of each)
        self.total = self.largest = 0.0

    def _worst(self, total: float, smallest: float) -> float:
        square = (total / min(self.w, self.h)) ** 2
        return max(square / smallest, self.largest / square)

    def _more(self, area: float, most: int) -> int:
        """How many children of ``area``, of ``most``, the open strip takes."""
        if self._worst(self.total + area, area) > self._worst(self.total, self.open[-1][2]) * TIE:
            return 0
        # As more equal areas are added the ratio falls and then rises; it is least at this total.
        least = min(self.w, self.h) * (self.largest * area) ** 0.25
        k = min(most, max(1, int((least - self.total) / area) - 2))
        now = self._worst(self.total + k * area, area)
        while k < most and (then := self._worst(self.total + (k + 1) * area, area)) <= now * TIE:
            k, now = k + 1, then
        return k

    def _close(self) -> Iterator[tuple]:
        """(first, children, x, y, dx, dy, w, h) of each run of the open strip, which ends here."""
        thick, along = self.total / min(self.w, self.h), 0.0
        upright = self.w >= self.h
        for first, n, area in self.open:
            long = area / thick
            if upright:
                yield first, n, self.x, self.y + along, 0.0, long, thick, long
            else:
                yield first, n, self.x + along, self.y, long, 0.0, long, thick
            along += n * long
        if upright:
            self.x, self.w = self.x + thick, self.w - thick
        else:
            self.y, self.h = self.y + thick, self.h - thick
        self.open, self.total = [], 0.0

    def add(self, area: float, n: int) -> Iterator[tuple]:
        """The strips that ``n`` more children of ``area`` complete."""
        while n and self.w >= 1 and self.h >= 1:
            if not self.open:
                self.open, self.total, self.largest, taken = [(self.at, 1, area)], area, area, 1
            elif taken := self._more(area, n):
                self.open.append((self.at, taken, area))
                self.total += taken * area
            else:
                yield from self._close()
                continue
            self.at, n = self.at + taken, n - taken

    def end(self) -> Iterator[tuple]:
        if self.open:
            yield from self._close()


def strips(runs: DataFrame) -> DataFrame:
    """(parent, first, n, x, y, dx, dy, w, h) of runs (parent, weight, n, sum, x, y, w, h): rows of equal boxes, dx and dy apart."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        parent, own, out = None, None, []

        def given() -> pd.DataFrame:
            return pd.DataFrame(out, columns=["parent", "first", "n", "x", "y", "dx", "dy", "w", "h"])

        for pdf in frames:
            for r in pdf.itertuples(index=False):
                if own is None or r.parent != parent:
                    if own:
                        out += [(parent, *s) for s in own.end()]
                    parent, own = r.parent, Strips(r.x, r.y, r.w, r.h)
                for s in own.add(r.weight / r.sum * r.box_w * r.box_h, r.n):
                    out.append((parent, *s))
                    if len(out) == 10_000:
                        yield given()
                        out.clear()
        if own:
            out += [(parent, *s) for s in own.end()]
        yield given()

    dealt = runs.withColumns({"box_w": F.col("w"), "box_h": F.col("h")}).repartition("parent").sortWithinPartitions("parent", F.desc("weight"))
    return dealt.mapInPandas(run, "parent string, first long, n long, x double, y double, dx double, dy double, w double, h double")


def numbered(scratch: Scratch, pairs: DataFrame) -> DataFrame:
    """``pairs`` (parent, id, weight) with ``at``, a child's place in its container from 0: heaviest first, then by id."""
    order = ("parent", F.desc("weight"), "id")
    placed = scratch.keep(pairs.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("seq", F.monotonically_increasing_id()))
    placed = placed.withColumns({"part": F.shiftright("seq", 33), "seq": F.col("seq").bitwiseAND(F.lit((1 << 33) - 1))})
    # A container's rows of a partition are neighbours: its part of the numbers begins at its least, after its rows in the partitions before.
    pieces = placed.groupBy("parent", "part").agg(F.min("seq").alias("least"), F.count(F.lit(1)).alias("rows"))
    before = pieces.selectExpr("parent", "part", "least", "sum(rows) over (partition by parent order by part) - rows as before")  # a row for each partition
    return scratch.keep(placed.join(before, ["parent", "part"]).select("parent", "id", "weight", (F.col("before") + F.col("seq") - F.col("least")).alias("at")))


def lay_out(scratch: Scratch, children: DataFrame, runs: DataFrame, boxes: DataFrame, few: int) -> DataFrame:
    """(id, x, y, w, h) of the ``children`` (parent, id, at) of ``few`` containers with ``boxes`` (parent, x, y, w, h); sides are 2 at least."""
    rows = strips(runs.join(side(boxes, few), "parent"))
    step = F.col("i").cast("double")
    one = rows.withColumn("i", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1))).select(
        "parent", (F.col("first") + F.col("i")).alias("at"), (F.col("x") + step * F.col("dx")).alias("x"), (F.col("y") + step * F.col("dy")).alias("y"), *[F.greatest(F.lit(2.0), c).alias(c) for c in "wh"]
    )
    return scratch.keep(children.join(one, ["parent", "at"]).select("id", *"xywh"))


def treemap(forest: DataFrame, slider: int = SLIDER) -> DataFrame:
    """(id, x, y, w, h), top-down: in each round all placed containers lay out their children."""
    scratch = Scratch(forest.sparkSession)
    cell = BASE_CELL * (slider / SLIDER)
    weights = subtree_weights(forest, slider)
    pairs = forest.select(F.coalesce("parent", F.lit("")).alias("parent"), F.col("child").alias("id")).distinct().join(weights, "id").filter("weight > 0")
    children = numbered(scratch, pairs)
    runs = children.groupBy("parent", "weight").agg(F.count(F.lit(1)).alias("n"))
    runs = scratch.keep(runs.join(runs.groupBy("parent").agg(F.sum(F.col("weight") * F.col("n")).alias("sum")), "parent"))
    top = runs.filter("parent = ''").agg(F.first("sum")).first()[0]
    schema = "id string, x double, y double, w double, h double"
    if not top:
        return scratch.close(forest.sparkSession.createDataFrame([], schema))
    width = float(round((top * cell * 4 / 3) ** 0.5))
    box = forest.sparkSession.createDataFrame([("", 0.0, 0.0, width, float(round(top * cell / width)))], schema)
    waves, few = [lay_out(scratch, children, runs, box.withColumnRenamed("id", "parent"), 1)], 1
    while True:
        inner = waves[-1].select(F.col("id").alias("parent"), (F.col("x") + PAD).alias("x"), (F.col("y") + HEADER).alias("y"), (F.col("w") - 2 * PAD).alias("w"), (F.col("h") - HEADER - PAD).alias("h")).filter("w >= 4 and h >= 4")
        inner = scratch.keep(inner.join(runs.select("parent").distinct(), "parent", "left_semi"))
        if not (few := inner.count()):
            break
        waves.append(lay_out(scratch, children, runs, inner, few))
    out = waves[0]
    for wave in waves[1:]:
        out = out.unionByName(wave)
    return scratch.close(out)
