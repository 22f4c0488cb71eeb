"""Exact Jaccard similarity join of shingle sets, size-aware: subsets for small sets, inverted lists for large ones.

Sets whose sizes allow the similarity meet at one *level* (a range of sizes; each set visits its own level and the next).
At a level at most ``d`` shingles may differ. Shingles are dealt by hash into a few more than ``d`` parts, and each
part's content becomes one element. Every differing shingle spoils one part at most, so two similar sets share all but
``d`` elements of either, and at least ``c`` of them are among the first ``d + c`` of both, in any order that depends on
the elements alone. Elements of many shingles come first: they say the most.

* Small sets (light): all subsets of the fixed size ``c = 2`` of those elements are join keys. They are selective, and few
  while ``d`` is small.
* Large sets (heavy): every element (``c = 1``) posts the set into that element's inverted list, and lists are scanned.

The boundary is a cost decision on the data: a bounded sample of sets is posted both ways, the lengths of its lists are
counted by level, and the level from which lists cost less than subsets (postings, and probes of the members that lists of
the whole table's size would hold) is where heavy begins. It moves work, never links. As an element stands for several
shingles at once, a passage that many documents share does not make a long list; only sets that are near each other meet.

Lists. Postings travel packed, in groups whose number follows the input's size, so that a group stays small: it is what one
task holds. Where there are more groups than a flush can be dealt into, a second exchange deals each of the first ones. A key that many sets of one batch share goes as one
posting of their smallest set; the others travel beside it, spread over all tasks, and are joined to the list's hub (its
smallest member) afterwards, so no task gathers a long list.

Families. Sets whose lists have the same hub form a family, cut into tiles of a bounded number of sets and of shingles;
every tile also gets the hub. A tile compares its members with the hub, then those that the hub does not connect with all
others. A family of one tile is done by then. In larger ones, the tiles with members that are still apart meet the
family's other tiles, pair by pair; what comes out are spanning links, never all pairs.

Sets with equal shingles are one class from the start. Documents are shingled twice: once to post, once to give the sets
that some list asks for together with the rows.

Defined cases: a text that is null or has no words has an empty set, is linked with nothing and is its own component; a
null id takes part like others but never names a component unless all ids are null; repeated rows are in one component
(those without words only if their id repeats); ids may be any integer type; other columns may have any names and are
never looked at. Components are exact up to collisions of 64-bit hashes; every link is checked on the two whole sets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from spandrel.operators.components import connected_roots

from .common import checkpoint, fitted, plain, plan_bytes, side
from .shingles import SIZE_CLASS, U, mix, set_signature, shingle_set

#: What it costs to probe a member of a list, in postings.
PROBE_COST = 3.0
#: Sets that the boundary is measured on, and the largest d that may be light.
SAMPLE = 4000
MOST_LIGHT = 12
#: Parts beyond those that must be posted, as a share of them.
SPARE = 0.25
SEEDS = 3
FLUSH = 1_000_000
#: Postings of one key within a flush from which they go beside the list.
HOT = 64
#: Members and shingles of a tile.
TILE = 1024
TILE_SHINGLES = 4_000_000
#: Shingles that are compared in one go.
CHUNK = 1_000_000
FILTER_WORDS = 1 << 19
#: Bytes of input to a group of keys, and the groups that one flush is dealt into at most; more are dealt in a second step.
GROUP_BYTES = 1 << 18
MOST_GROUPS = 1 << 16


class Levels:
    """Ranges of sizes, and what a level means for the sets at it, for a similarity of num / den or more."""

    def __init__(self, num: int, den: int, light: int = 4):
        self.num, self.den, self.light = num, den, light
        self.upper: list[int] = []

    def of(self, size: int) -> int:
        while not self.upper or self.upper[-1] < size:
            self.upper.append((self.upper[-1] + 1 if self.upper else 1) * self.den // self.num)
        return int(np.searchsorted(self.upper, size))

    def differing(self, level: int) -> int:
        """d of a level; 0: only equal sets are similar there."""
        while len(self.upper) <= level:
            self.of((self.upper[-1] if self.upper else 0) + 1)
        return 2 * self.upper[level] * (self.den - self.num) // (self.den + self.num)

    def shape(self, level: int) -> tuple[int, int, int]:
        """(d, c, parts) of a level."""
        d = self.differing(level)
        c = 2 if d <= self.light else 1
        return d, c, d + c + max(1, -int(-SPARE * (d + 1) // 1))


def level_keys(s: np.ndarray, content: np.ndarray, level: int, shape: tuple[int, int, int]) -> list[np.ndarray]:
    """The keys of one non-empty set at a level."""
    d, c, parts = shape
    out = []
    for seed in range(SEEDS):
        part = mix(s, 100 + seed) % U(parts)
        order = np.argsort(part, kind="stable")
        p = part[order]
        starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        sums = np.add.reduceat(content[order], starts)
        elements = mix(sums ^ mix(p[starts], 1000 + level * SEEDS + seed), 8)
        if len(elements) > d + c:
            size = np.diff(np.append(starts, len(p)))
            elements = elements[np.lexsort((elements, -size))[: d + c]]
        if c == 2:  # by value, so that a pair's key is the same in every set that holds the pair
            elements = np.sort(elements)
            i, j = np.triu_indices(len(elements), 1)
            out.append(mix(mix(elements[i], 9) + elements[j], 10))
        else:
            out.append(elements)
        if len(elements) == d + c:
            return out
    # Too few parts have shingles, for every seed: such sets meet under one key of the level.
    return [*out, mix(np.array([level], U), 11)]


def set_keys(s: np.ndarray, levels: Levels) -> np.ndarray:
    """The keys of one non-empty set, 64 bits each."""
    own, content = levels.of(len(s)), mix(s, 7)
    out = [k for level in (own, own + 1) if levels.differing(level) for k in level_keys(s, content, level, levels.shape(level))]
    return np.concatenate(out) if out else np.empty(0, U)


def _texts(batch: pa.RecordBatch, k: int) -> Iterator:
    column = batch.column(k)
    for at in range(0, len(column), 256):
        yield from column.slice(at, 256).to_pylist()


def _text_hash(text_col: str) -> Column:
    return F.xxhash64(F.coalesce(F.col(text_col).cast("string"), F.lit("")))


def _text(text_col: str) -> Column:
    return F.col(text_col).cast("string").cast("binary").alias("t")


# ---- the boundary ----------------------------------------------------------------------------------------------------


def cheapest(lists: dict[tuple[int, int], tuple[float, float]], scale: float) -> int:
    """The largest d that should be light. ``lists``: by (d, c) the postings and the ordered pairs within lists of a sample, of one in ``scale`` sets."""

    def cost(d: int, c: int) -> float:
        postings, meetings = lists.get((d, c), (0.0, 0.0))
        return postings + PROBE_COST * min(postings, meetings * scale)

    every = sorted({d for d, _ in lists})
    total = {b: sum(cost(d, 2 if d <= b else 1) for d in every) for b in [0, *every]}
    return min(total, key=lambda b: (total[b], b))


def choose_light(docs: DataFrame, text_col: str, width: int, num: int, den: int, sample: int = SAMPLE) -> int:
    """``cheapest`` by the lengths of the lists of about ``sample`` sets."""
    total = docs.count()
    scale = max(1.0, total / sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        levels = Levels(num, den)
        for b in batches:
            ds, cs, keys = [np.empty(0, np.int32)], [np.empty(0, np.int32)], [np.empty(0, U)]
            for t in _texts(b, 0):
                s = shingle_set(t, width)
                if not len(s):
                    continue
                own, content = levels.of(len(s)), mix(s, 7)
                for level in (own, own + 1):
                    d = levels.differing(level)
                    for c in (1, 2) if 0 < d <= MOST_LIGHT else ():
                        k = np.concatenate(level_keys(s, content, level, (d, c, levels.shape(level)[2])))
                        ds.append(np.full(len(k), d, np.int32))
                        cs.append(np.full(len(k), c, np.int32))
                        keys.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(ds)), pa.array(np.concatenate(cs)), pa.array(np.concatenate(keys).view(np.int64))], ["d", "c", "key"])

    some = docs.select(_text(text_col))
    some = (some.sample(False, 1 / scale, 11) if scale > 1 else some).mapInArrow(run, "d int, c int, key long")
    n = some.groupBy("d", "c", "key").agg(F.count(F.lit(1)).cast("double").alias("n"))
    rows = n.groupBy("d", "c").agg(F.sum("n").alias("postings"), F.sum(F.col("n") * (F.col("n") - 1)).alias("meetings")).collect()  # 2 * MOST_LIGHT at most
    return cheapest({(r["d"], r["c"]): (r["postings"], r["meetings"]) for r in rows}, scale)


# ---- lists -----------------------------------------------------------------------------------------------------------

#: Kinds of packed rows and of what the scan of lists gives.
LISTED, BESIDE, MARKED = 0, 1, 2
PACKED = "p long, kind int, keys binary, sigs binary"


def _packed(k: np.ndarray, s: np.ndarray, groups: int, far_k: np.ndarray = np.empty(0, U), far_s: np.ndarray = np.empty(0, np.int64), marked: np.ndarray = np.empty(0, U)) -> pa.RecordBatch:
    """Rows (p, kind, keys, sigs) of a flush of postings, with those that are beside their lists, and keys marked, already."""

    def dealt(kind: int, k: np.ndarray, s: np.ndarray, p: np.ndarray) -> list[tuple]:
        order = np.argsort(p, kind="stable")
        k, s, p = k[order], s[order], p[order]
        cut = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1], [True]))) if len(p) else np.zeros(1, int)
        return [(int(p[a]), kind, k[a:b].tobytes(), s[a:b].tobytes()) for a, b in zip(cut[:-1], cut[1:], strict=True)]

    order = np.lexsort((s, k))
    k, s = k[order], s[order]
    first = np.ones(len(k), bool)
    first[1:] = k[1:] != k[:-1]
    starts = np.flatnonzero(first)
    n = np.diff(np.append(starts, len(k)))
    beside = np.repeat(n >= HOT, n) & ~first
    marked = np.union1d(marked, k[starts[n >= HOT]])
    far_k, far_s = np.append(far_k, k[beside]), np.append(far_s, s[beside])
    rows = dealt(LISTED, k[~beside], s[~beside], (k[~beside] % U(groups)).astype(np.int64))
    rows += dealt(BESIDE, far_k, far_s, (mix(far_s.view(U), 21) % U(groups)).astype(np.int64))
    rows += dealt(MARKED, marked, np.zeros(len(marked), np.int64), (marked % U(groups)).astype(np.int64))
    types = (pa.int64(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], ["p", "kind", "keys", "sigs"])


def packed_keys(docs: DataFrame, text_col: str, width: int, levels: Levels, groups: int) -> DataFrame:
    """(p, kind, keys, sigs): packed keys and the sets they belong to, dealt into ``groups`` by key.

    LISTED: postings. BESIDE: postings of a key of which only the smallest set of the flush is listed, dealt by set. MARKED:
    keys that have such postings.
    """
    num, den, light = levels.num, levels.den, levels.light

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, keys, sigs, held, seen = Levels(num, den, light), [], [], 0, set()

        def flush() -> pa.RecordBatch:
            return _packed(np.concatenate(keys), np.repeat(np.array(sigs, np.int64), [len(x) for x in keys]), groups)

        for b in batches:
            for t in _texts(b, 0):
                s = shingle_set(t, width)
                sig = set_signature(s) if len(s) else 0
                if not len(s) or sig in seen:  # copies within a flush post once
                    continue
                k = set_keys(s, own)
                if len(k):
                    seen.add(sig)
                    keys.append(k)
                    sigs.append(sig)
                    held += len(k)
                if held >= FLUSH:
                    yield flush()
                    keys, sigs, held, seen = [], [], 0, set()
        if held:
            yield flush()

    return docs.select(_text(text_col)).mapInArrow(run, PACKED)


def dealt_again(packed: DataFrame, groups: int) -> DataFrame:
    """``packed`` in ``groups`` groups, a multiple of those it comes in, each of which is streamed past one task.

    What a flush holds is of few groups by then, so rows stay long however many groups there are.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {kind: [] for kind in (LISTED, BESIDE, MARKED)}
        n = 0

        def flush() -> pa.RecordBatch:
            k, s = ({kind: np.concatenate([np.empty(0, t), *[np.frombuffer(r[i], t) for r in rows]]) for kind, rows in held.items()} for i, t in ((0, U), (1, np.int64)))
            return _packed(k[LISTED], s[LISTED], groups, k[BESIDE], s[BESIDE], k[MARKED])

        for b in batches:
            for kind, k, s in zip(b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                held[kind].append((k.as_buffer(), s.as_buffer()))
                n += len(held[kind][-1][0]) // 8
                if n >= FLUSH:
                    yield flush()
                    held, n = {kind: [] for kind in held}, 0
        if n:
            yield flush()

    return packed.repartition("p").sortWithinPartitions("p").select("p", "kind", "keys", "sigs").mapInArrow(run, PACKED)


def scan_lists(packed: DataFrame) -> DataFrame:
    """(kind, a, b). LISTED: a member of a list and the list's hub, distinct within a group; BESIDE: key and member; MARKED: key and hub."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        kind = pdf["kind"].to_numpy()

        def joined(column: str, which: int, dtype) -> np.ndarray:
            return np.concatenate([np.empty(0, dtype), *[np.frombuffer(x, dtype) for x in pdf[column][kind == which]]])

        keys, sigs, out = joined("keys", LISTED, U), joined("sigs", LISTED, np.int64), []
        marked = np.unique(joined("keys", MARKED, U))
        slices = -(-len(keys) // (2 * FLUSH)) or 1
        for i in range(slices):  # a large group is scanned by ranges of keys
            mine = (keys >> U(40)) % U(slices) == i if slices > 1 else slice(None)
            k, s = keys[mine], sigs[mine]
            order = np.lexsort((s, k))
            k, s = k[order], s[order]
            starts = np.flatnonzero(np.concatenate(([True], k[1:] != k[:-1]))) if len(k) else np.empty(0, np.int64)
            hub = np.repeat(s[starts], np.diff(np.append(starts, len(k))))
            star = hub != s
            pairs = np.unique(np.stack([s[star], hub[star]], axis=1), axis=0) if star.any() else np.empty((0, 2), np.int64)
            out.append(np.column_stack([np.full(len(pairs), LISTED), pairs]))
            both = np.isin(k[starts], marked, assume_unique=True)
            out.append(np.column_stack([np.full(both.sum(), MARKED), k[starts][both].view(np.int64), s[starts][both]]))
        k, s = joined("keys", BESIDE, U).view(np.int64), joined("sigs", BESIDE, np.int64)
        out.append(np.column_stack([np.full(len(k), BESIDE), k, s]))
        return pd.DataFrame(np.concatenate(out).astype(np.int64), columns=["kind", "a", "b"])

    return packed.groupBy("p").applyInPandas(run, "kind long, a long, b long")


def candidate_pairs(packed: DataFrame) -> DataFrame:
    """(u, v), distinct: each member u of a list with the list's hub v."""
    scanned = checkpoint(scan_lists(packed))
    pairs = scanned.filter(F.col("kind") == LISTED).select(F.col("a").alias("u"), F.col("b").alias("v"))
    hubs = scanned.filter(F.col("kind") == MARKED).select(F.col("a").alias("key"), F.col("b").alias("v"))
    if n := hubs.count():
        beside = scanned.filter(F.col("kind") == BESIDE).select(F.col("a").alias("key"), F.col("b").alias("u"))
        pairs = pairs.unionByName(beside.join(side(hubs, n), "key").filter("u <> v").select("u", "v"))
    return checkpoint(pairs.distinct())


# ---- sets ------------------------------------------------------------------------------------------------------------


def _word_of(sig: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Word and bit of signatures in the filter, from bits above the size class."""
    return ((sig >> U(11)) & U(FILTER_WORDS - 1)).astype(np.int64), (sig >> U(5)) & U(63)


def described(docs: DataFrame, id_col: str, text_col: str, width: int, pairs: DataFrame) -> DataFrame:
    """(__id, hash, sig, n, items): a row per document, with the packed set where ``pairs`` may ask for it.

    A bit map of fixed size (FILTER_WORDS words of 64 bits) over the pairs goes along with the scan. A set is given once for
    all copies that one task sees in a row.
    """
    sigs = pairs.select(F.explode(F.array("u", "v")).alias("sig"))
    bits = sigs.select(F.expr(f"shiftrightunsigned(sig, 11) & {FILTER_WORDS - 1}").alias("w"), F.expr("shiftleft(1L, cast(shiftrightunsigned(sig, 5) & 63 as int))").alias("bit"))
    found = bits.groupBy("w").agg(F.bit_or("bit").alias("bits")).toArrow()  # FILTER_WORDS rows of 16 bytes at most
    mask = np.zeros(FILTER_WORDS, np.int64)
    mask[found.column("w").to_numpy()] = found.column("bits").to_numpy()
    shared = docs.sparkSession.sparkContext.broadcast(mask)
    fields = (("__id", pa.int64()), ("hash", pa.int64()), ("sig", pa.int64()), ("n", pa.int64()), ("items", pa.binary()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap, seen, given = shared.value.view(U), set(), 0
        for b in batches:
            for at in range(0, b.num_rows, 256):
                part = b.slice(at, 256)
                sig, n, items = [], [], []
                for t in part.column(2).to_pylist():
                    s = shingle_set(t, width)
                    x = set_signature(s) if len(s) else 0
                    w, bit = _word_of(np.array([x], np.int64).view(U))
                    wanted = len(s) and x not in seen and (bitmap[w[0]] >> bit[0]) & U(1)
                    sig.append(x)
                    n.append(len(s))
                    items.append(s.tobytes() if wanted else None)
                    if wanted:
                        seen.add(x)
                        if len(seen) > 200_000:
                            seen.clear()
                columns = [part.column(0), part.column(1), pa.array(sig, pa.int64()), pa.array(n, pa.int64()), pa.array(items, pa.binary())]
                yield pa.RecordBatch.from_arrays(columns, [f for f, _ in fields])

    src = docs.select(F.col(id_col).cast("long").alias("__id"), _text_hash(text_col).alias("hash"), _text(text_col))
    return src.mapInArrow(run, "__id long, hash long, sig long, n long, items binary")


# ---- families --------------------------------------------------------------------------------------------------------


def connect(items: list[np.ndarray], size: np.ndarray, group: np.ndarray, outside: np.ndarray, num: int, den: int) -> tuple[np.ndarray, list[tuple[int, int]]]:
    """Group numbers of sets after all links, and spanning links. Every link between groups has an end in ``outside``."""
    _, code = np.unique(np.concatenate(items), return_inverse=True)
    member = np.repeat(np.arange(len(items)), size)
    posts = member[np.argsort(code, kind="stable")]
    first = np.concatenate(([0], np.cumsum(np.bincount(code))))
    at = np.concatenate(([0], np.cumsum(size)))
    links = []
    for i in outside:
        if not (group != group[i]).any():
            break
        c = code[at[i] : at[i + 1]]
        n = first[c + 1] - first[c]
        take = np.arange(n.sum()) + np.repeat(first[c] - (np.cumsum(n) - n), n)
        both = np.bincount(posts[take], minlength=len(items))
        for j in np.flatnonzero((den * both >= num * (size[i] + size - both)) & (group != group[i])):
            if group[j] != group[i]:
                links.append((int(i), int(j)))
                group[group == group[i]] = group[j]
    return group, links


def _runs(columns: list[np.ndarray]) -> np.ndarray:
    """Where rows with equal values of all columns begin, in sorted rows."""
    new = np.zeros(len(columns[0]), bool)
    new[:1] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    return np.flatnonzero(new)


def _by_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Batches of whole groups (equal values of the first ``keys`` columns), of CHUNK shingles or one group each."""
    held: pa.Table | None = None
    for b in batches:
        for at in range(0, b.num_rows, 512):
            t = pa.Table.from_batches([b.slice(at, 512)])
            held = t if held is None else pa.concat_tables([held, t])
            if held.column("items").nbytes < 8 * CHUNK:
                continue
            last = _runs([held.column(k).to_numpy() for k in range(keys)])[-1]
            if last:
                yield held.slice(0, last).combine_chunks().to_batches()[0]
                held = held.slice(last)
    if held is not None and held.num_rows:
        yield held.combine_chunks().to_batches()[0]


def _sets(batch: pa.RecordBatch) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U) for x in batch.column(batch.schema.get_field_index("items"))]


def compare_tiles(members: DataFrame, num: int, den: int) -> DataFrame:
    """(list, tile, tiles, sig, label) of members (list, tile, tiles, sig, items): equal labels within a tile are connected.

    The hub's label is the hub.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_groups(batches, 2):
            names, tile, sig = (b.column(k).to_numpy() for k in (0, 1, 3))
            items = _sets(b)
            size = np.array([len(x) for x in items])
            starts = _runs([names, tile])
            n = np.diff(np.append(starts, len(names)))
            group, row = np.repeat(np.arange(len(starts)), n), np.repeat(np.arange(len(items)), size)
            hub_row = np.zeros(len(starts), np.int64)
            is_hub = sig == names
            hub_row[group[is_hub]] = np.flatnonzero(is_hub)
            own = mix(np.concatenate(items) ^ mix(group.astype(U), 31)[row], 32)  # a set's shingles, told apart by group
            hubs = np.sort(own[is_hub[row]])
            at = np.minimum(np.searchsorted(hubs, own), len(hubs) - 1)
            both = np.bincount(row[hubs[at] == own], minlength=len(items))
            near = den * both >= num * (size + size[hub_row[group]] - both)
            label = np.where(near, names, sig)
            apart = np.bincount(group[~near], minlength=len(starts))
            for g in np.flatnonzero((apart > 0) & (n > 2)):
                a, z = starts[g], starts[g] + n[g]
                number, _ = connect(items[a:z], size[a:z], np.where(near[a:z], -1, np.arange(n[g])), np.flatnonzero(~near[a:z]), num, den)
                center = number[hub_row[g] - a]
                for x in np.unique(number):
                    of = np.flatnonzero(number == x) + a
                    label[of] = names[a] if x == center else sig[of].min()
            yield pa.RecordBatch.from_arrays([*b.columns[:4], pa.array(label, pa.int64())], ["list", "tile", "tiles", "sig", "label"])

    dealt = members.select("list", "tile", "tiles", "sig", "items").repartition("list", "tile").sortWithinPartitions("list", "tile")
    return dealt.mapInArrow(run, "list long, tile long, tiles long, sig long, label long")


def compare_across(members: DataFrame, num: int, den: int) -> DataFrame:
    """Spanning links (u, v) between labels of the members (list, x, y, sig, label, items) of pairs of tiles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _by_groups(batches, 3):
            names, x, y, sig, label = (b.column(k).to_numpy() for k in range(5))
            items = _sets(b)
            size, links = np.array([len(i) for i in items]), []
            starts = _runs([names, x, y])
            for a, z in zip(starts, np.append(starts[1:], len(names)), strict=True):
                number = np.unique(label[a:z], return_inverse=True)[1]
                _, found = connect(items[a:z], size[a:z], number, np.flatnonzero(label[a:z] != names[a]), num, den)
                links += [(sig[a + i], sig[a + j]) for i, j in found]
            yield pa.RecordBatch.from_arrays([pa.array([l[k] for l in links], pa.int64()) for k in (0, 1)], ["u", "v"])

    dealt = members.select("list", "x", "y", "sig", "label", "items").repartition("list", "x", "y").sortWithinPartitions("list", "x", "y")
    return dealt.mapInArrow(run, "u long, v long")


def links_of(pairs: DataFrame, rows: DataFrame, num: int, den: int) -> DataFrame:
    """Links (u, v) that connect whatever similar sets are members of a common family."""
    weight = lambda c: F.expr(f"shiftleft(1L, cast({c} & {(1 << SIZE_CLASS) - 1} as int))")  # noqa: E731  at least the set's size
    sizes = pairs.groupBy("v").agg((F.count(F.lit(1)) + 1).alias("members"), F.sum(weight("u")).alias("shingles"))
    tiles = F.greatest(F.ceil(F.col("members") / TILE), F.ceil(F.col("shingles") / TILE_SHINGLES))
    sizes = checkpoint(sizes.select(F.col("v").alias("list"), tiles.cast("long").alias("tiles")))
    large = sizes.filter("tiles > 1")
    some = large.count()
    of = pairs.select(F.col("v").alias("list"), F.col("u").alias("sig"))
    of = of.join(side(large, some), "list", "left").select("list", "sig", F.coalesce("tiles", F.lit(1).cast("long")).alias("tiles")) if some else of.withColumn("tiles", F.lit(1).cast("long"))
    of = of.unionByName(sizes.select("list", F.col("list").alias("sig"), "tiles"))
    sets = rows.filter(F.col("items").isNotNull()).groupBy("sig").agg(F.first("items").alias("items"))
    own = F.array(F.pmod(F.xxhash64("sig"), F.col("tiles")))
    tile = F.when(F.col("sig") == F.col("list"), F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)).otherwise(own)
    found = checkpoint(compare_tiles(of.join(sets, "sig").withColumn("tile", F.explode(tile)), num, den))
    links = found.filter("sig <> label").select(F.col("sig").alias("u"), F.col("label").alias("v"))
    if not some:
        return links
    parted = found.filter("tiles > 1")
    open_ = parted.filter("label <> list").select("list", "tile", "tiles").distinct().withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tiles") - 1)))
    meet = checkpoint(open_.filter("other <> tile").select("list", F.least("tile", "other").alias("x"), F.greatest("tile", "other").alias("y")).distinct())
    if meet.isEmpty():
        return links
    sent = meet.select("list", "x", "y", F.explode(F.array("x", "y")).alias("tile"))
    across = parted.filter("sig <> list").select("list", "tile", "sig", "label").join(sent, ["list", "tile"]).join(sets, "sig")
    return links.unionByName(checkpoint(compare_across(across, num, den)))


def classes(docs: DataFrame, id_col: str, text_col: str, width: int, num: int, den: int, light: int | None = None) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` of plain names: rows (__id, hash, sig, n), and for each set with words (sig, own, top): the least (none, id, hash) of its rows and of its component's."""
    first = min(MOST_GROUPS, wanted := max(64, plan_bytes(docs) // GROUP_BYTES))
    groups = first * -(-wanted // first)
    light = choose_light(docs, text_col, width, num, den) if light is None else light
    packed = packed_keys(docs, text_col, width, Levels(num, den, light), first)
    pairs = candidate_pairs(dealt_again(packed, groups) if groups > first else packed)
    rows = checkpoint(described(docs, id_col, text_col, width, pairs))
    roots = checkpoint(connected_roots(links_of(pairs, rows, num, den)))
    linked = roots.count()
    own = F.min(F.struct(F.col("__id").isNull().alias("none"), "__id", "hash")).alias("own")
    best = checkpoint(rows.filter("n > 0").groupBy("sig").agg(own))
    part = best.join(side(roots.withColumnRenamed("node", "sig"), linked), "sig")
    part = checkpoint(fitted(part, linked)) if linked else part.limit(0)
    top = part.groupBy("root").agg(F.min("own").alias("top"))
    part = part.join(side(top, linked), "root").select("sig", "top")
    found = best.join(side(part, linked), "sig", "left").select("sig", "own", F.coalesce("top", "own").alias("top"))
    return rows.drop("items"), checkpoint(found)


def near_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 3, num: int = 90, den: int = 100, light: int | None = None) -> DataFrame:
    """A row per input row: id, n_shingles, component_id. Links: |A and B| * den >= |A or B| * num."""
    rows, found = classes(*plain(docs, id_col, text_col), width, num, den, light)
    full = rows.filter("n > 0").join(found.select("sig", F.col("top.__id").alias("component_id")), "sig")
    empty = rows.filter("n = 0").withColumn("component_id", F.col("__id"))
    columns = [F.col("__id").alias(id_col), F.col("n").alias("n_shingles"), "component_id"]
    return full.select(*columns).unionByName(empty.select(*columns))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, num: int = 80, den: int = 100, light: int | None = None) -> DataFrame:
    """``docs`` with one document of smallest id of each component (a null id only if all are null); texts without words stay.

    The mark of what stays is the id with the hash of the text, and of rows equal in both one stays.
    """
    own, i, t = plain(docs, id_col, text_col)
    back = own.columns
    rows, found = classes(own, i, t, width, num, den, light)
    mark = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("null")).alias("mark")
    kept = found.filter(F.col("own") == F.col("top")).select(mark("own.__id"), F.col("own.hash").alias("hash"), F.lit(True).alias("one"))
    kept = kept.unionByName(rows.filter("n = 0").select(mark("__id"), "hash", F.lit(False).alias("one")).distinct())
    own = own.withColumns({"mark": mark(i), "hash": _text_hash(t)}).join(kept, ["mark", "hash"])
    own = own.withColumn("row", F.when(F.col("one"), F.lit(-1).cast("long")).otherwise(F.monotonically_increasing_id()))
    return own.dropDuplicates(["mark", "hash", "row"]).select(*back).toDF(*docs.columns)


#: For tables of a few thousand documents: all pairs that share a shingle are counted.
ORACLE = r"""
with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents),
p as (select doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) as i from w where len(w) > 0),
s as (select distinct doc_id, hash(array_to_string(w[i:i + 2], ' ')) as x from p),
n as (select doc_id, count(*) as n from s group by doc_id),
b as (select a.doc_id as x, b.doc_id as y, count(*) as shared from s a join s b on a.x = b.x and a.doc_id <> b.doc_id group by 1, 2),
l as (select b.x, b.y from b join n m on m.doc_id = b.x join n o on o.doc_id = b.y where 100 * shared >= 90 * (m.n + o.n - shared)),
c(id, component_id) using key (id) as (select doc_id, doc_id from documents union select l.x, min(c.component_id) from c join l on l.y = c.id join recurring.c as r on r.id = l.x where c.component_id < r.component_id group by l.x)
select c.id as doc_id, coalesce(n.n, 0) as n_shingles, component_id from c left join n on n.doc_id = c.id
"""
