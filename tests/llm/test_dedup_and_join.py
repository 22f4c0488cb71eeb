import hashlib
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from spandrel.llm import exact_dedup, jaccard_join


def test_exact_dedup(docs, nothing):
    rows = [(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in docs.select("doc_id", "text").collect()]
    groups = defaultdict(list)
    for i, t in rows:
        groups[t].append(i)
    first = {t: min((i for i in g if i is not None), default=None) for t, g in groups.items()}
    expected = Counter((i, first[t], len(groups[t]), i == first[t], hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
    for runs in (1, 5, 64):
        assert Counter(map(tuple, exact_dedup.exact_dedup(docs, runs=runs).collect())) == expected
    kept = exact_dedup.keep_first(docs)
    assert kept.columns == docs.columns
    assert Counter(r.text for r in kept.collect()).most_common(1)[0][1] == 1
    assert {(r.doc_id, re.sub(r"[\x20\x09-\x0D]+", " ", r.text or "")) for r in kept.collect()} == {(i, t) for t, i in first.items()}
    assert exact_dedup.exact_dedup(nothing).count() == exact_dedup.keep_first(nothing).count() == 0


def test_exact_dedup_keeps_colliding_digests_apart(spark, docs):
    """Digest and second hash forced to collide: the texts decide."""
    from pyspark.sql import functions as F

    weak = lambda t: F.substring(F.sha2(t.cast("binary"), 256), 1, 1)
    same = lambda t: F.lit(0).cast("long")
    rows = [(i, f"w{i % 7} x") for i in range(40)] + [(None, "w1  x"), (None, "lone y"), (3, "w3 x")]
    d = spark.createDataFrame(rows, "doc_id long, text string").unionByName(docs.select("doc_id", "text")).repartition(5)
    plain = {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(d).collect()}
    forced = exact_dedup.exact_dedup(d, digest=weak, check=same).collect()
    assert len(forced) == d.count() and {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in forced} == plain
    first = lambda **more: Counter((r.doc_id, " ".join((r.text or "").split())) for r in exact_dedup.keep_first(d, **more).collect())
    assert first(digest=weak, check=same) == first()


def test_runs_are_sorted_and_merged_in_rounds(spark, docs):
    keyed = docs.selectExpr("doc_id as id", "sha2(coalesce(text, ''), 256) as digest", "0L as length", "0L as check")
    plan = exact_dedup.merge_runs(keyed, runs=16, fan_in=4)._jdf.queryExecution().executedPlan().toString()
    exchanges = [x for x in plan.splitlines() if "hashpartitioning(" in x]
    assert [("REPARTITION" in x, "digest" in x.split("hashpartitioning")[1]) for x in exchanges] == [(True, False), (True, False), (False, True)]
    assert plan.count("SortAggregate") == 6 and "HashAggregate" not in plan


def brute(rows, width, num, den):
    sets = []
    for i, t in rows:
        w = (t or "").encode().lower().split()
        sets.append((i, frozenset(tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))) if w else frozenset()))
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            x, y = sets[a][1], sets[b][1]
            if x and y and den * len(x & y) >= num * len(x | y):
                root[find(a)] = find(b)
    names = {}
    for k, (i, s) in enumerate(sets):
        if i is not None:
            names[find(k)] = min(i, names.get(find(k), i))
    return Counter((i, len(s), names.get(find(k)) if s else i) for k, (i, s) in enumerate(sets))


@pytest.mark.parametrize("width, num, tile, hot, light", [(3, 90, 512, 64, None), (5, 80, 512, 2, 4), (3, 90, 2, 3, 0), (2, 60, 3, 64, 4), (1, 50, 2, 2, 12), (2, 60, 2, 2, None)])
def test_near_components(docs, width, num, tile, hot, light, monkeypatch):
    monkeypatch.setattr(jaccard_join, "TILE", tile)
    monkeypatch.setattr(jaccard_join, "HOT", hot)
    monkeypatch.setattr(jaccard_join, "MOST_GROUPS", 8 if tile == 2 else 1 << 16)  # 8: lists are dealt in two steps
    got = Counter(map(tuple, jaccard_join.near_components(docs, width=width, num=num, light=light).select("doc_id", "n_shingles", "component_id").collect()))
    assert got == brute([(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()], width, num, 100)


def test_keep_one_and_nothing(docs, nothing):
    kept = jaccard_join.keep_one(docs, width=3, num=90)
    assert kept.columns == docs.columns and 0 < kept.count() < docs.count()
    assert jaccard_join.near_components(nothing).count() == jaccard_join.keep_one(nothing).count() == 0


def test_tiles_of_a_family_meet(spark, monkeypatch):
    """A template that many texts share by half: one family of several tiles whose members are linked in pairs only."""
    monkeypatch.setattr(jaccard_join, "TILE", 5)
    monkeypatch.setattr(jaccard_join, "HOT", 3)
    common = " ".join(f"c{i}" for i in range(60))
    rows = [(2 * i + k, f"{common} " + " ".join(f"own{i}x{j}" for j in range(28)) + f" end{k}") for i in range(30) for k in range(2)]
    d = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for num in (50, 90):
        got = Counter(map(tuple, jaccard_join.near_components(d, width=1, num=num).collect()))
        assert got == brute(rows, 1, num, 100)


def test_boundary_by_cost():
    # Long lists of single elements are dear, so subsets pay there; where lists are short, they don't.
    assert jaccard_join.cheapest({(1, 1): (2000.0, 5000.0), (1, 2): (3000.0, 10.0), (6, 1): (700.0, 1.0), (6, 2): (2800.0, 0.0)}, 100.0) == 1
    assert jaccard_join.cheapest({(1, 1): (200.0, 0.0), (1, 2): (300.0, 0.0)}, 100.0) == 0 and jaccard_join.cheapest({}, 1.0) == 0


def test_light_and_heavy_levels():
    levels = jaccard_join.Levels(90, 100)
    assert [levels.shape(levels.of(n))[1] for n in (10, 20, 30, 500)] == [2, 2, 2, 1]


@pytest.mark.parametrize("num, den", [(80, 100), (90, 100), (60, 100)])
def test_similar_short_sets_share_a_key(num, den):
    r = np.random.default_rng(3)
    levels, pairs = jaccard_join.Levels(num, den), 0
    for _ in range(20_000):
        a = np.unique(r.integers(0, 1 << 63, int(r.integers(5, 26)), dtype=np.uint64))
        b = np.unique(np.append(a[int(r.integers(0, 3)) :], r.integers(0, 1 << 63, int(r.integers(0, 3)), dtype=np.uint64)))
        both = len(np.intersect1d(a, b))
        if len(np.setxor1d(a, b)) and den * both >= num * (len(a) + len(b) - both):
            pairs += 1
            assert len(np.intersect1d(jaccard_join.set_keys(a, levels), jaccard_join.set_keys(b, levels)))
    assert pairs > 3000


def test_keep_one_with_null_and_repeated_ids(spark):
    base = [" ".join(f"{x}{i}" for i in range(40)) for x in "abcd"]
    near = lambda t: t + " more"
    rows = [(None, base[0]), (None, near(base[0])), (None, base[1]), (3, near(base[1])), (5, base[2]), (5, near(base[2])), (5, base[2].upper()), (6, base[3]), (6, base[3]), (None, ""), (None, None), (5, " ")]
    kept = jaccard_join.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert Counter((r.doc_id, (r.text or "").lower()[:2].strip()) for r in kept) == Counter({(None, "a0"): 1, (3, "b0"): 1, (5, "c0"): 1, (6, "d0"): 1, (None, ""): 2, (5, ""): 1})


def test_near_components_against_sql(spark, data):
    from helpers import assert_same, duck

    from spandrel.llm import queries

    assert_same(queries.op8_ngram_jaccard_join(spark, data), duck(jaccard_join.ORACLE))


def test_groups_dealt_in_two_steps(spark, docs, monkeypatch):
    """A second exchange makes groups small without losing a list, be it dealt, beside its list or marked."""
    monkeypatch.setattr(jaccard_join, "HOT", 4)
    packed = jaccard_join.packed_keys(docs, "text", 3, jaccard_join.Levels(90, 100, 4), 3)
    again = jaccard_join.dealt_again(packed, 3 * 50)
    pairs = lambda df: {tuple(r) for r in jaccard_join.candidate_pairs(df).collect()}
    one = pairs(packed)
    assert one and one == pairs(again)
    most = lambda df: max(r[1] for r in df.selectExpr("p", "length(keys) as n").groupBy("p").sum("n").collect())
    assert most(again) < most(packed) / 10
