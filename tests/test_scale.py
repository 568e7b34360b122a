"""Many hot keys, one hot offset, deep and shared hierarchies, merges and sweeps that must not go wrong."""

from __future__ import annotations

import random
import re

import pytest
from pyspark.sql import functions as F

from packstrata.operators import liveness as L
from packstrata.operators import merging as M
from packstrata.operators import overlaying as W
from packstrata.operators import skew
from packstrata.operators.hierarchy import forest, hierarchy, tree_paths
from packstrata.operators.intervals import periods_and_gaps
from packstrata.operators.journal import _covers, _resolve, content_map
from packstrata.operators.skew import hot_bounds, hot_keys, skew_join


@pytest.mark.parametrize("limit", [100_000, 10])
def test_thousands_of_hot_keys(spark, monkeypatch, limit):
    monkeypatch.setattr(skew, "BROADCAST_ROWS", limit)
    left = spark.range(60_000).select((F.col("id") % 2000).alias("k"), F.col("id").alias("v"))
    assert hot_keys(left, ["k"], 20).count() == 2000 and hot_keys(left, ["k"], 30) is None
    right = spark.range(0, 4000, 2).select(F.col("id").alias("k"), (F.col("id") * 3).alias("w"))
    for how in ("inner", "left", "left_semi", "left_anti"):
        want, got = left.join(right, ["k"], how), skew_join(left, right, ["k"], how, 20)
        assert got.count() == want.count() and got.exceptAll(want).count() == 0


def test_tiles_follow_rows(spark):
    df = spark.range(5000).select(F.when(F.col("id") < 4000, "big").otherwise("small").alias("k"), F.col("id").alias("v"))
    cuts = {x.k: x.c for x in hot_bounds(df, ["k"], {"c": F.col("v")}, 500).collect()}
    assert len(cuts["big"]) == 7 and len(cuts["small"]) == 1 and cuts["big"] == sorted(cuts["big"])


def test_one_offset_rewritten_very_often(spark):
    n = 200_000
    # every operation begins at 0, half of them with lengths of their own
    seq, length = F.col("id"), F.when(F.col("id") % 2 == 0, 100).otherwise(1000 + F.lit(n) - F.col("id"))
    journal = spark.range(n).select(
        F.lit(1).cast("long").alias("session_id"), seq.alias("seq"), F.lit(1).alias("op"), F.lit(5).cast("long").alias("inode"), seq.alias("handle"), F.lit(0).cast("long").alias("fileoff"), length.cast("long").alias("length"), F.lit(None).cast("timestamp").alias("recv_at")
    )
    whole, tiled = content_map(journal, 10**9), content_map(journal, 20_000)
    assert whole.count() == tiled.count() > 90_000 and whole.exceptAll(tiled).count() == 0
    got = periods_and_gaps(journal.select("inode", F.lit(0).alias("lo"), F.col("length").alias("hi")), ["inode"], "lo", "hi", 20_000).collect()
    assert [tuple(x) for x in got] == [(5, "run", 0, 1000 + n - 1)]


def test_resolving_stops_when_all_is_resolved():
    def ops():
        yield 0, (1 << 63) - 1, None
        raise AssertionError("read on")

    assert _resolve(ops()) == []


def test_covers_are_exact(spark):
    leaves = 16
    df = spark.createDataFrame([(a, b) for a in range(leaves) for b in range(-1, leaves)], "a int, b int").select("a", "b", _covers(F.col("a"), F.col("b"), leaves).alias("n"))
    for x in df.collect():
        tiles = []
        for node in x.n:
            level = leaves.bit_length() - node.bit_length()
            first = (node << level) - leaves
            tiles += range(first, first + (1 << level))
        assert sorted(tiles) == list(range(x.a, x.b + 1)) and len(x.n) <= 8


EDGE = "parent long, name binary, inode long, type int, generation long"


@pytest.mark.parametrize("seed", range(3))
def test_forest_reaches_as_a_walk_does(spark, seed):
    r = random.Random(seed)
    links = {(max(1, n - r.choice([1, 1, 2, 9])), n) for n in range(2, 50)} | {(r.randrange(1, 50), r.randrange(2, 50)) for _ in range(seed * 4)} | {(60, 61), (61, 60), (61, 62)}
    rows = [(p, b"%d" % c, c, 2, 1) for p, c in links] + [(n, b"leaf", 1000 + n, 1, 1) for n in {p for p, _ in links}]
    f = forest(spark.createDataFrame(rows, EDGE))
    nodes = {p for p, *_ in rows}
    down = {n: set() for n in nodes}
    for n in nodes:
        todo = [n]
        while todo:
            at = todo.pop()
            for p, c in links:
                if p == at and c in nodes and c not in down[n]:
                    down[n].add(c)
                    todo.append(c)
    asked = sorted(nodes)[:: 7]
    marks = spark.createDataFrame([(n,) for n in asked], "node long")
    assert {x.node for x in f.descendants(marks).collect()} == set(asked).union(*(down[n] for n in asked))
    assert {x.node for x in f.ancestors(marks).collect()} == set(asked) | {n for n in nodes if down[n] & set(asked)}
    loops = {n for n in nodes if n in down[n]}
    damaged = {n for n in nodes if n in loops or any(n in down[m] for m in loops)}
    assert {x.node for x in f.damaged().collect()} == damaged
    w = {x.node: x.w for x in f.below(spark.createDataFrame([(n, n * 10) for n in nodes], "node long, w long")).collect()}
    assert {n: w[n] for n in nodes - damaged} == {n: sum(m * 10 for m in down[n] | {n}) for n in nodes - damaged}
    reached = {x.id for x in L.reachable(spark.createDataFrame(list(links), "src long, dst long"), spark.createDataFrame([(1,), (None,)], "id long")).collect()}
    assert reached == {1} | {c for p, c in links if p in down[1] | {1}}


def test_paths_below_a_change_of_type_are_not_spread(spark):
    """Only hashes of folders are: the texts of all that lies above 2,100 files 200 folders down would be half a gigabyte."""
    deep = "/".join(f"folder-{i:04d}" for i in range(200))
    rows = [("cut", "type-change"), ("cutter", None), ("cutter/x", None), ("ok", None), (f"ok/{deep}", "type-change"), *((f"{top}/{deep}/f{i}", None) for top in ("cut", "ok", "cutter") for i in range(700)), (f"ok/{deep}/in/in", "type-change"), ("/", None), ("", "type-change")]
    df = spark.createDataFrame(rows, "path string, conflict string").repartition(4)
    got = M.below_conflicts(df, "path")
    below = {p for p, _ in rows if any(c == "type-change" and p.startswith(f"{q}/") for q, c in rows if c)}
    assert {x.path for x in got.collect()} == below and {x.path for x in M.walked(df, "path").collect()} == {p for p, _ in rows} - below
    assert not re.search(r"explode\(transform\(sequence[^\n]*lambdafunction\(concat_ws", got._jdf.queryExecution().optimizedPlan().toString())


def test_walked_counts_move_no_path(spark):
    """A count a folder and verdict leaves its task, whatever the files; paths of no folder and below a cut count as in the walk."""
    rows = [("cut", "conflict", "type-change"), ("top", "same", None), ("cut/x", "same", None), ("cut/d/y", "drop", None), *((f"ok/f{i}", "same" if i % 3 else "drop", None) for i in range(3000))]
    df = spark.createDataFrame(rows, "path string, outcome string, conflict string").coalesce(1)
    got = M.walked_counts(df, "path")
    want = M.walked(df, "path").groupBy("outcome", "conflict").agg(F.count(F.lit(1)).alias("n"))
    assert {tuple(x) for x in got.collect()} == {tuple(x) for x in want.collect()} == {("conflict", "type-change", 1), ("same", None, 2001), ("drop", None, 1000)}
    # the anti join meets folders with counts
    joined = re.search(r"Join LeftAnti[^\n]*\n[^\n]*Aggregate", got._jdf.queryExecution().optimizedPlan().toString())
    assert joined, got._jdf.queryExecution().optimizedPlan().toString()


def test_tree_paths_are_those_of_the_hierarchy(spark):
    """Sound entries with chains, shared folders, cycles, what is below them, repeated and null rows; in far fewer jobs."""
    edges = [(1, "a", 2, 1), (2, "b", 3, 1), (1, "s", 3, 2), (3, "c", 4, 1), (4, "f", 5, 1), (4, "f", 6, 2), (4, "f", 6, 2), (9, "x", 10, 1), (10, "y", 9, 1), (10, "z", 11, 1), (11, "g", 12, 1), (1, "into", 9, 1), (20, "p/q", 21, 1), (21, "", None, 1), (None, "n", 2, 1), (1, None, 2, 1)]
    df = spark.createDataFrame([(p, None if n is None else n.encode(), c, g) for p, n, c, g in edges], "parent long, name binary, inode long, generation long")
    tracker, results, jobs = spark.sparkContext.statusTracker(), [], []
    for k, f in enumerate((lambda: hierarchy(df, order="generation").where("state = 'tree'").select("parent", "path"), lambda: tree_paths(df, order="generation"))):
        spark.sparkContext.setJobGroup(f"paths-{k}", "paths")
        results.append(sorted(tuple(x) for x in f().collect()))
        jobs.append(len(tracker.getJobIdsForGroup(f"paths-{k}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert results[0] == results[1] and (4, "/s/c/f") in results[1] and not any(p in (9, 10, 11) for p, _ in results[1])
    assert jobs[1] < jobs[0]


def test_nothing_below_a_change_of_type(spark):
    side = lambda *rows: spark.createDataFrame(list(rows), "path string, kind int, body string, inode long")
    base = side(("/a", 2, "", 5), ("/f.txt", 1, "x", 6), ("/g", 1, "x", 7))
    ours = side(("/a", 1, "now a file", 5), ("/f.txt", 1, "ours", 6), ("/g", 1, "x", 7))
    theirs = side(("/a", 2, "", 5), ("/a/new", 1, "n", 9), ("/a/d", 2, "", 10), ("/a/d/x", 1, "n", 11), ("/f.txt", 1, "theirs", 6), ("/g", 1, "x2", 7))
    plan = M.three_way(base, ours, theirs, ["path"], "kind", ["body"])
    assert {(x.path, x.outcome, x.conflict) for x in M.walked(plan, "path").select("path", "outcome", "conflict").collect()} == {("/a", "conflict", "type-change"), ("/f.txt", "conflict", "both-modified"), ("/g", "take-theirs", None)}
    got = {tuple(x) for x in M.merged(base, ours, theirs, "path", "kind", ["body"], "inode", branch="side").collect()}
    assert got == {("/a", 1, "now a file", 5, "ours"), ("/f.txt", 1, "ours", 6, "ours"), ("/f (from side).txt", 1, "theirs", 8, "theirs-kept"), ("/g", 1, "x2", 7, "theirs")}
    # where ours is the directory, what it has below stays
    got = {tuple(x) for x in M.merged(base, theirs, ours, "path", "kind", ["body"], "inode").collect()}
    assert {("/a", 2, "", 5, "ours"), ("/a/new", 1, "n", 9, "ours"), ("/a/d/x", 1, "n", 11, "ours")} <= got


def test_fast_forwards_and_bases(spark):
    heads = spark.createDataFrame([("a", "1", "1", "2"), ("b", "1", "2", "1"), ("c", "1", "2", "2"), ("d", "1", "2", "3"), ("e", None, None, "3")], "name string, base string, ours string, theirs string")
    assert {x.name: x.merge for x in M.fast_forward(heads).collect()} == {"a": "theirs", "b": "ours", "c": "ours", "d": None, "e": None}
    forks = spark.createDataFrame([("f", "h1"), ("g", "h9"), ("i", None)], "name string, base_hash string")
    refs = spark.createDataFrame([("main", "branch", "h1"), ("v2", "tag", "h1"), ("v1", "tag", "h1"), ("x", "tag", None)], "ref string, kind string, hash string")
    assert {x.name: (x.ref, x.kind) for x in M.merge_bases(forks, refs).collect()} == {"f": ("v1", "tag"), "g": (None, None), "i": (None, None)}


def test_sweeps_refuse_an_empty_live_set(spark):
    placed = spark.createDataFrame([("p", b"k", 0, 5, "sb"), ("p", b"m", 5, 5, "")], "pack string, key binary, off long, length long, type string")
    with pytest.raises(L.NothingLive):
        L.pack_liveness(placed, placed.limit(0).select("key"))
    got = L.pack_liveness(placed, spark.createDataFrame([(b"z",)], "key binary"), F.col("type") == "sb").collect()
    assert [(x.live_entries, x.live_bytes, x.fraction) for x in got] == [(1, 5, 0.5)]
    objects = spark.createDataFrame([(n, 10, at) for n, at in (("live", 1), ("ledger", 1), ("odd", None), ("young", 990), ("again", 1), ("old", 1), ("edge", 900))], "name string, size long, created long")
    name = lambda n: spark.createDataFrame([(n,)], "name string")
    ledger = spark.createDataFrame([("ledger", 950), ("old", 900)], "name string, at long")
    got = {x.name: x.verdict for x in L.gc_plan(objects, name("live"), ledger, name("again"), 1000, 100).collect()}
    assert got == {"live": "live", "ledger": "ledger", "odd": "unknown-age", "young": "young", "again": "relisted", "old": "delete", "edge": "delete"}
    with pytest.raises(L.NothingLive):
        L.gc_plan(objects, name("live").limit(0), ledger, name("again"), 1000, 100)


def test_disturbed_spans(spark):
    r = random.Random(8)
    refs, dirty = [], []
    for inode in range(8):
        at = 0
        for _ in range(12):
            n = r.choice([0, 5, 17, 30])
            refs.append((inode, at, n))
            at += n
        dirty += [(inode, lo, lo + r.choice([0, 1, 20])) for lo in (r.randrange(at + 5) for _ in range(r.randrange(4)))]
    got = {}
    for x in W.disturbed_spans(spark.createDataFrame(refs, "inode long, off long, llen long"), spark.createDataFrame(dirty, "inode long, lo long, hi long")).collect():
        got.setdefault(x.inode, set()).update(range(x.from_off, x.to_off))
    want = {}
    for inode, lo, hi in dirty:
        if lo < hi:
            hit = want.setdefault(inode, set())
            hit.update(range(lo, hi))
            for i, off, n in refs:
                if i == inode and n and off < hi and off + n > lo:
                    hit.update(range(off, off + n))
    assert got == want


def test_names_after_operations(spark):
    base = spark.createDataFrame([(1, "a", 10, 1), (1, "b", 11, 1), (2, "x", 12, 2)], "parent long, name string, inode long, type int")
    ops = [
        (1, "unlink", 1, "a", None, None, 10, 1), (2, "create", 1, "a", None, None, 20, 1), (3, "rename", 1, "b", 2, "b", 11, 1), (4, "rename", 2, "b", 1, "b", 11, 1), (5, "link", 2, "c", None, None, 20, 1),
        (6, "rename", 2, "x", 2, "x", 12, 2), (7, "unlink", 2, "c", None, None, 20, 1), (7, "unlink", 2, "c", None, None, 20, 1), (8, "setattr", None, None, None, None, 20, 1), (9, "mkdir", None, "q", None, None, 30, 2),
    ]
    df = spark.createDataFrame(ops, "seq long, op string, parent long, name string, to_parent long, to_name string, inode long, type int")
    assert {tuple(x) for x in W.namespace_after(base, df, ["seq"]).collect()} == {(1, "a", 20, 1), (1, "b", 11, 1), (2, "x", 12, 2)}
    sets = spark.createDataFrame([(1, "setattr", 5, "mode", 1), (2, "setattr", 5, "mode", 2), (3, "setxattr", 5, "u", 7), (4, "removexattr", 5, "u", None), (5, "setattr", None, "mode", 1)], "seq long, op string, inode long, attr string, value long")
    assert [tuple(x) for x in W.attributes_after(sets, ["seq"]).collect()] == [(5, "mode", 2)]


def test_longest_runs(spark):
    rows = [("a", 1, 1, True), ("a", 2, 2, True), ("a", 3, 9, True), ("a", 4, 5, True), ("a", 5, 10, True), ("b", 1, 1, True), ("b", 2, None, False), ("b", 3, 4, True), ("c", 1, 3, True), ("d", 1, None, False), ("e", 1, 2, True), ("e", 2, 2, True)]
    df = spark.createDataFrame(rows, "s string, at int, seq long, good boolean")
    got = {x.s: (x.records, x.last_seq, x.torn) for x in W.longest_runs(df, "s", [F.col("at")], "seq", "good").collect()}
    assert got == {"a": (3, 9, False), "b": (1, 1, True), "c": (1, 3, False), "d": (0, None, True), "e": (1, 2, False)}


def test_a_cluster_needs_a_shared_folder(spark, monkeypatch):
    from packstrata import session

    class Elsewhere:
        class conf:  # noqa: N801
            get = staticmethod(lambda *a: None)

        class sparkContext:  # noqa: N801
            master = "spark://host:7077"

            @staticmethod
            def getConf():  # noqa: N802
                return {}

    with pytest.raises(ValueError, match="all executors share"):
        session.shared_folder(Elsewhere)
