"""The pN_ queries of the core against SQL, with and without split keys, and on hard small tables."""

from __future__ import annotations

import random

import pytest
from oracle import differences, duck, bag

import __spark_entry__ as entry
from packstrata.operators import skew
from packstrata.operators.hierarchy import hierarchy
from packstrata.operators.intervals import periods_and_gaps
from packstrata.operators.journal import _resolve, content_map
from packstrata.operators.orphans import integer_orphans, keyed_orphans
from packstrata.operators.snapshots import snapshot_changes
from packstrata.plans import problems

CORE = ["p1_found", "p2_found", "p3_found", "p4_found", "p6_found"]


@pytest.mark.parametrize("floor", [None, 12])
@pytest.mark.parametrize("name", CORE)
def test_equals_sql(spark, data, monkeypatch, name, floor):
    if floor:
        monkeypatch.setattr(skew, "HOT_FLOOR", floor)
        monkeypatch.setattr(skew, "TILES", 5)
    assert differences(problems.R.queries[name](spark, data), data, problems.R.sql[name]) == ([], [])


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() > 0


def written(spark, tmp_path, **tables):
    for name, (schema, rows) in tables.items():
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / f"{name}.parquet"))
    return str(tmp_path)


JOURNAL = "session_id long, seq long, op int, inode long, handle long, fileoff long, length long, recv_at timestamp, note string"


def random_journal(seed: int, n: int) -> list[tuple]:
    import datetime as dt

    r, rows = random.Random(seed), []
    for seq in range(n):
        op = r.choices([1, 2, 3, 4, 7, None], [30, 4, 2, 2, 1, 1])[0]
        at = dt.datetime(2025, 1, 1) + dt.timedelta(seconds=r.randrange(1000))
        row = (r.choice([1, 1, 1, 2]), seq, op, r.choice([5, 5, 5, 6, 1 << 41]), r.choice([None, *range(100 + seq, 104 + seq)]) if r.random() < 0.1 else 1000 + seq, r.choice([0, 5, r.randrange(200)]), r.choice([0, -1, 3, r.randrange(60)]), at, "x")
        rows += [row] * r.choice([1, 1, 2])
        if r.random() < 0.1:
            rows.append((*row[:5], None, *row[6:7], at + dt.timedelta(seconds=1), "torn"))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("floor", [None, 20])
@pytest.mark.parametrize("name", ["p1_found", "p6_found"])
def test_random_journals(spark, tmp_path, monkeypatch, name, floor):
    if floor:
        monkeypatch.setattr(skew, "HOT_FLOOR", floor)
        monkeypatch.setattr(skew, "TILES", 6)
    d = written(spark, tmp_path, ojournal=(JOURNAL, random_journal(7, 600)))
    assert differences(problems.R.queries[name](spark, d), d, problems.R.sql[name]) == ([], [])


def test_empty_journal(spark):
    none = spark.createDataFrame([], JOURNAL)
    assert content_map(none).count() == 0
    assert periods_and_gaps(none, ["session_id", "inode"], "fileoff", "length").count() == 0


def test_resolution_equals_byte_model():
    r = random.Random(3)
    for _ in range(300):
        ops = [(lo := r.randrange(40), lo + r.randrange(12), r.choice([None, k])) for k in range(r.randrange(1, 25))]
        image: dict[int, int | None] = {}
        for lo, hi, h in ops:
            for b in range(lo, hi):
                image.setdefault(b, h)
        want = {b: h for b, h in image.items() if h is not None}
        got = {b: h for lo, hi, h in _resolve(ops) for b in range(lo, hi)}
        assert got == want


@pytest.mark.parametrize("floor", [None, 8])
def test_intervals_random(spark, floor):
    r = random.Random(11)
    rows = [(r.choice(["a", "b", None]), lo, lo + r.choice([-2, 0, 1, 3, 9, 40]), 1) for lo in (r.randrange(-300, 300) for _ in range(300))]
    rows += rows[:40] + [("c", 5, 6, 1), ("a", None, 4, 1), ("d", -(1 << 62), 1 << 62, 1), ("d", (1 << 62) + 1, (1 << 63) - 1, 1)]
    want = []
    for key in "abcd":
        at = sorted((lo, hi) for k, lo, hi, _ in rows if k == key and lo is not None and lo < hi)
        runs: list[list[int]] = []
        for lo, hi in at:
            if runs and lo <= runs[-1][1]:
                runs[-1][1] = max(hi, runs[-1][1])
            else:
                runs.append([lo, hi])
        want += [(key, "run", *x) for x in runs] + [(key, "gap", a[1], b[0]) for a, b in zip(runs, runs[1:], strict=False)]
    df = spark.createDataFrame(rows, "k string, lo long, hi long, kind int")
    assert sorted(tuple(x) for x in periods_and_gaps(df, ["k"], "lo", "hi", floor, 4).collect()) == sorted(want)


EDGE = "parent long, name binary, inode long, type int, generation long, root string"


@pytest.mark.parametrize("seed", range(4))
@pytest.mark.parametrize("floor", [None, 3])
def test_hierarchies_with_damage(spark, tmp_path, seed, floor):
    r = random.Random(seed)
    rows, n = [], 60
    for node in range(2, n):
        if seed < 3 or node < 30:
            rows.append((max(1, node - r.choice([1, 1, 2, 7, 30])), f"n{node}/é ".encode(), node, 2, 1, ""))
        if r.random() < 0.3:
            rows.append((node, b"leaf", 1000 + r.randrange(20), 1, 1, ""))
    if seed:  # edges back up, shared directories, self loops
        for k in range(seed * 3):
            rows.append((r.randrange(20, n), f"back{k}".encode(), r.randrange(2, n), 2, 1, ""))
        rows.append((70, b"self", 70, 2, 1, ""))
        rows.append((70, b"below", 71, 2, 1, ""))
        rows.append((71, b"leaf", 72, 1, 1, ""))
    rows += rows[:5]
    d = written(spark, tmp_path, edge=(EDGE, rows))
    df = hierarchy(spark.read.parquet(f"{d}/edge.parquet"), order="generation", floor=floor)
    assert differences(df, d, problems.R.sql["p2_found"]) == ([], [])


def test_hierarchy_nulls_and_empty(spark):
    assert hierarchy(spark.createDataFrame([], EDGE)).count() == 0
    rows = [(1, b"a", 2, 2, 1, ""), (1, b"a", 3, 2, 2, ""), (None, b"x", 4, 1, 1, ""), (1, None, 4, 1, 1, ""), (3, b"b", None, 1, 1, "")]
    got = {(x.parent, x.inode): (x.root, x.depth, x.path, x.state, x.n_below) for x in hierarchy(spark.createDataFrame(rows, EDGE), order="generation").collect()}
    assert got == {(1, 3): (1, 1, "/a", "tree", 1), (3, None): (1, 2, "/a/b", "tree", 0)}


def test_deep_chain(spark):
    df = spark.createDataFrame([(k, b"d", k + 1, 2, 1, "") for k in range(1, 200)], EDGE)
    got = {x.inode: x for x in hierarchy(df).collect()}
    assert got[200].depth == 199 and got[200].path == "/d" * 199 and got[2].n_below == 198


@pytest.mark.parametrize("floor", [None, 1])
def test_orphans(spark, floor):
    parents = spark.createDataFrame([(k, k != 5, 3 if k == 7 else 1) for k in [1, 2, 3, 5, 6, 7, 8, 65535, 65536, 65537, -4]], "k long, _alive boolean, _born long")
    refs = spark.createDataFrame([(k, g) for k in [0, 1, 4, 5, 7, 9, 65536, 70000, -4, -5, None] for g in (2, 3, None)] + [(0, 2)], "k long, g long")
    want = sorted([(k, g, s) for k, s in [(0, "missing"), (4, "missing"), (5, "deleted"), (9, "missing"), (70000, "missing"), (-5, "missing")] for g in (2, 3, None)] + [(7, 2, "late"), (0, 2, "missing")], key=str)
    assert sorted((tuple(x) for x in integer_orphans(refs, "k", "g", parents, floor).select("k", "g", "state").collect()), key=str) == want
    assert sorted((tuple(x) for x in keyed_orphans(refs, "k", "g", parents, floor).select("k", "g", "state").collect()), key=str) == want
    assert integer_orphans(refs.limit(0), "k", "g", parents).count() == 0


def test_snapshots(spark, tmp_path):
    r = random.Random(5)
    rows = [(g, i, r.choice([None, 1, 2]), r.choice([None, 7])) for g in (2, 3, 9) for i in range(40) if r.random() < 0.7]
    rows += rows[:10] + [(None, 4, 1, 1), (9, None, 1, 1)]
    d = written(spark, tmp_path, node=("generation long, inode long, mtime_ns long, length long", rows))
    assert differences(problems.p4_found(spark, d), d, problems.R.sql["p4_found"]) == ([], [])
    assert snapshot_changes(spark.createDataFrame([], "g long, k long, v long"), ["k"], "g", ["v"]).count() == 0


def test_sql_helpers(data):
    names, rows = duck(data, "select 1 as b, 2 as a")
    assert bag(names, rows) == {(2, 1): 1}


def test_scratch_is_cleared(spark):
    from packstrata.session import Scratch, clear_scratch

    kept = Scratch(spark).keep(spark.range(3))
    assert kept.count() == 3 and clear_scratch(spark) > 0
    assert clear_scratch(spark) == 0
