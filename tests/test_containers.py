"""Next-fit packing, streamed and by doubling, against the plain loop; running totals and as-of matches."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from packstrata.operators.asof import asof, order_bytes, positions, running_totals
from packstrata.operators.containers import containers, packed
from packstrata.operators.lookup import sampled, windows_of
from packstrata.operators.orphans import match_runs


def plain(sizes: list[int], target: int, first: int | None) -> list[int]:
    part, used, room, out = 1, 0, first or target, []
    for n in sizes:
        if used > 0 and n > 0 and used + n > room:
            part, used, room = part + 1, 0, min(room * 2, target)
        used += n
        out.append(part)
    return out


@pytest.mark.parametrize("first", [None, 25])
@pytest.mark.parametrize("floor", [None, 3])
def test_containers_equal_the_loop(spark, floor, first):
    r = random.Random(4)
    groups = {k: [r.choice([0, 1, 40, 100, 130, r.randrange(60)]) for _ in range(n)] for k, n in (("a", 90), ("b", 40), ("c", 4), ("d", 1))}
    groups["e"] = [0, 0, 300, 0, 5, 300, 300]
    rows = [(k, i, n or (None if i % 2 else 0), "x") for k, sizes in groups.items() for i, n in enumerate(sizes)]
    df = spark.createDataFrame(rows, "k string, i int, n long, _end string")
    got = {(x.k, x.i): x.part for x in containers(df, ["k"], ["i"], "n", 100, first, floor).collect()}
    assert got == {(k, i): p for k, sizes in groups.items() for i, p in enumerate(plain(sizes, 100, first))}
    where = {(x.k, x.i): (x.part, x.off) for x in packed(df, ["k"], ["i"], "n", target=100, floor=floor or 10**6).collect()}
    for k, sizes in groups.items():
        at, last = 0, 0
        for i, (n, p) in enumerate(zip(sizes, plain(sizes, 100, None), strict=True)):
            at = at if p == last else 0
            assert where[k, i] == (p, at)
            at, last = at + n, p
    assert containers(df.limit(0), ["k"], ["i"], "n", 100).count() == 0


def test_running_totals_and_positions(spark):
    r = random.Random(2)
    rows = [(r.choice(["a", None]), i, r.randrange(9)) for i in range(400)]
    got = running_totals(spark.createDataFrame(rows, "g string, i int, n long"), ["g"], [F.desc("i")], "n").collect()
    for g in ("a", None):
        mine = sorted((x for x in rows if x[0] == g), key=lambda x: -x[1])
        want, total = {}, 0
        for place, (_, i, n) in enumerate(mine, 1):
            total += n
            want[i] = (place, total)
        assert {x.i: (x.place, x.total) for x in got if x.g == g} == want
    df = spark.createDataFrame([(b"%d" % (k % 90),) for k in range(300)] + [(None,)], "k binary")
    assert [bytes(x.k) for x in sorted(positions(df, "k").collect(), key=lambda x: x.place)] == sorted({b"%d" % k for k in range(90)})
    numbers = [-(1 << 63), -5, -1, 0, 1, 255, 256, (1 << 63) - 1]
    told = spark.createDataFrame([(n,) for n in numbers], "n long").select("n", order_bytes(F.col("n")).alias("b")).collect()
    assert [x.n for x in sorted(told, key=lambda x: bytes(x.b))] == numbers


def test_asof_over_groups(spark):
    r = random.Random(9)
    starts = [(g, s, s * 10) for g in "ab" for s in r.sample(range(1000), 60)] + [("a", None, 1)]
    probes = [(r.choice("abc"), r.randrange(-5, 1005)) for _ in range(300)] + [("a", None)]
    got = asof(spark.createDataFrame(probes, "g string, k long"), "k", spark.createDataFrame(starts, "g string, s long, v long"), "s", ["s", "v"], ["g"]).collect()
    best = lambda g, k: max(((s, v) for h, s, v in starts if h == g and s is not None and s <= k), default=(None, None))
    assert sorted(((x.g, x.k, x.s, x.v) for x in got), key=str) == sorted(((g, k, *best(g, k)) for g, k in {p for p in probes if p[1] is not None}), key=str)


def test_runs_of_any_width_hold_their_keys(spark):
    runs = spark.createDataFrame([(10, 200_000, "wide"), (300_000, 300_000, "one"), (1 << 41, (1 << 41) + (1 << 30), "far")], "_from long, _to long, f string")
    keys = spark.createDataFrame([(k,) for k in (9, 10, 100_000, 200_000, 200_001, 300_000, (1 << 41) + 70_000, 1 << 42)], "k long")
    got = {x.k: x.f for x in match_runs(keys, "k", runs, ["f"]).collect()}
    assert got == {9: None, 10: "wide", 100_000: "wide", 200_000: "wide", 200_001: None, 300_000: "one", (1 << 41) + 70_000: "far", 1 << 42: None}


def test_windows_go_back_over_leading_bytes(spark):
    table = spark.createDataFrame([(b"\x10\x00",), (b"\x20\x05",)], "key binary")
    probe = spark.createDataFrame([(b"\x30\x01",), (b"\x15",), (b"\x01",), (None,)], "id binary")
    got = {bytes(x.id): None if x["sample"] is None else bytes(x["sample"]) for x in windows_of(probe, "id", sampled(table, "key", 1)).collect()}
    assert got == {b"\x30\x01": b"\x20\x05", b"\x15": b"\x10\x00", b"\x01": None}
