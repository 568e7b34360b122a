"""Queries that once did less than the whole job, against SQL that says the whole."""

from __future__ import annotations

import pytest
from oracle import differences

import __spark_entry__ as entry
from packstrata.plans.problems import STANDING

UNCHANGED = f"""with recursive {STANDING}, e as (select distinct parent, name, inode from edge), up(inode) as (select inode from st union select e.parent from e join up on up.inode = e.inode)
select parent, name, inode from e where parent not in (select inode from up)"""


def tables(spark, tmp_path, **rows):
    """A folder of tables, each (schema, rows)."""
    for name, (schema, values) in rows.items():
        spark.createDataFrame(values, schema).coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


EDGE = "parent long, name binary, inode long, type int, generation long"
JOURNAL = "session_id long, seq long, op int, inode long, handle long, fileoff long, length long, recv_at timestamp"


def test_unchanged_entries_heed_every_operation(spark, data, tmp_path):
    assert differences(entry.queries()["unchanged_entries"](spark, data), data, UNCHANGED) == ([], [])
    # a directory each for a placed, truncated, forgotten and adopted file, and one untouched; inode 99 has no entry
    edge = [(1, b"%d" % n, n, 2, 1) for n in (2, 3, 4, 5, 6)] + [(n, b"f", n * 10, 1, 1) for n in (2, 3, 4, 5, 6)]
    ops = [(1, 1, 1, 20, 7, 0, 5, None), (1, 2, 2, 30, None, None, 5, None), (1, 3, 3, 40, None, None, None, None), (1, 4, 4, 50, 7, None, 5, None), (1, 5, 1, 99, 7, 0, 5, None)]
    d = tables(spark, tmp_path, edge=(EDGE, edge), ojournal=(JOURNAL, ops))
    assert [x.inode for x in entry.queries()["unchanged_entries"](spark, d).collect()] == [60]
    assert [x.inode for x in entry.queries()["unplaced_inodes"](spark, d).collect()] == [99]

# the last exact set by (session, seq), raised by later PLACE ends; an inode whose last operation is FORGET is none
OVERLAY = f"""with {STANDING}, o as (select *, row_number() over (partition by inode order by session_id, seq) k from st),
l as (select inode, max(k) filter (op <> 1) k, max_by(op, k) op from o group by 1),
h as (select distinct inode, length from node where generation = (select max(generation) from node))
select inode, length from h where inode not in (select inode from st) union all
select o.inode, cast(max(case when o.op = 1 and o.k > coalesce(l.k, 0) then o.fileoff + o.length when o.op in (2, 4) and o.k = l.k then o.length else 0 end) as bigint) from o join l on l.inode = o.inode where l.op <> 3 group by 1"""


def test_overlay_view_is_the_state_after_the_operations(spark, data):
    assert differences(entry.queries()["overlay_view"](spark, data), data, OVERLAY) == ([], [])


def test_sizes_left(spark):
    from packstrata.operators.journal import sizes_left

    place, cut, forget, adopt = (lambda at, n: (1, 7, at, n)), (lambda n: (2, None, None, n)), (3, None, None, None), (lambda n: (4, 7, None, n))
    cases = [
        ([place(0, 90), cut(10)], (True, 10)), ([place(0, 90), cut(10), place(20, 5)], (True, 25)), ([place(0, 90), adopt(40), place(0, 3)], (True, 40)),
        ([place(0, 90), forget, place(0, 4)], (True, 4)), ([cut(9), forget], (False, 0)), ([place(5, 5), place(0, 1)], (True, 10)), ([place(0, 90), forget, cut(0)], (True, 0)),
    ]
    # the sessions of an inode follow one another, whatever their own numbers
    rows = [(k // 2, 50 - 10 * (k // 2) + k, op, i, handle, at, n, None) for i, (ops, _) in enumerate(cases) for k, (op, handle, at, n) in enumerate(ops)]
    rows = [(s, q * 100 + i, *rest) for i, (s, q, *rest) in ((r[3], r) for r in rows)]
    for floor in (None, 1):
        got = {x.inode: (x.present, x.length) for x in sizes_left(spark.createDataFrame(rows, JOURNAL), ["inode"], ["session_id", "seq"], floor).collect()}
        assert {i: (p, n if p else 0) for i, (p, n) in got.items()} == {i: want for i, (_, want) in enumerate(cases)}


PACK, CHUNK = "name string, size long, generation long, condemned_at_unix long, trailer_hash binary", "identity string, pack string, generation long"


def test_condemned_packs_are_kept_for_the_grace_only(spark, tmp_path):
    from packstrata.plans.maintenance import GRACE, NOW

    name = lambda age, x: f"p-{(NOW - age) * 1_000_000_000:016x}-{x}"
    old, day = 400 * 86400, 86400
    named, fresh, edge, gone, ancient = (name(old, x) for x in "abcde")
    young = name(day, "f")
    dead = {named: NOW - 40 * day, fresh: NOW - day, edge: NOW - GRACE + 1, gone: NOW - GRACE, ancient: NOW - 40 * day, young: NOW - 40 * day}
    d = tables(
        spark, tmp_path, pack=(PACK, [(n, 10 + i, 1, at, b"h") for i, (n, at) in enumerate(dead.items())] + [("odd", 5, 1, NOW - 40 * day, b"h")]),
        ochunk=(CHUNK, [("00", named, 1)]),
    )
    q = entry.queries()
    assert {x.name for x in q["collectable_packs"](spark, d).collect()} == {gone, ancient}
    assert [tuple(x) for x in q["space_report"](spark, d).select("scanned", "retained", "young", "candidates", "bytes").collect()] == [(7, 3, 2, 2, 27)]
    assert {(x.name, x.at) for x in q["ledger_carry"](spark, d).collect()} == {(fresh, NOW - day), (edge, NOW - GRACE + 1)}


def test_integrity_structure_names_each_kind(spark, tmp_path):
    key, other = bytes(range(32)), b"\1" * 32
    edge = [(1, b"a", 2, 2, 1), (2, b"b", 3, 2, 1), (3, b"c", 2, 2, 1), (1, b"d", 4, 2, 1), (4, b"x", 50, 1, 1), (1, b"y", 50, 1, 1), (4, b"z", 51, 1, 1), (1, b"w", 51, 1, 1)]
    d = tables(
        spark, tmp_path, edge=(EDGE, edge), node=("inode long, type int, generation long", [(n, 2, 1) for n in (1, 2, 3, 4)] + [(51, 1, 1)]),
        pack=(PACK, [("p", 100, 1, None, b"h"), ("q", 100, 1, 5, b"h")]),
        pack_entry=("pack string, key binary, off long, length long, type string", [("q", key, 0, 10, "shard"), ("p", other, 95, 10, "shard"), ("p", b"short", 0, 10, "catalog"), ("p", key, 20, 7, ""), ("p", b"\2" * 32, 40, 9, "")]),
        ochunk=("identity string, pack string, stored long, generation long", [(key.hex(), "p", 8, 1), ("02" * 32, "p", 9, 1)]),
    )
    assert {tuple(x) for x in entry.queries()["integrity_structure"](spark, d).collect()} == {
        ("cycle", "2"), ("cycle", "3"), ("missing-shard", key.hex()), ("bad-shard", other.hex()), ("bad-catalog", b"short".hex()), ("shard-routing", "50"), ("chunkrefs", key.hex()),
    }


@pytest.mark.parametrize("name", ["collectable_packs", "space_report"])
def test_a_sweep_without_refs_is_refused(spark, tmp_path, name):
    d = tables(spark, tmp_path, pack=(PACK, [("p-0000000000000001-a", 10, 1, None, b"h")]), ochunk=(CHUNK, [("00", None, 1)]))
    with pytest.raises(ValueError, match="no chunk names a pack"):
        entry.queries()[name](spark, d)
