"""Every query of the core with SQL gives what the SQL gives; those without it, what a plain loop gives."""

from __future__ import annotations

import hashlib
import random

import pytest
from oracle import differences

import __spark_entry__ as entry
from packstrata.functions import chunking as C
from packstrata.plans import content, maintenance, namespace, problems, stores, trees, writing

SETS = [content.R, maintenance.R, namespace.R, stores.R, trees.R, writing.R]
NAMED = [(r, n) for r in SETS for n in r.sql]


@pytest.mark.parametrize(("r", "name"), NAMED, ids=[n for _, n in NAMED])
def test_equals_sql(spark, data, r, name):
    assert differences(r.queries[name](spark, data), data, r.sql[name]) == ([], [])


@pytest.mark.parametrize("name", [n for r in SETS for n in r.queries if n not in r.sql])
def test_runs(spark, data, name):
    df = entry.queries()[name](spark, data)
    assert df.count() > 0 and len(set(df.columns)) == len(df.columns)


def test_names_are_unique_and_known():
    q, s = entry.queries(), entry.oracle_sql()
    assert set(s) <= set(q) and len(q) >= 90
    assert sum(len(r.queries) for r in [problems.R, *SETS]) == len([n for n in q if not n.startswith(("p5", "p7", "p8", "p9"))])


# --- content-defined chunks against the plain loop


def plain_cuts(data: bytes, sizes: C.Sizes) -> list[int]:
    strict, loose = sizes.masks()
    gear, out, start = C._GEAR_INTS, [], 0
    while start < len(data):
        src = data[start : start + sizes.most]
        end, h = len(src), 0
        if len(src) > sizes.least:
            for i in range(sizes.least, len(src)):
                h = ((h << 1) + gear[src[i]]) & ((1 << 64) - 1)
                if h & (strict if i < min(sizes.average, len(src)) else loose) == 0:
                    end = i + 1
                    break
        out.append(start + end)
        start += end
    return out


@pytest.mark.parametrize("sizes", [C.Sizes(64, 256, 1024), C.Sizes(16, 64, 80), C.Sizes(256, 1024, 4096), C.Sizes(1, 8, 9)])
def test_cuts_equal_the_loop(sizes):
    r = random.Random(1)
    for n in (0, 1, 16, 17, 63, 64, 65, 300, 5000, 20_000):
        for data in (r.randbytes(n), bytes(r.choices(b"ab", k=n)), b"\0" * n):
            assert C.cuts(data, sizes) == plain_cuts(data, sizes)


def test_one_edit_moves_few_cuts():
    data = random.Random(2).randbytes(200_000)
    edited = data[:90_000] + b"!" + data[90_000:]
    ids = lambda b: {hashlib.sha256(b[a:e]).digest() for a, e in zip([0, *C.cuts(b)], C.cuts(b), strict=False)}
    assert len(ids(edited) - ids(data)) <= 4


@pytest.mark.parametrize("bad", [(0, 8, 9), (8, 8, 9), (4, 8, 8), (4, 9, 20), (1, 4, 9)])
def test_bad_sizes(bad):
    with pytest.raises(ValueError):
        C.Sizes(*bad)


def test_chunks_of_nothing(spark):
    df = spark.createDataFrame([(1, None), (2, b""), (3, b"x")], "inode long, data binary")
    assert [(x.inode, x.idx, x.off, x.llen) for x in C.content_chunks(df, "inode", "data").collect()] == [(3, 0, 0, 1)]
    assert C.content_chunks(df.limit(0), "inode", "data").count() == 0
    assert sorted((x.inode, x.alg, x.stored) for x in C.stored_form(df.where("data is not null"), "inode", "data").collect()) == [(2, 0, b""), (3, 0, b"x")]


# --- sequential folds against the plain loop


def test_folds(spark):
    from packstrata.operators.folds import next_fit, sequential_parts, spans

    r = random.Random(3)
    rows = [(k, i, r.randrange(1, 70)) for k in "abc" for i in range(80)]
    df = spark.createDataFrame(rows, "k string, i int, n long")
    got = {(x.k, x.i): x.part for x in sequential_parts(df, ["k"], ["i"], ["i", "n"], next_fit(100)).collect()}
    for k in "abc":
        part = used = 0
        for _, i, n in (x for x in rows if x[0] == k):
            if part == 0 or used + n > 100:
                part, used = part + 1, 0
            used += n
            assert got[k, i] == part
    reads = sorted({(k, r.randrange(5000), r.randrange(1, 50)) for k in "ab" for _ in range(100)})
    got = {(x.k, x.off, x.n): x.part for x in sequential_parts(spark.createDataFrame(reads, "k string, off long, n long"), ["k"], ["off", "n"], ["off", "n"], spans(40, 300)).collect()}
    for k in "ab":
        part, start, end = 0, 0, 0
        for _, off, n in (x for x in reads if x[0] == k):
            if part and 0 <= off - end <= 40 and off + n - start <= 300:
                end = off + n
            else:
                part, start, end = part + 1, off, off + n
            assert got[k, off, n] == part


# --- ledgers and tiers against the plain loop


def test_tiers_and_budgets(spark):
    from pyspark.sql import functions as F

    from packstrata.operators.ledger import mergeable, within_budget

    r, rows, want = random.Random(4), [], {}
    for g in range(120):
        sizes = [r.choice([0, 5, 40, 90, 260, 1000, r.randrange(2000)]) for _ in range(r.randrange(1, 9))]
        start, total = len(sizes), 0
        for i in range(len(sizes) - 1, -1, -1):
            s = sizes[i]
            if s <= 0 or total + s > 2500 or (i < len(sizes) - 1 and s > total and total + s > 100):
                break
            total += s
            start = i
        for i, s in enumerate(sizes):
            rows.append((g, i, s))
            want[g, i] = i >= start and len(sizes) - start >= 2
    df = spark.createDataFrame(rows, "g int, i int, size long")
    assert {(x.g, x.i): x.merges for x in mergeable(df, ["g"], [F.desc("i")], "size", 100, 2500).collect()} == want
    fits = {(x.g, x.i): x.fits for x in within_budget(df, ["g"], [F.desc("i")], "size", 700).collect()}
    for g in range(120):
        used, alive = 0, True
        for _, i, s in sorted((x for x in rows if x[0] == g), key=lambda x: -x[1]):
            alive = alive and used + s <= 700
            used += s
            assert fits[g, i] == alive


# --- merge matrix


@pytest.mark.parametrize(
    ("b", "o", "t", "want"),
    [
        ("f1", "f1", "f1", "same"), ("f1", "f2", "f2", "same"), (None, "f2", "f2", "same"), (None, "f1", "f2", "conflict:add-add"),
        ("f1", "f2", "f3", "conflict:both-modified"), ("f1", "f1", "f3", "take-theirs"), ("f1", "f3", "f1", "take-ours"), ("f1", "d1", "f1", "conflict:type-change"),
        ("d1", "d1", "d2", "descend"), (None, "d1", None, "descend"), ("d1", None, "d1", "descend"), (None, "f1", None, "take-ours"), ("f1", "f1", None, "drop"),
        ("f1", "f2", None, "conflict:modify-delete"), (None, None, "f1", "take-theirs"), ("f1", None, "f1", "drop"), ("f1", None, "f2", "conflict:modify-delete"), ("f1", None, None, "drop"),
    ],
)
def test_merge_matrix(spark, b, o, t, want):
    from packstrata.operators.merging import three_way

    side = lambda x: spark.createDataFrame([("n", 2 if x[0] == "d" else 1, x)] if x else [], "name string, kind int, body string")
    got = three_way(side(b), side(o), side(t), ["name"], "kind", ["body"]).collect()
    assert [":".join(filter(None, (x.outcome, x.conflict))) for x in got] == [want]


def test_below_conflicts(spark):
    from packstrata.operators.merging import below_conflicts

    df = spark.createDataFrame([("a", "type-change"), ("a/b", None), ("a/b/c", None), ("ab", None), ("c/a", None)], "path string, conflict string")
    assert sorted(x.path for x in below_conflicts(df, "path").collect()) == ["a/b", "a/b/c"]


# --- stores and streams


def test_store_commits_once(spark, tmp_path):
    from packstrata.sources.generations import Conflict, Root, Store, digest

    s = Store(spark, f"file://{tmp_path}/v")
    a = spark.range(5).toDF("x")
    first = s.commit("main", {"t": a}, expected=-1)
    with pytest.raises(Conflict):
        s.commit("main", {"t": a}, expected=-1)
    second = s.commit("main", {"t": spark.range(3).toDF("x"), "u": a}, expected=0)
    assert s.read(first, "t").count() == 5 and s.read(s.head("main"), "t").count() == 3 and s.verified(second, "u", a)
    assert not s.verified(second, "t", a) and digest(a) == digest(a.orderBy("x", ascending=False))
    s.tag("v1", first)
    with pytest.raises(Conflict):
        s.tag("v1", second)
    side = s.branch("side", first)
    assert side.lineage > 0 and side.fork["base"] == first.hash() and s.branches() == ["main", "side"] and s.tags() == ["v1"]
    assert s.verify_chain("main") == [] and s.unreferenced() == []
    with pytest.raises(ValueError):
        Root.decode(first.encode().replace('"branch"', '"x":1,"branch"'))
    with pytest.raises(ValueError):
        Root.decode(first.encode().replace('{"branch"', '{"branch":"m","branch"', 1))
    s.delete_branch("side")
    with pytest.raises(ValueError):
        s.delete_branch("main")
    s.delete_tag("v1")
    assert s.tags() == []


def test_ordered_fold_equals_batch(spark, tmp_path):
    from test_problems import JOURNAL, random_journal

    from packstrata.operators.journal import content_map, standing
    from packstrata.streaming.journal import fold_ordered, latest_extents

    journal = spark.createDataFrame(random_journal(9, 300), JOURNAL)
    ops = standing(journal)
    for part, cond in enumerate(("seq < 100", "seq >= 100 and seq < 200", "seq >= 200")):
        ops.where(cond).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/{part}")
    stream = spark.readStream.schema(ops.schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(f"{tmp_path}/in")
    q = fold_ordered(stream).writeStream.outputMode("update").foreachBatch(lambda df, n: df.write.mode("overwrite").parquet(f"{tmp_path}/out/b={n}")).option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    got = latest_extents(spark.read.parquet(f"{tmp_path}/out").drop("b"))
    assert sorted(tuple(x) for x in got.collect()) == sorted(tuple(x) for x in content_map(journal).collect())


def test_late_operation_is_an_error():
    from packstrata.streaming.journal import Extents

    e = Extents([], [], [], 0, False)
    for op in [(1, 7, 0, 10), (1, 8, 3, 2), (2, None, 0, 6), (1, 9, 8, 0)]:
        e.apply(op[0], op[1] or 0, op[2], op[3])
    assert (e.los, e.his, e.handles, e.size) == ([0, 3, 5], [3, 5, 6], [7, 8, 7], 8)


def test_plan_lines(spark):
    from packstrata.sources.objects import parse_plan

    df = spark.createDataFrame([("write a/b off=0 len=9 fill",), ("  ",), ("# note",), ("sync",)], "value string")
    assert [(x.op, x.path, x.args) for x in parse_plan(df).collect()] == [("write", "a/b", {"off": "0", "len": "9", "fill": None}), ("sync", None, {})]


def test_scalars(spark):
    from pyspark.sql import functions as F

    from packstrata.functions import scalar as S

    df = spark.createDataFrame([("8G", "00112233-4455-6677-8899-aabbccddeeff", "p-181c79a33cc29a11-ab"), ("x", "zz", "P-1"), ("12", None, "p-ffffffffffffffff-1")], "a string, b string, c string")
    rows = df.select(S.parse_size(F.col("a")), S.volume_id_text(S.volume_id_bytes(F.col("b"))), S.pack_time_ns(F.col("c"))).collect()
    assert [tuple(r) for r in rows] == [(8 << 30, "00112233-4455-6677-8899-aabbccddeeff", 0x181C79A33CC29A11), (None, None, None), (12, None, None)]


def test_split_equals_the_walk(spark):
    from packstrata.operators.splitting import split

    r = random.Random(5)
    parent = {n: max(1, n - r.choice([1, 1, 2, 5, 20])) for n in range(2, 70)}
    rows = [(p, f"d{n}".encode(), n, 2, 1) for n, p in parent.items()]
    files = [(r.randrange(1, 70), 1000 + k, r.choice([0, 50, 900, 2048, 5000])) for k in range(200)]
    files += [(n, 2000 + n, 7) for n in range(1, 70)]
    rows += [(p, f"f{i}".encode(), i, 1, 1) for p, i, _ in files]
    size = {i: n for _, i, n in files}
    own = {n: sum(200 + (size.get(i, 0) if t == 1 and size.get(i, 0) <= 2048 else 0) for p, _, i, t, _ in rows if p == n) for n in range(1, 70)}
    weight, roots = {}, {1}
    for n in range(69, 0, -1):
        kids = sorted((c for c, p in parent.items() if p == n), key=lambda c: (-weight[c], c))
        w = own[n] + sum(weight[c] for c in kids)
        for c in kids:
            if w <= 6000 or weight[c] <= 200:
                break
            w += 200 - weight[c]
            roots.add(c)
        weight[n] = w
    edge = spark.createDataFrame(rows, "parent long, name binary, inode long, type int, generation long")
    node = spark.createDataFrame([(i, n) for i, n in size.items()], "inode long, length long")
    got = {x.inode: (x.weight, x.catalog) for x in split(edge, node, 6000).collect()}
    assert got == {n: (weight[n], n in roots) for n in weight} and len(roots) > 3


def test_skip_and_continue(spark):
    from packstrata.operators.folds import sequential_parts, skip_and_continue

    df = spark.createDataFrame([("a", i, c) for i, c in enumerate([5, 4, 9, 1, 2])], "k string, i int, n long")
    got = sequential_parts(df, ["k"], ["i"], ["i", "n"], skip_and_continue(10), flags=True).collect()
    assert [x.part for x in sorted(got, key=lambda x: x.i)] == [1, 1, 0, 1, 0]


def test_following_a_branch(spark, tmp_path):
    from packstrata.sources.generations import Store
    from packstrata.streaming.heads import changes_since

    s = Store(spark, f"file://{tmp_path}/v")
    rows = lambda x: spark.createDataFrame(x, "k int, v string, m int")
    s.commit("main", {"t": rows([(1, "a", 0), (2, "b", 0)])})
    s.commit("main", {"t": rows([(1, "a", 1), (3, "c", 0)])})
    s.commit("main", {"u": rows([])})
    got = [(r.generation, sorted(tuple(x) for x in df.collect())) for r, df in changes_since(s, "main", 0, "t", ["k"], ["v"], ["m"])]
    assert got == [(1, [(1, "changed", False, True), (2, "removed", True, True), (3, "added", True, True)])]


def test_observed_report_and_prefetch(spark):
    from pyspark.sql import functions as F

    from packstrata.sources.objects import prefetched, report

    df, told = report(spark.range(10), "run", rows=F.count(F.lit(1)), top=F.max("id"))
    assert df.count() == 10 and told() == {"rows": 10, "top": 9}
    assert prefetched(spark.range(4), "id", 6).count() == 4
    with pytest.raises(ValueError):
        prefetched(spark.range(4), "id", 5)
