"""Operators of the llm subpackage against brute force, exact round trips and SQL."""

from __future__ import annotations

import random
import unicodedata

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import differences

from packstrata.llm import lookalike, queries
from packstrata.llm.fingerprints import BITS, Filter, build
from packstrata.llm.lookalike import LATTICE, Former, Ngrams, consistent_forms, lattice_of, lookalike_classes, lookalike_pairs, skeleton, unicode_shapes
from packstrata.llm.packing import Tournament, first_fit_decreasing, pack
from packstrata.llm.seen import SealedKeys, seen_before, seen_errors
from packstrata.llm.tokens import encode, parts, token_bytes, token_ids, tokenizer


# --- 5: keys seen before


@pytest.mark.parametrize("n", [0, 1, 2, 5, 1000, 50_000])
def test_filter_never_misses_and_rarely_lies(n):
    r = np.random.default_rng(n)
    keys = r.integers(0, 1 << 63, n, dtype=np.uint64)
    f = Filter(build(np.concatenate([keys, keys[:3]])))
    assert f.has(keys).all()
    others = r.integers(1 << 63, (1 << 64) - 1, 400_000, dtype=np.uint64)
    assert f.has(others).mean() < 6 / (1 << BITS)


def test_p5_equals_sql(spark, data):
    assert differences(queries.p5_found(spark, data), data, queries.R.sql["p5_found"]) == ([], [])


@pytest.mark.parametrize("shard_keys", [1 << 19, 40])
def test_seen_before_brute_force(spark, shard_keys):
    r = random.Random(2)
    rows = [(k, r.choice([None, b"", b"hot", b"hot", bytes([r.randrange(90)]), r.randbytes(r.choice([12, 32]))]), "x") for k in r.sample(range(-50, 2000), 700)]
    rows += [(None, b"hot", "x"), (3000, b"tie", "x"), (3000, b"tie", "x"), (3001, b"tie", "x")]
    known = [(b"\x07",), (None,), (b"\x09",)]
    seen, want = {k for (k,) in known}, []
    for at in sorted({a for a, _, _ in rows if a is not None}):
        now = [k for a, k, _ in rows if a == at and k is not None]
        want += [at for k in now if k in seen]
        seen |= set(now)
    df, kn = spark.createDataFrame(rows, "at long, k binary, _key string"), spark.createDataFrame(known, "k binary")
    assert sorted(x[0] for x in seen_before(df, "k", "at", kn, batches=9, shard_keys=shard_keys).collect()) == sorted(want)
    told = seen_errors(df, "k", "at", kn, batches=9, shard_keys=shard_keys).collect()
    assert all(x.missed == 0 and 0 <= x.rate <= 1 for x in told) and len(told) <= 9


def test_seen_before_empty(spark):
    none = spark.createDataFrame([], "at long, k binary")
    assert seen_before(none, "k", "at").count() == 0
    assert seen_errors(none, "k", "at").count() == 0


# --- 7: token ids


@pytest.fixture(scope="module")
def enc():
    return tokenizer(queries.ranks())


@pytest.fixture(scope="module")
def plain():
    """The tokenizer as its makers describe it, without cuts."""
    import base64

    import public_tokenizers as P
    import tiktoken

    with open(queries.ranks(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from(list("ab é1,'s.\n\t\r \x85\x1c\x1f　 \xa0検🙂<|>_")), max_size=60))
def test_cuts_change_no_id(enc, plain, text):
    assert encode(text, enc) == plain.encode_ordinary(text)
    assert [i for p in parts(text, 5) for i in plain.encode_ordinary(p)] == plain.encode_ordinary(text)


@pytest.mark.parametrize("text", ["", " ", "a" * 70_000, " " * 70_000, "\n\n" * 40_000, "検査" * 40_000, "ab  cd\n" * 30_000, "<|endoftext|>", "\x00\x1b[31m" * 20_000])
def test_long_and_odd_texts(enc, plain, text):
    assert encode(text, enc) == plain.encode_ordinary(text)
    assert enc.decode_bytes(encode(text, enc)) == text.encode()


def test_p7_ids_and_round_trip(spark, data, plain):
    rows = {x.doc_id: x.text for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {x.doc_id: x.ids for x in queries.p7_ids(spark, data).collect()}
    assert got == {k: None if t is None else plain.encode_ordinary(t) for k, t in rows.items()}
    assert differences(queries.p7_round_trip(spark, data), data, queries.R.sql["p7_round_trip"]) == ([], [])


def test_ids_of_nothing(spark):
    df = spark.createDataFrame([("a", None, 1), ("b", "", 2), ("b", "", 2), (None, "x", 3)], "doc_id string, text string, ids int")
    assert sorted(((x.doc_id, x.ids) for x in token_ids(df, queries.ranks()).collect()), key=str) == [("a", None), ("b", []), ("b", []), (None, [87])]
    assert token_ids(df.limit(0), queries.ranks()).count() == 0
    assert {x.bytes for x in token_bytes(token_ids(df, queries.ranks()), queries.ranks()).collect()} == {None, b"", b"x"}


# --- 8: containers


def test_first_fit_decreasing_equals_the_plain_loop():
    r = random.Random(4)
    for _ in range(60):
        cap = r.choice([1, 7, 50])
        sizes = [r.randrange(cap + 1) for _ in range(r.randrange(60))]
        free, want = [], [0] * len(sizes)
        for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
            at = next((b for b, f in enumerate(free) if f >= sizes[i]), None)
            if at is None:
                at = len(free)
                free.append(cap)
            free[at] -= sizes[i]
            want[i] = at
        assert first_fit_decreasing(sizes, cap) == (want, len(free))
    assert Tournament(5, 1).place(5) == 0


@pytest.mark.parametrize("group", [16_384, 10])
def test_packing_is_whole(spark, group):
    r = random.Random(8)
    rows = [(k, r.choice([0, 1, 2048, 2049, 6144, 9000, r.randrange(2500)]), "c") for k in range(200)] + [(500, None, "c"), (501, 3, "c"), (501, 3, "c")]
    got = pack(spark.createDataFrame(rows, "doc_id long, n long, container string"), "doc_id", "n", len(rows), group_items=group).collect()
    room, size, whole = {}, {}, {}
    for x in got:
        room[x.container] = room.get(x.container, 0) + x.n_tokens
        size[x.doc_id] = size.get(x.doc_id, 0) + x.n_tokens
        whole.setdefault(x.doc_id, []).append((x.first_token, x.n_tokens))
    assert max(room.values()) <= 2048
    for k, n, _ in rows:
        n = n or 0
        assert size[k] == n * (2 if k == 501 else 1)
        if n <= 2048 and k != 501:
            assert len(whole[k]) == 1
        elif k != 501:
            assert sorted(whole[k]) == [(i, min(2048, n - i)) for i in range(0, n, 2048)]
    if group > 200:
        assert len(room) <= sum(size.values()) / 2048 * 1.15 + 1
    assert pack(spark.createDataFrame([], "doc_id long, n long"), "doc_id", "n", 0).count() == 0


def test_p8_packs_every_document(spark, data):
    got = queries.p8_containers(spark, data)
    assert {x.doc_id for x in got.select("doc_id").collect()} == {x.doc_id for x in spark.read.parquet(f"{data}/documents.parquet").select("doc_id").collect()}
    assert max(x.n for x in got.groupBy("container").agg({"n_tokens": "sum"}).toDF("c", "n").collect()) <= 2048


# --- 9: look-alikes


def disguised(text: str, r: random.Random) -> str:
    out = []
    for c in text:
        own = LATTICE.get(c)
        x = r.random()
        if own and x < 0.3:
            c = r.choice(list(own.values()))
        elif c == " " and x < 0.4:
            c = r.choice([" ", " ", "　"])
        elif "!" <= c <= "~" and x < 0.1:
            c = chr(ord(c) + 0xFEE0)
        elif x > 0.9:
            c += r.choice(["​", "­", "﻿", "⁠"])
        out.append(c)
    return unicodedata.normalize(r.choice(["NFC", "NFD"]), "".join(out))


BASES = ["The reader publishes, déjà vu.", "Сервер пишет журнал ёлки", "Ο κατάλογος είναι κενός", "cop axe", "検査はガでＡ", "", "  x", "plain\nlines\tand 12 digits", "COPE", "ﬁn x² ½ ①"]


def test_forms_of_disguises_are_one():
    f, r = Former(Ngrams([(0, ord("t"), 5), (ord("t"), ord("h"), 9), (0, 0x441, 4)])), random.Random(1)
    for base in BASES:
        want = f.form(base)
        assert unicodedata.is_normalized("NFC", want) and f.form(want) == want
        for _ in range(40):
            assert f.form(disguised(base, r)) == want, base


def test_visible_differences_stay():
    f = Former(Ngrams([]))
    shown = ["Abc 1", "abc 1", "abc  1", "abc\t1", "abc\n1", "abc\r\n1", "abç 1", "abc 2", "abc, 1", "abd 1", "аbс 1 я", "x²", "x2", "ﬁ", "fi", "…", "...", "①", "1", "½"]
    assert len({f.form(x) for x in shown}) == len(shown)
    assert len({skeleton(x) for x in shown}) == len(shown)


def test_search_keeps_scripts_together():
    text = "сервер работает, кеш пуст; каталог закрыт"
    pairs: dict[tuple[int, int], int] = {}
    for word in (text + " the cache is empty and stays so").split():
        for a, b in zip("\0" + word, word, strict=False):
            pairs[ord(a), ord(b)] = pairs.get((ord(a), ord(b)), 0) + 1
    f = Former(Ngrams([(a, b, n) for (a, b), n in pairs.items()]))
    assert f.form(text) == text
    assert f.form("сервep рaбoтaeт") == "сервер работает"
    assert f.form("thе cаchе") == "the cache"


@pytest.mark.parametrize("floor", [None, 1])
def test_pairs_brute_force(spark, floor):
    r = random.Random(6)
    texts = [t for base in BASES for t in [base, base, disguised(base, r), disguised(base, r)]] + [None, None, "​", "alone", "thing"] + ["cop axe"] * 5
    rows = [(k * 3, t, "en", "own") for k, t in enumerate(texts)]
    bones = {k: None if t is None else unicodedata.normalize("NFC", skeleton(t)) for k, t, _, _ in rows}
    want = sorted((a, b) for a, s, _, _ in rows for b, t, _, _ in rows if a < b and s is not None and t is not None and s != t and bones[a] == bones[b])
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, form string")
    assert sorted(tuple(x) for x in lookalike_pairs(df, floor=floor).collect()) == want and want
    assert lookalike_pairs(df.limit(0)).count() == 0


def test_p9_forms_whole(spark, data):
    rows = {x.doc_id: x.text for x in spark.read.parquet(f"{data}/documents.parquet").collect()}
    got = {x.doc_id: x.form for x in queries.p9_forms(spark, data).collect()}
    assert {k for k, v in got.items() if v is None} == {k for k, t in rows.items() if t is None}
    assert consistent_forms(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def counted(text: str, times: int) -> Ngrams:
    pairs: dict[tuple[int, int], int] = {}
    for word in text.split():
        for a, b in zip("\0" + word, word, strict=False):
            pairs[ord(a), ord(b)] = pairs.get((ord(a), ord(b)), 0) + times
    return Ngrams([(a, b, n) for (a, b), n in pairs.items()])


def test_search_decides_where_a_skeleton_would_be_wrong(spark):
    bones = unicode_shapes(spark)
    options = lattice_of(bones)
    assert len({s for row in options.values() for s, _, _ in row}) > 12
    # two Cyrillic letters share Unicode's prototype: comparing prototypes would join different words
    assert bones["у"] == bones["ү"] == "y"
    kazakh, russian = Former(counted("жүк күн күлдік жүн", 5000), options), Former(counted("жук кун кулдык жун", 5000), options)
    for f in (kazakh, russian):
        assert f.form("бұл күн") == "бұл күн" and f.form("бұл кун") == "бұл кун"
    # a Latin letter may stand for either, and the words of the corpus say for which
    assert kazakh.form("жaң кyн") == "жаң күн" and russian.form("жaң кyн") == "жаң кун"
    # Unicode's prototype of the small palochka is i: it would part this word from hello
    assert bones["ӏ"] == "i" and Former(counted("hello world", 9), options).form("heӏӏo worӏd") == "hello world"


def test_classes_count_the_pairs(spark, data):
    links = {}
    for x in queries.p9_found(spark, data).collect():
        links[x.doc_a], links[x.doc_b] = links.get(x.doc_a, 0) + 1, links.get(x.doc_b, 0) + 1
    got = queries.p9_classes(spark, data).collect()
    assert {x.doc: x.links for x in got} == links and all(x["class"] <= x.doc for x in got)
    rows = [(k, "aа"[k % 2] * 3 if k < 40 else f"{k}") for k in range(60)] + [(3, "ааа")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for floor in (None, 1):
        told = lookalike_classes(df, floor=floor).collect()
        assert {(x.doc, x["class"], x.links) for x in told} == {(k, 0, 20) for k in range(40)}


def test_stripes_pair_every_text_of_a_form(spark, monkeypatch):
    monkeypatch.setattr(lookalike, "STRIPE", 4)
    texts = ["a" * k + "а" * (9 - k) + " cat" for k in range(10)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(x) for x in lookalike_pairs(df).collect()) == [(a, b) for a in range(10) for b in range(a + 1, 10)]


def test_sealed_filters_of_earlier_runs(spark, data, tmp_path):
    assert differences(queries.p5_sealed_run(spark, data), data, queries.R.sql["p5_sealed_run"]) == ([], [])
    store = SealedKeys(spark, str(tmp_path / "s"), 3)
    keys = lambda *ks: spark.createDataFrame([(k, "x") for k in ks], "k binary, note string")
    store.seal(keys(b"a", b"a", None, b""), "k", 1)
    store.seal(keys(b"b"), "k", 7)
    assert {(bytes(x.k), x.claimed) for x in store.claims(keys(b"", b"a", b"b", b"c", None), "k").collect()} == {(b"", True), (b"a", True), (b"b", True), (b"c", False)}
    assert store.claims(keys(b"a").limit(0), "k").count() == 0


def test_one_late_arrival_does_not_make_one_batch(spark):
    df = spark.createDataFrame([(k, b"%d" % (k % 400)) for k in range(900)] + [(1 << 60, b"3")], "at long, k binary")
    told = seen_errors(df, "k", "at", batches=8).collect()
    assert len(told) == 8 and max(x.probed for x in told) < 200
    assert seen_before(df, "k", "at", batches=8).count() == 501
