"""Exact copies, near copies and repeated passages against brute force."""

import random

import numpy as np
import pyarrow as pa
import pytest
from brute import SCHEMA, components, removed, rows, texts
from pyspark.sql import functions as F

from tessera.llm import exact_dedup, ngram_join, substring_dedup
from tessera.llm.components import components as connected
from tessera.llm.induced_sort import order_of, sort_suffixes


def test_exact(spark, docs, none):
    got = {r["doc_id"]: r for r in exact_dedup.decide(spark, docs).collect()}
    groups = {}
    for r in docs.collect():
        groups.setdefault(r["text"] or "", []).append(r["doc_id"])
    for members in groups.values():
        for i in members:
            assert (got[i]["keep_id"], got[i]["group_size"], got[i]["kept"]) == (max(members), len(members), i == max(members))
    assert exact_dedup.decide(spark, none).count() == 0
    left = exact_dedup.deduplicate(spark, docs)
    assert left.columns == docs.columns and sorted(r["doc_id"] for r in left.collect()) == sorted(map(max, groups.values()))


def test_exact_with_repeated_and_null_ids(spark):
    df = spark.createDataFrame([(1, "a"), (1, "a"), (2, "a"), (None, "b"), (None, "a"), (3, None), (4, "")], "doc_id long, text string")
    got = sorted(((str(r["doc_id"]), r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(spark, df).collect()), key=str)
    assert got == [("1", 2, 4, False), ("1", 2, 4, False), ("2", 2, 4, True), ("3", 4, 2, False), ("4", 4, 2, True), ("None", 2, 4, False), ("None", None, 1, True)]
    df = spark.createDataFrame([(1, "a"), (1, "a"), (0, "a")], "doc_id long, text string")
    assert [r["doc_id"] for r in exact_dedup.deduplicate(spark, df).collect()] == [1]


def test_index_takes_only_new_digests(spark):
    index = exact_dedup.DigestIndex(spark, buckets=4)
    first = exact_dedup.digests(spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string"))
    second = exact_dedup.digests(spark.createDataFrame([(3, "b"), (4, "c"), (5, "c")], "doc_id long, text string"))
    index.append(first)
    assert [r["keep_id"] for r in index.unseen(second).collect()] == [5]
    index.append(second)
    assert sorted(r["keep_id"] for r in index.table().collect()) == [1, 2, 5]
    assert sorted((r["keep_id"], r["group_size"]) for r in index.rows().collect()) == [(1, 1), (3, 2), (5, 2)]
    plan = index.unseen(second)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Bucketed: true" in plan
    # the index goes on under its name, with its own number of buckets
    again = exact_dedup.DigestIndex(spark, index.name)
    assert again.buckets == 4
    third = spark.createDataFrame([(9, "a"), (0, "b"), (7, "d")], "doc_id long, text string")
    got = {r["doc_id"]: (r["keep_id"], r["group_size"], r["kept"]) for r in exact_dedup.decide(spark, third, again).collect()}
    assert got == {9: (9, 2, True), 0: (3, 3, False), 7: (7, 1, True)}
    again.drop()
    assert not again.exists()


def test_exact_drops_copies_without_an_id(spark):
    df = spark.createDataFrame([(None, "a"), (2, "a"), (3, "b")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["text"]) for r in exact_dedup.deduplicate(spark, df).collect()) == [(2, "a"), (3, "b")]


def test_exact_leaves_no_table_and_carries_any_columns(spark):
    before = {t.name for t in spark.catalog.listTables()}
    long = "word " * 200_000
    data = [(1, "a", 1, "x"), (1, "b", 2, "y"), (2, "a", 3, "z"), (None, "n", 4, "p"), (None, "n", 5, "q"), (None, "b", 6, "r"), (3, long, 7, "s"), (4, long, 8, "t")]
    df = spark.createDataFrame(data, "doc_id long, text string, row long, digest string").withColumnRenamed("row", "_i")
    left = exact_dedup.deduplicate(spark, df)
    assert left.columns == df.columns
    got = sorted(((r["doc_id"], r["text"][:1]) for r in left.collect()), key=str)
    assert got == sorted([(1, "b"), (2, "a"), (None, "n"), (4, "w")], key=str)
    assert {t.name for t in spark.catalog.listTables()} == before


def near(spark, data):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in ngram_join.group(spark, spark.createDataFrame(data, SCHEMA).repartition(3)).collect()}
    assert got == components(data)


def test_near(spark, docs, none):
    near(spark, rows(texts()))
    assert ngram_join.group(spark, none).count() == 0
    left = ngram_join.keep_one(spark, docs)
    assert left.columns == docs.columns
    assert sorted(r["doc_id"] for r in left.collect()) == sorted({c for _, c in components(rows(texts())).values()})


def test_near_in_hot_groups(spark, monkeypatch):
    """A large group of near copies, and documents that share much without being similar."""
    monkeypatch.setattr(ngram_join, "SMALL", 3)
    monkeypatch.setattr(ngram_join, "COMMON", 2)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(60)]
    data = []
    for _ in range(40):
        w = list(base)
        for _ in range(rng.randrange(0, 5)):
            w[rng.randrange(60)] = f"n{rng.randrange(1000)}"
        data.append(" ".join(w))
    data += [" ".join(base[:40] + [f"u{rng.randrange(10**6)}" for _ in range(rng.randrange(0, 30))]) for _ in range(30)]
    near(spark, rows(data))


@pytest.mark.parametrize("seed", [11, 12])
def test_tree_join(seed):
    rng = random.Random(seed)
    sets = {}
    for i in range(60):
        base = set(rng.sample(range(200), rng.randrange(1, 60))) if i % 3 == 0 or not sets else set(sets[rng.choice(list(sets))].tolist()) ^ set(rng.sample(range(200), rng.randrange(0, 6)))
        sets[i] = np.array(sorted(base or {1}), np.uint64)
    wanted = {i: set(range(60)) - {i} for i in range(60)}
    got = set(ngram_join.tree_join(sets, wanted))
    full = {i: set(s.tolist()) for i, s in sets.items()}
    assert got == {(a, b) for a in full for b in full if a != b and 100 * len(full[a] & full[b]) >= 80 * len(full[a] | full[b])}


def test_components(spark):
    pairs = [(i, i + 1) for i in range(30)] + [(100, 50), (50, 70), (200, 201)]
    got = {r["node"]: r["root"] for r in connected(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(31)}, 100: 50, 50: 50, 70: 50, 200: 200, 201: 200}
    assert connected(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("budget", [64, 1 << 28])
def test_suffix_order(budget):
    rng = random.Random(budget)
    for _ in range(150):
        k = rng.choice([1, 2, 4, 30])
        s = [rng.randrange(k) for _ in range(rng.randrange(1, 80))]
        if rng.random() < 0.5:
            s = (s * 4)[:200]
        order, common = sort_suffixes(np.array(s, np.int32), k, budget)
        want = sorted(range(len(s)), key=lambda i: s[i:])
        assert order.tolist() == want
        for a, b, c in zip(want, want[1:], common[1:].tolist(), strict=False):
            n = 0
            while a + n < len(s) and b + n < len(s) and s[a + n] == s[b + n]:
                n += 1
            assert c == n


def test_order_by_recursive_induction():
    rng = random.Random(12)
    for _ in range(300):
        k = rng.choice([1, 2, 3, 9, 1000])
        s = [rng.randrange(k) for _ in range(rng.randrange(1, 90))]
        s = rng.choice([s, (s * 5)[:200], sorted(s), sorted(s)[::-1]])
        assert order_of(np.array(s, np.int64)).tolist() == sorted(range(len(s)), key=lambda i: s[i:])


def test_queues_of_a_shard_use_the_disk(monkeypatch):
    """Shards of the usual size don't fit the budget of the queues; the order is the same with and without."""
    from tessera.llm import induced_sort

    spilled = []
    spill = induced_sort.SymbolQueue._spill
    monkeypatch.setattr(induced_sort.SymbolQueue, "_spill", lambda q: (spilled.append(1), spill(q))[1])
    rng = random.Random(2)
    words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randrange(1, 7))) for _ in range(300)]
    text = np.frombuffer(" ".join(rng.choice(words) for _ in range(250_000)).encode(), np.uint8).astype(np.int16)
    order, common = sort_suffixes(text, 257)
    assert spilled
    again, same = sort_suffixes(text, 257, 1 << 30)
    assert (order == again).all() and (common == same).all()


def passages(spark, data):
    df = spark.createDataFrame(data, SCHEMA).repartition(3)
    assert {r["doc_id"]: tuple(r)[1:] for r in substring_dedup.repeats(spark, df).collect()} == removed(data)


def test_passages(spark, docs, none):
    passages(spark, rows(texts()))
    assert substring_dedup.repeats(spark, none).count() == 0
    cut = substring_dedup.remove_repeats(spark, docs)
    assert cut.columns == docs.columns
    want = removed(rows(texts()))
    for r in cut.collect():
        n, gone, _, _ = want[r["doc_id"]]
        if gone == 0:
            assert len((r["text"] or "").encode()) == n


@pytest.mark.parametrize(("hot", "hottest"), [(2, 10**9), (2, 4), (1, 1)])
def test_passages_of_hot_anchors(spark, monkeypatch, hot, hottest):
    """Anchors of many documents are dealt in pieces; a line that all share stands among different words."""
    monkeypatch.setattr(substring_dedup, "HOT", hot)
    monkeypatch.setattr(substring_dedup, "HOTTEST", hottest)
    rng = random.Random(hot + hottest % 7)
    line = "the line that all of the documents here do share with others"
    word = lambda: "".join(rng.choice("abcd") for _ in range(rng.randrange(1, 9)))
    around = [" ".join(word() for _ in range(6)) for _ in range(6)]
    data = [rng.choice(around)[-rng.randrange(1, 30) :] + line[rng.randrange(12) : 60 - rng.randrange(12)] + rng.choice(around)[: rng.randrange(30)] + "-" * rng.randrange(200) + "ab" * rng.randrange(60) for _ in range(60)]
    passages(spark, rows(data))


def test_passages_in_runs(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "CHUNK", 300)
    monkeypatch.setattr(substring_dedup, "SHARD", 500)
    rng = random.Random(6)
    parts = ["".join(rng.choice("ab") for _ in range(rng.randrange(20, 120))) for _ in range(10)] + ["é", "a" * 60, "ab" * 40, "\0" * 55]
    passages(spark, rows(["".join(rng.choice(parts) for _ in range(rng.randrange(8))) for _ in range(80)]))


def test_passages_with_repeated_and_null_ids(spark):
    a, b = "".join(map(chr, range(40, 100))), "".join(map(chr, range(60, 125)))
    df = spark.createDataFrame([(1, a), (1, b), (1, b), (2, a + "x"), (None, a), (0, b[:50])], "doc_id long, text string")
    got = sorted((str(r["doc_id"]), r["n_bytes"], r["n_removed"]) for r in substring_dedup.repeats(spark, df).collect())
    assert got == [("0", 50, 0), ("1", 60, 0), ("1", 65, 50), ("1", 65, 50), ("2", 61, 60), ("None", 60, 0)]


def test_near_with_repeated_and_null_ids(spark):
    a, b = (" ".join(f"{c}{i}" for i in range(60)) for c in "ab")
    data = [(5, a), (5, b), (2, a + " more"), (3, b + " more"), (None, a), (None, "alone here"), (9, None), (9, None)]
    df = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in ngram_join.group(spark, df).collect()), key=str)
    assert got == sorted([(5, 56, 2), (5, 56, 2), (2, 57, 2), (3, 57, 2), (None, 56, 2), (None, 1, None), (9, 0, 9), (9, 0, 9)], key=str)


@pytest.mark.parametrize("cells", [1, 300, 10**6])
def test_classes_joined_in_a_tile(monkeypatch, cells):
    monkeypatch.setattr(ngram_join, "CELLS", cells)
    monkeypatch.setattr(ngram_join, "STEP", 5)
    rng = random.Random(cells)
    for _ in range(20):
        sets = {}
        for i in range(40):
            base = set(rng.sample(range(150), rng.randrange(1, 50))) if i % 4 == 0 else set(rng.choice(list(sets))) ^ set(rng.sample(range(150), rng.randrange(0, 7)))
            sets.setdefault(tuple(sorted(base or {1})), i)
        sets = [np.array(x, np.uint64) for x in sets]
        classes = [rng.randrange(12) for _ in sets]
        probes = rng.sample(range(len(sets)), len(sets) // 2)
        full = [set(x.tolist()) for x in sets]
        similar = [(a, b) for a in probes for b in range(len(sets)) if 100 * len(full[a] & full[b]) >= 80 * len(full[a] | full[b])]

        def partition(pairs):
            kind = dict(zip(range(12), range(12)))
            for a, b in pairs:
                x, y = kind[classes[a]], kind[classes[b]]
                kind = {k: min(x, y) if v in (x, y) else v for k, v in kind.items()}
            return kind

        got = ngram_join.joined_classes(sets, classes, probes)
        assert set(got) <= set(similar) and partition(got) == partition(similar)


def test_runs_are_one_cover(spark):
    """Runs of one byte or a short period: covers stay as small as the windows that differ, whatever is around."""
    data = ["-" * 5000, "x" + "-" * 3000 + "y", "ab" * 900, "ba" * 700 + "c", "abc" * 400, "z" + "cab" * 300 + "abz" * 30, "." * 49, "." * 50, "." * 51, "long " + "-" * 80 + " mid " + "=" * 90 + "-" * 70,
            "".join(map(chr, range(33, 70))) * 20, "".join(map(chr, range(40, 70))) + "".join(map(chr, range(33, 70))) * 9 + "!", "a" * 60 + "b" + "a" * 60, "b" + "a" * 55 + "c"]
    passages(spark, rows(data))
    passages(spark, rows(data[::-1]))
    covers = substring_dedup._covers(spark.createDataFrame([(1, 1, "-" * 100_000)], "key long, doc_id long, text string").selectExpr("*", f"array({substring_dedup.Chunk([(0, b'-' * 60)]).hash[0]}) hashes", "cast(null as array<struct<hash:long,parts:int>>) hot")).collect()
    assert [(r["start"], r["stop"], len(r["cover"])) for r in covers] == [(0, 100_000, 50)]


def test_cut_texts_keep_any_columns(spark):
    a = "".join(map(chr, range(40, 100)))
    df = spark.createDataFrame([(1, a, 1, "d"), (2, a + "?", 2, "e"), (None, a, 3, "f")], "doc_id long, text string, key long, digest string").withColumnRenamed("key", "kept").withColumn("_id", F.lit(1)).withColumn("_own", F.lit(2))
    got = substring_dedup.remove_repeats(spark, df)
    assert got.columns == df.columns
    assert sorted((r["kept"], r["text"], r["digest"]) for r in got.collect()) == [(1, a, "d"), (2, "?", "e"), (3, a, "f")]


def test_comparison_doesn_t_depend_on_batches(monkeypatch):
    """Anchors that begin, go on and end anywhere among the batches give the same removed windows."""
    monkeypatch.setattr(substring_dedup, "SHARD", 400)
    rng = random.Random(13)

    class Captured:
        def mapInArrow(self, f, _):  # noqa: N802
            self.f = f
            return self

    held = Captured()
    substring_dedup._compared(held)
    rows_ = []
    for anchor in range(40):  # windows of one anchor occur under no other
        text = "".join(rng.choice("abcdef") for _ in range(60))
        for doc in sorted(rng.randrange(9) for _ in range(rng.randrange(1, 12))):
            a = rng.randrange(6)
            cover = text[a : a + 52].encode() + bytes([65 + rng.randrange(3)])
            at = rng.randrange(100)
            rows_.append((anchor, doc, doc, at, at + len(cover), 0, cover))
    kinds = [pa.int64()] * 5 + [pa.int32(), pa.binary()]
    table = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows_), kinds)], list("hdkspqc"))
    seen = set()
    for size in (1, 2, 7, 50, 10_000):
        gone = set()
        for batch in held.f(iter([table.slice(i, size) for i in range(0, table.num_rows, size)])):
            for key, a, b in zip(*(c.to_pylist() for c in batch.columns)):
                gone |= {(key, x) for x in range(a, b)}
        seen.add(frozenset(gone))
    assert len(seen) == 1 and len(next(iter(seen))) > 100
