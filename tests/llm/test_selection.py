"""Quality, urls, mixing, licenses, languages and neighbours."""

import math
import random

import duckdb
import numpy as np
import pytest
from brute import SCHEMA, WORD, rows, texts
from pyspark.sql import functions as F

from tessera.llm import language_id, license_scan, mixing, nearest, quality, url_filter

LABELS = "doc_id long, quality int, toxic int"


def labels(spark, data=()):
    return spark.createDataFrame(list(data), LABELS)


def test_mixing_meets_targets(spark, docs, none):
    got = {r["doc_id"]: r for r in mixing.mix(spark, docs, labels(spark, [(i, i % 2, 0) for i in range(0, 60, 3)])).collect()}
    size = {r["doc_id"]: len(WORD.findall(r["text"] or "")) for r in docs.collect()}
    assert {i: r["size"] for i, r in got.items()} == size
    total, partial = {}, {}
    for r in got.values():
        total[r["source"]] = total.get(r["source"], 0) + r["taken"]
        partial[r["source"]] = partial.get(r["source"], 0) + (r["taken"] not in (0, r["size"], 2 * r["size"]))
        assert 0 <= r["taken"] <= 2 * r["size"]
    targets = {r["source"]: r["target"] for r in got.values()}
    assert abs(sum(targets.values()) - 1.5 * sum(size.values())) < 1e-6
    for s, t in targets.items():
        assert t - 1 < total[s] <= t + 1e-9 and partial[s] <= 1
    again = {r["doc_id"]: r["taken"] for r in mixing.mix(spark, docs.repartition(5), labels(spark, [(i, i % 2, 0) for i in range(0, 60, 3)])).collect()}
    assert again == {i: r["taken"] for i, r in got.items()}
    assert mixing.mix(spark, none, labels(spark)).count() == 0
    copies = mixing.mixed_documents(spark, docs, labels(spark))
    assert copies.columns == docs.columns and copies.count() > 0


def test_mixing_of_one_source_and_wordless_rows(spark):
    one = spark.createDataFrame([(1, "a b c", "s"), (2, "d e", "s"), (None, None, None)], "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["target"], r["taken"]) for r in mixing.mix(spark, one, labels(spark)).collect()}
    assert got[1][0] == 7.5 and got[1][1] + got[2][1] == 7 and got[None] == (0.0, 0)


def test_mixing_agrees_for_repeated_and_null_ids(spark):
    """Other orders and partitions of rows give the same rows; what is taken is the target's whole part."""
    rng = random.Random(4)
    data = [(None if i % 3 else i % 7, "w " * rng.randrange(9), f"s{i % 2}" if i % 5 else None, i, i) for i in range(600)]
    schema = "doc_id long, text string, source string, _times long, _copy long"
    seen = []
    for part in (1, 4):
        rng.shuffle(data)
        df = spark.createDataFrame(data, schema).repartition(part)
        seen.append(sorted(map(str, mixing.mix(spark, df, labels(spark, [(0, 1, 0), (1, 0, 0)])).collect())))
    assert seen[0] == seen[1]
    rows = mixing.mix(spark, df, labels(spark)).collect()
    for source in {r["source"] for r in rows}:
        own = [r for r in rows if r["source"] == source]
        assert sum(r["taken"] for r in own) == math.floor(own[0]["target"] + 1e-9)
    copies = mixing.mixed_documents(spark, df, labels(spark))
    assert copies.columns == df.columns
    words = {}
    for r in copies.collect():
        words[r["source"]] = words.get(r["source"], 0) + len((r["text"] or "").split())
    assert all(abs(words[r["source"]] - r["target"]) <= 9 for r in rows)


def test_heavier_documents_come_first(spark):
    """Half of the words are in documents of a quarter of the weight: they fill less of a budget of one half."""
    df = spark.createDataFrame([(i, "w " * 10, f"s{i % 3}") for i in range(3000)], "doc_id long, text string, source string")
    got = mixing.mix(spark, df, labels(spark, [(i, i // 3 % 2, 0) for i in range(3000)])).where("source = 's2'").collect()
    light = sum(r["taken"] for r in got if r["doc_id"] // 3 % 2 == 0)
    assert light < 0.45 * sum(r["taken"] for r in got)


@pytest.mark.parametrize(("url", "host", "path", "rule", "verdict"), [
    (None, "", "", None, "allow"), ("no scheme", "", "", None, "allow"), ("http://A.Example.ORG/es/x?q#f", "a.example.org", "/es/x", "example.org/es/", "block"),
    ("https://example.org/en/12", "example.org", "/en/12", "example.org/en/1", "block"), ("https://example.org/en/2", "example.org", "/en/2", "org/", "allow"),
    ("https://notexample.org/es/", "notexample.org", "/es/", "org/", "allow"), ("x://b.com/de/1", "b.com", "/de/1", "com/de/", "block"), ("x://b.com", "b.com", "", None, "allow"),
    ("x://b.org", "b.org", "", None, "allow"), ("a://b://c/d", "b:", "//c/d", None, "allow"),
])
def test_rules(spark, url, host, path, rule, verdict):
    pages = spark.createDataFrame([(1, url)], "page_id long, url string")
    r = url_filter.judge(spark, pages, labels(spark)).first()
    assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict)


def test_bad_branch_is_blocked_and_similar_ones_merge(spark):
    rng = random.Random(1)
    pages, known = [], []
    for i in range(600):
        branch = ("spam", "a", "b", "c")[i % 4]
        pages.append((i, f"http://h.net/{branch}/{i}"))
        known.append((i, int(rng.random() > (0.95 if branch == "spam" else 0.05)), 0))
    got = {r["page_id"]: r for r in url_filter.judge(spark, spark.createDataFrame(pages, "page_id long, url string"), labels(spark, known)).collect()}
    assert {r["verdict"] for i, r in got.items() if i % 4 == 0} == {"block"} and {r["verdict"] for i, r in got.items() if i % 4} == {"allow"}
    assert got[0]["template"] != got[1]["template"] and got[0]["template"].endswith("/*")
    assert url_filter.judge(spark, spark.createDataFrame([], "page_id long, url string"), labels(spark)).count() == 0


def test_deep_segments_tell_branches_apart(spark, tmp_path, monkeypatch):
    """Branches that differ from the fifth segment on, of several depths; SQL with as many levels agrees."""
    rng = random.Random(4)
    pages, known = [], []
    for i in range(800):
        branch = ("spam", "good", "fine", "spam/x/y/z")[i % 4]
        pages.append((i, f"http://h.net/a/b/c/d/{branch}/{i}"))
        known.append((i, int(rng.random() > (0.95 if branch.startswith("spam") else 0.05)), 0))
    pages += [(900, "http://one.net" + "/s" * 40), (901, "http://h.net/a/b/c/d"), (902, "http://h.net"), (903, None)]
    pages += [(1000 + i, "http://r.net/" + "/".join(rng.choice("ab") for _ in range(rng.randrange(9))) + f"/{i}") for i in range(400)]
    known += [(i, rng.randrange(2), 0) for i in range(300)]
    tables = {"pages": spark.createDataFrame(pages, "page_id long, url string"), "labels": labels(spark, known)}
    judged = url_filter.judge(spark, tables["pages"], tables["labels"]).cache()
    got = {r["page_id"]: r for r in judged.collect()}
    assert len(got) == len(pages)
    assert all(got[i]["verdict"] == ("block" if i % 4 in (0, 3) else "allow") for i in range(800))
    assert got[900]["template"] == "/s" * 40 and got[902]["template"] == ""
    for name, df in tables.items():
        df.coalesce(1).write.parquet(f"{tmp_path}/raw/{name}")
        next((tmp_path / "raw" / name).glob("*.parquet")).rename(tmp_path / f"{name}.parquet")
    monkeypatch.setattr(url_filter, "DEPTH", 40)
    con = duckdb.connect()
    for name in tables:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{tmp_path}/{name}.parquet')")
    expected = con.execute(url_filter.oracle()).fetchall()
    assert sorted(map(tuple, judged.select("page_id", "host", "path", "rule", "verdict").collect()), key=repr) == sorted(expected, key=repr)


def test_licenses(spark, none):
    mit = license_scan.TEMPLATES["MIT-grant"]
    w = mit.split()
    changed = " ".join(w[:10] + ["really"] + w[10:20] + w[22:])
    data = ["text before " + mit + " after", changed, " ".join(w[: len(w) // 2]), "Released under the MIT License.\nmore. RELEASED under the mit license", None, "", "released under this license", "x " * 5000 + "Licensed under CC BY-NC 4.0."]
    got = {}
    for r in license_scan.scan(spark, spark.createDataFrame(rows(data), SCHEMA)).collect():
        got.setdefault(r["doc_id"], []).append((r["license"], round(r["coverage"], 2), data[r["doc_id"]][r["start"] : r["stop"]]))
    assert got[0] == [("MIT-grant", 1.0, mit)]
    assert got[1][0][0] == "MIT-grant" and 0.9 < got[1][0][1] < 1 and got[1][0][2] == changed
    assert [m[2] for m in sorted(got[3], key=lambda m: m[2])] == ["RELEASED under the mit license", "Released under the MIT License."]
    assert got[7] == [("CC-BY-NC-4.0", 1.0, "Licensed under CC BY-NC 4.0.")] and sorted(got) == [0, 1, 3, 7]
    assert license_scan.scan(spark, none).count() == 0


def test_short_notices_are_found_anywhere():
    index, words = license_scan.Index(license_scan.TEMPLATES), license_scan.Words()
    rng = random.Random(8)
    for _ in range(200):
        around = [" ".join("".join(rng.choice("abcdef") for _ in range(4)) for _ in range(rng.randrange(12))) for _ in range(2)]
        text = f"{around[0]} All rights reserved. {around[1]}"
        assert [(m[0], text[m[2] : m[3]]) for m in license_scan.matches(index, words, text)] == [("rights-reserved", "All rights reserved.")]


def _common(a, b):
    best = [0] * (len(b) + 1)
    for x in a:
        last = best[:]
        for j, y in enumerate(b):
            best[j + 1] = last[j] + 1 if x == y else max(last[j + 1], best[j])
    return best[-1]


def test_every_license_with_planted_edits_is_found():
    """Whatever full alignment covers to 0.8 or more, with words left out, changed and put in, and an address
    put into long notices; and nothing that it covers to less."""
    index, words = license_scan.Index(license_scan.TEMPLATES), license_scan.Words()
    rng = random.Random(5)
    odd = lambda: "q" + "".join(rng.choice("xyz") for _ in range(5))
    for name, template in license_scan.TEMPLATES.items():
        plain = [x for w in template.split() if (x := w.strip(license_scan.EDGES).lower())]
        for trial in range(60):
            kept = list(plain)
            for i in rng.sample(range(len(kept)), rng.randrange(len(kept) // 4 + 2)):
                kept[i] = rng.choice(["", odd()])
            extra = set(rng.sample(range(1, len(kept)), rng.randrange(max(1, len(kept) // 5)))) if len(kept) > 4 else set()
            if len(plain) > 20 and trial % 3 == 0:
                at = rng.randrange(8, len(kept) - 8)
                kept[at] += " " + " ".join(odd() for _ in range(rng.randrange(9, 31)))
            edited = " ".join(f"{odd()} {w}" if i in extra else w for i, w in enumerate(kept)).split()
            text = " ".join([odd() for _ in range(rng.randrange(9))] + edited + [odd() for _ in range(9)])
            got = {m[0]: m[1] for m in license_scan.matches(index, words, text)}
            covered = _common(plain, edited) / len(plain)
            telling = {w for w in plain if any(map(str.isdigit, w)) or w in license_scan.DECIDING}
            if covered >= 0.8 and not telling <= set(edited):
                continue  # what is left doesn't say which license it is
            if covered >= 0.8:
                others = {n for n in got if n != name}
                assert got.get(name) == covered or others, (name, text, covered)
            else:
                assert name not in got, (name, text)
    for text, name in (("Released under MIT License.", "MIT"), ("Licensed under Apache License, Version 2.0", "Apache-2.0")):
        assert name in {m[0] for m in license_scan.matches(index, words, text)}


@pytest.mark.parametrize(("text", "name"), [
    ("This program is licensed under the GNU Affero General Public License, version 3.", None),
    ("This work is licensed under the GNU General Public License, version 2.", None),
    ("This work is licensed under the GNU Lesser General Public License, version 3.", None),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0"),
    ("Licensed under the Apache License, Version 1.1", None),
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", "CC-BY-ND-4.0-long"),
    ("This work is licensed under a Creative Commons Attribution 3.0 International License.", None),
    ("Licensed under CC BY-NC-SA 4.0.", None),
    ("Released under the BSD License.", None),
])
def test_versions_and_variants_are_told_apart(text, name):
    index, words = license_scan.Index(license_scan.TEMPLATES), license_scan.Words()
    for around in ("{}", "Some words before. {} And some after it."):
        assert [m[0] for m in license_scan.matches(index, words, around.format(text))] == ([name] if name else [])


def test_alignment_equals_longest_common_subsequence():
    rng = random.Random(2)
    for _ in range(200):
        t = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(3, 9))], np.uint64)
        c = np.array([rng.randrange(1, 5) for _ in range(rng.randrange(0, 9))], np.uint64)
        best = [[0] * (len(c) + 1) for _ in range(len(t) + 1)]
        for i in range(len(t)):
            for j in range(len(c)):
                best[i + 1][j + 1] = best[i][j] + 1 if t[i] == c[j] else max(best[i][j + 1], best[i + 1][j])
        assert license_scan.align(t, c, -4, 4)[0] == best[-1][-1]


def synthetic_languages(n, seed):
    rng = random.Random(seed)
    parts = {"aa": ["the", "ing", "tion", "wh"], "bb": ["der", "ung", "sch", "ein"], "cc": ["eau", "que", "oui", "lle"]}
    word = lambda lang: "".join(rng.choice(parts[lang]) for _ in range(rng.randrange(1, 4)))
    out = []
    for i in range(n):
        lang = rng.choice(sorted(parts))
        out.append((i, " ".join(word(lang) for _ in range(rng.randrange(3, 60))), lang))
    return out, word


def test_languages(spark, none):
    data, word = synthetic_languages(240, 3)
    switched = " ".join([*(word("aa") for _ in range(30)), *(word("bb") for _ in range(30))])
    data += [(1000, None, None), (1001, "", "aa"), (1002, "123 %%", None), (1003, switched, None), (1004, "theing " * 30_000, None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r["doc_id"]: r for r in language_id.predict(spark, df, model).collect()}
    held = [(got[i]["lang_pred"], lang) for i, _, lang in data[:240] if got[i]["held_out"]]
    assert len(held) > 30 and np.mean([a == b for a, b in held]) > 0.95
    assert [got[i]["lang_pred"] for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1004]["lang_pred"] == "aa"
    assert all(0 <= r["score"] <= 1 for r in got.values())
    runs = {r["doc_id"]: r["runs"] for r in language_id.label_words(spark, df, model).collect()}[1003]
    assert [r["lang"] for r in runs] == ["aa", "bb"] and abs(runs[0]["end"] - 30) <= 2
    kept = language_id.keep_known(spark, df, model)
    assert kept.columns == df.columns and {1000, 1001, 1002}.isdisjoint(r["doc_id"] for r in kept.collect())
    assert language_id.predict(spark, none, language_id.fit(none)).count() == 0


def test_text_without_spaces_is_read_whole(spark):
    """Words of many languages' parts without a space: the ends are of one language, all between of another."""
    data, word = synthetic_languages(240, 3)
    long = lambda lang, n: "".join(word(lang) for _ in range(n))
    data += [(2000, long("aa", 4)[:16] + long("bb", 400) + long("aa", 4)[-16:], None), (2001, long("aa", 4)[:16] + long("cc", 400) + long("aa", 4)[-16:], None)]
    data += [(2002, f"{word('aa')} {word('aa')} {long('bb', 60)} {word('bb')}", None)]
    df = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.fit(df)
    got = {r["doc_id"]: r["lang_pred"] for r in language_id.predict(spark, df, model).collect()}
    assert (got[2000], got[2001], got[2002]) == ("bb", "cc", "bb")
    runs = {r["doc_id"]: r["runs"] for r in language_id.label_words(spark, df, model).collect()}
    assert runs[2002][0]["first"] == 0 and runs[2002][-1]["end"] == 4 and runs[2002][-1]["lang"] == "bb"


def test_pieces_hold_every_byte():
    rng = random.Random(6)
    for _ in range(300):
        text = "".join(rng.choice("aZ.é語İ😀Σ ") if rng.random() < 0.9 else " " for _ in range(rng.randrange(120)))
        text = text.replace(" ", "" if rng.random() < 0.5 else " ")
        got, starts = language_id.pieces(text)
        words = text.split()
        starts = list(range(len(words))) if starts is None else starts.tolist()
        assert len(starts) == len(words)
        if not words:
            continue
        for w, a, b in zip(words, starts, [*starts[1:], len(got)], strict=True):
            assert got[a:b] == [w] or "".join(got[a:b]) == w.lower().strip(language_id.PUNCTUATION)
        language_id.features(got)


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(1)
    moves = rng.standard_normal((3, 3)).astype(np.float32)
    lengths = np.array([4, 3, 1])
    scores = rng.standard_normal((8, 3)).astype(np.float32)
    post, norm = language_id.forward_backward(scores, lengths, moves)
    at = 0
    for n, z in zip(lengths, norm, strict=True):
        s, total, want = scores[at : at + n], 0.0, np.zeros((n, 3))
        for path in np.ndindex(*([3] * n)):
            p = math.exp(sum(s[i, y] for i, y in enumerate(path)) + sum(moves[a, b] for a, b in zip(path, path[1:], strict=False)))
            total += p
            for i, y in enumerate(path):
                want[i, y] += p
        assert np.allclose(post[at : at + n], want / total, atol=1e-5) and abs(z - math.log(total)) < 1e-4
        at += n


def test_held_out(spark):
    import zlib

    got = spark.range(200).select("id", language_id.held_out(F.col("id")).alias("h")).collect()
    assert all(r["h"] == (zlib.crc32(str(r["id"]).encode()) % 4 == 2) for r in got)


def test_quality(spark, docs, none):
    rng = random.Random(5)
    good = lambda: " ".join(rng.choice(["the", "cat", "sat", "there", "quietly"]) + str(rng.randrange(99)) for _ in range(40)) + "."
    data, known = [], []
    for i in range(400):
        bad, toxic = i % 5 == 0, i % 7 == 0
        data.append((i, ("buy %%% now!!! " * 20 if bad else good()) + (" awful" if toxic else ""), f"site{i % 4}", "p"))
        known.append((i, int(not bad), int(toxic)))
    df = spark.createDataFrame([*data, (900, None, None, None), (901, "", "site0", None), (902, good(), "rare", "x")], "doc_id long, text string, host string, path string")
    model = quality.fit(df.where("doc_id % 3 <> 0"), labels(spark, known))
    got = {r["doc_id"]: r for r in quality.classify(spark, df, model).collect()}
    test = [i for i in range(0, 400, 3)]
    assert np.mean([(got[i]["quality"] >= 0.5) == (i % 5 != 0) for i in test]) > 0.97
    assert np.mean([(got[i]["toxic"] >= 0.5) == (i % 7 == 0) for i in test]) > 0.97
    rates = [got[i]["path_rate"] for i in got]
    assert all(0 < r < 1 for r in rates) and len(got) == 403
    # one document hardly moves its site from the global rate
    assert abs(got[902]["path_rate"] - got[1]["host_rate"]) < 0.2
    sited = quality.sites_of_documents(none)
    assert quality.classify(spark, sited, quality.fit(none, labels(spark))).count() == 0
    assert quality.classify(spark, quality.sites_of_documents(docs), quality.fit(docs, labels(spark))).count() == 60


def vectors(n=400, d=16, seed=1):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    x[50:150] = x[50]  # many equal ones
    return [(i, [float(v) for v in x[i]]) for i in range(n)]


def test_neighbours(spark, monkeypatch):
    monkeypatch.setattr(nearest, "PART", 90)
    data = vectors()
    odd = [(1000, None), (1020, [0.0] * 16), (1040, [float("nan")] + [1.0] * 15), (1060, [None] + [1.0] * 15), (1080, [float("inf")] + [0.0] * 15), (1100, [1.0] * 3), (None, [1.0] * 16)]
    got = {}
    for r in nearest.search(spark, spark.createDataFrame(data + odd, "vec_id long, embedding array<float>"), F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    x = np.array([v for _, v in data])
    assert sorted(got) == list(range(0, 400, 20))
    hits = 0
    for q, found in got.items():
        want = sorted(((-float(x[q] @ x[i]), i) for i in range(400) if i != q))[:20]
        hits += len({i for _, i in want} & {i for _, i, _ in found})
        assert [r for r, _, _ in found] == list(range(1, 21))
        assert all(abs(s - x[q] @ x[i]) < 1e-9 for _, i, s in found) and [(-s, i) for _, i, s in found] == sorted((-s, i) for _, i, s in found)
    assert hits >= 0.99 * 20 * len(got)


@pytest.mark.parametrize("size", [1e20, 1e150, 1e-30])
def test_components_of_any_size(spark, monkeypatch, size):
    """Finite components far beyond what single precision holds; repeated ids and clashing columns."""
    monkeypatch.setattr(nearest, "PART", 90)
    x = np.random.default_rng(4).standard_normal((200, 8)) * size
    data = [(i, [float(v) for v in x[i]], 1, 2.0) for i in range(200)] + [(7, [float(v) for v in x[8]], 1, 2.0)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, part int, length double")
    got = {}
    for r in nearest.search(spark, df, F.col("vec_id") % 20 == 0).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["vec_id"]))
    hits = 0
    for q in range(0, 200, 20):
        want = sorted((-float(x[q] @ np.array(v)), i) for i, v, _, _ in data if i != q)[:20]
        hits += len({i for _, i in want} & {i for _, i in got[q]})
        assert len(got[q]) == 20 and got[q] == sorted(got[q])
    assert hits >= 0.98 * 200


def test_few_vectors(spark):
    schema = "vec_id long, embedding array<float>"
    assert nearest.search(spark, spark.createDataFrame([], schema), F.col("vec_id") % 20 == 0).count() == 0
    got = nearest.search(spark, spark.createDataFrame([(0, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [1.0, 1.0])], schema), F.col("vec_id") % 20 == 0).orderBy("rank").collect()
    assert [(r["vec_id"], r["score"]) for r in got] == [(2, 1.0), (1, 0.0)]


def test_pipeline(spark, docs, none, tmp_path):
    import corpus_pipeline

    labels(spark, [(1, 1, 0)]).write.parquet(str(tmp_path / "labels.parquet"))
    step = docs.withColumn("text", F.when(F.col("doc_id") % 2 == 0, F.col("text")).otherwise(F.concat(F.coalesce("text", F.lit("")), F.lit(" more"))))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, str(tmp_path))
        assert out.columns == (docs.columns if name != "bpe" else [*docs.columns, "token_ids"])
        out.write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        sizes.append(step.count())
    assert sizes[0] >= sizes[1] >= sizes[2] > 0 and sizes[3] == sizes[4]
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_pipeline_stages_with_odd_rows(spark, tmp_path):
    """Null and repeated ids, equal rows, copies, long and empty texts, columns with names that operators use."""
    import corpus_pipeline

    data, word = synthetic_languages(120, 5)
    long = " ".join(word("aa") for _ in range(20_000))
    mixed = " ".join(word(lang) for lang in ("aa", "bb", "cc") for _ in range(30))
    near_copy = data[3][1] + " " + word("aa")
    rows = [(i, t, lang) for i, t, lang in data] + [(500, data[0][1], "aa"), (500, data[1][1], "bb"), (500, data[1][1], "bb"), (None, data[2][1], "cc"), (None, mixed, None), (None, mixed, None), (600, long, "aa"), (601, None, None), (602, "12 34", None), (603, near_copy, data[3][2])]
    df = spark.createDataFrame([(i, t, lang, f"s{k % 2}" if k % 9 else None, k, "key") for k, (i, t, lang) in enumerate(rows)], "doc_id long, text string, lang string, source string, key long, _times string")
    labels(spark, [(1, 1, 0), (2, 0, 0), (None, None, None)]).write.parquet(str(tmp_path / "labels.parquet"))
    step, left = df, {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, step, str(tmp_path))
        assert out.columns == (df.columns if name != "bpe" else [*df.columns, "token_ids"])
        out.write.parquet(str(tmp_path / name))
        step = spark.read.parquet(str(tmp_path / name))
        left[name] = step.collect()
    kept = {r["key"] for r in left["language_id"]}
    assert kept == set(range(len(rows))) - {len(rows) - 3, len(rows) - 2}
    texts_left = [r["text"] for r in left["exact_dedup"]]
    assert len(texts_left) == len(set(texts_left)) == len({r["text"] for r in left["language_id"]})
    highest = {}
    for r in left["language_id"]:
        highest[r["text"]] = max(highest.get(r["text"], -1), -1 if r["doc_id"] is None else r["doc_id"])
    assert all((-1 if r["doc_id"] is None else r["doc_id"]) == highest[r["text"]] for r in left["exact_dedup"])
    words = lambda rs: {(r["doc_id"], r["text"]) for r in rs}
    assert words(left["near_dedup"]) <= words(left["exact_dedup"])
    assert (603, near_copy) not in words(left["near_dedup"]) and (600, long) in words(left["near_dedup"]) and (None, mixed) in words(left["near_dedup"])
    assert words(left["mixing"]) <= words(left["near_dedup"]) and len(left["mixing"]) == len(left["bpe"])
    assert all(len(r["token_ids"]) > 0 for r in left["bpe"])


def test_pages_that_repeat_and_odd_urls(spark):
    """Repeated pages each get a row; null ids, very long urls and columns with names from inside do no harm."""
    deep = "http://h.net/" + "/".join("s" for _ in range(300)) + "/" + "9" * 40
    data = [(1, "http://h.net/a/1", "x", 1), (1, "http://h.net/a/1", "y", 2), (None, "http://h.net/a/2", "z", 3), (2, deep, "w", 4), (3, "x://", "v", 5), (4, "", "u", 6), (5, "http://h.net//", "t", 7)]
    df = spark.createDataFrame(data, "page_id long, url string, host string, t long")
    got = sorted((tuple(r[:5]) for r in url_filter.judge(spark, df, labels(spark, [(1, 0, 0), (1, 1, 0), (1, 1, 0), (1, 1, 0), (None, 0, 0), (2, None, 0)])).collect()), key=repr)
    assert len(got) == len(data) and {r[4] for r in got} == {"allow"}
    assert [r[1:3] for r in got if r[0] == 2] == [("h.net", deep.removeprefix("http://h.net"))] and [r[1:3] for r in got if r[0] in (3, 4)] == [("", ""), ("", "")]


def test_languages_of_repeated_rows(spark):
    data, word = synthetic_languages(90, 8)
    data += [(7, data[7][1], data[7][2]), (None, data[8][1], data[8][2]), (None, None, "aa"), (95, word("aa") + " " + "語" * 4000, None)]
    df = spark.createDataFrame([(*r, "held_out") for r in data], "doc_id long, text string, lang string, score string")
    model = language_id.fit(df)
    got = language_id.predict(spark, df, model).collect()
    assert len(got) == len(data) and len({(r["lang_pred"], r["score"]) for r in got if r["doc_id"] == 7}) == 1
    assert {r["held_out"] for r in got if r["doc_id"] is None} == {False}
    assert language_id.keep_known(spark, df, model).columns == df.columns
    assert language_id.fit(df.where("false")).labels == [] and {r["lang_pred"] for r in language_id.predict(spark, df, language_id.fit(df.where("false"))).collect()} == {"und"}


def test_training_words_come_from_the_whole_text():
    words = [f"w{i}" for i in range(10_000)]
    got = language_id.spread_words(" ".join(words)).split()
    assert len(got) == language_id.TRAIN_WORDS and got[0] == "w0" and got[-1] == "w9999"
    assert max(int(b[1:]) - int(a[1:]) for a, b in zip(got, got[1:])) < 1000
    assert language_id.spread_words("a b") == "a b" and language_id.spread_words(None) == ""


def test_quality_of_repeated_rows_and_labels(spark):
    good, bad = "fine words that read well in every line", "spam % spam % | buy $$$ now !!! | spam"
    data = [(i, f"{good} {i}" if i % 2 else f"{bad} {i}", f"h{i % 3}", None if i % 5 else "p", "e", 1) for i in range(200)]
    data += [data[1], data[1], (None, good, None, None, "e", 1), (400, bad + " x" * 30_000, "h0", "p", "e", 1), (401, None, "h0", "p", "e", 1)]
    df = spark.createDataFrame(data, "doc_id long, text string, host string, path string, evidence string, n int")
    known = [(i, i % 2, None) for i in range(150)] + [(3, 0, 1), (1, 1, 0), (None, 1, 1), (9, None, 1)]
    model = quality.fit(df, labels(spark, known))
    got = quality.classify(spark, df, model).collect()
    assert len(got) == len(data) and len({tuple(r) for r in got if r["doc_id"] == 1}) == 1
    assert np.mean([(r["quality"] >= 0.5) == (r["doc_id"] % 2 == 1) for r in got if r["doc_id"] is not None and r["doc_id"] >= 150 and r["doc_id"] < 200]) > 0.95


def test_shrinkage_of_sites_by_hand(spark):
    """Rates against the same formulas over plain lists, null sites as sites of their own."""
    rng = random.Random(6)
    data = [(f"h{rng.randrange(3)}" if rng.random() < 0.9 else None, f"p{rng.randrange(4)}" if rng.random() < 0.9 else None, rng.random()) for _ in range(300)]
    got = {(r["host"], r["path"]): r for r in quality.shrink(spark.createDataFrame(data, "host string, path string, evidence double")).collect()}

    def strength(mean, spread):
        return min(max(mean * (1 - mean) / max(spread, 1e-9) - 1, quality.LEAST_STRENGTH), quality.MOST_STRENGTH)

    def spread(groups):  # (values, prior) of each group
        total = sum(len(v) for v, _ in groups)
        out = 0.0
        for v, prior in groups:
            rate = sum(v) / len(v)
            within = (sum(x * x for x in v) / len(v) - rate * rate) / len(v)
            out += len(v) * ((rate - prior) ** 2 - within)
        return out / total

    paths, hosts = {}, {}
    for host, path, e in data:
        paths.setdefault((host, path), []).append(e)
        hosts.setdefault(host, []).append(e)
    overall = sum(e for *_, e in data) / len(data)
    k = strength(overall, spread([(v, overall) for v in hosts.values()]))
    host_rate = {h: (sum(v) + k * overall) / (len(v) + k) for h, v in hosts.items()}
    between = spread([(v, host_rate[h]) for (h, _), v in paths.items()])
    assert set(got) == set(paths)
    for (h, p), v in paths.items():
        k = strength(host_rate[h], between)
        r = got[h, p]
        assert r["n"] == len(v) and abs(r["global_rate"] - overall) < 1e-9 and abs(r["host_rate"] - host_rate[h]) < 1e-9
        assert abs(r["path_rate"] - (sum(v) + k * host_rate[h]) / (len(v) + k)) < 1e-9


def test_licenses_of_repeated_rows(spark):
    text = "Released under the MIT License."
    df = spark.createDataFrame([(1, text, "a", 0), (1, text, "a", 0), (None, text, "b", 1), (2, "x " * 100_000 + text, "c", 2)], "doc_id long, text string, license string, start int")
    got = sorted((tuple(r) for r in license_scan.scan(spark, df).collect()), key=repr)
    assert [r[:3] for r in got] == [(1, "MIT", 1.0), (1, "MIT", 1.0), (2, "MIT", 1.0), (None, "MIT", 1.0)]
    assert {r[3] for r in got if r[0] == 2} == {200_000}


def test_targets_of_many_sources(spark):
    """Water-filling over thousands of sources against a plain search for the level."""
    rng = random.Random(10)
    sizes = {f"s{i:05d}": rng.choice([0, 1, rng.randrange(1, 10_000)]) for i in range(3000)} | {None: 77}
    got = {r["source"]: r for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long").repartition(5)).collect()}
    share = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or "")))}
    low, high, total = 0.0, 1e9, 1.5 * sum(sizes.values())
    for _ in range(200):
        level = (low + high) / 2
        low, high = (level, high) if sum(min(2 * n, level * share[s]) for s, n in sizes.items()) < total else (low, level)
    assert len(got) == 3001 and all(got[s]["share"] == share[s] and abs(got[s]["target"] - min(2 * n, low * share[s])) < 1e-6 * (1 + n) for s, n in sizes.items())
