"""URL filter, preferences, search and pipeline."""

import math
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridweft.llm import preferences, topk, url_filter


def test_rules(spark):
    urls = [
        (1, "https://www.Example.com/en/7?x"), (2, "http://a.com/en/1"), (3, "http://acom/en/1"), (4, "http://x.net/de/8"), (5, "http://y.example.net/de/8#t"),
        (6, None), (7, "no scheme"), (8, "http://com"), (9, "http://b.com?x=/en/"), (9, "http://b.com?x=/en/"),
    ]
    pages = spark.createDataFrame([(*u, "h") for u in urls], "page_id long, url string, host string")
    model = url_filter.train(spark.createDataFrame([("http://a-b.com/", 1), ("http://c.com/", 0)], "url string, unwanted int"), trees=2)
    got = {r["page_id"]: r for r in url_filter.judge(pages, url_filter.RULES, model).collect()}
    assert [got[i]["rule"] for i in range(1, 10)] == ["example.com/en/7", "com/en/", None, "net/de/", "example.net/de/8", None, None, None, None]
    assert [got[i]["verdict"] for i in (1, 2, 4, 5)] == ["allow", "block", "allow", "block"]
    assert (got[1]["host"], got[1]["path"]) == ("www.example.com", "/en/7") and (got[7]["host"], got[7]["path"]) == ("", "")
    assert url_filter.judge(pages.where("false"), url_filter.RULES, model).count() == 0


def test_judge_against_brute_force(spark):
    """Hosts, paths, rules, features and the trees' scores of random urls, one by one."""
    rng = np.random.default_rng(17)
    hosts = ["Example.com", "a.example.com", "b-c.net", "x.example.net", "org", "m.y.org", "com", "", "spam-1.com", "É.com:80"]
    paths = ["", "/", "/en/7", "/en/8?a=1&b=2", "/de/8#x", "/de/9?q=/en/", "?x=1", "/es/a/b/c", "#f"]
    urls = [f"http://{h}{p}" for h in hosts for p in paths] + [None, "", "no scheme", "a://b://c/en/7", "//com/en/"]
    labelled = spark.createDataFrame([(u, int(rng.random() < (0.8 if u and "-" in u else 0.2))) for u in urls if u], "url string, unwanted int")
    model = url_filter.train(labelled, trees=3)
    assert model.trees and any(t.splits for t in model.trees)
    stats = {r["suffix"]: (r["suffix_rate"], r["suffix_count"]) for r in model.suffixes.collect()}
    got = url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), url_filter.RULES, model).collect()
    assert len(got) == len(urls)
    for r in got:
        url = urls[r["page_id"]]
        host = path = ""
        if url and "://" in url:
            after = url.split("://", 1)[1]
            host = re.match("[^/?#]*", after)[0]
            path = re.match("[^?#]*", after[len(host) :])[0]
            host = re.sub("[A-Z]", lambda m: m[0].lower(), host)
        fits = [x for x in url_filter.RULES if (host == x.host or host.endswith("." + x.host)) and path.startswith(x.path)]
        rule = max(fits, key=lambda x: len(x.text), default=None)
        url = url or ""
        query = re.search(r"\?([^#]*)", url)
        rate, count = stats.get(".".join(host.split(".")[-2:]), (0.5, 0.0))
        entropy = -sum(host.count(c) / len(host) * math.log2(host.count(c) / len(host)) for c in set(host))
        values = (len(url), len(host), len(path), len(re.findall("/[^/]+", path)), len(re.findall("[^.]+", host)), len(re.findall("[0-9]", url)) / max(len(url), 1), entropy, len(re.findall("[^&]+", query[1])) if query else 0, host.count("-"), rate, count)
        value, score = dict(zip(url_filter.FEATURES, values, strict=True)), model.base
        for tree in model.trees:
            node = 1
            while node in tree.splits:
                name, cut = tree.splits[node]
                node = 2 * node + (value[name] > cut)
            score += tree.leaves.get(node, 0.0)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule.text if rule else None)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-score)))
        assert r["verdict"] == (rule.verdict if rule else "block" if r["score"] >= 0.5 else "allow")


def test_trees_held_out(spark):
    rng = np.random.default_rng(1)
    rows = []
    for i in range(600):
        bad = i % 3 == 0
        host = f"{'x-' if bad and rng.random() < 0.9 else ''}site{rng.integers(0, 50)}.{'zz' if bad else 'org'}"
        rows.append((f"http://{host}/p{i}" + ("?a=1&b=2&c=3" if bad else ""), int(bad)))
    labelled = spark.createDataFrame(rows, "url string, unwanted int")
    train = labelled.where(F.pmod(F.xxhash64("url"), F.lit(2)) == 0)
    model = url_filter.train(train, trees=4)
    test = labelled.withColumn("page_id", F.monotonically_increasing_id()).where(F.pmod(F.xxhash64("url"), F.lit(2)) == 1)
    found = url_filter.judge(test, (), model).join(test.select("page_id", "unwanted"), "page_id").collect()
    assert np.mean([(r["verdict"] == "block") == bool(r["unwanted"]) for r in found]) > 0.95
    nothing = url_filter.train(labelled.where("false"))
    assert nothing.trees == []


def test_suffix_statistics_cover_all(spark):
    """Trees are fitted on a sample, suffixes are counted over all labelled urls."""
    rows = [(f"http://h{k}.s{i}.org/p", int(i % 2 == 0)) for i in range(40) for k in range(3)]
    labelled = spark.createDataFrame(rows, "url string, unwanted int")
    model = url_filter.train(labelled, sample=10, trees=1)
    assert {(r["suffix"], r["suffix_rate"], r["suffix_count"]) for r in model.suffixes.collect()} == {(f"s{i}.org", (8 if i % 2 == 0 else 5) / 13, 3.0) for i in range(40)}
    host, path = url_filter.host_path(F.col("url"))
    assert url_filter.with_features(labelled.withColumns({"host": host, "path": path}), model.suffixes).where("suffix_count = 3").count() == 120


def test_preferences(spark):
    turns = [
        (0, 0, "user", "hi"), (0, 1, "assistant", "a <| b"), (0, 1, "assistant", "a <| b"), (1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, None, None),
        (4, 0, "user", "alone"), (6, 0, "user", "same"), (7, 0, "user", "same"), (None, 0, "user", "x"),
    ]
    df = spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, a int")
    got = {r["pair_id"]: r for r in preferences.format_pairs(df, F.shiftright("conv_id", 1), F.col("conv_id").bitwiseAND(1) == 0).collect()}
    one = got[0]
    assert one["prompt"] == "<|user|>\nhi\n" and one["n_common"] == 1
    assert one["chosen"] == "<|assistant|>\na < | b\n" and one["rejected"] == "<|assistant|>\nno\n<|unknown|>\n\n"
    assert [one["chosen"][b:e] for b, e in one["chosen_spans"]] == ["a < | b\n"] and [one["rejected"][b:e] for b, e in one["rejected_spans"]] == ["no\n"]
    assert got[2]["rejected"] is None and got[2]["prompt"] == "" and got[3]["chosen"] == got[3]["rejected"] == ""
    assert set(got) == {0, 2, 3}
    assert preferences.format_pairs(df.where("false"), F.col("conv_id"), F.lit(True)).count() == 0


def brute_pair(own, other):
    """Chosen and rejected turns of one conversation: sorted (turn, role, text), null first."""
    order = lambda rows: sorted(rows, key=lambda t: [(x is not None, x) for x in t])
    own, other = order(set(own)), order(set(other))
    last, swap = (next((t for t in reversed(c) if t[1] == "assistant"), None) for c in (own, other))
    if last is None or swap is None:
        return own, own
    return own, order({*own[: own.index(last)], (last[0], "assistant", swap[2])})


def test_answer_swaps(spark):
    """Random conversations, which share their turns up to the last answer, against brute force."""
    rng = np.random.default_rng(9)
    texts, roles = [None, "", "a", "b", "<| c", "Ünï"], ["user", "assistant", "system", None]
    convs = {i: [(int(k) if k < 5 else None, roles[rng.integers(0, 4)], texts[rng.integers(0, 6)]) for k in rng.integers(0, 7, rng.integers(0, 8))] for i in range(60)}
    df = spark.createDataFrame([(i, *t, "x") for i, c in convs.items() for t in c] + [(None, 1, "assistant", "q", "x")], "conv_id long, turn long, role string, text string, side string")
    pairs = preferences.answer_swaps(df)
    got = {r["pair_id"]: r for r in preferences.format_pairs(pairs, F.col("pair_id"), F.col("is_chosen")).collect()}
    shown = lambda t: f"<|{t[1] or 'unknown'}|>\n{(t[2] or '').replace('<|', '< |')}\n"
    assert set(got) == {i for i, c in convs.items() if c}
    for i, r in got.items():
        a, b = brute_pair(convs[i], convs.get(i ^ 1, []))
        n = next((k for k, (x, y) in enumerate(zip(a, b, strict=False)) if x[1:] != y[1:]), min(len(a), len(b)))
        assert (r["n_common"], r["prompt"]) == (n, "".join(map(shown, a[:n])))
        for side, turns in (("chosen", a), ("rejected", b)):
            assert r[side] == "".join(map(shown, turns[n:]))
            assert [r[side][s:e] for s, e in r[f"{side}_spans"]] == [shown(t).split("|>\n", 1)[1] for t in turns[n:] if t[1] == "assistant"]
    assert preferences.answer_swaps(df.where("false")).count() == 0


def test_swaps_share_turns(spark):
    df = spark.createDataFrame([(i, k, "assistant" if k % 2 else "user", f"{i}:{k}") for i in range(6) for k in range(4)], "conv_id long, turn long, role string, text string")
    rows = preferences.format_pairs(preferences.answer_swaps(df), F.col("pair_id"), F.col("is_chosen")).collect()
    assert [r["n_common"] for r in rows] == [3] * 6
    assert {r["pair_id"]: r["rejected"] for r in rows} == {i: f"<|assistant|>\n{i ^ 1}:3\n" for i in range(6)}


@pytest.mark.parametrize("block", [4, 256])
def test_topk(spark, monkeypatch, block):
    monkeypatch.setattr(topk, "BLOCK", block)
    monkeypatch.setattr(topk, "GROUP", 50)
    monkeypatch.setattr(topk, "QUERIES", 3)
    rng = np.random.default_rng(2)
    vectors = {i: np.round(rng.normal(size=5), 1).tolist() for i in range(120)}
    rows = [(i, v, 1) for i, v in vectors.items()] + [(200, None, 1), (201, [1.0, None], 1), (202, [float("nan")], 1), (203, [], 1), (None, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score int")
    got = {}
    for r in topk.top_k(df, df.where("vec_id % 10 = 0"), k=3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
    whole = {i: np.floor(256 * np.array(v, np.float32).astype(float)).astype(int) for i, v in vectors.items()} | {203: np.zeros(5, int)}
    for q in range(0, 120, 10):
        best = sorted((-int(whole[q] @ v), i) for i, v in whole.items() if i != q)[:3]
        assert sorted(got[q]) == [(k, i, -s) for k, (s, i) in enumerate(best, 1)]
    assert topk.top_k(df.where("false"), df.where("false")).count() == 0


def test_topk_prunes():
    """Where one block is far ahead, the others are left."""
    vectors = np.zeros((1024, 4), np.int64)
    vectors[:256] = 100
    _, ids, visits = topk.search(np.ones((1, 4), np.int64), np.array([-5]), vectors, np.arange(1024), 3)
    assert ids.tolist() == [[0, 1, 2]] and visits == 1


def test_topk_large_components(spark):
    """Beyond 2**53 scores stay whole numbers; what 64 bits can't hold is an error."""
    rows = [(1, [2.0**40, 3.0]), (2, [2.0**5 + 1, -1.0]), (3, [2.0**5, 1.0 + 2.0**-8])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = [(r["vec_id"], r["score"]) for r in topk.top_k(df, df.where("vec_id = 1"), k=2).orderBy("rank").collect()]
    assert got == [(2, 2**48 * 33 * 256 - 3 * 2**16), (3, 2**48 * 2**13 + 768 * 257)]
    for large in ([2.0**53, 1.0], [2.0**40, 1.0]):
        more = df.unionByName(spark.createDataFrame([(4, large), (6, large)], df.schema))
        with pytest.raises(Exception, match="64-bit|64 bits"):
            topk.top_k(more, more.where("vec_id = 4")).collect()


def test_topk_visits_few_blocks_of_clusters():
    """Vectors near one of 32 centres, dealt at random: in blocks by direction most are never scored."""
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(32, 64))
    vectors = np.floor(256 * (centres[rng.integers(0, 32, 16384)] + 0.1 * rng.normal(size=(16384, 64)))).astype(np.int64)
    ids = np.arange(16384)
    order = topk.in_blocks(vectors, ids)
    top, who, visits = topk.search(vectors[:200], ids[:200], vectors[order], ids[order], 5)
    scores = np.where(np.eye(16384, dtype=bool)[:200], -(2**62), vectors[:200] @ vectors.T)
    assert (top == -np.sort(-scores, axis=1)[:, :5]).all()
    assert visits < 0.25 * 200 * 64


CLASHES = ["_id", "_digest", "_copies", "_nth", "selected", "expected_grade", "id", "mark", "digest", "copies", "nth", "text_hash", "taken", "c0", "c1", "size", "range", "key", "class", "cluster", "keep_id", "kept"]


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    """Every stage returns what users have in columns that the operators might use, and runs on an empty table."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rows = [(1, "one two three four five six"), (2, None), (3, ""), (4, " \t\n "), (5, "one two three four five six"), (5, "one two three four five six"), (6, "word " * 3000), (None, "nameless row"), (7, "Ünï cödé")]
    docs = spark.createDataFrame([(i, t, None if i is None else "ab"[i % 2], *[f"{c}{i}" for c in CLASHES]) for i, t in rows], "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in CLASHES))
    spark.createDataFrame([(1, 1, 0), (7, 1, 0), (2, None, None), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    given = {(r["doc_id"], r["text"]): tuple(r) for r in docs.collect()}
    counts = []
    for _, stage in pipeline.STAGES[:4]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        found = out.collect()
        assert all(tuple(r) == given[(r["doc_id"], r["text"])] for r in found)
        counts.append(sorted(str(r["doc_id"]) for r in found))
        assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0
    assert counts[0] == sorted(str(i) for i, _ in rows) and counts[1] == sorted(["3", "4", "5", "6", "7", "None"])
    assert counts[2] == sorted(["1", "2", "3", "4", "6", "7", "None"]) and "2" not in counts[3]
    _, stage = pipeline.STAGES[4]
    assert stage(spark, docs, str(tmp_path)).select("doc_id").distinct().count() == 8
    assert stage(spark, docs.where("false"), str(tmp_path)).count() == 0


def test_pipeline(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(3)
    rows, labels = [], []
    for i in range(240):
        text = [f"w{x}" for x in rng.integers(0, 500, 40)]
        if i % 4 == 0:
            text = [x + "%%%" for x in text]
        rows.append((i, " ".join(text), "en", f"s{i % 3}", 1))
        labels.append((i, 0 if i % 4 == 0 else 1, 0))
    rows += [(300, rows[1][1], "en", "s0", 1), (301, rows[2][1] + " tail", "en", "s1", 1), (302, None, None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    columns, seen = docs.columns, []
    for name, stage in pipeline.STAGES[:4]:
        docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), docs.schema)
        assert docs.columns == columns
        seen.append([r["doc_id"] for r in docs.select("doc_id").collect()])
    good, unique, far, mixed = seen
    assert not {i for i in good if i < 240 and i % 4 == 0} and len([i for i in good if i < 240]) >= 175
    assert 1 not in unique and 300 in unique and len(unique) == len(set(unique))
    assert 301 not in far and 2 in far
    assert max(mixed.count(i) for i in set(mixed)) <= 2 and set(mixed) <= set(far)
    packed = pipeline.STAGES[4][1](spark, docs, str(tmp_path))
    assert packed.select("doc_id").distinct().count() == len(set(mixed))


def test_pipeline_texts_without_ids(spark, tmp_path):
    """A near copy among texts without ids goes alone, and each is copied as often as the mix takes it."""
    pipeline = pytest.importorskip("corpus_pipeline")
    rng = np.random.default_rng(4)
    text = [" ".join(f"w{x}" for x in rng.integers(0, 4000, 60 + i)) for i in range(12)]
    rows = [(1, text[0], "a")] + [(None, t, "a") for t in text[1:]] + [(None, text[0] + " tail", "a"), (None, text[5] + " tail", "a"), (4, "", "b"), (4, text[2] + " end", "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(1, 1)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    left = pipeline.drop_near_copies(spark, docs, str(tmp_path))
    got = sorted(r["text"] for r in left.collect())
    assert len(got) == 13 and sum(t.startswith(text[5]) for t in got) == 1
    assert set(got) >= {"", text[0], text[2] + " end", *text[1:2], *text[3:5], *text[6:]}
    ready = spark.createDataFrame([(None, t, f"s{i % 2}") for i, t in enumerate(text)], "doc_id long, text string, source string")
    from gridweft.llm import mixing

    taken = mixing.mix(ready).agg(F.sum("taken")).first()[0]
    mixed = pipeline.mix_sources(spark, ready, str(tmp_path))
    assert mixed.select(F.sum(mixing.word_count(F.col("text")))).first()[0] == taken
