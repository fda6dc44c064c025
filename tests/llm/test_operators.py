"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and clashing columns, against brute force."""

import hashlib
import re
import subprocess
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from tidelog.llm import decontaminate, language, lm, neardup, neighbours, packing, pii, sstable, tokens, toxicity, urls
from tidelog.llm.common import bounded_sample, scratch_dir, tokenizer_path
from tidelog.llm.components import connected_components

SCHEMA = "doc_id long, text string, lang string, score double, node string"
WORDS = [f"w{i}" for i in range(400)]


def prose(seed, n):
    return " ".join(np.random.default_rng(seed).choice(WORDS, n))


LONG = prose(1, 9000)
ROWS = [(1, LONG), (2, LONG), (3, LONG + " end"), (4, None), (5, ""), (6, "a b"), (6, "a b"), (None, prose(2, 60)), (7, prose(3, 80)), (8, prose(3, 80) + " x"), (9, "¿¡… 42"), (10, "the <|endoftext|> don't İstanbul café café")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, "en" if k % 2 else "fr", 0.5, "x") for k, (i, t) in enumerate(ROWS)], SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_neardup(docs, empty):
    got = {(r["doc_id"], r["class_id"]) for r in neardup.near_duplicates(docs).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5), (6, 6), (None, None), (7, 7), (8, 7), (9, 9), (10, 10)}
    assert neardup.near_duplicates(docs).count() == len(ROWS)
    assert sorted(r["doc_id"] or 0 for r in neardup.keep_one(docs).collect()) == [0, 1, 4, 5, 6, 7, 9, 10]
    assert neardup.near_duplicates(empty).count() == 0 and neardup.keep_one(empty).count() == 0


def test_keep_one_keeps_rows_not_ids(spark):
    """A repeated id takes no other text with it; rows without an id, and repeated rows, keep one of each text; columns may have any names."""
    rows = [(1, "s"), (5, "s"), (5, "u"), (7, "r"), (7, "r"), (None, "s"), (None, "v"), (None, "v"), (8, None), (8, "")]
    texts = {k: prose(60 + i, 40) for i, k in enumerate("suvr")}
    docs = spark.createDataFrame([(i, texts.get(t, t), k, t) for k, (i, t) in enumerate(rows)], "doc_id long, text string, rid int, __salt string")
    got = neardup.keep_one(docs)
    assert got.columns == docs.columns
    kept = sorted((r["__salt"] or "", r["doc_id"] or 0) for r in got.collect())
    assert kept == [("", 8), ("", 8), ("r", 7), ("s", 1), ("u", 5), ("v", 0)]


def shuffled_since(spark, stage):
    """(the last stage's number, bytes of shuffle written by the stages after ``stage``), of those that Spark still lists."""
    jvm = spark.sparkContext._jvm
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    nothing = jvm.java.util.ArrayList()
    stages = spark.sparkContext._jsc.sc().statusStore().stageList(nothing, False, False, spark.sparkContext._gateway.new_array(jvm.double, 0), nothing)
    seen = [(stages.apply(i).stageId(), stages.apply(i).shuffleWriteBytes()) for i in range(stages.size())]
    return max([stage, *(n for n, _ in seen)]), sum(b for n, b in seen if n > stage)


def test_keep_one_shuffles_no_text_that_stays(spark):
    """Texts without copies are not shuffled, when no table is small enough to broadcast either."""
    rng = np.random.default_rng(61)
    texts = [" ".join(rng.bytes(100).hex() for _ in range(100)) for _ in range(300)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts[:5]])], "doc_id long, text string").repartition(4).cache()
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        docs.count()
        before, _ = shuffled_since(spark, -1)
        assert sorted(r["doc_id"] for r in neardup.keep_one(docs).select("doc_id", F.length("text")).collect()) == list(range(300))
        assert 0 < shuffled_since(spark, before)[1] < sum(map(len, texts)) / 4
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
        docs.unpersist()


@pytest.mark.parametrize("bits", [64, 128])
def test_keep_one_does_not_depend_on_its_bitmap(spark, monkeypatch, bits):
    """With a bitmap so small that rows share its bits, only the join by doc_id and text decides: null ids and texts, repeated rows, copies."""
    monkeypatch.setattr(neardup, "MATE_BITS", bits)
    texts = [prose(200 + i, 40) for i in range(120)]
    rows = [*enumerate(texts), *[(1000 + i, t) for i, t in enumerate(texts[:40])], *[(i, texts[i]) for i in range(50, 70)], *[(None, t) for t in texts[30:45]], *[(None, "alone " + prose(400, 40))] * 3, (7, "other " + prose(401, 40)), (8, None), (8, None), (9, "")]
    got = neardup.keep_one(spark.createDataFrame(rows, "doc_id long, text string"))
    want = [*enumerate(texts), (None, rows[-5][1]), (7, rows[-4][1]), (8, None), (8, None), (9, "")]
    assert sorted(map(repr, ((r["doc_id"], r["text"]) for r in got.collect()))) == sorted(map(repr, want))


def test_icws_estimates_weighted_jaccard():
    a, b = neardup.shingles(prose(5, 400).encode()), neardup.shingles((prose(5, 360) + " " + prose(6, 40)).encode())
    idf = np.full(neardup.CELLS, 1.5, dtype=np.float32)
    sim = neardup.weighted_jaccard(a, b, idf)
    same = (neardup.icws(a[0], a[1] * 1.5) == neardup.icws(b[0], b[1] * 1.5)).mean()
    assert abs(sim - same) < 0.25


def test_prefix_filter_loses_no_similar_pair(spark):
    """A family around one text, whose members are near the threshold to each other, against all pairs."""
    rng, base, texts = np.random.default_rng(11), prose(12, 120).split(), []
    for i in range(90):
        ws = list(base)
        for p in rng.choice(len(ws), i % 6, replace=False):
            ws[p] = f"v{rng.integers(8)}"
        texts.append(" ".join(ws))
    texts = sorted(set(texts))
    idf = np.full(neardup.CELLS, neardup.IDF_TOP, dtype=np.float32)
    sh = [neardup.shingles(t.encode()) for t in texts]
    root = [f"n{i - i % 3:03d}" for i in range(len(texts))]
    want = {(i, j) for i in range(len(texts)) for j in range(i) if root[i] != root[j] and neardup.weighted_jaccard(sh[i], sh[j], idf) >= 0.8}
    nodes = spark.createDataFrame([(f"n{i:03d}", t) for i, t in enumerate(texts)], "node string, text string")
    classes = spark.createDataFrame([(f"n{i:03d}", r) for i, r in enumerate(root)], "node string, root string")
    got = [(int(r[0][1:]), int(r[1][1:])) for r in neardup._possible(nodes, classes, idf, 0.8).collect()]
    assert want and want <= set(got) and len(got) == len(set(got)) and all(root[i] != root[j] for i, j in got)
    assert neardup._possible(nodes.limit(0), classes, idf, 0.8).count() == 0


def test_components(spark):
    edges = [(i, i + 1) for i in range(20)] + [(30, 31), (31, 32), (40, 40)]
    got = {r["node"]: r["root"] for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(21)} | {30: 30, 31: 30, 32: 30}


def test_urls(spark):
    rows = [(1, "http://A.Example.net/en/1?x"), (2, "http://a.example.net/de/1"), (3, None), (4, "nonsense"), (5, "https://x.org/fr/9#t"), (6, "http://example.com/de/"), (6, "http://example.com/de/"), (7, "http://b.io")]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string")).collect()}
    assert got[1] == ("a.example.net", "/en/1", "example.net/en/", "allow") and got[2][2:] == ("net/", "block")
    assert got[3] == got[4] == ("", "", None, "allow") and got[5][2:] == ("org/fr/", "allow") and got[6][2:] == ("example.com/de/", "block") and got[7][:3] == ("b.io", "", None)


def test_urls_bad_section_among_many(spark):
    """Twelve word sections, one wholly bad: it is blocked by itself; sections with few labels share the wildcard."""
    pages = [(f"http://h.io/{'abcdefghijkl'[k]}/{i}", k, i) for k in range(12) for i in range(60)]
    rows = [(j, url) for j, (url, _, _) in enumerate(pages)]
    good = [("h.io", url[11:], 1, int(k != 3)) for url, k, i in pages if k < 10 or i < 2]
    judged = urls.judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(good, "host string, path string, n_labelled long, n_good long"))
    got = {(r["path"].split("/")[1], r["template"].split("/")[1], r["verdict"]) for r in judged.collect()}
    assert ("d", "d", "block") in got and ("l", "{word}", "allow") in got
    assert {s for s, _, v in got if v == "block"} == {"d"}


def test_urls_trees_match_a_plain_form(spark):
    """Templates and purity of a small crawl, deep paths among them, against a recursive form."""
    rng = np.random.default_rng(15)
    pages = sorted({f"/{'abc'[rng.integers(3)]}/{'xyzuvwstr'[rng.integers(9)]}" + "".join(f"/{rng.integers(3)}" for _ in range(int(rng.integers(0, 12)))) for _ in range(1200)})
    share = {s: rng.choice([0.05, 0.9, 0.9]) for s in "xyzuvwstr"}
    good = {p: (int(rng.integers(1, 6)), 0) for p in pages if rng.random() < 0.9}
    good = {p: (n, int(rng.binomial(n, share[p.split("/")[2]]))) for p, (n, _) in good.items()}

    def walk(paths, depth, so_far, out):
        sets = {}
        for p in paths:
            segs = p.split("/")[1:]
            if len(segs) <= depth:
                out[p] = so_far
            else:
                shape = "number" if segs[depth].isdigit() else "word"
                sets.setdefault(shape, {}).setdefault(segs[depth], []).append(p)
        for shape, children in sets.items():
            told = {s: (sum(good.get(p, (0, 0))[0] for p in ps), sum(good.get(p, (0, 0))[1] for p in ps)) for s, ps in children.items()}
            told = {s: x for s, x in told.items() if x[0] >= urls.MIN_LABELLED}
            shares = sorted(g / n for n, g in told.values())
            below = {}
            for s, ps in children.items():
                literal = len(children) == 1
                if s in told and not literal:
                    (n, g), mid = told[s], shares[(len(shares) - 1) // 2]
                    p0 = (mid * n + 0.5) / (n + 1)
                    literal = (g - n * p0) ** 2 / (n * p0 * (1 - p0)) > 2 * np.log(20 * len(told))
                below.setdefault(f"{so_far}/{s}" if literal else f"{so_far}/{{{shape}}}", []).extend(ps)
            for t, ps in below.items():
                walk(ps, depth + 1, t, out)
        return out

    want = walk(pages, 0, "", {})
    labels = spark.createDataFrame([("h.io", p, n, g) for p, (n, g) in good.items()], "host string, path string, n_labelled long, n_good long")
    judged = urls.judge_urls(spark.createDataFrame([(i, "http://h.io" + p) for i, p in enumerate(pages)], "page_id long, url string"), labels).collect()
    assert {r["path"]: r["template"] for r in judged} == want and len({t for t in want.values()}) > 5
    total = [sum(x) for x in zip(*good.values(), strict=True)]
    overall, per = total[1] / total[0], {}
    for p, t in want.items():
        n, g = per.get(t, (0, 0))
        per[t] = (n + good.get(p, (0, 0))[0], g + good.get(p, (0, 0))[1])
    assert all(abs(r["purity"] - (per[r["template"]][1] + 10 * overall) / (per[r["template"]][0] + 10)) < 1e-9 for r in judged)
    assert {r["verdict"] for r in judged} == {"allow", "block"}


def test_urls_edge_cases(spark):
    one = spark.createDataFrame([(1, "http://a.b/c/1", "x", "y", 2.0)], "page_id long, url string, html string, __wild string, purity_ double")
    got = urls.judge_urls(one)
    assert got.count() == 1 and set(one.columns) <= set(got.columns) and urls.judge_urls(one.limit(0)).count() == 0


@pytest.mark.parametrize("best", [9, 3])
def test_urls_method_blocks_by_the_overall_share(spark, best):
    """Eleven bad pages block their template, whether good ones are many (share 0.85) or few (0.28), and no unlabelled one is blocked."""
    pages = [(f"http://g.io/x/{i}", int(i % 10 < best)) for i in range(200)] + [(f"http://b.io/y/{i}", 0) for i in range(11)] + [("http://u.io/z", None)]
    good = [(u[7:11], u[11:], 1, y) for u, y in pages if y is not None]
    judged = urls.judge_urls(spark.createDataFrame([(j, u) for j, (u, _) in enumerate(pages)], "page_id long, url string"), spark.createDataFrame(good, "host string, path string, n_labelled long, n_good long"))
    assert {(r["host"], r["verdict"]) for r in judged.collect()} == {("g.io", "allow"), ("b.io", "block"), ("u.io", "allow")}


def test_tokens_are_the_tokenizers(docs):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokenizer_path())
    enc = tokens.WordEncoder(tokenizer_path())
    for _, text in ROWS:
        want = t.encode(text or "", add_special_tokens=False).ids + [1]
        assert np.frombuffer(enc.encode([None if text is None else text.encode()], 1)[0], "<u4").tolist() == want


def test_shards(spark, docs, empty):
    out = f"{scratch_dir(spark)}/test-sst"
    manifest = sstable.write_shards(docs, out, tokenizer_path()).toPandas()
    system, _ = sstable.filesystem(out)
    got = []
    for path in manifest.sort_values("first_key")["path"]:
        with system.open_input_file(path) as f:
            reader = sstable.ShardReader(f)
            got += [sstable.id_of(k) for k, _ in reader]
            for k, ids in list(reader)[:3]:
                assert reader.get(k) is not None and len(ids)
            assert reader.get(sstable.key_of(12345)) is None
    assert got == [None, 1, 2, 3, 4, 5, 6, 6, 7, 8, 9, 10]
    assert sstable.write_shards(empty, out + "-none", tokenizer_path()).count() == 0


def test_packing(docs, empty):
    seqs = {}
    for r in packing.pack_documents(docs, limit=512).collect():
        seqs.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in seqs.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 512
    assert packing.pack_documents(empty).count() == 0
    rng = np.random.default_rng(0)
    histogram = dict(zip(*[x.tolist() for x in np.unique(rng.integers(1, 4097, 5000), return_counts=True)], strict=True))
    runs = packing.plan(histogram)
    placed = {}
    for m, lengths in runs:
        assert sum(lengths) <= 4096
        for x in lengths:
            placed[x] = placed.get(x, 0) + m
    assert placed == histogram
    assert sum(m for m, _ in runs) <= 1.02 * -(-sum(x * n for x, n in histogram.items()) // 4096)


def test_packing_keeps_any_columns_and_repeated_rows(spark):
    rows = [(i if i % 5 else None, 0, 0, 1 + i % 7, i, "b", "n", "x") for i in range(60)] * 2
    pieces = spark.createDataFrame(rows, "doc_id long, piece int, start long, length long, `__b` long, `__n` string, `__rank` string, `l.x` string")
    got = packing.pack(pieces, limit=10).toPandas()
    assert list(got.columns) == [*pieces.columns, "sequence_id", "offset"]
    assert sorted(got["__b"]) == sorted(r[4] for r in rows) and (got["length"] == 1 + got["__b"] % 7).all() and (got["l.x"] == "x").all()
    for _, places in got.sort_values("offset").groupby("sequence_id"):
        assert list(places["offset"]) == [0, *places["length"].cumsum()[:-1]] and places["length"].sum() <= 10


def test_language(spark, docs, empty):
    learn = spark.createDataFrame([(("the house and the garden " if k % 2 else "la maison et le jardin ") * 3 + str(k), "en" if k % 2 else "fr") for k in range(40)], "text string, lang string")
    model = language.train(learn)
    got = {r["doc_id"]: r["lang_pred"] for r in language.identify(docs, model, ["doc_id"]).collect()}
    assert got[4] == got[5] == got[9] == "und"
    probe = spark.createDataFrame([(1, "the garden and house"), (2, "le jardin et la maison")], "doc_id long, text string")
    assert [r["lang_pred"] for r in language.identify(probe, model).orderBy("doc_id").collect()] == ["en", "fr"]
    assert language.train(empty) is None and {r["lang_pred"] for r in language.identify(docs, None, ["doc_id"]).collect()} == {"und"}


def test_rare_language_is_fitted(spark):
    """Two languages with many rows and one with few: the few are fitted, too."""
    base = ["the house and the garden", "la maison et le jardin", "the hoose an the gairden"]
    rows = [(f"{base[k]} {i}", k) for k, n in enumerate((20000, 20000, 20)) for i in range(n)]
    model = language.train(spark.createDataFrame([(t, "abc"[k]) for t, k in rows], "text string, lang string"))
    probe = spark.createDataFrame([(i, f"the gairden {i} an hoose") for i in range(50)], "doc_id long, text string")
    assert {r["lang_pred"] for r in language.identify(probe, model).collect()} == {"c"}


def test_language_sample_is_balanced(spark):
    """Many well-filled languages leave room for a rare one; copies do not thin out a language's other texts."""
    rows = [(f"{k} text {i}", f"l{k:02d}") for k in range(12) for i in range(3000)] + [(f"rare text {i}", "rare") for i in range(3)]
    assert "rare" in language.train(spark.createDataFrame(rows, "text string, lang string")).languages
    copies = spark.createDataFrame([("same", "a")] * 2900 + [(f"other {i}", "a") for i in range(100)], "text string, lang string")
    assert bounded_sample(copies, "lang", 400).count() == 101


def test_toxicity(spark, empty):
    rows = [(i, prose(i, 30) + (" scum idiot" if i % 4 == 0 else "")) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(100)] + [(None, 1), (7, None)], "doc_id long, toxic int")
    docs = spark.createDataFrame(rows + [(900, None), (901, "")], "doc_id long, text string")
    model = toxicity.train(docs, labels)
    got = {r["doc_id"]: r["predicted"] for r in toxicity.score(docs, model, ["doc_id"]).collect()}
    assert all(got[i] == int(i % 4 == 0) for i in range(200)) and got[900] == got[901] == 0
    assert toxicity.train(empty, labels) is None and toxicity.score(empty, None, ["doc_id"]).count() == 0


def test_toxicity_weighs_every_telling_word_by_all_documents(spark):
    """More than 256 telling words, and one that is frequent in texts without a label."""
    rows = [(i, prose(i, 20) + "".join(f" bad{(i + 10 * j) % 300}" for j in range(30) if i < 200)) for i in range(400)]
    rows += [(i, "bad0 bad0") for i in range(1000, 1600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    model = toxicity.train(docs, spark.createDataFrame([(i, int(i < 200)) for i in range(400)], "doc_id long, toxic int"))
    assert {f"bad{i}".encode() for i in range(300)} <= set(model.at)
    df = sum("bad0" in t.split() for _, t in rows)
    assert abs(model.idf[model.at[b"bad0"]] - (np.log((len(rows) + 1) / (df + 1)) + 1)) < 1e-9


def test_block_max_index_is_exact():
    rng = np.random.default_rng(3)
    x = rng.random((500, 20)) * (rng.random((500, 20)) < 0.15)
    index = toxicity.BlockMaxIndex(x, np.arange(500), np.zeros(500, dtype=int), 16)
    for _ in range(30):
        terms = np.sort(rng.choice(20, 4, replace=False))
        w = rng.random(4)
        pos, cos = index.search(terms, w, 7)
        full = x[:, terms] @ w
        want = [i for i in np.lexsort((np.arange(500), -full)) if full[i] > 0][:7]
        assert np.allclose(cos, full[want]) and index.ids[pos].tolist() == want


def test_neighbours(spark):
    rng = np.random.default_rng(2)
    rows = [(i, rng.standard_normal(8).tolist()) for i in range(600)] + [(i, [1.0] * 8) for i in range(600, 700)]
    rows += [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [1.0, None] + [1.0] * 6), (None, [1.0] * 8)]
    v = neighbours.valid_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), "vec_id", "embedding")
    x, hit = np.array([r[1] for r in rows[:700]]), 0
    got = neighbours.nearest(v, v.where("id % 50 = 0")).toPandas()
    assert len(got) == 14 * 10
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(700), d))[:10]) & set(g["vec_id"]))
    assert hit >= 0.9 * 140 and got[got["query_id"] == 650].sort_values("rank")["vec_id"].tolist() == list(range(600, 610))
    assert neighbours.nearest(v.where("id < 0"), v.where("id < 0")).count() == 0


def test_distances_are_exact_with_ties_and_far_from_the_origin():
    rng = np.random.default_rng(13)
    for p in (rng.integers(0, 2, (400, 12)).astype(float), rng.standard_normal((400, 6)) + 1e7, np.ones((30, 4))):
        q, ids = p[:20], rng.permutation(len(p))
        pos, d = neighbours.distances(q, p, 9, ids)
        for i in range(len(q)):
            full = np.sqrt(((p - q[i]) ** 2).sum(1))
            want = np.lexsort((ids, full))[:9]
            assert pos[i].tolist() == want.tolist() and np.array_equal(d[i], full[want])


def test_neighbours_far_from_the_origin(spark):
    rng = np.random.default_rng(14)
    x = rng.standard_normal((900, 8)) + 1e7
    v = neighbours.valid_vectors(spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>"), "vec_id", "embedding")
    got, hit = neighbours.nearest(v, v.where("id % 50 = 0")).toPandas(), 0
    for q, g in got.groupby("query_id"):
        d = np.sqrt(((x - x[q]) ** 2).sum(1))
        d[q] = np.inf
        hit += len(set(np.lexsort((np.arange(900), d))[:10]) & set(g["vec_id"]))
    assert len(got) == 180 and hit >= 0.9 * 180


def test_pii(spark, docs, empty):
    text = "x a@b.c_x@d.e +1 (017) 555-7713 card 4111 1111 1111 1111 ip 1.2.3.4 999.1.1.1 iban DE89370400440532013000 " + "9" * 3000
    got = pii.find_pii(spark.createDataFrame([(1, text), (2, None)], "doc_id long, text string")).orderBy("doc_id").collect()
    kinds = [x["kind"] for x in got[0]["pii"]]
    assert kinds == ["email", "email", "phone", "card", "ip", "iban"] and got[1]["pii"] == []
    assert [text[x["s"] : x["e"]] for x in got[0]["pii"]][:2] == ["a@b.c", "_x@d.e"]
    clean = pii.redact(spark.createDataFrame([(1, text)], "doc_id long, text string")).first()["text"]
    assert "a@b.c" not in clean and "<CARD>" in clean
    assert pii.redact(docs).count() == len(ROWS) and pii.redact(empty).count() == 0


def test_decontamination(spark, docs, empty):
    items = spark.createDataFrame([(1, prose(3, 20)), (2, "w5 a"), (3, None), (None, LONG), (4, "a b"), (4, "a b")], "item_id long, text string")
    got = {r["doc_id"]: r for r in decontaminate.contamination(docs, items).collect()}
    assert got[7]["n_hit"] == sum(1 for _ in prose(3, 20).split()) and got[7]["contaminated"] and got[4]["n_words"] == 0
    assert got[6]["n_hit"] == 2 and got[6]["items_sha256"] == hashlib.sha256(b"4").hexdigest() and got[1]["n_items"] == 0
    assert decontaminate.contamination(empty, items).count() == 0 and decontaminate.contamination(docs, items.limit(0)).where("n_hit > 0").count() == 0


def test_decontamination_judges_rows_not_ids(spark):
    """A clean row stays though a contaminated one has its id, null or not."""
    bad, rows = prose(3, 20), [(None, 0), (None, 1), (5, 0), (5, 1), (5, 0), (6, 1)]
    docs = spark.createDataFrame([(i, bad if hit else f"clean {k}", k) for k, (i, hit) in enumerate(rows)], "doc_id long, text string, rid int")
    got = decontaminate.decontaminate(docs, spark.createDataFrame([(1, bad)], "item_id long, text string"))
    assert got.columns == docs.columns
    clash = docs.withColumnsRenamed({"rid": "__bad"}).withColumns({"__salt": docs.doc_id, "found": docs.text, "__r_doc_id": docs.doc_id})
    other = decontaminate.decontaminate(clash, spark.createDataFrame([(1, bad)], "item_id long, text string"))
    assert other.columns == clash.columns and sorted(r["__bad"] for r in other.collect()) == [0, 2, 4]
    assert sorted((r["rid"], r["doc_id"], r["text"]) for r in got.collect()) == [(k, i, f"clean {k}") for k, (i, hit) in enumerate(rows) if not hit]


def test_decontamination_of_long_texts_and_short_items(spark):
    """Thirteen words in a long text are enough to drop it; a few words of a short item are not."""
    items = spark.createDataFrame([(1, prose(3, 20)), (2, "w5 a")], "item_id long, text string")
    span = prose(3, 20).split()
    docs = spark.createDataFrame([(1, prose(70, 5000) + " " + " ".join(span[:13])), (2, prose(70, 5000) + " " + " ".join(span[:12]) + " w5 a"), (3, "w5 a")], "doc_id long, text string")
    assert [r["doc_id"] for r in decontaminate.decontaminate(docs, items).collect()] == [2]
    got = {r["doc_id"]: (r["n_hit"], r["contaminated"], [(x["s"], x["e"]) for x in r["spans"]]) for r in decontaminate.contamination(docs, items).collect()}
    assert got == {1: (13, False, [(5000, 5013)]), 2: (2, False, [(5012, 5014)]), 3: (2, True, [(0, 2)])}


@pytest.mark.parametrize("frequent", [lm.FREQUENT, 16])
def test_language_model_sums_to_one_and_matches_counts(spark, docs, monkeypatch, frequent):
    monkeypatch.setattr(lm, "FREQUENT", frequent)  # 16: most words are counted by their hash
    base = docs.select("doc_id", "text")
    counts = lm.word_counts(base).persist()
    v = lm.Vocabulary(counts)
    net = lm.train(base, v)
    got = lm.score(base, counts, v, net, ["doc_id"]).toPandas()
    split = [re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower()) for _, t in ROWS]
    assert sorted(got["n_tokens"]) == sorted(len(s) + 1 for s in split) and (got["train_tokens"] == sum(len(s) + 1 for s in split)).all()
    h, _ = net.context(np.array([1, 2, 3]), np.arange(3))
    z = h @ net.out.T + net.bias
    total = sum(10 ** net.log10(np.array([o])) for o in range(lm.OUT))
    assert abs(total - 1) < 1e-3 and z.shape == (3, lm.OUT)
    seen = {}
    for ws in split:
        for w in [*ws, ""]:
            seen[w] = seen.get(w, 0) + 1
    n, kinds = sum(seen.values()), len(seen)
    want = sorted((len(ws) + 1, sum(np.log10((seen.get(w, 0) + 1) / (n + kinds + 1)) for w in [*ws, ""])) for ws in split)
    assert np.allclose(sorted(zip(got["n_tokens"], got["base_score"], strict=True)), want) and (got["n_known"] == got["n_tokens"]).all()


def test_language_model_edge_cases(spark):
    texts = [None, "", "  ", "a b", "a b", "the cat sat " * 15_000]
    rows = spark.createDataFrame([(i, "k", t, "x", None) for i, t in enumerate(texts)], "known long, codes string, text string, rare string, `w.x` string")
    names = ["known", "codes", "rare", "w.x"]
    nothing = rows.limit(0)
    counts = lm.word_counts(nothing)
    v = lm.Vocabulary(counts)
    net = lm.train(nothing, v)
    got = lm.score(rows, counts, v, net, names).toPandas().sort_values("known")
    lengths = np.array([1, 1, 1, 3, 3, 45_001])
    assert list(got.columns[:4]) == names and (got["n_tokens"] == lengths).all() and (got["n_known"] == 0).all() and (got["train_tokens"] == 0).all()
    assert np.allclose(got["score"], -lengths * np.log10(lm.OUT), rtol=1e-4) and np.allclose(got["base_score"], 0)
    assert lm.score(nothing, counts, v, net, names).count() == 0


def test_language_model_batches_are_whole_texts(monkeypatch):
    """Texts scored together, and long ones in stretches, get the context of their own text and nothing else's."""
    rng = np.random.default_rng(8)
    texts = [rng.integers(0, lm.OUT, n) for n in (1, 2, 5, 700, 3, 9000, 1, 40)]
    net = lm.Net.start(np.full(lm.OUT, 1 / lm.OUT))

    def plain(o):
        total = 0.0
        for t in range(len(o)):
            h = sum(net.near[i][o[t - 1 - i] if t > i else lm.OUT] for i in range(lm.ORDER)) + (net.far[o[:t]].mean(0) if t else 0)
            z = (net.out @ h + net.bias).astype(float)
            total += z[o[t]] - np.log(np.exp(z - z.max()).sum()) - z.max()
        return total / np.log(10)

    want = [plain(o) for o in texts]
    for stretch in (lm.STRETCH, 512):
        monkeypatch.setattr(lm, "STRETCH", stretch)
        assert np.allclose(net.log10_all(texts), want, rtol=1e-4)


def test_language_model_learns(monkeypatch):
    """The gradient of one step is that of the sampled loss, by differences; steps raise the probability of what was seen."""
    rng = np.random.default_rng(9)
    q = np.full(lm.OUT, 1 / lm.OUT)
    o, pos = rng.integers(0, 40, 60), np.r_[np.arange(25), np.arange(35)]
    t = lm.Trainer(lm.Net.start(q), q, 1)
    start, noise = t.net.flat.astype(np.float64), np.minimum(np.searchsorted(np.cumsum(q), np.random.default_rng(1).random(lm.SHARED_NOISE)), lm.OUT - 1)

    def loss(flat):
        net = lm.Net(flat.astype(np.float32))
        h, _ = net.context(o, pos)
        s = (h * net.out[o]).sum(1) + net.bias[o] - t.log_kq[o]
        x = h @ net.out[noise].T + net.bias[noise] - t.log_kq[noise]
        return -np.logaddexp(0, -s.astype(float)).sum() - lm.NOISE / lm.SHARED_NOISE * np.logaddexp(0, x.astype(float)).sum()

    t.learn(o, pos)
    grad = np.sqrt((t.squares.flat.astype(float) - 1e-2).clip(0)) * np.sqrt(len(o))
    for i in np.argsort(-grad)[:: max(1, lm.Net.SIZE // 400)][:6]:
        step = np.zeros_like(start)
        step[i] = 0.02
        assert abs(abs(loss(start + step) - loss(start - step)) / 0.04 - grad[i]) < 0.05 * grad[i] + 0.05
    first = lm.Net(start.astype(np.float32)).log10_all([o])[0]
    for _ in range(20):
        t.learn(o, pos)
    assert t.net.log10_all([o])[0] > first + 5


def test_language_model_training_reuses_memory():
    """Steps after the first few ask the system for next to no new pages, in a process of their own."""
    code = """
import resource
import numpy as np
from tidelog.llm import lm
q = np.full(lm.OUT, 1 / lm.OUT)
t, o = lm.Trainer(lm.Net.start(q), q, 1), np.random.default_rng(2).integers(0, lm.OUT, 2400)
for i in range(30):
    if i == 10:
        start = resource.getrusage(resource.RUSAGE_SELF).ru_minflt
    t.learn(o, np.arange(2400) % 400)
print((resource.getrusage(resource.RUSAGE_SELF).ru_minflt - start) / 20)
"""
    out = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, timeout=120, cwd=Path(lm.__file__).parents[2])
    assert float(out.stdout.split()[-1]) < 60


def test_language_model_sums_in_pairs_and_far_logits():
    rng = np.random.default_rng(9)
    for kind in (np.float32, np.float64):
        x = rng.standard_normal((50, lm.DIM)).astype(kind)
        assert np.array_equal(lm.running_sum(x.copy()), np.cumsum(x, axis=0))
    x, first = rng.standard_normal((50, 6 * lm.DIM)).astype(np.float32), np.array([0, 1, 7, 49])
    assert np.allclose(lm.sums_from(x, first), np.add.reduceat(x, first, axis=0), atol=1e-5)
    net = lm.Net((rng.standard_normal(lm.Net.SIZE) * 3).astype(np.float32))  # logits of hundreds
    o = rng.integers(0, lm.OUT, 150)
    z = (net.context(o, np.arange(150))[0].astype(float) @ net.out.T + net.bias).astype(float)
    top = z.max(1)
    want = z[np.arange(150), o] - top - np.log(np.exp(z - top[:, None]).sum(1))
    assert top.max() > 100 and np.isclose(net.log10_all([o])[0], want.sum() / np.log(10), rtol=1e-5)


def test_language_model_trains_on_every_text(spark):
    """A single training text, whichever it is, moves the model away from its start."""
    for i in range(4):
        one = spark.createDataFrame([(i, prose(20 + i, 50))], "doc_id long, text string")
        v = lm.Vocabulary(lm.word_counts(one).persist())
        assert not np.array_equal(lm.train(one, v).flat, lm.Net.start(v.q).flat)


def test_pipeline_on_edge_cases(spark, docs, empty, tmp_path):
    spark.createDataFrame([(1, prose(3, 20))], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for start in (docs, empty):
        cur = start
        for _, stage in corpus_pipeline.STAGES[:-1]:
            cur = stage(spark, cur, str(tmp_path))
            assert cur.columns == docs.columns
        assert corpus_pipeline.STAGES[-1][1](spark, cur, str(tmp_path)).count() == (0 if start is empty else corpus_pipeline.STAGES[-1][1](spark, cur, str(tmp_path)).count())


def test_crc_of_null_id():
    assert zlib.crc32(b"") == 0
