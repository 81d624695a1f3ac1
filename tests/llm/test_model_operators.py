"""kNN, language model, decontamination and classifiers against brute force, exact sums and held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkreco.llm import bilinear, decontaminate, knn, quality, toxicity
from sparkreco.llm import blocks as B
from sparkreco.llm.samples import fold


def _brute_knn(rows, k):
    vectors = [(i, [math.floor(256 * float(np.float32(x))) for x in v]) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = Counter()
    for n, (i, v) in enumerate(vectors):
        if i % 5 == 0:
            scores = sorted((-sum(a * b for a, b in zip(v, w, strict=False)), j) for m, (j, w) in enumerate(vectors) if m != n)[:k]
            out.update((i, r + 1, j, -s) for r, (s, j) in enumerate(scores))
    return out


@pytest.mark.parametrize("small", [False, True])
def test_knn_join(spark, small, monkeypatch):
    if small:
        monkeypatch.setattr(knn, "GROUP_QUERIES", 3)
        monkeypatch.setattr(knn, "BLOCK_ROWS", 17)
    rng = np.random.default_rng(0)
    centres = rng.normal(size=(6, 8))
    rows = [(i, [float(x) for x in centres[i % 6] + 0.1 * rng.normal(size=8)]) for i in range(150)]
    rows += [(200 + i, rows[0][1]) for i in range(20)]  # ties
    rows += [(10, rows[1][1]), (10, rows[10][1]), (31, rows[31][1])]  # repeated ids, as queries and as candidates
    rows += [(None, rows[0][1]), (300, None), (301, [None] * 8), (305, [float("nan")] * 8), (310, [0.0] * 8), (315, [float("inf")] * 8)]
    df = spark.createDataFrame([(i, v, i, 1) for i, v in rows], "vec_id long, embedding array<float>, id long, q int")
    got = knn.knn_join(df, F.col("vec_id") % 5 == 0, 5, pivots=8).collect()
    assert Counter((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in got) == _brute_knn(rows, 5)
    assert knn.knn_join(df.limit(0), F.col("vec_id") % 5 == 0).count() == 0
    few = df.filter("vec_id < 3")
    assert knn.knn_join(few, F.col("vec_id") == 0).count() == 2


def _docs(n=120, seed=3):
    rng = random.Random(seed)
    langs = [["the", "of", "and", "to", "in"], ["der", "und", "die", "von", "zu"]]
    rows = []
    for i in range(n):
        own = langs[i % 2]
        rows.append((i, " ".join(rng.choice(own) if rng.random() < 0.6 else rng.choice("abcdefgh") + rng.choice(["ing", "ung"][i % 2 : i % 2 + 1]) + str(rng.randrange(40)) for _ in range(rng.randrange(3, 60)))))
    return rows + [(n, None), (n + 1, ""), (None, "the of nothing"), (1, "the repeated id")]


def test_language_model_sums_and_normalisation(spark, monkeypatch):
    monkeypatch.setattr(B, "BLOCK_BYTES", 1500)
    rows = _docs()
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, score int").repartition(2)
    got = bilinear.score_texts(df, fold("doc_id", 5) != 1, sample_texts=60).collect()
    tokens = lambda t: (t or "").encode().lower().split() + [None]
    trained = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    counts = Counter(w for i, t in rows if trained(i) for w in tokens(t))
    total, kinds = sum(counts.values()), len(counts)
    want = sorted((len(tokens(t)), sum(w in counts for w in tokens(t)), round(sum(math.log10((counts[w] + 0.5) / (total + 0.5 * (kinds + 1))) for w in tokens(t)), 6)) for _, t in rows)
    assert sorted((r["n_tokens"], r["n_known"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 and r["train_tokens"] == total for r in got)
    held = [r for r in got if not r["trained"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_language_model_is_alike_in_any_partitioning(spark, monkeypatch):
    monkeypatch.setattr(bilinear, "SHARD_BYTES", 2000)
    monkeypatch.setattr(bilinear, "SLICE_BYTES", 700)
    df = spark.createDataFrame(_docs(), "doc_id long, text string")
    runs = []
    for parts in (1, 4, 16):
        monkeypatch.setattr(B, "BLOCK_BYTES", 500 * parts)
        got = bilinear.score_texts(df.repartition(parts, F.rand(parts)), fold("doc_id", 5) != 1, sample_texts=20).collect()
        runs.append(sorted((r["doc_id"] or -1, r["n_tokens"], round(r["score"], 6)) for r in got))
    assert runs[0] == runs[1] == runs[2]


def test_language_model_is_normalised():
    rng = np.random.default_rng(1)
    by_class = np.zeros((3, bilinear.CLASSES), np.int64)
    by_class[:, :4] = [[50, 40, 30, 20], [10, 9, 8, 7], [3, 2, 1, 4]]
    counts = bilinear.Counts(140, 34, 10, by_class, np.sort(rng.integers(1, 1 << 60, 3).astype(np.uint64)), np.array([20, 10, 5]), np.array([0, 1, 2], np.uint8))
    model = bilinear.fit(["a b c d", "b c"], counts)
    n = len(model.bias)
    assert n == bilinear.CLASSES + 1 + 3
    for before, last in [(0, 1), (n, n), (n, 2), (bilinear.END, n - 1)]:
        p = 10 ** model.log10(np.full(n, before), np.full(n, last), np.arange(n)).astype(float)
        assert abs(p.sum() - 1) < 1e-4
    # within a class, seen words and the unseen share make one
    in_class = bilinear._class_counts(counts)
    seen = (1 - model.unseen[:4]) * in_class[:4] / in_class[:4] + model.unseen[:4]
    assert np.allclose(seen, 1)


def test_language_model_of_nothing(spark):
    assert bilinear.score_texts(spark.createDataFrame([], "doc_id long, text string"), F.lit(True)).count() == 0
    one = bilinear.score_texts(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), F.lit(False)).first()
    assert (one["n_tokens"], one["n_known"], one["train_tokens"]) == (3, 0, 0) and one["base_score"] == 0


ITEMS = [(1, "What is the capital of the northern kingdom, and why? It is Aldor since the old river moved away."), (2, "Name three rivers that meet below the western hills: Bran, Cale and the slow Dorn."), (3, None), (4, "too short"), (1, "What is the capital of the northern kingdom, and why? It is Aldor since the old river moved away.")]


def _leaky(shards):
    filler = "nothing of note was said here today by anyone at all in this town and "
    return [
        (10, filler * 20 + ITEMS[0][1] + filler * 20, True), (11, filler * 30, False), (12, ITEMS[1][1].upper(), True), (13, None, False), (14, "", False),
        (15, "the capital of the northern kingdom is a place with the river", False), (16, (filler * 7 + "w ") * 50 + ITEMS[1][1], True), (None, ITEMS[1][1], True), (10, filler, False),
    ]


@pytest.mark.parametrize("shard", [1024, 2])
def test_decontamination(spark, shard, monkeypatch):
    monkeypatch.setattr(decontaminate, "SHARD_ITEMS", shard)
    rows = _leaky(shard)
    docs = spark.createDataFrame([(i, t, leaked, 1) for i, t, leaked in rows], "doc_id long, text string, leaked boolean, leaks int")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = decontaminate.find_leaks(docs, items).collect()
    assert all((len(r["leaks"]) > 0) == r["leaked"] for r in found)
    assert [x["item_id"] for r in found if r["doc_id"] == 10 and r["leaked"] for x in r["leaks"]] == [1, 1]
    clean = decontaminate.drop_leaked(docs, items)
    assert clean.columns == docs.columns and clean.filter("leaked").count() == 0 and clean.count() == 5
    assert decontaminate.drop_leaked(docs, items.limit(0)).count() == len(rows)
    assert decontaminate.drop_leaked(docs.limit(0), items).count() == 0


def test_decontamination_finds_short_items(spark):
    items = ["Zeta", "Zeta kappa?", "Is zeta kappa", "Zeta is kappa now", "Why is zeta kappa now", "Why is zeta kappa right now", "..."]
    texts = [f"some words before, {t} and others after" for t in items] + ["kappa now is what zeta was", None, ""]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    holds = lambda t, w: any(t[k : k + len(w)] == w for k in range(len(t) - len(w) + 1))
    want = {d: [i for i, t in enumerate(items) if split(t) and holds(split(text), split(t))] for d, text in enumerate(texts)}
    got = decontaminate.find_leaks(docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), overlap=1.0).collect()
    assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in got} == want
    assert want[4] == [0, 1, 2, 4]


def test_decontamination_is_alike_in_any_number_of_shards(spark, monkeypatch):
    rng = random.Random(8)
    items = [(i, " ".join(f"w{int(60 * rng.random() ** 2)}" for _ in range(rng.randrange(6, 30)))) for i in range(40)] + [(None, "w1 w2"), (50, None)]
    texts = []
    for i in range(80):  # copies with words lost, near the threshold
        words = items[i % 40][1].split()
        texts.append((i, " ".join(f"x{rng.randrange(9)}" if rng.random() < 0.3 else w for w in words * 2)))
    docs, rows = spark.createDataFrame(texts, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    runs = []
    for shard in (1024, 16):
        monkeypatch.setattr(decontaminate, "SHARD_ITEMS", shard)
        found = decontaminate.find_leaks(docs, rows, overlap=0.2).collect()
        runs.append(sorted((r["doc_id"], x["item_id"] or -1, round(x["score"], 9), x["question"], x["answer"]) for r in found for x in r["leaks"]))
    assert len(runs[0]) > 20 and runs[0] == runs[1]


def _plain_leaks(docs, items, retrieve, overlap):
    """BM25 of every passage with every item, then overlap; all in plain sets and dicts."""
    split = lambda t: "".join(c if c.isalnum() else " " for c in (t or "").lower()).split()
    words = [split(t) for _, t in items]
    used = [w for w in words if w]
    mean = sum(map(len, used)) / len(used)
    having = Counter(x for w in used for x in set(w))
    idf = {t: math.log(1 + (len(used) - n + 0.5) / (n + 0.5)) for t, n in having.items()}
    run = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    out = set()
    for d, text in docs:
        doc = split(text)
        for i, w in enumerate(words):
            if not w:
                continue
            weight = {t: idf[t] * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, c in Counter(w).items()}
            half = 1
            while half * 4 < len(w) * 5:
                half *= 2
            parts = [w, w] if len(w) < 5 else [w[: len(w) // 2], w[len(w) // 2 :]]
            sizes = [len(w)] * 2 if len(w) < 5 else [min(3, len(x)) for x in parts]
            for s in range(0, max(1, len(doc)), half):
                passage = doc[s : s + 2 * half]
                score = sum(weight[t] for t in set(passage) & weight.keys()) / sum(weight.values())
                shares = [len(run(x, n) & run(passage, n)) / len(run(x, n)) for x, n in zip(parts, sizes, strict=True)]
                if score >= retrieve and min(shares) >= overlap:
                    out.add((d, items[i][0]))
    return out


def test_decontamination_against_a_plain_version(spark):
    rng = random.Random(12)
    items = [(i, " ".join(f"w{int(80 * rng.random() ** 2)}" for _ in range(rng.choice([2, 4, 5, 9, 17, 30, 120])))) for i in range(40)]
    docs = []
    for i in range(90):
        w = items[i % 40][1].split()
        lost = [x for x in w if rng.random() < 0.9]
        docs.append((i, " ".join([f"w{rng.randrange(80)}" for _ in range(rng.randrange(60))] + (lost if i % 3 else w) + [f"x{rng.randrange(9)}" for _ in range(rng.randrange(90))])))
    want = _plain_leaks(docs, items, 0.5, 0.5)
    found = decontaminate.find_leaks(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r["doc_id"], x["item_id"]) for r in found for x in r["leaks"]} == want and len(want) > 60


def test_an_item_leaks_alike_whatever_the_others_length(spark):
    item = "the old mill stands behind seven white birches since winter"
    words = item.split()
    spread = " ".join(" ".join(words[k : k + 3]) + " " + "and so on it goes " * 12 for k in range(0, 10, 2))  # its trigrams, sixty words apart
    near = "he wrote that " + item + " and nothing else"
    docs = spark.createDataFrame([(0, spread), (1, near)], "doc_id long, text string")
    long_item = " ".join(f"z{k}" for k in range(1500))
    for items in ([(1, item)], [(1, item), (2, long_item)]):
        found = decontaminate.find_leaks(docs, spark.createDataFrame(items, "item_id long, text string")).collect()
        assert {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in found} == {0: [], 1: [1]}


def test_wand_finds_what_a_full_scan_finds(monkeypatch):
    monkeypatch.setattr(decontaminate, "half_passage", lambda n: 64)
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)]
    texts = [" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(5, 25))) for _ in range(90)]
    (index,) = decontaminate.build_indexes(list(range(90)), texts)
    for _ in range(40):
        terms = np.array(sorted(rng.sample(range(len(index.terms)), min(len(index.terms), rng.randrange(1, 50)))))
        scores = np.zeros(90)
        for t in terms:
            scores[index.items[t]] += index.weights[t]
        threshold = rng.choice([0.2, 0.5, 0.8])
        reached = dict(decontaminate._reached(index, terms, np.array([0]), np.array([len(terms)]), threshold))
        got = decontaminate.wand(index, terms, reached[0], threshold) if reached else []
        clear = {i for i in range(90) if abs(scores[i] - threshold) > 1e-9 and scores[i] >= threshold}
        assert {i for i, _ in got} >= clear and all(scores[i] >= threshold - 1e-9 for i, _ in got)


@pytest.mark.parametrize("at_once", [1, 70, 1 << 20])
def test_block_bounds_of_many_passages(monkeypatch, at_once):
    monkeypatch.setattr(decontaminate, "BOUNDS", at_once)
    monkeypatch.setattr(decontaminate, "SUMS", at_once)
    rng = random.Random(6)
    texts = [" ".join(f"w{rng.randrange(40)}" for _ in range(rng.randrange(1, 12))) for _ in range(50)]
    monkeypatch.setattr(decontaminate, "half_passage", lambda n: 64)
    (index,) = decontaminate.build_indexes(list(range(50)), texts)
    dense = np.zeros((len(index.terms), index.blocks))
    for t, (items, weights) in enumerate(zip(index.items, index.weights, strict=True)):
        np.maximum.at(dense[t], items // decontaminate.BLOCK_ITEMS, weights)
    passages = [sorted(rng.sample(range(len(index.terms)), rng.randrange(1, 30))) for _ in range(30)]
    ends = np.cumsum([len(p) for p in passages])
    starts = np.concatenate([[0], ends[:-1]])
    got = {k: blocks.tolist() for k, blocks in decontaminate._reached(index, np.concatenate(passages), starts, ends, 0.4)}
    sums = [dense[p].sum(0) for p in passages]
    assert all(set(got.get(k, [])) >= set(np.flatnonzero(x >= 0.4)) and all(x[b] >= 0.4 - 1e-5 for b in got.get(k, [])) for k, x in enumerate(sums))
    assert 0 < len(got) and got.keys() <= set(range(30))


def _labelled(seed=1, n=400):
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        toxic, bad = i % 8 == 0, i % 5 == 0
        words = [rng.choice("bcdfg") + rng.choice("aeiou") + rng.choice("lmnr") + str(rng.randrange(300)) for _ in range(rng.randrange(5, 80))]
        if toxic:
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(["idiot", "Scum!", "moron,"])
        if bad:
            words = [w + rng.choice(["***", "$$$", "###"]) for w in words]
        rows.append((i, " ".join(words), "en", "src"))
        labels.append((i, int(not bad), int(toxic)))
    return rows + [(n, None, None, None), (n + 1, "", "de", "s"), (None, "an idiot", "en", "s"), (0, rows[0][1], "en", "s")], labels


def test_toxicity_on_held_out_rows(spark):
    rows, labels = _labelled()
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit_toxicity(docs, marked, fold("doc_id", 5) != 0)
    held = toxicity.score_toxicity(docs, model).join(marked, "doc_id").filter(fold("doc_id", 5) == 0).toPandas()
    assert ((held["toxicity"] >= 0.5) == held["toxic"]).mean() > 0.97
    scored = toxicity.score_toxicity(docs, model)
    assert scored.count() == len(rows) and scored.filter("toxicity IS NULL OR toxicity < 0 OR toxicity > 1").count() == 0
    kept = toxicity.reject_toxic(docs.withColumn("toxicity", F.lit("mine")), model)
    assert kept.columns[-1] == "toxicity" and kept.filter("toxicity = 'mine'").count() == kept.count()
    untaught = toxicity.fit_toxicity(docs, marked.limit(0), fold("doc_id", 5) != 0)
    assert toxicity.score_toxicity(docs, untaught).select("toxicity").distinct().count() == 1
    assert toxicity.score_toxicity(docs.limit(0), model).count() == 0


def test_toxicity_of_a_text_in_stretches(monkeypatch):
    rng = random.Random(2)
    texts = [" ".join(rng.choice(["a", "bb", "ccc", "idiot"]) for _ in range(n)) for n in (0, 1, 2, 50, 300)]
    model = toxicity.ToxicityModel(np.random.default_rng(0).normal(size=(toxicity.ROWS, toxicity.DIM)).astype(np.float32), {w: np.random.default_rng(w).normal(size=(w * toxicity.DIM, toxicity.FILTERS)).astype(np.float32) for w in toxicity.WIDTHS}, {w: np.zeros(toxicity.FILTERS, np.float32) for w in toxicity.WIDTHS}, np.ones(len(toxicity.WIDTHS) * toxicity.FILTERS), 0.0)
    whole = model.logits(*toxicity._encode(texts))
    monkeypatch.setattr(toxicity, "STRETCH", 7)
    monkeypatch.setattr(toxicity, "SLICE", 100)
    assert np.allclose(whole, model.logits(*toxicity._encode(texts)))


def test_quality_on_held_out_rows(spark):
    rows, labels = _labelled(2)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    marked = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit_quality(docs, marked, fold("doc_id", 4) != 2, decide_at=0.7)
    scored = quality.score_quality(docs, model)
    held = scored.join(marked, "doc_id").filter(fold("doc_id", 4) == 2).toPandas()
    assert ((held["quality_score"] >= 0.7) == held["quality"]).mean() > 0.95
    assert scored.count() == len(rows) and scored.filter("quality_score IS NULL OR quality_score < 0 OR quality_score > 1").count() == 0
    assert quality.score_quality(docs.limit(0), model).count() == 0
    assert quality.score_quality(docs, quality.fit_quality(docs, marked.limit(0), F.lit(True))).select("quality_score").distinct().count() == 1


def test_pipeline_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    rows, labels = _labelled(4, 200)
    leaked = [(900, "words before " * 10 + ITEMS[0][1] + " words after" * 10, "en", "s"), (901, rows[3][1] + " extra", "en", "s")]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows + leaked], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    now = docs
    for k, (name, stage) in enumerate(pipeline.STAGES):
        stage(spark, now, str(tmp_path)).write.parquet(f"{tmp_path}/{k}")
        now = spark.read.parquet(f"{tmp_path}/{k}")
        if k < len(pipeline.STAGES) - 1:
            assert now.columns == docs.columns, name
            assert now.filter("text IS NOT NULL AND n_chars <> length(text)").count() == 0
    left = {r["doc_id"] for r in now.collect()}
    assert 900 not in left and not any(i % 8 == 0 for i in left if i is not None and i < 200)
    assert len(left & {i for i in range(200) if i % 8}) > 165
    assert pipeline.run(spark, str(tmp_path)).count() == now.count()
