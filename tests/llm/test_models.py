import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plexigraph.llm import language_id, quality_net


@pytest.fixture(scope="module")
def small(spark):
    d = "/root/testdata/sf0.01"
    return spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")


def test_language_id_held_out(spark, small):
    docs = small[0].select("doc_id", "text", "lang")
    model = language_id.train(docs.filter(language_id.remainder("doc_id", 3) != 1))
    rows = language_id.predict(docs, model).join(docs.select("doc_id", "lang"), "doc_id").filter(language_id.remainder("doc_id", 3) == 1).collect()
    right = [r["lang_pred"] == r["lang"] for r in rows]
    assert np.mean(right) >= 0.98
    assert abs(np.mean([r["score"] for r in rows]) - np.mean(right)) < 0.05  # calibrated
    assert all(0 <= r["score"] <= 1 for r in rows)
    assert (np.abs(model.table[:, :-1]) == 0).mean() > 0.5  # sparse


def test_language_id_edges(spark, make):
    model = language_id.train(make([(i, "der die das und " * 9, "de") for i in range(8)] + [(20 + i, "the and of to " * 9, "en") for i in range(8)] + [(40, None, "fr"), (41, "x", None)]))
    assert model.langs == ["de", "en"]
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and"), (4, "the and"), (None, "und die"), (5, "the of and " * 40_000), (6, "²½"), (7, "ß")]
    got = [(r["doc_id"], r["lang_pred"]) for r in language_id.predict(make(rows).withColumnRenamed("source", "score"), model).collect()]
    assert got[:7] == [(1, "und"), (2, "und"), (3, "und"), (4, "en"), (4, "en"), (None, "de"), (5, "en")]
    assert got[7] == (6, "und") and got[8][1] in ("de", "en")
    kept = language_id.keep_known(make(rows), model, 0.5)
    assert {r["doc_id"] for r in kept.collect()} >= {4, 5} and kept.filter("doc_id in (1, 2, 3, 6)").count() == 0


def test_language_id_without_training_rows(make):
    assert language_id.train(make([])) is None
    rows = language_id.predict(make([(1, "abc")]), None).collect()
    assert [(r["lang_pred"], r["score"]) for r in rows] == [("und", 0.0)]
    assert language_id.keep_known(make([(1, "abc"), (2, "1")]), None, 0.3).count() == 1


def test_sample_leaves_no_language_out(spark, make):
    """14 languages, the table sorted by language, one of 20 times the others' size and one of long texts only."""
    rows = [(1000 * k + i, f"w{k} x{i} y{i % 7}", f"l{k:02d}") for k in range(13) for i in range(1200 if k == 4 else 60)]
    rows += [(90_000 + i, f"long{i} " * 30, "l13") for i in range(40)] + [(5, "w0 copy", "l00")] * 500
    got = language_id.draw_sample(make(rows), 600, 140, 100).collect()
    counts = {}
    for r in got:
        counts[r["lang"]] = counts.get(r["lang"], 0) + 1
    assert counts == {**{f"l{k:02d}": 10 for k in range(13)}, "l13": 1}
    again = language_id.draw_sample(make(rows).repartition(7), 600, 140, 100).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))


def plain_scores(model, text):
    """The model's probabilities for one text, n-gram by n-gram."""
    mask, odd = 2**64 - 1, [int(x) for x in language_id._ODD]
    low, sums, norm = "".join(c if ord(c) > 127 or c.isalpha() else " " for c in text.lower()), [0.0] * len(model.langs), 0.0
    padded = low + "  "
    for i in range(len(low)):
        if padded[i : i + 2] == "  ":
            continue
        h = 0
        for k in range(3):
            h = (h + ord(padded[i + k]) + k + 1) * odd[k] & mask
            b = ((h ^ (h >> 29)) * odd[1] & mask) >> (64 - language_id.BITS)
            norm += float(model.table[b, -1])
            sums = [s + float(w) for s, w in zip(sums, model.table[b, :-1], strict=True)]
    z = [(s / max(norm, 1e-12) + b) / model.temperature for s, b in zip(sums, model.bias, strict=True)]
    e = [math.exp(x - max(z)) for x in z]
    return [x / sum(e) for x in e]


def test_language_query_against_a_plain_scorer(spark, sf):
    out = language_id.op5_language_id(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "lang_pred": "string", "score": "double"}
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    model = language_id.train(docs.filter(language_id.remainder("doc_id", 3) != 1))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        t = texts[r["doc_id"]]
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)
        if t is None or not any(map(str.isalpha, t)):
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
            continue
        p = plain_scores(model, t)
        assert model.langs[int(np.argmax(p))] == r["lang_pred"] and abs(max(p) - r["score"]) < 1e-6


def test_quality_held_out(spark, small):
    docs, labels = small
    seen = language_id.remainder("doc_id", 5) != 0
    net = quality_net.train(docs.filter(seen), labels.filter(seen))
    rows = quality_net.score(docs.filter(~seen), net).join(labels, "doc_id").collect()
    assert np.mean([(r["score"] >= 0.3) == (r["quality"] == 1) for r in rows]) >= 0.9


def test_chunks_cover_every_byte():
    for n in (0, 1, 511, 512, 513, 960, 961, 5000):
        text = "".join(chr(97 + k % 26) for k in range(n))
        codes, again, owner = quality_net.chunks_of([text])
        seen = np.zeros(len(codes) * quality_net.STEP + quality_net.CHUNK, np.int64)
        for k, c in enumerate(codes):
            own = seen[k * quality_net.STEP : k * quality_net.STEP + quality_net.CHUNK]
            own[:] = np.maximum(own, c)
        assert [x - 1 for x in seen[:n]] == list(text.encode()) and not seen[n:].any()
        assert codes.shape == again.shape and (owner == 0).all()


def test_gradients_are_those_of_the_loss():
    net = quality_net.Net(3)
    texts, labels = ["ab cd " * 30, "### ab ### " * 60, "xyz"], np.array([1.0, 0.0, 1.0], np.float32)
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    parts = quality_net.chunks_of(texts)

    def loss():
        s = net.score(texts)
        return -np.mean(labels * np.log(s) + (1 - labels) * np.log(1 - s))

    g = net.gradients(*parts, labels)
    for name, at in (("v", (3,)), ("c", (0,)), ("b", (5,)), ("w", (10, 5)), ("embed", (98, 2))):
        old, eps = net.p[name][at], 1e-3
        net.p[name][at] = old + eps
        up = loss()
        net.p[name][at] = old - eps
        down = loss()
        net.p[name][at] = old
        assert abs((up - down) / (2 * eps) - g[name][at]) < 2e-3


def test_quality_edges(spark, make):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (3, None, 0), (1, 1, 0), (99, 1, 0)], "doc_id long, quality int, toxic int")
    docs = make([(1, "good words here"), (2, "### $$$"), (3, None), (None, ""), (4, "long text " * 30_000), (4, "x")])
    net = quality_net.train(docs, labels, epochs=2)
    rows = quality_net.score(docs.withColumnRenamed("source", "score"), net).collect()
    assert len(rows) == 6 and all(0 <= r["score"] <= 1 for r in rows)
    one = quality_net.train(docs, labels.filter("quality = 1"))
    assert {r["score"] for r in quality_net.score(docs, one).collect()} == {1.0}
    none = quality_net.train(make([]), labels.limit(0))
    assert {r["score"] for r in quality_net.score(docs, none).collect()} == {0.5}
    assert quality_net.score(make([]), none).count() == 0
    assert quality_net.score(docs, one).filter(F.col("doc_id").isNull()).count() == 1


def test_blocks_are_the_chunks_of_the_whole_text():
    text = "".join(chr(97 + (k * k) % 26) for k in range(9000)) + "é" * 300
    whole = quality_net.blocks_of([text], at_once=1000)
    codes, again, _ = next(whole)
    parts = list(quality_net.blocks_of(["x", text, None], at_once=3))
    assert max(len(p[0]) for p in parts) <= 6
    owner = np.concatenate([p[2] for p in parts])
    assert (np.concatenate([p[0] for p in parts])[owner == 1] == codes).all()
    assert (np.concatenate([p[1] for p in parts])[owner == 1] == again).all()


def plain_quality(net, text):
    """The network's probability for one text, place by place."""
    raw, p = (text or "").encode(), quality_net
    n = max(1, -(-(len(raw) - (p.CHUNK - p.STEP)) // p.STEP))
    line = [b + 1 for b in raw] + [0] * ((n - 1) * p.STEP + p.CHUNK + 3 - len(raw))
    w, embed = net.p["w"].reshape(p.WIDTH, p.EMBED + 1, p.FILTERS).astype(float), net.p["embed"].astype(float)
    mark = [float(line[i] > 0 and any(i >= lag and line[i : i + 4] == line[i - lag : i - lag + 4] for lag in range(2, p.LAGS + 1))) for i in range(len(line) - 3)]
    pooled = []
    for c in range(n):
        best = np.full(p.FILTERS, -np.inf)
        for at in range(c * p.STEP, c * p.STEP + p.CHUNK - p.WIDTH + 1, p.STRIDE):
            best = np.maximum(best, sum(embed[line[at + k]] @ w[k, : p.EMBED] + mark[at + k] * w[k, p.EMBED] for k in range(p.WIDTH)))
        pooled.append(np.maximum(best + net.p["b"], 0))
    z = np.concatenate([np.max(pooled, axis=0), np.mean(pooled, axis=0)]) @ net.p["v"] + net.p["c"]
    return 1 / (1 + math.exp(-float(z[0])))


def test_quality_query_against_a_plain_scorer(spark, sf):
    out = quality_net.op9_quality_classifier(spark, sf)
    assert dict(out.dtypes) == {"doc_id": "bigint", "held_out": "boolean", "score": "double", "predicted": "int"}
    docs, labels = (spark.read.parquet(f"{sf}/{x}.parquet") for x in ("documents", "labels"))
    seen = language_id.remainder("doc_id", 5) != 0
    net = quality_net.train(docs.filter(seen), labels.filter(seen))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    rows = out.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0) and r["predicted"] == int(r["score"] >= 0.3)
        if len(texts[r["doc_id"]] or "") < 1500:
            assert abs(plain_quality(net, texts[r["doc_id"]]) - r["score"]) < 1e-4


def test_quality_sample_is_bounded_before_texts_are_read(spark, make):
    docs = make([(i, "word " * (100 if i % 2 else 30_000)) for i in range(60)] + [(1, "other")] * 50)
    labels = spark.createDataFrame([(i, i % 3 % 2, 0) for i in range(60)] * 2, "doc_id long, quality int, toxic int")
    rows = quality_net.draw_sample(docs, labels, most=1000, most_chunks=20, longest=50)
    assert len(rows) == 20  # a chunk each, the long ones left out
    assert all(len(t) < 1000 for t, _ in rows)
