"""Quality classifier: a byte-level convolutional network in numpy.

A text's UTF-8 bytes are cut into overlapping chunks that cover all of it. A learned filter bank
runs over each chunk's byte embeddings and a repeat channel (does the four-byte gram here stand
within the `LAGS` bytes before), is rectified and max-pooled per chunk. The maxima and means of a
document's chunks go through one logistic layer into a single probability.

Training is plain back-propagation with Adam on the driver over a bounded, documented sample: `most`
labelled rows chosen by a hash of the id, none of more than `longest` chunks, `most_chunks` in all
(14 MB of text). The bounds hold before a text is fetched. The rest of the corpus is only scored, by
Arrow batches on the executors, whole texts always; chunks are cut and scored a fixed number at a
time, so that beyond the text itself memory doesn't grow with it.

Scores use the text alone. Null and empty texts are one chunk of padding and get its score. Labels
of null quality or id are left out; a document labelled repeatedly counts once, with its highest
label, and of documents with the same id the fit takes one. Where there is nothing to
learn from, or one class only, the score is that class's share (0.5 without any). Repeated rows are
scored each. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from plexigraph.llm._common import cache_of, parts, table
from plexigraph.llm.language_id import remainder

CHUNK, STEP = 512, 448
WIDTH, STRIDE, EMBED, FILTERS = 8, 2, 6, 24
LAGS = 24
AT_ONCE = 128


def _spread(raw: bytes, lo: int, hi: int) -> tuple[np.ndarray, np.ndarray]:
    """Chunks lo to hi of a text's bytes: (bytes + 1 [chunk, CHUNK], repeats [chunk, CHUNK]); 0 pads."""
    lead = LAGS if lo else 0  # what repeats may look back on
    start, n = lo * STEP - lead, (hi - lo - 1) * STEP + CHUNK
    own = np.frombuffer(raw, np.uint8)[start : start + lead + n + 3]
    line = np.zeros(lead + n + 3, np.uint16)  # and the last grams ahead
    line[: len(own)] = own
    line[: len(own)] += 1
    b = line.astype(np.uint64)
    gram = b[:-3] | b[1:-2] << np.uint64(9) | b[2:-1] << np.uint64(18) | b[3:] << np.uint64(27)
    same = np.zeros(len(gram), bool)
    for lag in range(2, LAGS + 1):
        same[lag:] |= gram[lag:] == gram[:-lag]
    same &= line[:-3] > 0
    cut = lambda x: np.lib.stride_tricks.sliding_window_view(x[lead : lead + n], CHUNK)[::STEP]
    return cut(line), cut(same)


def blocks_of(texts: list[str | None], at_once: int = AT_ONCE):
    """(bytes + 1, repeats, text of each chunk) of all texts' chunks in order, about `at_once` at a time."""
    codes, again, owner, held = [], [], [], 0
    for k, t in enumerate(texts):
        raw = (t or "").encode("utf-8", "surrogatepass")
        count = max(1, -(-(len(raw) - (CHUNK - STEP)) // STEP))
        for lo in range(0, count, at_once):
            c, a = _spread(raw, lo, min(count, lo + at_once))
            codes.append(c)
            again.append(a)
            owner += [k] * len(c)
            held += len(c)
            if held >= at_once:
                yield np.concatenate(codes), np.concatenate(again), np.array(owner)
                codes, again, owner, held = [], [], [], 0
    if held:
        yield np.concatenate(codes), np.concatenate(again), np.array(owner)


def chunks_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All blocks of some texts at once."""
    return tuple(np.concatenate(x) for x in zip(*blocks_of(texts), strict=True))


class Net:
    def __init__(self, seed: int = 7) -> None:
        r = np.random.default_rng(seed)
        f32 = lambda *s, sd=1.0: (r.standard_normal(s) * sd).astype(np.float32)
        self.p = {"embed": f32(257, EMBED, sd=0.5), "w": f32(WIDTH * (EMBED + 1), FILTERS, sd=(2 / (WIDTH * (EMBED + 1))) ** 0.5), "b": np.zeros(FILTERS, np.float32), "v": f32(2 * FILTERS, sd=0.1), "c": np.zeros(1, np.float32)}
        self.p["embed"][0] = 0
        self.constant: float | None = None

    def responses(self, codes: np.ndarray, again: np.ndarray) -> np.ndarray:
        """[chunk, place, filter] before the bias. A byte and its repeat mark select a row of a table per
        place in the filter, so a response is a sum of WIDTH rows."""
        w = self.p["w"].reshape(WIDTH, EMBED + 1, FILTERS)
        tables = np.einsum("ce,kef->kcf", self.p["embed"], w[:, :EMBED])[:, :, None, :] + np.stack([np.zeros_like(w[:, EMBED]), w[:, EMBED]], axis=1)[:, None]
        rows = codes.astype(np.intp) * 2 + again
        places = (CHUNK - WIDTH) // STRIDE + 1
        out = None
        for k in range(WIDTH):
            part = np.take(tables[k].reshape(-1, FILTERS), rows[:, k : k + STRIDE * places : STRIDE], axis=0)
            out = part if out is None else np.add(out, part, out=out)
        return out

    def pool(self, codes: np.ndarray, again: np.ndarray, places: bool = False):
        """Max-pooled, rectified responses [chunk, filter], and where the maxima stand."""
        pooled, at = np.empty((len(codes), FILTERS), self.p["b"].dtype), np.empty((len(codes), FILTERS), np.int64) if places else None
        for lo in range(0, len(codes), AT_ONCE):
            y = self.responses(codes[lo : lo + AT_ONCE], again[lo : lo + AT_ONCE])
            pooled[lo : lo + AT_ONCE] = y.max(axis=1) + self.p["b"]
            if places:
                at[lo : lo + AT_ONCE] = y.argmax(axis=1)
        return np.maximum(pooled, 0), at

    def combine(self, pooled: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
        """[text, 2 * FILTERS]: the maximum and the mean over each text's chunks (every text has one)."""
        first = np.searchsorted(owner, np.arange(n))
        counts = np.diff(np.append(first, len(owner)))
        return np.concatenate([np.maximum.reduceat(pooled, first, axis=0), np.add.reduceat(pooled, first, axis=0) / counts[:, None].astype(np.float32)], axis=1)

    def score(self, texts: list[str | None]) -> np.ndarray:
        if self.constant is not None or not texts:
            return np.full(len(texts), self.constant or 0.0)
        most, total, count = np.zeros((len(texts), FILTERS), self.p["b"].dtype), np.zeros((len(texts), FILTERS), np.float64), np.zeros(len(texts))
        for codes, again, owner in blocks_of(texts):  # a long text's chunks come in several blocks
            pooled = self.pool(codes, again)[0]
            np.maximum.at(most, owner, pooled)
            np.add.at(total, owner, pooled)
            np.add.at(count, owner, 1)
        z = np.concatenate([most, total / count[:, None]], axis=1) @ self.p["v"] + self.p["c"]
        return 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))

    def gradients(self, codes, again, owner, labels) -> dict[str, np.ndarray]:
        n = len(labels)
        pooled, at = self.pool(codes, again, places=True)
        both = self.combine(pooled, owner, n)
        z = both @ self.p["v"] + self.p["c"]
        d = ((1 / (1 + np.exp(-np.clip(z, -30, 30))) - labels) / n).astype(np.float32)
        g = {"v": both.T @ d, "c": d.sum(keepdims=True)}
        dmax, dmean = d[:, None] * self.p["v"][:FILTERS], d[:, None] * self.p["v"][FILTERS:]
        counts = np.bincount(owner, minlength=n)
        winner = pooled == both[owner, :FILTERS]
        shared = np.zeros((n, FILTERS), np.float32)
        np.add.at(shared, owner, winner.astype(np.float32))
        dp = (winner * dmax[owner] / shared[owner] + dmean[owner] / counts[owner, None]) * (pooled > 0)
        g["b"] = dp.sum(axis=0)
        g["w"], g["embed"] = np.zeros_like(self.p["w"]), np.zeros_like(self.p["embed"])
        w = self.p["w"].reshape(WIDTH, EMBED + 1, FILTERS)
        rows = np.arange(len(codes))
        for k in range(WIDTH):
            place = at * STRIDE + k  # [chunk, filter]
            code, rep = codes[rows[:, None], place], again[rows[:, None], place]
            e = self.p["embed"][code]  # [chunk, filter, EMBED]
            gw = np.einsum("cf,cfe->ef", dp, e)
            g["w"].reshape(WIDTH, EMBED + 1, FILTERS)[k] = np.concatenate([gw, (dp * rep).sum(axis=0)[None]])
            np.add.at(g["embed"], code.ravel(), (dp[:, :, None] * w[k, :EMBED].T[None]).reshape(-1, EMBED))
        g["embed"][0] = 0
        return g

    def fit(self, texts: list[str], labels: np.ndarray, epochs: int = 14, batch: int = 32, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Net:
        if not len(labels) or labels.min() == labels.max():
            self.constant = float(labels.mean()) if len(labels) else 0.5
            return self
        data = [chunks_of([t])[:2] for t in texts]
        share = float(labels.mean())
        self.p["c"][:] = np.log(share / (1 - share))
        m, s = {k: np.zeros_like(v) for k, v in self.p.items()}, {k: np.zeros_like(v) for k, v in self.p.items()}
        r, t, steps = np.random.default_rng(seed), 0, epochs * -(-len(texts) // batch)
        for _ in range(epochs):
            order = r.permutation(len(texts))
            for lo in range(0, len(order), batch):
                own = order[lo : lo + batch]
                codes, again = np.concatenate([data[i][0] for i in own]), np.concatenate([data[i][1] for i in own])
                g = self.gradients(codes, again, np.repeat(np.arange(len(own)), [len(data[i][0]) for i in own]), labels[own].astype(np.float32))
                t += 1
                now = rate * (1 - t / (steps + 1))
                for k in self.p:
                    x = g[k] + decay * self.p[k]
                    m[k] = 0.9 * m[k] + 0.1 * x
                    s[k] = 0.999 * s[k] + 0.001 * x * x
                    self.p[k] = (self.p[k] - now * (m[k] / (1 - 0.9**t)) / (np.sqrt(s[k] / (1 - 0.999**t)) + 1e-8)).astype(np.float32)
        return self


def draw_sample(docs: DataFrame, labels: DataFrame, most: int, most_chunks: int, longest: int) -> list[tuple[str, int]]:
    """(text, quality) of the labelled documents of least draw, at most `most` and `most_chunks` chunks in all.

    A draw is a hash of the id. The rows to take are chosen by id, hash and size alone; only their
    texts, at most `most_chunks` chunks, are then fetched.
    """
    draw = F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), F.lit(5)), 11) * F.lit(2.0**-53)
    marked = labels.filter("quality in (0, 1)").filter(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("__d")).agg(F.max("quality").cast("int").alias("quality"))
    total = marked.count()
    chosen = marked.withColumnRenamed("__d", "doc_id").withColumn("draw", draw).filter(F.col("draw") < min(1.0, 1.5 * most / max(total, 1))).withColumnRenamed("doc_id", "__d")
    full = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).withColumn("h", F.xxhash64("text")).withColumn("chunks", F.greatest(F.lit(1), F.ceil((F.octet_length("text") - (CHUNK - STEP)) / STEP)))
    fits = full.filter(F.col("chunks") <= longest)
    # About 1.5 * most ids, each once; of texts with the same id the one of least hash.
    narrow = fits.join(F.broadcast(chosen), fits["doc_id"] == chosen["__d"]).groupBy("doc_id", "quality", "draw").agg(F.min(F.struct("h", "chunks")).alias("t"))
    rows, room, used = sorted(narrow.select("doc_id", "quality", "draw", "t.h", "t.chunks").collect(), key=lambda r: (r["draw"], r["doc_id"])), most_chunks, []
    for r in rows[:most]:
        if r["chunks"] <= room:
            used.append(r)
            room -= r["chunks"]
    if not used:
        return []
    kind = docs.schema["doc_id"].dataType.simpleString()
    want = docs.sparkSession.createDataFrame([(r["doc_id"], r["h"]) for r in used], f"doc_id {kind}, h long")
    texts = {r["doc_id"]: r["text"] for r in fits.join(F.broadcast(want), ["doc_id", "h"], "left_semi").dropDuplicates(["doc_id"]).select("doc_id", "text").collect()}
    return [(texts[r["doc_id"]], r["quality"]) for r in used]


def train(docs: DataFrame, labels: DataFrame, most: int = 2000, most_chunks: int = 30_000, longest: int = 3750, epochs: int = 14) -> Net:
    """A network from docs(doc_id, text) and labels(doc_id, quality), all of which may be learned from."""
    rows = draw_sample(docs, labels, most, most_chunks, longest)
    return Net().fit([t for t, _ in rows], np.array([q for _, q in rows], np.float64), epochs=epochs)


def score(docs: DataFrame, net: Net) -> DataFrame:
    """docs(doc_id, text) as (doc_id, score)."""
    held = docs.sparkSession.sparkContext.broadcast(net)

    def run(batches):
        cache_of("quality_net")
        for part in parts(batches, 1, 64):
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(held.value.score(part.column(1).to_pylist()), pa.float64())], ["doc_id", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, score double")


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    seen = remainder("doc_id", 5) != 0
    net = train(docs.filter(seen), labels.filter(seen))
    out = score(docs, net)
    return out.select("doc_id", (remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
