"""Language ID: sparse multinomial logistic regression on TF-IDF of character n-grams.

Features are hashed n-grams of 1 to 3 code points of the lower-cased text, whose ASCII other than
letters counts as spaces, term frequencies relative
to the text's length, weighted by inverse document frequency and normalised to sum 1. Weights are
trained with follow-the-regularised-leader (per-coordinate FTRL-proximal, elastic-net penalties, so
most stay exactly zero); a temperature fitted on held-back rows of the sample calibrates the scores.

Document frequencies are counted over all training documents, as partial vectors per task that
Spark sums (2^bits rows at most). The fit uses a bounded sample: of each language the `per_language`
documents of least hash of id and text, fewer where all languages would give more than `most` (one
each at least), none of more than `longest` characters unless a language has no other, so the driver
holds a bounded number of features and no language is left out. All three are parameters. A fifth
of each language's sample is held back for the temperature.
Every text is read whole; its score is a sum over its n-grams, gathered in numpy batch by batch.

Prediction uses the text only. Null texts and texts without a letter are `und` with score 0, as are
all where no language could be learned (an empty table, or no labels). Repeated rows are predicted
each. Extra columns are ignored. A language held by a third of all rows weighs no more than others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from plexigraph.llm._common import cache_of, parts, table

BITS, ORDERS = 16, (1, 2, 3)
U = np.uint64
_ODD = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))
SLICE_CHARS, ROWS = 1 << 18, 512
#: ASCII that isn't a letter says nothing of a language and counts as a space; so numbers and addresses don't drown words.
_ASCII = np.array([c if chr(c).isalpha() else 0x20 for c in range(128)], U)


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def ngram_buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(bucket of every n-gram, text of every n-gram); texts are joined so numpy sees them at once.

    Grams that would reach into the next text are those of the text padded with spaces. Runs of
    spaces count as one.
    """
    pad = " " * (max(ORDERS) - 1)
    low = [t.lower() + pad for t in texts]
    chars = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(U)
    chars[chars < 128] = _ASCII[chars[chars < 128]]
    owner = np.repeat(np.arange(len(low)), [len(t) for t in low])
    n = len(chars) - (max(ORDERS) - 1)
    owner = owner[:n]
    inside = np.concatenate([np.arange(len(t)) < len(t) - len(pad) for t in low])[:n] if low else np.zeros(0, bool)
    inside &= (chars[:n] != U(0x20)) | (chars[1 : n + 1] != U(0x20))
    h, found = np.zeros(n, U), []
    for k in range(max(ORDERS)):
        h = (h + chars[k : k + n] + U(k + 1)) * _ODD[k % 3]
        if k + 1 in ORDERS:
            x = h ^ (h >> U(29))
            found.append(((x * _ODD[1]) >> U(64 - BITS)).astype(np.int32)[inside])
    owner = owner[inside]
    return np.stack(found), owner


def _slices(texts: list[str]):
    """Index ranges of at most about SLICE_CHARS characters, one text at least."""
    lo, size = 0, 0
    for k, t in enumerate(texts):
        if size and size + len(t) > SLICE_CHARS:
            yield lo, k
            lo, size = k, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def remainder(doc_id: str, by: int) -> Column:
    """crc32 of the id as text, mod `by`; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % by


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """(documents with each bucket, documents) over all of docs(text)."""

    def count(batches):
        cache_of("language_id")
        total, n = np.zeros(1 << BITS, np.int64), 0
        for batch in parts(batches, 0, ROWS):
            texts = batch.column(0).to_pylist()
            for lo, hi in _slices(texts):
                buckets, owner = ngram_buckets(texts[lo:hi])
                for at in range(lo, hi, 64):
                    there = np.zeros((64, 1 << BITS), bool)
                    a, b = np.searchsorted(owner, [at - lo, at - lo + 64])
                    for row in buckets:
                        there[owner[a:b] - (at - lo), row[a:b]] = True
                    total += there.sum(axis=0)
                n += hi - lo
        k = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(k, -1), pa.int32()), pa.array(np.append(total[k], n))], ["k", "n"])

    df, n = np.zeros(1 << BITS, np.int64), 0
    for r in docs.mapInArrow(count, "k int, n long").groupBy("k").agg(F.sum("n").alias("n")).collect():
        if r["k"] < 0:
            n = r["n"]
        else:
            df[r["k"]] = r["n"]
    return df, n


def sample_features(docs: DataFrame) -> list[tuple[str, float, np.ndarray, np.ndarray]]:
    """(lang, draw, buckets, counts) of docs(text, lang, draw), made on the executors."""

    def run(batches):
        for batch in batches:
            for text, lang, draw in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                b, n = np.unique(ngram_buckets([text])[0], return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang]), pa.array([draw]), pa.array([b.astype("<i4").tobytes()], pa.binary()), pa.array([n.astype("<i4").tobytes()], pa.binary())], ["lang", "draw", "b", "n"])

    rows = docs.mapInArrow(run, "lang string, draw double, b binary, n binary").collect()
    return sorted(((r["lang"], r["draw"], np.frombuffer(r["b"], "<i4"), np.frombuffer(r["n"], "<i4").astype(np.float64)) for r in rows), key=lambda r: (r[1], r[0], len(r[2])))


class Model:
    """weights[bucket, language + 1]: IDF times weight, and IDF alone for the norm."""

    def __init__(self, langs: list[str], idf: np.ndarray, w: np.ndarray, bias: np.ndarray, scale: float, temperature: float) -> None:
        self.langs, self.bias, self.temperature = langs, bias, temperature
        self.table = np.concatenate([w * idf[:, None] * scale, idf[:, None]], axis=1).astype(np.float32)

    def scores(self, texts: list[str]) -> np.ndarray:
        """Calibrated probabilities [text, language]."""
        logits = np.zeros((len(texts), len(self.langs)))
        for lo, hi in _slices(texts):
            buckets, owner = ngram_buckets(texts[lo:hi])
            sums = np.zeros((hi - lo, self.table.shape[1]))
            there, first = np.unique(owner, return_index=True)
            if len(first):
                for row in buckets:
                    sums[there] += np.add.reduceat(self.table[row], first, axis=0, dtype=np.float64)
            logits[lo:hi] = sums[:, :-1] / np.maximum(sums[:, -1:], 1e-12) + self.bias
        return softmax(logits / self.temperature)


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def ftrl(rows: list[tuple[int, np.ndarray, np.ndarray]], classes: int, epochs: int, alpha: float, beta: float, l1: float, l2: float) -> tuple[np.ndarray, np.ndarray]:
    """(weights, bias) by FTRL-proximal over rows (label, buckets, values)."""
    z, n = np.zeros((1 << BITS, classes)), np.zeros((1 << BITS, classes))
    zb, nb = np.zeros(classes), np.zeros(classes)

    def weights(z, n):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((beta + np.sqrt(n)) / alpha + l2))

    for _ in range(epochs):
        for label, b, x in rows:
            zs, ns = z[b], n[b]
            w, bias = weights(zs, ns), -zb / ((beta + np.sqrt(nb)) / alpha + l2)
            p = softmax(x @ w + bias)
            p[label] -= 1
            g = x[:, None] * p
            grown = ns + g * g
            z[b], n[b] = zs + g - (np.sqrt(grown) - np.sqrt(ns)) / alpha * w, grown
            grown = nb + p * p
            zb, nb = zb + p - (np.sqrt(grown) - np.sqrt(nb)) / alpha * bias, grown
    return weights(z, n), -zb / ((beta + np.sqrt(nb)) / alpha + l2)


def fit_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of 0.05 to 20 with the least negative log-likelihood (golden section on its log).

    The labels count as right in n + 1 of n + 2 cases, as in Platt's scaling: held-back rows without
    an error would else call for boundless confidence.
    """
    n, k = logits.shape
    target = np.full((n, k), 1 / (n + 2) / max(1, k - 1))
    target[np.arange(n), labels] = (n + 1) / (n + 2)
    loss = lambda t: -(target * np.log(np.maximum(softmax(logits / np.exp(t)), 1e-12))).sum(axis=1).mean()
    a, b, r = np.log(0.05), np.log(20.0), (5**0.5 - 1) / 2
    for _ in range(40):
        c, d = b - r * (b - a), a + r * (b - a)
        a, b = (a, d) if loss(c) < loss(d) else (c, b)
    return float(np.exp((a + b) / 2))


def draw_sample(labelled: DataFrame, per_language: int, most: int, longest: int) -> DataFrame:
    """(text, lang, draw): of each language the documents of least draw, at most its share of `most`.

    A draw is a hash of id and text, so the sample depends on neither order nor parallelism, and
    repeated rows are one. A language with only texts over `longest` gives an eighth of its share.
    """
    draw = (F.shiftrightunsigned(F.xxhash64(F.col("doc_id").cast("string"), "text"), 11) * F.lit(2.0**-53)).cast("double")
    drawn, short = labelled.select("text", "lang", draw.alias("draw")), F.length("text") <= longest
    # Different draws are counted, as a row repeated many times is one of the sample; twice what is wanted is looked at.
    counts = drawn.groupBy("lang").agg(F.approx_count_distinct("draw").alias("n"), F.approx_count_distinct(F.when(short, F.col("draw"))).alias("short")).collect()  # a row per language
    if not counts:
        return drawn.limit(0)
    share = max(1, min(per_language, most // len(counts)))
    want = {r["lang"]: share if r["short"] else max(1, share // 8) for r in counts}
    odds = {r["lang"]: min(1.0, (2.0 * want[r["lang"]] + 16) / max(1, r["short"] or r["n"])) for r in counts}
    long = sorted(r["lang"] for r in counts if not r["short"])
    of = lambda d: F.create_map(*[F.lit(x) for k in sorted(d) for x in (k, d[k])])[F.col("lang")]
    drawn = drawn.filter(short | F.col("lang").isin(long) if long else short)
    low: dict[str, list[float]] = {}
    for r in drawn.filter(F.col("draw") < of(odds)).select("lang", "draw").distinct().collect():  # about 2 * share + 16 numbers a language
        low.setdefault(r["lang"], []).append(r["draw"])
    last = {k: sorted(v)[: want[k]][-1] for k, v in low.items()}
    if not last:
        return drawn.limit(0)
    return drawn.filter(F.col("draw") <= of(last)).dropDuplicates(["lang", "draw"])


def train(docs: DataFrame, per_language: int = 600, most: int = 4000, longest: int = 50_000, epochs: int = 4, scale: float = 50.0, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.05, l2: float = 0.1) -> Model | None:
    """A model from docs(doc_id, text, lang), all of which may be learned from."""
    labelled = docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull()).select("doc_id", "text", "lang")
    df, n = document_frequency(labelled.select("text"))
    if not n:
        return None
    idf = np.log((1 + n) / (1 + df)) + 1
    features = sample_features(draw_sample(labelled, per_language, most, longest))
    langs, own = sorted({f[0] for f in features}), {}
    for f in features:
        own.setdefault(f[0], []).append(f)
    # Languages take turns, each in the order of its draws; every fifth row of one is held back.
    turns = sorted((((k + 0.5) / len(fs), langs.index(lang), k % 5 == 4, f) for lang, fs in own.items() for k, f in enumerate(fs)), key=lambda t: t[:2])
    rows = []
    for _, label, back, (_, _, b, c) in turns:
        x = c * idf[b]
        rows.append((label, b, scale * x / max(x.sum(), 1e-12), back))
    kept, held = [r for r in rows if not r[3]], [r for r in rows if r[3]]
    w, bias = ftrl([r[:3] for r in kept], len(langs), epochs, alpha, beta, l1, l2)
    check = held or rows
    logits, labels = np.array([x @ w[b] + bias for _, b, x, _ in check]), np.array([r[0] for r in check])
    return Model(langs, idf, w, bias, scale, fit_temperature(logits, labels))


def _best(model: Model | None, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    known = [k for k, t in enumerate(texts) if has_letter(t)] if model else []
    if known:
        p = model.scores([texts[k] for k in known])
        best = p.argmax(axis=1)
        score[known] = p[np.arange(len(best)), best]
        for k, b in zip(known, best, strict=True):
            pred[k] = model.langs[b]
    return pred, score


def keep_known(docs: DataFrame, model: Model | None, least: float) -> DataFrame:
    """docs, all columns, whose text has a letter and a language with a score of `least` or more.

    Without a model (no labelled document at all) texts with a letter stay.
    """
    held, at = docs.sparkSession.sparkContext.broadcast(model), docs.columns.index("text")

    def run(batches):
        cache_of("language_id")
        for batch in parts(batches, at, ROWS):
            texts = batch.column(at).to_pylist()
            if held.value is None:
                keep = [has_letter(t) for t in texts]
            else:
                keep = [x != "und" and y >= least for x, y in zip(*_best(held.value, texts), strict=True)]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """docs(doc_id, text) as (doc_id, lang_pred, score)."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        cache_of("language_id")
        for batch in parts(batches, 1, ROWS):
            pred, score = _best(held.value, batch.column(1).to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, lang_pred string, score double")


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = train(docs.filter(remainder("doc_id", 3) != 1))
    out = predict(docs, model)
    return out.select("doc_id", (remainder("doc_id", 3) == 1).alias("held_out"), "lang_pred", "score")
