import hashlib
import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from plexigraph.llm import packing
from tests.llm.brute import near_components
from tests.llm.test_decontaminate import brute as contaminated

GERMAN, ENGLISH = "der die das und nicht ein mit auf für werden haben über".split(), "the and of to in that with from have which they this".split()
#: Texts of no language that can be learned (their rows are no training rows).
UNKNOWN = [("これは日本語の文章です。天気がいいので散歩に行きます。", None), ("Привет мир, это русский текст о погоде и природе", None), ("Το ελληνικό κείμενο είναι εδώ για δοκιμή", None)]
ITEM = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi"


def corpus():
    r = random.Random(9)
    rows = []
    for i in range(70):
        words = GERMAN if i % 3 == 0 else ENGLISH
        body = [" ".join(r.choice(words) + r.choice(["", "", "er", "ly", "ung"]) for _ in range(12)) for _ in range(4)]
        if i % 5 == 0:
            body.insert(1, "All Rights reserved ")
        if i % 17 == 0:
            body.append(ITEM)
        rows.append([i, "\n".join(body), "de" if i % 3 == 0 else "en"])
    rows += [[110 + k, t, lang] for k, (t, lang) in enumerate(UNKNOWN)]
    rows += [[100, rows[3][1], "de"], [101, rows[4][1].replace("\n", "  ", 1), "en"], [102, rows[7][1] + " extra", "en"], [103, None, "en"], [104, "", "en"], [105, "12 34 !!", "en"], [6, rows[6][1], "de"]]
    return [tuple(x) for x in rows]


def brute(rows, items):
    """Ids and texts that the filtering stages keep, in plain Python."""
    rows = [(i, t) for i, t, _ in rows if t and any(c.isalpha() for c in t) and t not in dict(UNKNOWN)]
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").lower()
    counts = {}
    for _, t in rows:
        for k in {key(x) for x in t.split("\n")}:
            counts[k] = counts.get(k, 0) + 1
    rows = [(i, "\n".join(x for x in t.split("\n") if not key(x) or counts[key(x)] < 10)) for i, t in rows]
    near = near_components(rows, k=5, percent=80)
    rows = sorted({rows[n] for n, (_, c) in near.items() if rows[n][0] == c})
    bad = {x[0] for x in contaminated(rows, items) if x[4]}
    return [(i, t) for i, t in rows if i not in bad]


def test_run_matches_brute_force(spark, make, tmp_path):
    rows = corpus()
    make(rows).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    model = Tokenizer.from_file(packing.tokenizer_file())
    want = []
    for i, t in brute(rows, [(1, ITEM)]):
        ids = np.array([*model.encode(t, add_special_tokens=False).ids, 1], "<u4").tobytes()
        want.append((i, len(ids) // 4, zlib.crc32(ids)))
    assert sorted((r["doc_id"], r["length"], r["ids_crc32"]) for r in got) == want
    assert 40 < len(want) < 70
    by = {}
    for r in got:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        assert [o for o, _ in sorted(own)] == list(np.cumsum([0, *(n for _, n in sorted(own))])[:-1])


def test_stages_keep_the_columns(spark, make, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = make(corpus())
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language id", "line dedup", "minhash near-dedup", "benchmark decontamination", "best-fit packing"]


def test_language_stage_keeps_known_and_rejects_unknown_texts(spark, make, tmp_path):
    kept = {r["doc_id"] for r in corpus_pipeline.identify_language(spark, make(corpus()), str(tmp_path)).collect()}
    assert kept == {i for i, t, _ in corpus() if t and any(c.isalpha() for c in t) and t not in dict(UNKNOWN)}


def test_long_texts_and_clashing_columns(spark, make, tmp_path):
    spark.createDataFrame([(1, ITEM)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    rows = [*corpus(), (500, " ".join(f"the{k % 977} and{k % 89} of" for k in range(60_000)), "en"), (None, "the and of to in that with from", None)]
    docs = make(rows)
    docs.selectExpr("*", "'x' as n_lines", "1 as kept", "2 as component_id", "3 as `offset`", "4 as score").write.parquet(str(tmp_path / "documents.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = {r["doc_id"] for r in got}
    assert None in ids and sorted(r["piece"] for r in got if r["doc_id"] == 500) == list(range(sum(r["doc_id"] == 500 for r in got)))
    assert sum(r["doc_id"] == 500 for r in got) > 10


def test_empty_documents(spark, make, tmp_path):
    make([]).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_sql_of_the_queries_agrees(spark):
    """Every query with SQL gives the SQL's rows on the smallest tables."""
    from plexigraph.llm import queries
    from tests.oracle import same

    for name, sql in queries.SQL.items():
        assert same(spark, queries.QUERIES[name], sql, "/root/testdata/sf0.001"), name
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")
