import re

import pytest

from plexigraph.llm import decontaminate

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def words(t):
    return WORD.findall((t or "").translate(LOWER))


def brute(docs, items, size=13):
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for item, text in items:
            v = words(text)
            for win in {tuple(v[k : k + size]) for k in range(max(1, len(v) - size + 1))} if v else ():
                for s in range(len(w) - len(win) + 1):
                    if tuple(w[s : s + len(win)]) == win:
                        hit.update(range(s, s + len(win)))
                        if item is not None:
                            found.add(str(item))
        out.append((i, len(w), len(hit), sorted(found), bool(hit) and 20 * len(hit) >= len(w)))
    return sorted(out, key=repr)


def result(df):
    return sorted(((r["doc_id"], r["n_words"], r["n_hit"], r["items"], r["contaminated"]) for r in df.collect()), key=repr)


A = "Alpha beta, gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron"
ITEMS = [(1, A), (1, A), (2, "short item here"), (3, None), (4, "... !!"), (None, "null id words"), (5, "Überß ÉTÉ x"), (6, "a a a"), (11, "gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho")]
DOCS = [
    (1, "start " + A.upper() + " end " + "w " * 300), (2, "short ITEM here"), (3, None), (4, ""), (5, "..."), (6, "null id words, short item"),
    (7, "überß éTé x"), (7, "Überß Été x"), (7, "Überß ÉtÉ x"), (8, "a a a a a b a a"), (9, A + " " + A), (9, A + " " + A), (None, "x short item here"), (10, "filler " * 40_000 + A),
    (11, " ".join(A.split()[:12])), (12, "İ short item here Σας"),
]


def test_brute_force(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    docs = make(DOCS).withColumnRenamed("source", "n_hit")
    assert result(decontaminate.decontaminate(docs, items)) == brute(DOCS, ITEMS)


def test_exchange_instead_of_broadcast(spark, make):
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert result(decontaminate.decontaminate(make(DOCS), items, broadcast_rows=0)) == brute(DOCS, ITEMS)


def test_clean_keeps_the_rest(spark, make):
    items = spark.createDataFrame([(1, A)], "item_id long, text string")
    out = decontaminate.clean(make([(1, A), (2, "other words"), (3, None), (None, A), (None, "fine")]), items)
    assert sorted((r["doc_id"] for r in out.collect()), key=repr) == sorted([2, 3, None], key=repr)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.mark.parametrize(("docs", "items"), [([], ITEMS), (DOCS[:4], []), ([], [])])
def test_empty_tables(spark, make, docs, items):
    got = decontaminate.decontaminate(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == brute(docs, items)


def test_only_a_to_z_are_lower_cased(spark, make):
    """Capitals that newer character tables know, the long Greek and Turkish cases, and one-word items by the hundred."""
    odd = ["Ⱟ", "Ꟁ", "\U00010570", "İ", "Σ", "ẞ"]
    items = [(k, f"item {c} x{k}") for k, c in enumerate(odd)] + [(90, "Mono"), (91, "mono"), (92, "duo duo")]
    docs = [(k, f"ITEM {c} X{k}") for k, c in enumerate(odd)] + [(20 + k, f"item {c.lower()} x{k}") for k, c in enumerate(odd)] + [(50, "mono " * 400 + "duo duo duo"), (51, "duo mono")]
    got = decontaminate.decontaminate(make(docs), spark.createDataFrame(items, "item_id long, text string"))
    assert result(got) == brute(docs, items)
