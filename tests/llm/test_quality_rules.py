import re

from plexigraph.llm import quality_rules as q

W = re.compile(r"[^\x20\x09-\x0D]+")


def brute(t):
    t = t or ""
    w = W.findall(t)
    win = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    hit = {k for i, x in enumerate(win) if win.count(x) > 1 for k in range(i, i + 5)}
    lines = [x for x in t.split("\n") if W.search(x)]
    return (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines), len(lines) - len(set(lines)), len(hit), sum("A" <= c <= "Z" for c in t), sum(a == b for a, b in zip(w, w[1:])))


ROWS = [
    (1, None), (2, ""), (3, " \n\t"), (4, "one two three four five six seven eight nine ten"), (5, "a b c d e a b c d e"), (6, "x x x x x x x"), (7, "### $$$ | a\n\na\na\n b "),
    (8, "w " * 5), (9, "ü é ñ x  y"), (10, " ".join(f"k{i % 700}" for i in range(2500))), (4, "one two three four five six seven eight nine ten"), (None, "A B C D E"),
]


def test_measures(make):
    got = sorted(((r["doc_id"], *(r[m] for m in q.MEASURES)) for r in q.ledger(make(ROWS).withColumnRenamed("source", "failed")).collect()), key=repr)
    assert got == sorted(((i, *brute(t)) for i, t in ROWS), key=repr)


def test_policies_and_ablations(make):
    rows = q.ledger(make(ROWS)).cache()
    kept = q.apply_policies(rows).collect()
    for r in kept:
        for p in q.POLICIES:
            assert r[f"kept_v{p.version}"] == (r["failed"] & p.mask == 0)
    policy = q.POLICIES[-1]
    bits = {name: 1 << b for b, name, _ in q.RULES}
    failed = [r["failed"] & policy.mask for r in kept]
    for r in q.ablations(rows, policy).collect():
        b = bits[r["rule"]]
        assert (r["n_failed"], r["n_only"], r["n_kept_without"]) == (sum(bool(f & b) for f in failed), sum(f == b for f in failed), sum(f & ~b == 0 for f in failed))


def test_empty_table(make):
    assert q.ledger(make([])).count() == 0
    assert q.ablations(q.ledger(make([])), q.POLICIES[0]).count() == 0
