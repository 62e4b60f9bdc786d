"""Source divergence against plain loops over Python integers."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from chronofold.llm import divergence as D
from llm_cases import ODD, prose

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")


def brute(rows, least=3, top=200):
    """rows: (text, lang, source)."""
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    rows = [((t or "").translate(lower), g or "", s or "") for t, g, s in rows]
    out = set()
    for lang in {g for _, g, _ in rows}:
        mine = [(Counter(TERM.findall(t)), s) for t, g, s in rows if g == lang]
        docs = Counter(w for c, _ in mine for w in c)
        kept = sorted((w for w, n in docs.items() if n >= least), key=lambda w: w.encode())

        def p_of(counts):
            n = sum(counts[w] for w in kept)
            return {w: 1 + 10**9 * (counts[w] + 1) // (n + len(kept)) for w in kept}

        sources = sorted({s for _, s in mine})
        total = {s: sum((c for c, x in mine if x == s), Counter()) for s in sources}
        p = {s: p_of(total[s]) for s in sources}
        q = p_of(sum(total.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in sources:
            pairs = [(-sum(f(p[s][w], p[o][w]) for w in kept), o.encode()) for o in sources if o != s]
            terms = [(-f(p[s][w], q[w]), w.encode()) for w in kept if total[s][w] and p[s][w] > q[w]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, i.decode(), -v, r + 1) for r, (v, i) in enumerate(found)}
    return out


def run(spark, rows, **more):
    df = spark.createDataFrame([(i, t, g, s, "x", "y") for i, (t, g, s) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, chunk string").repartition(4)
    got = D.source_divergence(df, **more)
    assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
    rows = [tuple(r) for r in got.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def corpus():
    r = random.Random(2)
    words = prose(1, 150).split() + ["Éa", "éa", "ßx", "日本", "zA", "za"]
    rows = [(" ".join(r.choice(words[: 20 + 9 * (i % 15)]) for _ in range(r.randint(0, 60))), r.choice(["en", "de"]), r.choice("abcde")) for i in range(200)]
    rows += [(t, "en" if i else None, "a") for i, t in ODD] + [("only once here", "fr", "a"), (None, "fr", "b"), ("", "it", None), (None, None, None), ("a1b_C\0d\x7fe", "en", "a")]
    return rows + [("hot hot copy", "en", "a")] * 300


@pytest.mark.parametrize("more", [{}, {"chunk": 7, "block": 2, "top_terms": 5}])
def test_against_loops(spark, monkeypatch, more):
    if more:
        for name, value in (("MOST_TOKENS", 50), ("CUT_ROWS", 11), ("SLICE", 40), ("SALTS", 3)):
            monkeypatch.setattr(D, name, value)
    assert run(spark, corpus(), **more) == brute(corpus(), top=more.get("top_terms", 200))


def test_empty_and_termless(spark):
    assert run(spark, []) == set()
    rows = [(None, "en", "a"), ("1 2", "en", "b"), ("x", "en", "c")]
    assert run(spark, rows) == brute(rows) and len(brute(rows)) == 6


def test_shares_at_any_size():
    rng = np.random.default_rng(0)
    for whole in (1, 7, 999, 10**9, 10**12 + 7, (1 << 53) - 1, (1 << 53) + 5, 1 << 60):
        c = rng.integers(0, whole, 200)
        assert D.shares(c, whole).tolist() == [1 + 10**9 * (int(x) + 1) // whole for x in c]
