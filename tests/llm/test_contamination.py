import re
from collections import Counter

import pytest

from chronofold.llm import decontaminate
from llm_cases import ODD, prose

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")


def words(t):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))


ITEMS = [(1, prose(1, 30)), (2, prose(2, 13)), (3, "Only Four É words"), (4, None), (5, "..."), (6, prose(1, 30)), (7, "one")]
ROWS = ODD + [(20, prose(9, 40) + " " + prose(1, 30).upper() + ", end"), (21, "x " + prose(2, 13)), (22, "but only; four é WORDS here"), (23, prose(5, 900) + " " + prose(2, 13)), (24, prose(2, 12)), (25, "one one two"), (26, prose(1, 30) + " " + prose(1, 30))]


def brute(t):
    w, hit, items = words(t), set(), set()
    for i, x in ITEMS:
        g = words(x)
        n = min(13, len(g))
        for a in range(len(g) - n + 1 if n else 0):
            for b in range(len(w) - n + 1):
                if w[b : b + n] == g[a : a + n]:
                    hit |= set(range(b, b + n))
                    items.add(i)
    return len(w), len(hit), len(items), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("broadcast", [decontaminate.MOST_BROADCAST, 0])
def test_against_brute_force(spark, docs, broadcast):
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    got = Counter((r["doc_id"], r["n_words"], r["n_hit"], r["n_items"], r["contaminated"]) for r in decontaminate.contamination(docs(ROWS), bench, most_broadcast=broadcast).collect())
    assert got == Counter((i, *brute(t)) for i, t in ROWS)


def test_removal(spark, docs):
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    d = docs([(1, "keep " + prose(2, 13)), (2, "clean")])
    assert [r["doc_id"] for r in decontaminate.decontaminate(d, bench).collect()] == [2]
    assert {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(d, bench, mode="words").collect()} == {1: "keep ", 2: "clean"}


def test_rows_of_one_id_are_judged_each_by_its_own_text(spark, docs):
    bench = spark.createDataFrame(ITEMS[:2], "item_id long, text string")
    rows = [(1, "x " + prose(2, 13)), (1, "clean"), (None, "y " + prose(2, 13)), (None, "fine"), (None, "fine"), (4, None), (4, None)]
    left = decontaminate.decontaminate(docs(rows), bench).collect()
    assert Counter((r["doc_id"], r["text"]) for r in left) == Counter([(1, "clean"), (None, "fine"), (None, "fine"), (4, None), (4, None)])


def test_words_mode_leaves_the_rest_of_the_text_as_it_is(spark, docs):
    bench = spark.createDataFrame([(1, "Only Four É words")], "item_id long, text string")
    rows = [(1, "Hello, World! Keep: only (four) É-WORDS; This."), (2, "\n«Only four É words» Só"), (3, "Hello, World! Keep This."), (4, "only four É words"), (5, "A only four É words, only four É words B")]
    got = {r["doc_id"]: r["text"] for r in decontaminate.decontaminate(docs(rows), bench, mode="words").collect()}
    assert got == {1: "Hello, World! Keep: ; This.", 2: rows[1][1], 3: rows[2][1], 4: "", 5: "A  B"}


def test_empty_tables(spark, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(docs([]), bench).count() == 0
    assert decontaminate.contamination(docs(ODD), bench).where("contaminated").count() == 0
