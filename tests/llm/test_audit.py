"""The filter audit against applying the filters one after the other, and its odd cases."""

from collections import Counter
from itertools import permutations

import pytest

from tracklens.llm import audit

DOCS, LABELS = "doc_id bigint, text string, lang string, extra int", "doc_id bigint, quality int, toxic int"
LONG = " ".join(f"w{k}" for k in range(120))
ROWS = [
    (1, LONG, "en", 0), (2, LONG, "en", 0), (3, LONG, "de", 0), (4, LONG + " #", "en", 0), (5, "a a a a", "en", 0), (5, "a a a a", "en", 0), (6, None, None, 0), (7, "", "", 0),
    (8, "ABC def", "de", 0), (9, LONG.upper(), "de", 0), (9, LONG.upper(), "en", 0), (10, "x | y " * 60, "en", 0), (None, LONG, "en", 0), (None, None, None, 0), (11, "x " * 200, "fr", 0), (12, LONG, "en", 0),
]
TOLD = [(1, 1, 0), (2, 1, 1), (3, 0, 1), (3, 1, None), (4, None, 1), (8, 1, 0), (99, 1, 1), (None, 1, 1)]


def fails(doc_id, text, firsts):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r" else c for c in text).split(" ") if w]
    return {
        "A": len(words) < 100, "B": 100 * len(set(words)) < 80 * len(words), "C": 100 * sum("A" <= c <= "Z" for c in text) > 10 * len(text), "D": any(c in "#$%&*|" for c in text),
        "E": doc_id is not None and firsts[text] < doc_id,
    }


def plain(rows, told):
    firsts = {}
    for i, text, *_ in rows:
        if i is not None:
            firsts[text or ""] = min(i, firsts.get(text or "", i))
    good, toxic = ({i for i, *x in told if x[k] == 1 and i is not None} for k in (0, 1))
    docs = [(lang or "", i, fails(i, text or "", firsts)) for i, text, lang, _ in rows]
    out, shapley = {}, Counter()
    for part in {p for p, *_ in docs}:
        for order in permutations("ABCDE"):
            left = [(i, f) for p, i, f in docs if p == part]
            every = left
            for step, name in enumerate(order, 1):
                taken = [i for i, f in left if f[name]]
                left = [(i, f) for i, f in left if not f[name]]
                failing = sum(f[name] for _, f in every)
                out[part, "".join(order), step] = (len(left), len(taken), failing - len(taken), sum(f[name] and sum(f.values()) == 1 for _, f in every), sum(i in good for i in taken), sum(i in toxic for i in taken))
                shapley[part, name] += len(taken)
    return {k: (*v, shapley[k[0], k[1][k[2] - 1]]) for k, v in out.items()}


def test_against_applying_the_filters(spark):
    got = audit.interactions(spark.createDataFrame(ROWS, DOCS), spark.createDataFrame(TOLD, LABELS)).collect()
    assert {(r["part"], r["filter_order"], r["step"]): tuple(r[3:]) for r in got} == plain(ROWS, TOLD)
    assert len(got) == 4 * 600


@pytest.mark.parametrize("n", [1, 2, 3, 5])
def test_swaps_visit_every_order_once(n):
    order, seen = list(range(n)), {tuple(range(n))}
    for k in audit.swaps(n):
        order[k], order[k + 1] = order[k + 1], order[k]
        assert tuple(order) not in seen
        seen.add(tuple(order))
    assert seen == set(permutations(range(n)))


def test_empty_tables(spark):
    none, labels = spark.createDataFrame([], DOCS), spark.createDataFrame([], LABELS)
    assert audit.interactions(none, labels).count() == 0
    rows = audit.interactions(spark.createDataFrame(ROWS[:1], DOCS), labels).collect()
    assert len(rows) == 600 and {r["kept"] for r in rows} == {1} and not any(r["good_lost"] for r in rows)
