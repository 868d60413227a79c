import re

import pytest

from recuento.llm.decontam import shared_spans, words_within

DOC = "doc_id long, text string, words string, bits string"
ITEM = "item_id long, text string, doc_id string"


def words(text):
    return re.findall(r"[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, span=10):
    """Hit words and items by comparing every window with every window."""
    windows = {}
    for i, t in items:
        w = words(t)
        n = min(span, len(w))
        for s in range(len(w) - n + 1) if n else ():
            windows.setdefault(tuple(w[s : s + n]), set()).add("" if i is None else str(i))
    out = []
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for window, names in windows.items():
            for s in range(len(w) - len(window) + 1):
                if tuple(w[s : s + len(window)]) == window:
                    hit |= set(range(s, s + len(window)))
                    found |= names
        out.append((i, len(w), len(hit), sorted(found)))
    return sorted(out, key=str)


def found(spark, docs, items, **options):
    docs = spark.createDataFrame([(*d, "x", "y") for d in docs], DOC).repartition(3)
    items = spark.createDataFrame([(*i, "z") for i in items], ITEM)
    rows = shared_spans(docs, items, **options).withColumn("n_hit", words_within("spans")).collect()
    for r in rows:
        assert all(a["end"] < b["start"] for a, b in zip(r.spans, r.spans[1:]))
    return sorted([(r.doc_id, r.n_words, r.n_hit, r["items"]) for r in rows], key=str)


def run(start, n, alphabet=1000):
    return [f"w{(start * 31 + k * k * 7 + k) % alphabet}" for k in range(n)]


def planted():
    passage, other = run(1, 40), run(2, 25)
    items = [(1, " ".join(passage)), (2, " ".join(other)), (12, " ".join(other)), (3, "only three words"), (4, "alone"), (5, ""), (6, None)]
    items += [(7, "a " * 30), (None, "five words make one window"), (8, "Éa-Éb éc" + " d" * 6), (1, "a second text of item one which is long enough here")]
    docs = [(k, " ".join(run(50 + k, 30) + passage[k : k + 9 + k] + run(90 + k, 5))) for k in range(8)]
    docs += [(20, " ".join(other).upper()), (21, ", ".join(other[5:15] + other[:12])), (22, "ALONE"), (23, "x" * 5000 + " only\nThree--words alone"), (24, "")]
    docs += [(25, None), (None, "five words make one window five words make one window"), (26, "a " * 500), (27, "a " * 9), (28, " ".join(passage) * 3)]
    docs += [(29, "Éa Éb éc d d d d d d"), (29, "Éa Éb éc d d d d d d"), (29, "éa éb éc d d d d d d d"), (30, "second text of item one which is long enough here")]
    return docs, items


def test_equals_brute_force(spark):
    docs, items = planted()
    assert found(spark, docs, items) == brute(docs, items)


@pytest.mark.parametrize("span, gram", [(4, 2), (6, 6), (3, 5), (7, 1)])
def test_other_lengths(spark, span, gram):
    docs, items = planted()
    assert found(spark, docs, items, span=span, gram=gram) == brute(docs, items, span)


def test_every_offset_of_a_shared_span(spark):
    item = run(3, 60)
    docs = [(s, " ".join(run(70 + s, s % 13) + item[s : s + 10] + run(71 + s, 11))) for s in range(51)]
    assert all(r[2] >= 10 for r in found(spark, docs, [(1, " ".join(item))]))


def test_one_passage_in_very_many_documents(spark):
    passage = " ".join(run(5, 30))
    docs = [(k, f"{passage} own{k} {'more ' * (k % 7)}") for k in range(3000)]
    items = [(k, f"{passage} item {k}") for k in range(200)]
    rows = found(spark, docs, items)
    assert len(rows) == 3000 and all(r[2] == 30 and len(r[3]) == 200 for r in rows)


def test_empty_tables(spark):
    docs, items = planted()
    assert [r[2:] for r in found(spark, docs, [])] == [(0, [])] * len(docs)
    assert found(spark, [], items) == []


def test_no_python_and_one_scan(spark):
    docs = spark.createDataFrame([(1, "a b", "x", "y")], DOC)
    plan = shared_spans(docs, spark.createDataFrame([(1, "a", "z")], ITEM))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Cartesian" not in plan
