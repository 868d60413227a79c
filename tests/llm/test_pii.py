import random
import re

import plain
from recuento.llm import pii
from recuento.llm.pii import find_personal_data, listed


def test_base_spans(spark):
    rng = random.Random(2)
    letters = "0123456789 -.+()@abé日_%\n"
    noise = lambda: "".join(rng.choice(letters) for _ in range(rng.randint(0, 120)))
    known = ["4111 1111 1111 1111", "4532015112830366", "a@b.cc_x@d.ee", "1.2.3.4.5.6.7.8", "999.1.1.1", "+1 (555) 123-4567", "x@y"]
    rows = [(i, noise() + rng.choice(known) + noise(), 1) for i in range(300)]
    long = ["a" * 20_000, "1." * 5000, "a." * 4000 + "@b.c", "+1 " + "(" * 5000 + "9", "4 1" * 4000]
    rows += [(300 + i, t, 1) for i, t in enumerate([None, "", *long])]
    found = {r.doc_id: [tuple(s) for s in r.base] for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string, base int")).collect()}
    assert found == {i: plain.base_spans(t) for i, t, _ in rows}


def test_contexts_find_unseen_identifiers(spark):
    rows = [(i, f"some words here please call me at +1 (555) {i:03d}-{i * 7 % 10000:04d} thanks") for i in range(60)]
    rows += [(100 + i, f"other text now please call me at 555-{i * 3:04d}-{i:03d}. bye") for i in range(6)]
    # a common context and an unreliable one bring nothing
    rows += [(200 + i, f"the number of the {1000000 + i} of the x and of the +1 555 000 {i:04d}") for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r for r in find_personal_data(docs).collect()}
    for i in range(6):
        text = dict(rows)[100 + i]
        assert [(s.kind, text[s.start : s.end]) for s in found[100 + i].spans] == [("phone", f"555-{i * 3:04d}-{i:03d}")]
    assert all(found[i].spans == found[i].base for i in found if not 100 <= i < 106)


def test_contexts_find_identifiers_in_groups(spark):
    rows = [(i, f"some words please call me at +1 (555) {i:03d}-{i * 7 % 10000:04d} thanks") for i in range(30)]
    rows += [(50 + i, f"some words in room {i} ring +1 (555) {i:03d}-{i * 7 % 10000:04d} thanks") for i in range(30)]
    rows += [(90 + i, f"room 7 ring +1 (555) {i:03d}-{i * 7 % 10000:04d} thanks") for i in range(30)]
    wanted = {200: "555 123 4567", 201: "(555) 123-4568", 202: "555.123.4569", 203: "1234 5678 9012 3451"}
    rows += [(i, f"now call me at {value}, 3rd time") for i, value in wanted.items()]
    # a digit word is one of the two words before; a list of numbers is read word by word
    wanted |= {204: "555-0001-002", 205: "5550001"}
    rows += [(204, "room 7 ring 555-0001-002 today"), (205, "call me at 5550001 " + "1234 " * 20)]
    found = {r.doc_id: r for r in find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, value in wanted.items():
        assert [(s.kind, dict(rows)[i][s.start : s.end]) for s in found[i].spans] == [("phone", value)]


def test_places_and_contexts_of_many_matches(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choice(["é", "the", "at", f"n{i}", "(x5)", "\U0001f600 7"]) for i in range(n)) for n in (0, 60, 63, 64, 65, 127, 128, 129, 1000)]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, text string")
    pattern = "[0-9]+"
    found = docs.select("id", pii.matches("text", pattern, "char_length(m.value) <> 2").alias("m")).collect()
    for row in found:
        text = texts[row.id]
        wanted = [(m.start(), m.end(), m[0], text[max(0, m.start() - 120) : m.start()]) for m in re.finditer(pattern, text) if len(m[0]) != 2]
        assert [tuple(m) for m in row.m] == wanted


def test_repeated_rows_null_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(None, "a@b.cc 1.2.3.4"), (1, "x"), (1, "x"), (1, None)], "doc_id long, text string")
    rows = find_personal_data(docs)
    assert sorted((str(r[0]), r[1]) for r in rows.select("doc_id", listed("spans")).collect()) == [
        ("1", ""), ("1", ""), ("1", ""), ("None", "email:0:6,ip:7:14"),
    ]
    assert find_personal_data(docs.limit(0)).count() == 0
    text = rows._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in text and "Arrow" not in text
