import numpy as np

import pytest

from recuento.llm import nn_descent
from recuento.llm.nn_descent import near_duplicate_vectors

KIND = "vec_id long, embedding array<float>, label int, node string"


def brute(ids, rows, threshold=0.95):
    unit = np.asarray(rows, dtype=np.float32).astype(float)
    unit /= np.linalg.norm(unit, axis=1, keepdims=True)
    linked = unit @ unit.T >= threshold
    np.fill_diagonal(linked, False)
    name = np.array(ids)
    while True:
        new = np.array([min([name[i], *name[linked[i]]]) for i in range(len(ids))])
        if (new == name).all():
            return {i: (int(n), int(c)) for i, n, c in zip(ids, linked.sum(1), name)}
        name = new


def test_links_and_components(spark):
    rng = np.random.default_rng(0)
    base = rng.standard_normal((400, 24))
    near = base[:60] + 0.08 * rng.standard_normal((60, 24))
    crowd = base[399] + 0.05 * rng.standard_normal((700, 24))
    rows = np.concatenate([base, near, crowd, np.repeat(base[5:6], 30, 0)]).astype(np.float32)
    ids = rng.permutation(len(rows)).tolist()
    df = spark.createDataFrame([(i, r.tolist(), 0, "x") for i, r in zip(ids, rows)], KIND)
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()}
    assert found == brute(ids, rows)


def test_vectors_that_link_with_nothing(spark):
    inf, nan = float("inf"), float("nan")
    odd = [None, [], [0.0, 0.0], [nan, 1.0], [None, 1.0], [inf, 1.0], [1.0, 0.0, 0.0]]
    rows = [(i, v, 0, "x") for i, v in enumerate(odd, 10)]
    rows += [(1, [1.0, 0.0], 0, "x"), (2, [2.0, 0.0], 0, "x"), (3, [1.0, 0.0], 0, "x"), (None, [1.0, 0.0], 0, "x")]
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in near_duplicate_vectors(spark.createDataFrame(rows, KIND)).collect()}
    assert found == {i: (0, i, True) for i in range(10, 17)} | {1: (3, 1, True), 2: (3, 1, False), 3: (3, 1, False), None: (3, 1, False)}


def test_empty_table(spark):
    assert near_duplicate_vectors(spark.createDataFrame([], KIND)).count() == 0


def two_dense_groups(size):
    """Cosines of 0.999 within a group and of 0.961 to 0.968 across."""
    rng = np.random.default_rng(1)
    centre = np.zeros((2, 64))
    centre[:, 0], centre[1, 1] = 1, 0.27
    rows = np.repeat(centre / np.linalg.norm(centre, axis=1, keepdims=True), size, 0)
    return (rows + 0.0035 * rng.standard_normal(rows.shape)).astype(np.float32)


def test_lists_full_of_links_hide_none(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "AUDIT", 0)
    rows = two_dense_groups(200)
    ids = list(range(len(rows)))
    df = spark.createDataFrame([(i, r.tolist(), 0, "x") for i, r in zip(ids, rows)], KIND)
    found = {r.vec_id: (r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()}
    assert found == brute(ids, rows) and set(found.values()) == {(399, 0)}


def test_the_audit_adds_no_links(spark, monkeypatch):
    leaves = nn_descent._leaves
    monkeypatch.setattr(nn_descent, "_leaves", lambda *args: leaves(*args).limit(0))
    df = spark.createDataFrame([(i, [1.0, 0.001 * i], 0, "x") for i in range(5)], KIND)
    with pytest.raises(RuntimeError, match="recall of 0.0000"):
        near_duplicate_vectors(df)


def test_two_dense_groups_with_a_small_audit(spark, monkeypatch):
    monkeypatch.setattr(nn_descent, "AUDIT", 5)
    rows = two_dense_groups(300)
    df = spark.createDataFrame([(i, r.tolist(), 0, "x") for i, r in enumerate(rows)], KIND)
    assert {(r.n_links, r.component_id) for r in near_duplicate_vectors(df).collect()} == {(599, 0)}
