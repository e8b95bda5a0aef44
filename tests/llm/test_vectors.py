import numpy as np
import pytest

from cargofile.llm import vectors as module
from cargofile.llm.vectors import near_vectors, rotation

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string, kept string"


def made(groups, each, seed, size=32):
    pick, rows = np.random.default_rng(seed), []
    for g in range(groups):
        base = pick.standard_normal(size)
        for v in range(each):
            x = base + pick.standard_normal(size) * pick.choice([0, 0.1, 0.3, 0.5])
            rows.append((g + groups * v, [float(np.float32(y)) for y in x], g % 3))
    return rows


def brute(rows):
    sound = [(i, np.array(e, float), c) for i, e, c in rows if i is not None and e and c is not None and all(
        x is not None and np.isfinite(x) for x in e) and any(e)]
    links, parent = {}, {i: i for i, _, _ in rows if i is not None}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for k, (i, x, c) in enumerate(sound):
        for j, y, d in sound[:k]:
            if c == d and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.93:
                links[i], links[j] = links.get(i, 0) + 1, links.get(j, 0) + 1
                a, b = top(i), top(j)
                parent[max(a, b)] = min(a, b)
    return {i: (links.get(i, 0), top(i)) for i in parent}


@pytest.mark.parametrize("task_rows", [1024, 16])
def test_recall_and_no_wrong_link(spark, monkeypatch, task_rows):
    monkeypatch.setattr(module, "TASK_ROWS", task_rows)
    rows = made(25, 16, 1)
    found = {r.vec_id: r for r in near_vectors(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)).collect()}
    exact = brute(rows)
    assert sorted(found) == sorted(exact)
    assert all(found[i].n_links <= n for i, (n, _) in exact.items())
    assert sum(r.n_links for r in found.values()) >= 0.97 * sum(n for n, _ in exact.values())
    assert np.mean([found[i].component_id == c for i, (_, c) in exact.items()]) >= 0.97
    assert all(r.kept == (i == r.component_id) for i, r in found.items())


def test_unsound_vectors_link_with_nothing(spark):
    x, nan, inf = [1.0, 2.0, 3.0], float("nan"), float("inf")
    rows = [(1, x, 0), (2, x, 0), (3, x, None), (4, x, 1), (5, None, 0), (6, [], 0), (7, [0.0] * 3, 0), (8, [1.0, None, 3.0], 0),
            (9, [1.0, nan, 3.0], 0), (10, [1.0, inf, 3.0], 0), (11, [1.0, 2.0, 3.0, 0.0], 0), (None, x, 0), (12, [2.0, 4.0, 6.0], 0)]
    out = near_vectors(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)).collect()
    found = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in out}
    assert len(out) == len(rows) and found[None] == (0, None, True)
    assert (found[1], found[2], found[12]) == ((2, 1, True), (2, 1, False), (2, 1, False))
    assert all(found[k] == (0, k, True) for k in (3, 4, 5, 6, 7, 8, 9, 10, 11))
    assert near_vectors(spark.createDataFrame([], SCHEMA)).collect() == []


def test_rotation_is_orthogonal_and_lowers_the_quantisation_error():
    pick = np.random.default_rng(2)
    rows = pick.standard_normal((500, 16)) @ np.diag(np.linspace(3, 0.1, 16))
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    start, turn = rotation(rows, 16, 3, rounds=0), rotation(rows, 16, 3)
    assert np.allclose(turn @ turn.T, np.eye(16))

    def error(r):
        return np.linalg.norm(np.where(rows @ r >= 0, 1, -1) - 4 * rows @ r)

    assert error(turn) < error(start)


def test_id_that_is_smallest_in_no_class_ties_its_classes(spark):
    x, y, z = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]
    rows = [(1, x, 0), (5, x, 0), (2, y, 0), (5, y, 0), (6, y, 0), (3, z, 0), (6, z, 0), (None, x, 0)]
    out = near_vectors(spark.createDataFrame([(*r, "a", "b") for r in rows], SCHEMA)).collect()
    assert {(r.vec_id, r.component_id) for r in out} == {(i, 1) for i in (1, 2, 3, 5, 6)} | {(None, None)}
