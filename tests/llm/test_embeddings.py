import math

import numpy as np
import pytest

from gazette.llm import embeddings

SCHEMA = "vec_id bigint, embedding array<double>"


def brute(rows, least=0.9):
    units = []
    for _, v in rows:
        good = v is not None and len(v) and all(x is not None and math.isfinite(x) for x in v) and any(v)
        x = np.array(v, float) if good else None
        units.append(None if x is None else (x / np.abs(x).max()) / np.linalg.norm(x / np.abs(x).max()))
    n = len(rows)
    near = [[j for j in range(n) if j != i and units[i] is not None and units[j] is not None and len(units[i]) == len(units[j])
             and (units[i] @ units[j] >= least or rows[i][1] == rows[j][1])] for i in range(n)]
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for i in range(n):
            for j in near[i]:
                if root[j] < root[i]:
                    root[i], changed = root[j], True
    out = []
    for i, (key, _) in enumerate(rows):
        keys = [rows[j][0] for j in range(n) if root[j] == root[i] and rows[j][0] is not None]
        least_key = min(keys, default=None)
        out.append((key, len(near[i]), least_key, key is not None and key == least_key))
    return sorted(out, key=repr)


def check(frame, rows, **options):
    made = embeddings.near_duplicates(frame(rows, SCHEMA), **options).collect()
    assert sorted(map(tuple, made), key=repr) == brute(rows)


def test_odd_vectors(frame):
    rows = [(1, [1.0, 0.0]), (2, [1.0, 0.1]), (3, [0.0, 0.0]), (4, None), (5, [1.0, None]), (6, [math.nan, 1.0]), (7, [math.inf, 1.0]), (8, []),
            (9, [2.0, 0.0]), (10, [1e300, 1e299]), (11, [1e-300, 1e-301]), (12, [1.0, 0.0, 0.0]), (13, [1.0, 0.05, 0.0]), (14, [-1.0, 0.0]), (1, [1.0, 0.0]),
            (15, [5.0]), (16, [7.0]), (17, [-1.0]), (18, [-0.0, 1.0]), (19, [0.0, 1.0]), (None, [0.0, 3.0])]
    check(frame, rows)


@pytest.mark.parametrize("block", [7, 64, 4096])
def test_groups_of_near_and_exact_copies(frame, block):
    r = np.random.default_rng(5)
    rows = []
    for c in range(12):
        center = r.normal(size=24)
        rows += [(100 * c + k, (center + r.normal(size=24) * 0.22).tolist()) for k in range(18)]
    rows += [(5000 + k, rows[3][1]) for k in range(25)] + [(6000 + k, r.normal(size=24).tolist()) for k in range(60)]
    check(frame, rows, block=block)


def test_equal_first_coordinates_are_split(frame):
    rows = [(k, [0.0, math.cos(k / 40), math.sin(k / 40)]) for k in range(200)]
    check(frame, rows, block=16)


def test_small_table(small):
    rows = [(r.vec_id, list(r.embedding)) for r in small("embeddings").collect()]
    made = embeddings.near_duplicates(small("embeddings"), block=100).collect()
    assert sorted(map(tuple, made), key=repr) == brute(rows)


def test_bounds_never_lose_a_pair():
    r = np.random.default_rng(2)
    base = r.normal(size=(40, 16))
    x = np.concatenate([base, base + r.normal(size=base.shape) * 0.35])
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    turn = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    found = {(int(a), int(b)) for p, q in embeddings._links_of(x, x, turn, 0.9, True) for a, b in zip(p, q)}
    assert found == {(i, j) for i in range(80) for j in range(i + 1, 80) if x[i] @ x[j] >= 0.9} and found


def test_empty_table_and_other_columns(frame):
    assert embeddings.near_duplicates(frame([], SCHEMA)).count() == 0
    made = embeddings.near_duplicates(frame([(1, [1.0, 2.0], 3, "v")], SCHEMA + ", links int, vid string")).first()
    assert tuple(made) == (1, 0, 1, True)
