from __future__ import annotations

import numpy as np
import pytest

from llm_frames import rows_of
from millrace.llm import queries, vectors
from oracle import connect, difference

SCHEMA = "vec_id long, embedding array<float>, label int, id long, n long, cls long"


def table(spark, rows):
    return spark.createDataFrame([(*row, 1, 2, 3) for row in rows], SCHEMA)


def brute(rows, least=0.98):
    def unit(vector):
        if vector is None or any(x is None or not np.isfinite(x) for x in vector):
            return None
        point = np.array(vector, np.float32).astype(np.float64)
        return point / np.linalg.norm(point) if np.abs(point).max(initial=0) > 0 else None

    units = [unit(v) for _, v, _ in rows]
    links = [
        {b for b in range(len(rows)) if a != b and rows[a][2] is not None and rows[a][2] == rows[b][2]
         and units[a] is not None and units[b] is not None and len(units[a]) == len(units[b]) and units[a] @ units[b] >= least}
        for a in range(len(rows))
    ]
    out = []
    for a in range(len(rows)):
        seen, open_ = {a}, [a]
        while open_:
            fresh = links[open_.pop()] - seen
            seen |= fresh
            open_ += fresh
        known = [rows[b][0] for b in seen if rows[b][0] is not None]
        smallest = min(known) if known else None
        out.append((rows[a][0], len(links[a]), smallest, rows[a][0] is not None and rows[a][0] == smallest))
    return sorted(out, key=str)


def samples(count=400, width=16):
    rng = np.random.default_rng(6)
    rows = []
    for i in range(count):
        vector = rng.normal(size=width)
        if rows and i % 3 == 0:
            other = rows[rng.integers(len(rows))]
            vector = np.array(other[1]) * rng.uniform(0.1, 9) + rng.normal(size=width) * rng.choice([0.0, 0.05, 0.12])
        rows.append((i, [float(np.float32(x)) for x in vector], int(rng.integers(3))))
    return rows


ODD = [
    (1000, None, 1), (1001, [], 1), (1002, [0.0] * 16, 1), (1003, [float("nan")] + [1.0] * 15, 1), (1004, [float("inf")] * 16, 1),
    (1005, [None] + [1.0] * 15, 1), (1006, [1.0] * 16, None), (1007, [1.0] * 16, 1), (1007, [1.0] * 16, 1), (1008, [2.0] * 16, 1),
    (None, [1.0] * 16, 1), (None, [5.0, -1.0], 1), (1009, [1e-30] * 16, 2), (1010, [1e30] * 16, 2), (1011, [1.0, 2.0, 3.0], 2),
    (1012, [1.0] * 15, 1), (1013, [3.0, 3.0] + [0.0] * 14, 0), (1014, [-0.0] * 14 + [1.0, 1.0], 0), (1015, [0.0] * 14 + [1.0, 1.0], 0),
]


@pytest.mark.parametrize("block, size", [(1024, 512), (7, 20)])
def test_equals_brute_force(spark, monkeypatch, block, size):
    monkeypatch.setattr(vectors, "BLOCK", block)
    monkeypatch.setattr(vectors, "LIST_SIZE", size)
    rows = samples() + ODD
    assert sorted(rows_of(vectors.near_vectors(table(spark, rows).repartition(4))), key=str) == brute(rows)


def test_probes_and_bounds_lose_nothing():
    rng = np.random.default_rng(2)
    points = rng.normal(size=(600, 32))
    points[300:] = points[:300] + rng.normal(size=(300, 32)) * 0.03
    units = points / np.linalg.norm(points, axis=1, keepdims=True)
    learned = vectors.fit(units[:200], 24)
    lists = learned.lists(units)
    codes, lost = learned.encode(units, lists)
    probes = learned.probes(units, lists, 0.2)
    for a in range(600):
        for b in np.flatnonzero(units @ units[a] >= 0.98):
            assert lists[b] in probes[a]
            assert learned.distances(units[a : a + 1], lists[b], codes[b : b + 1])[0, 0] <= 0.2 + lost[b] + vectors.SLACK


def test_crowd_of_near_copies(spark):
    rng = np.random.default_rng(3)
    rows = [(i, [float(np.float32(x)) for x in np.ones(8) + rng.normal(size=8) * 0.01], 1) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8, 1) for i in range(200)]
    assert sorted(rows_of(vectors.near_vectors(table(spark, rows))), key=str) == brute(rows)


def test_empty_and_unusable_tables(spark):
    assert rows_of(vectors.near_vectors(table(spark, []))) == []
    rows = [(1, None, 1), (2, [0.0], 1)]
    assert sorted(rows_of(vectors.near_vectors(table(spark, rows)))) == brute(rows)


def test_query_equals_sql(spark, tables):
    name = "op10_near_vectors"
    assert difference(queries.QUERIES[name](spark, tables), connect(tables), queries.SQL[name]) is None
