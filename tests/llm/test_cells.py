"""Cells of the embedding join: neighbours against plain enumeration, results for any number of coordinates."""

import itertools

import numpy as np
import pytest

from contestflow.llm import vectors


@pytest.mark.parametrize("grid", [1, 3, 5])
def test_cells_equal_plain_enumeration(grid):
    y, width, radius = np.random.default_rng(grid).standard_normal((60, grid)) * 0.2, 0.28, 0.07
    got = {(int(r), tuple(c.tolist()), v) for rows, cells, v in vectors._cells(y, width, radius) for r, c in zip(rows, cells, strict=True)}
    want = set()
    for r, point in enumerate(y):
        home = np.floor(point / width).astype(int)
        for step in itertools.product((-1, 0, 1), repeat=grid):
            gaps = [0 if s == 0 else (h + 1) * width - x if s > 0 else x - h * width for s, h, x in zip(step, home, point, strict=True)]
            if step >= (0,) * grid and sum(g * g for g in gaps) <= radius**2 * (1 + 1e-9):
                want.add((r, tuple((home + step).tolist()), step != (0,) * grid))
    assert got == want and any(v for *_, v in got)


def test_grid_follows_the_largest_label():
    assert [vectors.grid_of(n) for n in (0, 1, 40_000, 40_001, 100_000, 100_001, 10**9)] == [4, 4, 4, 5, 5, 6, 8] and vectors.grid_of(10**9, 5) == 5


def test_results_do_not_depend_on_the_grid(spark, monkeypatch):
    r = np.random.default_rng(8)
    centres = r.standard_normal((12, 24))
    rows = [(100 * c + k, (centres[c] + 0.1 * r.standard_normal(24)).tolist(), c % 2) for c in range(12) for k in range(12)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int")
    out = []
    for least in (40_000, 60, 1):
        monkeypatch.setattr(vectors, "GRID_VECTORS", least)
        out.append(sorted(map(tuple, vectors.near_duplicates(df).collect())))
    assert out[0] == out[1] == out[2] and sum(x[1] for x in out[0]) > 100
