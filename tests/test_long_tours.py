"""Tours of many stops, row by row."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from peregrin.operators import routing as RT


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 40, 90])
def test_a_path_is_shortened_as_by_all_gains_at_once(n):
    rng = np.random.default_rng(n)
    lat, lon = 40 + rng.integers(0, 30, n) / 1000, 2 + rng.integers(0, 30, n) / 1000
    path = rng.permutation(n)
    want = RT.shorten_paths(RT.line_matrix(lat, lon), path[None, :])[0]
    assert RT.shorten_path(RT.Lines(lat, lon), path).tolist() == want.tolist()
    assert RT.shorten_path(RT.line_matrix(lat, lon), path).tolist() == want.tolist()


def test_a_long_path_needs_no_square_of_memory():
    rng = np.random.default_rng(1)
    lat, lon = 40 + np.sort(rng.random(3000)) / 10, np.full(3000, 2.0)
    km = RT.Lines(lat, lon)
    tracemalloc.start()
    assert RT.nearest_tour(km, list(range(3000))) == list(range(3000))
    assert RT.shorten_path(km, np.arange(3000)).tolist() == list(range(3000))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 5e6
