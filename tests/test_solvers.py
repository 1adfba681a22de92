"""Normal equations of lags: sound ones are solved by elimination, others by their eigenvectors."""

import numpy as np
import pytest

from usage_ts.learning import lagged, solvers


def test_sound_systems_need_no_eigenvectors(monkeypatch):
    z = np.random.default_rng(3).standard_normal(900)
    gram = lagged.lag_gram(z, 40)
    expected = np.linalg.eigh(gram[1:, 1:])
    expected = expected[1] @ (expected[1].T @ gram[1:, :2] / expected[0][:, None])

    def refuse(a):
        raise AssertionError("eigenvectors of a sound system")

    monkeypatch.setattr(np.linalg, "eigh", refuse)
    assert np.allclose(solvers.solve_symmetric(gram[1:, 1:], gram[1:, :2]), expected, rtol=0, atol=1e-11)


@pytest.mark.parametrize("gap", [0.0, 1e-17, 1e-14])
def test_directions_below_rounding_are_left_out(gap):
    x = np.random.default_rng(4).standard_normal((50, 3))
    a = np.zeros((4, 4))
    a[:3, :3] = x.T @ x
    a[3], a[:, 3] = a[0], a[:, 0]
    a[3, 3] = a[0, 0] + gap * a[0, 0]
    found = solvers.solve_symmetric(a, a[:, 0])
    assert np.allclose(found, [0.5, 0, 0, 0.5], atol=1e-6)


@pytest.mark.parametrize("n, width", [(10, 0), (10, 1), (10, 9), (3, 2), (400, 300)])
def test_gram_matrix_of_lags(n, width):
    z = np.random.default_rng(n + width).standard_normal(n)
    rows = np.column_stack([z[width:], solvers.lagged(z, list(range(1, width + 1)), width)])
    assert np.allclose(lagged.lag_gram(z, width), rows.T @ rows, rtol=0, atol=1e-11)
