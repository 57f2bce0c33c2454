"""Special functions and small fits against published values and identities."""

import math

import numpy as np
import pytest

from helixframe.functions import numeric as n
from helixframe.operators.integration import nnls, snf
from helixframe.operators.sequences import align, open_reading_frames, palindromes, stem_loops, tandem_repeats
from helixframe.operators.survival import cox_fit


@pytest.mark.parametrize(("t", "df", "p"), [(2.228, 10, 0.05), (1.96, 1e6, 0.05), (3.169, 10, 0.01), (12.706, 1, 0.05)])
def test_student(t, df, p):
    assert n.t_two_sided(t, df) == pytest.approx(p, rel=2e-3)


@pytest.mark.parametrize(("x", "df", "p"), [(3.841, 1, 0.05), (18.307, 10, 0.05), (6.635, 1, 0.01)])
def test_chi_squared(x, df, p):
    assert n.chi2_sf(x, df) == pytest.approx(p, rel=1e-3)


def test_other_tails():
    assert n.f_sf(4.965, 1, 10) == pytest.approx(0.05, rel=1e-3) and n.f_sf(3.326, 5, 10) == pytest.approx(0.05, rel=1e-3)
    assert n.normal_two_sided(1.959964) == pytest.approx(0.05, rel=1e-5)
    assert n.hypergeom_sf(3, 20, 7, 5) == pytest.approx(sum(math.comb(7, k) * math.comb(13, 5 - k) for k in range(3, 6)) / math.comb(20, 5))
    assert n.beta_cdf(2, 3, 0.4) == pytest.approx(0.5248)


def test_fits():
    a = np.array([[1.0, 0.0], [0.0, 1.0], [1.0, 1.0]])
    assert nnls(a, a @ np.array([2.0, 3.0])) == pytest.approx([2.0, 3.0]) and nnls(a, np.array([1.0, -5.0, 1.0]))[1] == 0
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 1))
    beta, error = cox_fit(rng.exponential(1 / np.exp(0.7 * x[:, 0])), np.ones(2000), x)
    assert abs(beta[0] - 0.7) < 3 * error[0] < 0.2
    blocks = [np.r_[rng.normal(0, 1, (15, 5)), rng.normal(6, 1, (15, 5))] for _ in range(2)]
    w = snf(blocks, 5, 10)
    assert np.allclose(w, w.T) and w[:15, :15].sum() > 2 * w[:15, 15:].sum()


def test_sequence_tables():
    assert align("ACGT", "AGT") == (4.0, "ACGT", "A-GT") and align("TTACGTT", "GGACGGG", local=True)[:2] == (6.0, "ACG")
    assert (0, 9, "+", 0, 9) in open_reading_frames("ATGAAATAG", least=9)
    assert tandem_repeats("GGACACACTT", 6, 3) == [(2, 8, "AC", 3)]
    assert (0, 6, 3, 0) in palindromes("GAATTC", 3) and stem_loops("GGGGAAACCCC", 4)
