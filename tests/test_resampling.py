from fractions import Fraction as Fr

import numpy as np
import pytest

from loomset.operators import pixels

CUBIC = lambda x: Fr(3, 2) * x**3 - Fr(5, 2) * x**2 + 1 if x < 1 else Fr(-1, 2) * x**3 + Fr(5, 2) * x**2 - 4 * x + 2 if x < 2 else Fr(0)
EXACT = {"triangle": (lambda x: max(Fr(0), 1 - x), 1), "bicubic": (CUBIC, 2)}


def by_hand(line, new, kernel):
    """One pass over a line, in fractions up to the coefficients, which are rounded away from zero at the half."""
    fn, reach = EXACT[kernel]
    old, scale = len(line), Fr(len(line), new)
    wide, out = max(scale, Fr(1)), []
    for i in range(new):
        centre = (i + Fr(1, 2)) * scale
        first, last = max(0, int(centre - reach * wide + Fr(1, 2))), min(old, int(centre + reach * wide + Fr(1, 2)))
        w = [fn(abs(k - centre + Fr(1, 2)) / wide) for k in range(first, last)]
        fixed = [int(abs(x / sum(w)) * 2**22 + Fr(1, 2)) * (1 if x >= 0 else -1) for x in w]
        out.append(min(255, max(0, (2**21 + sum(a * b for a, b in zip(fixed, line[first:last], strict=True))) >> 22)))
    return out


@pytest.mark.parametrize("kernel", ["triangle", "bicubic"])
def test_passes_equal_exact_arithmetic(kernel):
    rng = np.random.default_rng(3)
    for old, new in ((9, 4), (4, 9), (17, 8), (31, 32), (64, 7), (5, 1), (1, 6), (448, 100)):
        line = rng.integers(0, 256, old).tolist()
        assert pixels.resample(np.array([line], np.uint8), new, 1, kernel)[0, :, 0].tolist() == by_hand(line, new, kernel)


@pytest.mark.parametrize("kernel", ["triangle", "bicubic"])
def test_columns_then_rows_rounded_between(kernel):
    image = np.random.default_rng(4).integers(0, 256, (13, 10), np.uint8)
    across = [by_hand(row, 7, kernel) for row in image.tolist()]
    want = np.array([by_hand(list(column), 5, kernel) for column in zip(*across, strict=True)]).T
    assert (pixels.resample(image, 7, 5, kernel)[..., 0] == want).all()


#: Worked out by hand: halves, quarters and overshoot of steps.
RECORDED = {
    ("triangle", (0, 100), 4): [0, 25, 75, 100],
    ("triangle", (0, 0, 255, 255), 2): [36, 219],
    ("bicubic", (0, 0, 255, 255), 8): [0, 0, 0, 52, 203, 255, 255, 255],
    ("lanczos", (7, 7, 7, 7, 7), 3): [7, 7, 7],
}


def test_recorded_arrays():
    for (kernel, line, new), want in RECORDED.items():
        got = pixels.resample(np.array([line], np.uint8), new, 1, kernel)[0, :, 0].tolist()
        assert got == want, (kernel, line, got)
        if kernel in EXACT:
            assert by_hand(list(line), new, kernel) == want


def test_coefficients_and_sides_that_stay():
    image = np.random.default_rng(5).integers(0, 256, (6, 8, 3), np.uint8)
    assert (pixels.resample(image, 8, 6) == image).all() and (pixels.resample(image, 8, 3)[:, :, 0] == pixels.resample(image[..., :1], 8, 3)[..., 0]).all()
    for kernel, (fn, reach) in pixels.KERNELS.items():
        for old, new in ((100, 33), (33, 100), (3, 2)):
            _, weights = pixels._taps(old, new, fn, reach)
            assert (abs(weights.sum(1) - (1 << pixels.POINT)) <= weights.shape[1]).all(), kernel
