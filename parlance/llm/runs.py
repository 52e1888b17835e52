"""Hashes of runs of words or bytes, read off prefix sums."""

import numpy as np

from parlance.llm.common import mixed, power


def run_hashes(hashes: np.ndarray, starts: np.ndarray, size: int, base: int) -> np.ndarray:
    """Hash of the `size` values from each start, from prefix sums of a polynomial."""
    sums = np.concatenate((
        np.zeros(1, np.uint64), np.cumsum(hashes * power(base, len(hashes)), dtype=np.uint64)
    ))
    back = power(pow(base, -1, 1 << 64), len(hashes))
    return mixed((sums[starts + size] - sums[starts]) * back[starts])
