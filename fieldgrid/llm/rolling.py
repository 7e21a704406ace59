"""Hashes of all substrings of a byte array, from prefix sums of a polynomial modulo 2^64."""

from __future__ import annotations

#: An odd number, so that it has an inverse modulo 2^64.
BASE = 0x9E3779B97F4A7C15
_powers: dict = {}


def powers(n: int):
    """The base's powers 0..n-1, and those of its inverse."""
    import numpy as np

    if _powers.get("n", 0) < n:
        n = max(n, 1 << 16)
        out = []
        for base in (BASE, pow(BASE, -1, 1 << 64)):
            x = np.full(n, base, np.uint64)
            x[0] = 1
            out.append(np.cumprod(x))
        if n > 1 << 23:  # a very long text's are not kept
            return out
        _powers.update(n=n, up=out[0], down=out[1])
    return _powers["up"], _powers["down"]


def prefix_sums(data):
    """sums[i] is the polynomial's value for the first i bytes."""
    import numpy as np

    up, _ = powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=sums[1:])
    return sums


def mixed(x):
    """Each bit of the result depends on all bits of x."""
    import numpy as np

    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


def hashes_of(sums, start, end, salt=None):
    """A hash of each of the substrings start..end, wherever they stand."""
    import numpy as np

    _, down = powers(len(sums))
    x = mixed((sums[end] - sums[start]) * down[start])
    if salt is not None:
        x = x + salt
    return mixed(x + (end - start).astype(np.uint64) * np.uint64(0xE7037ED1A0B428DB))
