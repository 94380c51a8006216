"""Normalised indel similarity ``2*LCS(a,b)/(len a + len b)`` as Arrow UDFs.

The LCS length uses the bit-parallel recurrence (one big-integer word per
string, one step per character of the shorter string), so whole texts are
compared, never prefixes.  A length bound decides most pairs without it:
the ratio can never exceed ``2*min(la,lb)/(la+lb)``.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType

MASK_CELLS = 1 << 22      # cells compared at once when masks are built
STEPS = 256               # steps between two looks at the bounds


def _masks(t: str, alphabet) -> dict:
    """The places in ``t`` of every character of ``alphabet`` as the bits of one integer."""
    arr = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    codes = np.array([ord(ch) for ch in alphabet], dtype=np.uint32)
    out, step = {}, max(1, MASK_CELLS // len(arr))
    for k in range(0, len(codes), step):
        bits = np.packbits(arr == codes[k:k + step, None], axis=1, bitorder="little")
        out.update((chr(c), int.from_bytes(row.tobytes(), "little")) for c, row in zip(codes[k:k + step].tolist(), bits))
    return out


def _lcs(a: str, b: str, enough: Callable[[int], bool] | None = None) -> int:
    """Length of the longest common subsequence; with ``enough``, a lower bound of it as soon as that gives the same
    answer for the bound and for the bound plus all that is left."""
    s, t = (a, b) if len(a) <= len(b) else (b, a)
    if not s:
        return 0
    m = len(t)
    full = v = (1 << m) - 1
    masks = _masks(t, set(s))
    for k in range(0, len(s), STEPS):
        for mk in map(masks.__getitem__, s[k:k + STEPS]):
            u = v & mk
            v = (v + u) | (v ^ u)       # the carries above bit m never come back down
        v &= full
        found, left = m - v.bit_count(), len(s) - k - STEPS
        if enough is not None and left > 0 and enough(found) == enough(found + left):
            break
    return found


def lcs_length(a: str, b: str) -> int:
    """Length of the longest common subsequence of code points."""
    return _lcs(a, b)


def indel_ratio(a: str | None, b: str | None) -> float | None:
    if a is None or b is None:
        return None
    total = len(a) + len(b)
    if total == 0:
        return 1.0
    return 2.0 * lcs_length(a, b) / total


def is_similar(a: str | None, b: str | None, r: float) -> bool:
    """ratio(a, b) > r, with the length bound deciding when it can."""
    if a is None or b is None:
        return False
    la, lb = len(a), len(b)
    total = la + lb
    if total == 0:
        return 1.0 > r
    if 2.0 * min(la, lb) / total <= r:
        return False
    if a == b:
        return 1.0 > r
    def above(n):
        return 2.0 * n / total > r
    return above(_lcs(a, b, above))


@F.pandas_udf(DoubleType())
def similarity_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([indel_ratio(x, y) for x, y in zip(a, b)], dtype="float64")


def similar_above(r: float):
    """A boolean Arrow UDF ``(a, b) -> ratio(a, b) > r``."""
    @F.pandas_udf(BooleanType())
    def _similar(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([is_similar(x, y, r) for x, y in zip(a, b)], dtype="bool")
    return _similar
