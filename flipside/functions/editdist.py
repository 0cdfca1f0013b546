"""Edit similarity on whole texts.

``levenshtein_similarity`` = 1 - distance / max(len). Spark's native
``levenshtein`` fills the full n*m table (also with a threshold), which is
quadratic on long documents. Counterfactual candidates are near copies of
their original, so the distance d is small: a diagonal-transition search
(furthest-reaching points per diagonal, matches skipped with memcmp-speed
slice compares) needs about d*d steps whatever the length. Common beginnings
and endings are cut off first (most rewrites add a clause or change one place).
It runs in an Arrow UDF, over all pairs of a batch at once in numpy, with a step budget;
pairs over the budget (long texts with many edits) go to an exact bit-parallel
recurrence (n*m/64 word operations, about ten times faster here than the native n*m table). The native
``levenshtein`` stays as the last resort for nulls. All paths count
characters (code points) and give the exact distance.

``ratcliff_similarity`` is the reference's ``difflib.SequenceMatcher.ratio``
(autojunk on, asymmetric), exact, in an Arrow UDF.
"""

from __future__ import annotations

import difflib
import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType, IntegerType


def _common_prefix(a: str, b: str, i: int, j: int) -> int:
    """Length of the common prefix of a[i:] and b[j:] (gallop + bisection)."""
    limit = min(len(a) - i, len(b) - j)
    if limit <= 0 or a[i] != b[j]:
        return 0
    lo, step = 1, 1
    while lo < limit:
        hi = min(limit, lo + step)
        if a[i + lo:i + hi] == b[j + lo:j + hi]:
            lo = hi
            step <<= 1
            continue
        while hi - lo > 1:
            mid = (lo + hi) >> 1
            if a[i + lo:i + mid] == b[j + lo:j + mid]:
                lo = mid
            else:
                hi = mid
        return lo
    return lo


def _common_suffix(a: str, b: str) -> int:
    """Length of the longest common ending."""
    most = min(len(a), len(b))
    lo, step = 0, 8
    while lo < most:
        hi = min(most, lo + step)
        if a[len(a) - hi:len(a) - lo] != b[len(b) - hi:len(b) - lo]:
            while lo < hi and a[-1 - lo] == b[-1 - lo]:   # the part that differs, from its end
                mid = (lo + hi + 1) >> 1
                if a[len(a) - mid:len(a) - lo] == b[len(b) - mid:len(b) - lo]:
                    lo = mid
                else:
                    hi = mid - 1
            return lo
        lo, step = hi, step << 1
    return lo


def core(a: str, b: str) -> tuple[str, str]:
    """Both texts without their common beginning and ending, which change no distance."""
    start = _common_prefix(a, b, 0, 0)
    a, b = a[start:], b[start:]
    end = _common_suffix(a, b)
    return a[:len(a) - end], b[:len(b) - end]


def levenshtein(a: str, b: str) -> int:
    """Exact Levenshtein distance. A clause added or one run replaced costs what the run costs, however long the texts."""
    a, b = core(a, b)
    if not a or not b:
        return len(a) + len(b)
    d = bounded_levenshtein(a, b, step_budget(len(a), len(b)))
    return d if d is not None else bitparallel_levenshtein(a, b)


def bounded_levenshtein(a: str, b: str, max_d: int) -> int | None:
    """Exact Levenshtein distance if it is <= max_d, else None."""
    n, m = len(a), len(b)
    goal = m - n
    if abs(goal) > max_d:
        return None
    front = {0: _common_prefix(a, b, 0, 0)}
    if goal == 0 and front[0] >= n:
        return 0
    for e in range(1, max_d + 1):
        nxt = {}
        for k in range(-e, e + 1):
            best = -1
            v = front.get(k)
            if v is not None:
                best = v + 1                      # substitution
            v = front.get(k - 1)
            if v is not None and v > best:
                best = v                          # insertion (consume b)
            v = front.get(k + 1)
            if v is not None and v + 1 > best:
                best = v + 1                      # deletion (consume a)
            if best < 0:
                continue
            top = min(n, m - k)
            if best > top:
                best = top
            if best < 0 or best + k < 0:
                continue
            best += _common_prefix(a, b, best, best + k)
            nxt[k] = best
        if nxt.get(goal, -1) >= n:
            return e
        front = nxt
    return None


def bitparallel_levenshtein(a: str, b: str) -> int:
    """Exact Levenshtein distance with the bit-vector recurrence of Myers
    (1999) in Hyyro's formulation for global distance: one column per
    character of the longer string, the shorter one packed into a Python
    integer used as a bit vector, so the work is about n*m/64 word operations
    done inside big-integer arithmetic."""
    if len(a) < len(b):
        a, b = b, a
    m = len(b)
    if m == 0:
        return len(a)
    full = (1 << m) - 1
    high = 1 << (m - 1)
    peq: dict[str, int] = {}
    for i, ch in enumerate(b):
        peq[ch] = peq.get(ch, 0) | (1 << i)
    pv, mv, score = full, 0, m
    for ch in a:
        eq = peq.get(ch, 0)
        xv = eq | mv
        xh = ((((eq & pv) + pv) & full) ^ pv) | eq
        ph = mv | (~(xh | pv) & full)
        mh = pv & xh
        if ph & high:
            score += 1
        elif mh & high:
            score -= 1
        ph = ((ph << 1) | 1) & full
        mh = (mh << 1) & full
        pv = mh | (~(xv | ph) & full)
        mv = ph & xv
    return score


def step_budget(n: int, m: int) -> int:
    """Largest d worth trying before the native n*m table is cheaper."""
    return max(32, int(math.sqrt(float(n) * float(m)) / 50.0))


#: Characters of the pairs that are searched together, and what no furthest-reaching point is.
TOGETHER, NOWHERE = 1 << 20, -(1 << 30)


def _joined(texts: list[str], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts, ``end`` after each, and where each begins."""
    size = np.array([len(t) + 1 for t in texts], np.int64)
    starts = np.cumsum(size) - size
    out = np.full(int(size.sum()), end, np.uint32)
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    keep = np.ones(len(out), bool)
    keep[starts + size - 1] = False
    out[keep] = points
    return out, starts


def _slide(a: np.ndarray, b: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """How far a and b agree from each i and j on; the ends of texts agree with nothing."""
    far = np.zeros(len(i), np.int64)
    at = np.flatnonzero(a[i] == b[j])
    step = 1
    far[at] = 1
    while len(at):
        step = min(step * 4, 4096)
        over = np.arange(step)
        x, y = i[at] + far[at], j[at] + far[at]
        same = a[np.minimum(x[:, None] + over, len(a) - 1)] == b[np.minimum(y[:, None] + over, len(b) - 1)]
        whole = same.all(axis=1)
        far[at] += np.where(whole, step, same.argmin(axis=1))
        at = at[whole]
    return far


def levenshteins(pairs: list[tuple[str, str]], budgets: list[int]) -> list[int | None]:
    """``bounded_levenshtein`` of many pairs at once: the furthest points of all diagonals of all pairs are one array."""
    out: list[int | None] = [None] * len(pairs)
    a, at_a = _joined([x for x, _ in pairs], 0xFFFFFFFF)
    b, at_b = _joined([y for _, y in pairs], 0xFFFFFFFE)
    n, m = (np.array([len(p[s]) for p in pairs], np.int64) for s in (0, 1))
    most, goal, who = np.array(budgets, np.int64), m - n, np.arange(len(pairs))
    front = _slide(a, b, at_a, at_b)[:, None]      # diagonals -e to e
    e = 0
    while len(who):
        found = (np.abs(goal) <= e) & (front[np.arange(len(who)), np.clip(goal + e, 0, 2 * e)] >= n)
        for w in who[found]:
            out[w] = e
        e += 1
        stay = ~found & (most >= e)
        if not stay.all():
            a_b = [x[stay] for x in (who, n, m, most, goal, at_a, at_b, front)]
            who, n, m, most, goal, at_a, at_b, front = a_b
        if not len(who):
            break
        wide = np.full((len(who), 2 * e + 3), NOWHERE, np.int64)
        wide[:, 2:-2] = front
        best = np.maximum(np.maximum(wide[:, 1:-1] + 1, wide[:, :-2]), wide[:, 2:] + 1)   # replaced, inserted, deleted
        k = np.arange(-e, e + 1)
        best = np.minimum(best, np.minimum(n[:, None], m[:, None] - k))
        ok = (best >= 0) & (best + k >= 0)
        row, col = np.nonzero(ok)
        i = best[row, col]
        front = np.full(best.shape, NOWHERE, np.int64)
        front[row, col] = i + _slide(a, b, at_a[row] + i, at_b[row] + i + k[col])
    return out


def distances(pairs) -> list[int | None]:
    """Exact Levenshtein distances of pairs, None where a text is missing. So many pairs are
    searched at a time as TOGETHER characters hold."""
    out: list[int | None] = []
    waiting: list[tuple[int, str, str]] = []
    held = 0

    def settle() -> None:
        budgets = [search_budget(len(x), len(y)) for _, x, y in waiting]
        for (at, x, y), d in zip(waiting, levenshteins([w[1:] for w in waiting], budgets)):
            out[at] = bitparallel_levenshtein(x, y) if d is None else d

    for x, y in pairs:
        out.append(None)
        if x is None or y is None:
            continue
        x, y = core(x, y)
        if not x or not y:
            out[-1] = len(x) + len(y)
            continue
        waiting.append((len(out) - 1, x, y))
        held += len(x) + len(y)
        if held >= TOGETHER or len(waiting) >= 512:
            settle()
            waiting, held = [], 0
    if waiting:
        settle()
    return out


def search_budget(n: int, m: int) -> int:
    """Largest d that is worth searching together: about 0.12 us a step squared, against 1 to 2 ns for each of the n*m places."""
    return max(32, int(math.sqrt(max(n, m) * (8.0 + min(n, m) / 120.0))))


@F.arrow_udf(IntegerType())
def _levenshtein_fast(a: pa.Array, b: pa.Array) -> pa.Array:
    # a pair at a time leaves Arrow, so that a batch's texts aren't held twice
    return pa.array(distances((x.as_py(), y.as_py()) for x, y in zip(a, b)), pa.int32())


def levenshtein_distance(a: Column, b: Column) -> Column:
    """Exact character Levenshtein distance: fast path, native fallback."""
    return F.coalesce(_levenshtein_fast(a, b), F.levenshtein(a, b))


def levenshtein_similarity(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when(longest == 0, F.lit(1.0)).otherwise(
        1.0 - levenshtein_distance(a, b).cast("double") / longest.cast("double"))


@pandas_udf(DoubleType())
def _ratcliff(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([
        None if x is None or y is None else float(difflib.SequenceMatcher(a=x, b=y).ratio())
        for x, y in zip(a, b)
    ], dtype="float64")


def ratcliff_similarity(a: Column, b: Column) -> Column:
    return _ratcliff(a, b)


def edit_similarity(a: Column, b: Column, method: str = "levenshtein") -> Column:
    if method == "levenshtein":
        return levenshtein_similarity(a, b)
    if method == "ratcliff":
        return ratcliff_similarity(a, b)
    raise ValueError(f"unknown edit method {method!r}")
