"""Line diffs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T


def common_length(a: list[str], b: list[str]) -> int:
    """The length of the longest common subsequence, bit-parallel (Hyyrö, 2004): a row of the table is one number."""
    head = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
    a, b = a[head:], b[head:]
    at: dict[str, int] = {}
    for i, line in enumerate(a):
        at[line] = at.get(line, 0) | 1 << i
    full = (1 << len(a)) - 1
    row = full
    for line in b:
        same = row & at.get(line, 0)
        row = (row + same | row - same) & full
    return head + len(a) - row.bit_count()


@F.pandas_udf(T.StructType([T.StructField(x, T.LongType()) for x in ("kept", "added", "removed")]))
def changed_lines(old: pd.Series, new: pd.Series) -> pd.DataFrame:
    """How many lines two versions keep in order, add and remove; a null version has no lines."""
    rows = []
    for a, b in zip(old, new):
        a, b = ([] if x is None else list(x) for x in (a, b))
        n = common_length(a, b)
        rows.append((n, len(b) - n, len(a) - n))
    return pd.DataFrame(rows, columns=["kept", "added", "removed"])


def _row(row: int, same: int, full: int) -> int:
    low = row & same
    return (row + low | row - low) & full


def differences(before: list[str], after: list[str]) -> tuple[list[int], list[int]]:
    """Places of ``before`` that are removed and of ``after`` that are added, by one longest common subsequence.

    The alignment is walked from the front: equal items stay; where either could go, the removal comes
    first. Rows of suffix lengths are numbers of a bit an item of ``after``; only every ``step``-th is kept
    and those between are worked out anew, so space grows with the square root of the lengths.
    """
    head = next((i for i, (x, y) in enumerate(zip(before, after)) if x != y), min(len(before), len(after)))
    most = min(len(before), len(after)) - head
    tail = next((i for i in range(most) if before[-1 - i] != after[-1 - i]), most)
    a, b = before[head : len(before) - tail], after[head : len(after) - tail]
    at: dict[str, int] = {}
    for j, x in enumerate(reversed(b)):
        at[x] = at.get(x, 0) | 1 << j
    full, step = (1 << len(b)) - 1, max(1, int(len(a) ** 0.5))
    row = full
    kept = {len(a): full}  # row i: one bit an item of b from the back, zero where the subsequence of a[i:] grows
    for i in range(len(a) - 1, -1, -1):
        row = _row(row, at.get(a[i], 0), full)
        if i % step == 0:
            kept[i] = row
    removed, added, i, j, rows = [], [], 0, 0, {}

    def length(i: int, j: int) -> int:
        if i not in rows:
            rows.clear()
            low = i - i % step
            high = min(low + step, len(a))
            rows[high] = kept[high]
            for k in range(high - 1, low - 1, -1):
                rows[k] = _row(rows[k + 1], at.get(a[k], 0), full)
        n = len(b) - j
        return n - (rows[i] & ((1 << n) - 1)).bit_count()

    while i < len(a) and j < len(b):
        if a[i] == b[j]:
            i, j = i + 1, j + 1
        elif length(i + 1, j) >= length(i, j + 1):
            removed.append(head + i)
            i += 1
        else:
            added.append(head + j)
            j += 1
    return removed + list(range(head + i, len(before) - tail)), added + list(range(head + j, len(after) - tail))


@F.pandas_udf(T.ArrayType(T.StructType([T.StructField("side", T.StringType()), T.StructField("line_no", T.IntegerType()), T.StructField("line", T.StringType())])))
def line_differences(old: pd.Series, new: pd.Series) -> pd.Series:
    """The lines that a new version removes and adds, with their place in their version; blank lines and changes of white space alone do not count, a null version has no lines."""

    def one(a, b) -> list[dict]:
        sides = [[(i, " ".join(x.split()), x.strip()) for i, x in enumerate([] if v is None else v) if x.strip()] for v in (a, b)]
        places = differences(*[[key for _, key, _ in side] for side in sides])
        return [{"side": name, "line_no": side[k][0], "line": side[k][2]} for name, side, at in zip(("removed", "added"), sides, places) for k in at]

    return pd.Series([one(a, b) for a, b in zip(old, new)])
