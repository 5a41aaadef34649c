"""Order-preserving matching: unit sequences by scored alignment, texts by longest common subsequence."""

from __future__ import annotations

import numpy as np

#: Scores of the unit alignment (fixed values).
SAME, BONUS, DIFFERENT, GAP = 2, 1, -2, -1
#: Texts below this length are cheaper without arrays.
SMALL = 96


class BudgetError(Exception):
    """An alignment would pass its budget of cells; nothing of it is done."""


class Cells:
    """Budget of cells: one limit for a single alignment, one for all of a cohort. Charged before the work."""

    def __init__(self, single: int, total: int):
        self.single, self.left = single, total

    def charge(self, cells: int) -> None:
        if cells > self.left:
            raise BudgetError(f"total alignment cell budget exhausted: required {cells}, remaining {self.left}")
        self.left -= cells

    def check(self, cells: int, what: str) -> None:
        if cells > self.single:
            raise BudgetError(f"{what} alignment cells {cells} exceed {self.single}")


def align_units(a: list[tuple], b: list[tuple]) -> list[int | None]:
    """For each unit of ``a`` the matched unit of ``b`` or None. A unit is (key, content).

    Global alignment; going back, a match on equal keys is preferred, then leaving out a unit of ``a``.
    """
    n, m = len(a), len(b)
    row = [GAP * j for j in range(m + 1)]
    rows = [row]
    for i in range(1, n + 1):
        key, content = a[i - 1]
        above, row = row, [GAP * i]
        for j in range(1, m + 1):
            other = b[j - 1]
            pair = SAME + BONUS * (content == other[1]) if key == other[0] else DIFFERENT
            row.append(max(above[j - 1] + pair, above[j] + GAP, row[j - 1] + GAP))
        rows.append(row)
    match: list[int | None] = [None] * n
    i, j = n, m
    while i and j:
        here = rows[i][j]
        if a[i - 1][0] == b[j - 1][0] and here == rows[i - 1][j - 1] + SAME + BONUS * (a[i - 1][1] == b[j - 1][1]):
            i, j = i - 1, j - 1
            match[i] = j
        elif here == rows[i - 1][j] + GAP:
            i -= 1
        else:
            j -= 1
    return match


def _prefix_lengths(a: str, masks: dict[str, int], n: int) -> np.ndarray:
    """Common-subsequence length of ``a`` with every prefix of the other text, one big-integer step a character.

    Bit j of the state is 0 where the length grows at character j of the other text.
    """
    full = (1 << n) - 1
    state = full
    for c in a:
        hit = state & masks.get(c, 0)
        if hit:
            state = ((state + hit) | (state - hit)) & full
    if n < SMALL:
        out, total = [0], 0
        for _ in range(n):
            total += not state & 1
            out.append(total)
            state >>= 1
        return np.array(out)
    raw = np.frombuffer(state.to_bytes((n + 7) // 8, "little"), np.uint8)
    grows = 1 - np.unpackbits(raw, bitorder="little")[:n].astype(np.int64)
    return np.concatenate(([0], np.cumsum(grows)))


def _masks(b: str) -> dict[str, int]:
    """Positions of each character as the bits of a number."""
    if len(b) < SMALL:
        bits: dict[str, int] = {}
        for j, c in enumerate(b):
            bits[c] = bits.get(c, 0) | 1 << j
        return bits
    where: dict[str, list[int]] = {}
    for j, c in enumerate(b):
        where.setdefault(c, []).append(j)
    out = {}
    for c, at in where.items():
        flags = np.zeros(len(b), np.uint8)
        flags[at] = 1
        out[c] = int.from_bytes(np.packbits(flags, bitorder="little").tobytes(), "little")
    return out


def lcs_match(a: str, b: str) -> list[int]:
    """For each character of ``a`` its partner in ``b``, -1 for none; linear memory.

    ``a`` is halved, ``b`` split where both halves have most in common (the first such place); a single
    character takes its first occurrence.
    """
    match = [-1] * len(a)
    todo = [(0, len(a), 0, len(b))]
    while todo:
        a0, a1, b0, b1 = todo.pop()
        if a0 == a1 or b0 == b1:
            continue
        if a1 - a0 == 1:
            match[a0] = b.find(a[a0], b0, b1)
            continue
        mid, part = a0 + (a1 - a0) // 2, b[b0:b1]
        left = _prefix_lengths(a[a0:mid], _masks(part), len(part))
        back = part[::-1]
        right = _prefix_lengths(a[mid:a1][::-1], _masks(back), len(back))[::-1]
        total = left + right
        cut = int(total.argmax())
        if total[cut] == 0:
            continue
        todo.append((a0, mid, b0, b0 + cut))
        todo.append((mid, a1, b0 + cut, b1))
    return match


def match_text(a: str, b: str, cells: Cells, memo: dict) -> list[int]:
    """lcs_match under the budget; equal texts match character by character and cost their length."""
    if a == b:
        cells.charge(len(a))
        return list(range(len(a)))
    need = (len(a) + 1) * (len(b) + 1)
    cells.check(need, "text")
    cells.charge(need)
    if (a, b) not in memo:
        memo[a, b] = lcs_match(a, b)
    return memo[a, b]
