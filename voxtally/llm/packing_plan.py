"""How many pieces of which lengths share a sequence: linear grouping and best fit over counts.

Everything here works on the number of pieces per length, at most one number per token of the
capacity, so its cost does not depend on the size of the corpus.
"""

from __future__ import annotations

from collections import defaultdict, deque
from dataclasses import dataclass, field

import numpy as np

GROUPS = 64  # equal-cardinality groups of the long pieces
SMALL = (6, 4, 3, 2)  # pieces up to the capacity over this are short; the best of these counts
PIVOTS = 600  # most steps of the linear programme; fewer sequences are all that more could give


@dataclass
class Run:
    """``count`` sequences with the same lengths in the same places."""

    count: int
    room: int
    parts: list[tuple[int, int]] = field(default_factory=list)  # (length, pieces of it)

    def split(self, count: int) -> Run:
        """Take ``count`` sequences off this run."""
        self.count -= count
        return Run(count, self.room, list(self.parts))

    def add(self, length: int, pieces: int) -> None:
        self.parts.append((length, pieces))
        self.room -= length * pieces


def groups_of(counts: dict[int, int], n_groups: int) -> list[tuple[int, deque[list[int]]]]:
    """Linear grouping: ``(rounded length, [[length, pieces], …])``, longest first.

    Pieces in order of length are cut into groups of equal cardinality; a group's rounded length is
    that of its longest piece.
    """
    total = sum(counts.values())
    share = max(1, -(-total // n_groups))
    groups: list[tuple[int, deque[list[int]]]] = []
    room = 0
    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            if room == 0:
                if groups and groups[-1][0] == length:
                    room = left  # equal lengths need no second group
                else:
                    groups.append((length, deque()))
                    room = share
            taken = min(left, room)
            groups[-1][1].append([length, taken])
            left -= taken
            room -= taken
    return groups


def configurations(sizes: np.ndarray, demand: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """``(pieces per size, sequences)``: the whole parts of the cheapest mix of configurations.

    The linear programme "fewest sequences that hold the demand" by column generation: the prices
    of the sizes in the present mix, a knapsack that finds the configuration worth most at these
    prices, and an exchange while that is worth more than a sequence.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(PIVOTS):
        amounts = np.linalg.solve(basis, demand)
        prices = np.linalg.solve(basis.T, np.ones(k))
        column, worth = _knapsack(sizes, prices, capacity)
        if worth <= 1 + 1e-7:
            break
        change = np.linalg.solve(basis, column)
        ratios = np.where(change > 1e-9, amounts / np.where(change > 1e-9, change, 1), np.inf)
        leaving = int(ratios.argmin())
        if not np.isfinite(ratios[leaving]):
            break
        basis[:, leaving] = column
    amounts = np.linalg.solve(basis, demand)
    return [
        (basis[:, j].round().astype(int), int(amounts[j] + 1e-6)) for j in np.argsort(-amounts) if amounts[j] >= 1
    ]


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    best = np.zeros(capacity + 1)
    choice = np.full(capacity + 1, -1)
    least = int(sizes.min())
    order = np.argsort(sizes)
    ascending = sizes[order]
    values = np.maximum(prices[order], 0)
    fits = np.searchsorted(ascending, np.arange(capacity + 1), side="right")
    for room in range(least, capacity + 1):
        n = fits[room]
        worth = best[room - ascending[:n]] + values[:n]
        j = int(worth.argmax())
        best[room], choice[room] = worth[j], order[j]
    column, room = np.zeros(len(sizes)), capacity
    while room >= least and choice[room] >= 0:
        column[choice[room]] += 1
        room -= int(sizes[choice[room]])
    return column, float(best[capacity])


def _fill(groups, mix, capacity: int) -> list[Run]:
    """Put actual lengths into the places of the configurations, except the shortest of several.

    Actual pieces are shorter than the rounded ones, so the room for the last piece differs between
    sequences of one configuration; best fit then chooses it by that room.
    """
    runs: list[Run] = []
    for column, count in mix:
        places = [j for j in np.flatnonzero(column) for _ in range(column[j])]
        places = places[:-1] or places
        part = Run(count, capacity)
        parts = [part]
        for j in places:
            queue = groups[j][1]
            done: list[Run] = []
            for run in parts:
                while run.count and queue:
                    length, left = queue[0]
                    taken = min(left, run.count)
                    piece = run.split(taken) if taken < run.count else run
                    piece.add(int(length), 1)
                    queue[0][1] -= taken
                    if not queue[0][1]:
                        queue.popleft()
                    done.append(piece)
                    if piece is run:
                        break
                else:
                    if run.count:
                        done.append(run)
            parts = done
        runs += [r for r in parts if r.parts]
    return runs


def best_fit(runs: list[Run], counts: dict[int, int], capacity: int) -> list[Run]:
    """Best fit, longest first: each piece goes where the least room is left over."""
    by_room: dict[int, list[Run]] = defaultdict(list)
    for run in runs:
        by_room[run.room].append(run)
    for length in sorted(counts, reverse=True):
        left = counts[length]
        for room in sorted(r for r in by_room if r >= length):
            if not left:
                break
            each = room // length
            waiting, by_room[room] = by_room[room], []
            for run in waiting:
                full = min(run.count, left // each)
                if full:
                    piece = run.split(full) if full < run.count else run
                    piece.add(length, each)
                    by_room[piece.room].append(piece)
                    left -= full * each
                    if piece is run:
                        continue
                if 0 < left < each:
                    piece = run.split(1) if run.count > 1 else run
                    piece.add(length, left)
                    by_room[piece.room].append(piece)
                    left = 0
                    if piece is run:
                        continue
                by_room[room].append(run)
        each = capacity // length
        for count, pieces in ((left // each, each), (1, left % each)):
            if count and pieces:
                run = Run(count, capacity)
                run.add(length, pieces)
                by_room[run.room].append(run)
    return [run for bucket in by_room.values() for run in bucket]


def pack_counts(counts: dict[int, int], capacity: int) -> list[Run]:
    """The runs of sequences that hold all pieces: the best over some bounds of what is short."""
    best: list[Run] | None = None
    for share in SMALL:
        large = {n: c for n, c in counts.items() if n > capacity // share}
        left = defaultdict(int, {n: c for n, c in counts.items() if n not in large})
        runs: list[Run] = []
        if large:
            groups = groups_of(large, GROUPS)
            sizes = np.array([size for size, _ in groups])
            demand = np.array([sum(c for _, c in queue) for _, queue in groups], dtype=float)
            runs = _fill(groups, configurations(sizes, demand, capacity), capacity)
            for _, queue in groups:
                for length, count in queue:
                    left[length] += count
        runs = best_fit(runs, left, capacity)
        if best is None or sum(r.count for r in runs) < sum(r.count for r in best):
            best = runs
    return best or []


@dataclass(frozen=True)
class Places:
    """Where the pieces of each length go, by their number within the length."""

    key: np.ndarray
    each: np.ndarray
    sequence: np.ndarray
    offset: np.ndarray

    SHIFT = 50  # a length's pieces are numbered below 2 to the 50

    @classmethod
    def of(cls, runs: list[Run]) -> Places:
        rows, used, sequence = [], defaultdict(int), 0
        for run in runs:
            offset = 0
            for length, pieces in run.parts:
                rows.append(((length << cls.SHIFT) + used[length], pieces, sequence, offset))
                used[length] += run.count * pieces
                offset += length * pieces
            sequence += run.count
        columns = np.array(sorted(rows), dtype=np.int64).reshape(-1, 4).T
        return cls(*columns)

    def find(self, length: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = (length << self.SHIFT) + number
        at = np.searchsorted(self.key, key, side="right") - 1
        past = key - self.key[at]
        return self.sequence[at] + past // self.each[at], self.offset[at] + past % self.each[at] * length
