"""All words of a list found in texts in one pass: a trie with failure links, held in arrays."""

from __future__ import annotations

import io
from collections.abc import Sequence

import numpy as np

LANE = 256  # characters that one lane scans at least
_FREE = np.int64(-1)
_SPREAD = np.uint64(0x9E3779B97F4A7C15)


def code_points(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """The characters of all texts in a row, and where each text ends."""
    sizes = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    data = "".join(texts).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, dtype="<u4"), np.cumsum(sizes)


class Steps:
    """The trie's edges from ``state * classes + character class`` to states, hashed.

    ``slots`` says where an edge may be: at its hash or the next ``reach`` places.
    """

    def __init__(self, edges: np.ndarray, targets: np.ndarray, reach: int):
        self.edges, self.targets, self.reach = edges, targets, reach
        self._shift = np.uint64(64 - int(len(edges)).bit_length() + 1)

    @classmethod
    def of(cls, edges: np.ndarray, targets: np.ndarray) -> Steps:
        size = 1 << max(4, int(2 * len(edges)).bit_length())
        held = cls(np.full(size, _FREE), np.zeros(size, dtype=np.int32), 0)
        left, place = np.arange(len(edges)), held._home(edges)
        while len(left):
            free = held.edges[place] == _FREE
            # Of several edges for one free place the last one written stays.
            held.edges[place[free]] = edges[left[free]]
            put = held.edges[place] == edges[left]
            held.targets[place[put]] = targets[left[put]]
            left, place = left[~put], (place[~put] + 1) & (size - 1)
            held.reach += 1
        return held

    def _home(self, edges: np.ndarray) -> np.ndarray:
        return ((edges.astype(np.uint64) * _SPREAD) >> self._shift).astype(np.int64)

    def find(self, edges: np.ndarray) -> np.ndarray:
        """The state that each edge leads to, -1 if there is none."""
        place = self._home(edges)
        held = self.edges[place]
        found = np.where(held == edges, self.targets[place], -1)
        left = np.flatnonzero((held != edges) & (held != _FREE))
        for _ in range(self.reach):
            if not len(left):
                break
            place[left] = (place[left] + 1) & (len(self.edges) - 1)
            held = self.edges[place[left]]
            hit = held == edges[left]
            found[left[hit]] = self.targets[place[left[hit]]]
            left = left[~hit & (held != _FREE)]
        return found


class WordAutomaton:
    """Finds the words of a list inside texts; what a word is part of does not matter.

    State 0 is the root. ``fail`` is the longest other state that a state ends with, ``word`` the
    number of the word that a state spells (or -1), ``next_word`` the longest state on the chain of
    ``fail`` that spells one (or 0).
    """

    FIELDS = ("alphabet", "edges", "targets", "fail", "word", "next_word", "numbers")

    def __init__(self, longest: int, reach: int, **arrays: np.ndarray):
        self.longest = longest
        for name in self.FIELDS:
            setattr(self, name, arrays[name])
        self._steps = Steps(self.edges, self.targets, reach)
        self._classes = len(self.alphabet) + 1
        self._ends = (self.word >= 0) | (self.next_word > 0)
        # The empty word is in every text.
        self._always = self.numbers[1:] if self.numbers[0] else self.numbers[:0]

    @classmethod
    def build(cls, words: Sequence[str]) -> WordAutomaton:
        """From distinct words; a word's number is its place in the list."""
        codes, to = code_points(words)
        sizes = np.diff(to, prepend=0)
        alphabet, classes = np.unique(codes, return_inverse=True)
        at, width = to - sizes, len(alphabet) + 1
        state, word = np.zeros(len(words), dtype=np.int64), [np.full(1, -1, dtype=np.int32)]
        edges, parents, marks, count = [], [], [], 1
        for depth in range(int(sizes.max(initial=0))):
            going = np.flatnonzero(sizes > depth)
            mark = classes[at[going] + depth] + 1
            new, which = np.unique(state[going] * width + mark, return_inverse=True)
            state[going] = count + which
            spelt = np.full(len(new), -1, dtype=np.int32)
            ending = sizes[going] == depth + 1
            spelt[which[ending]] = going[ending]
            edges.append(new)
            parents.append(new // width)
            marks.append(new % width)
            word.append(spelt)
            count += len(new)
        edge = np.concatenate(edges) if edges else np.zeros(0, dtype=np.int64)
        steps = Steps.of(edge, np.arange(1, count, dtype=np.int32))
        word = np.concatenate(word)
        fail, next_word = np.zeros(count, dtype=np.int32), np.zeros(count, dtype=np.int32)
        first = 1
        for depth, (parent, mark) in enumerate(zip(parents, marks)):
            own = np.arange(first, first + len(parent))
            first += len(parent)
            if depth:
                fail[own] = _follow(steps, fail, width, fail[parent].astype(np.int64), mark)
            back = fail[own]
            next_word[own] = np.where(word[back] >= 0, back, next_word[back])
        always = np.flatnonzero(sizes == 0)
        return cls(
            int(sizes.max(initial=0)),
            steps.reach,
            alphabet=alphabet,
            edges=steps.edges,
            targets=steps.targets,
            fail=fail,
            word=word,
            next_word=next_word,
            numbers=np.concatenate(([len(always)], always)),
        )

    def to_bytes(self) -> bytes:
        out = io.BytesIO()
        bounds = np.array([self.longest, self._steps.reach])
        np.savez(out, bounds=bounds, **{n: getattr(self, n) for n in self.FIELDS})
        return out.getvalue()

    @classmethod
    def from_bytes(cls, data: bytes) -> WordAutomaton:
        with np.load(io.BytesIO(data)) as held:
            longest, reach = held["bounds"].tolist()
            return cls(longest, reach, **{n: held[n] for n in cls.FIELDS})

    def find(self, texts: Sequence[str]) -> list[np.ndarray]:
        """For each text the numbers of the words in it, once each and in order.

        The texts are cut into lanes of equal length that are scanned side by side, one character of
        each at a time; a lane begins early by the length of the longest word less one, so that it
        knows what a word that ends in it began with.
        """
        codes, ends = code_points(texts)
        pairs = [np.arange(len(texts)) * len(self.word) + w for w in self._always.tolist()]
        if len(codes) and self.longest:
            at = np.searchsorted(self.alphabet, codes)
            known = self.alphabet[np.minimum(at, len(self.alphabet) - 1)] == codes
            marks = np.where(known, at + 1, 0)  # 0: in no word
            places, words = self._scan(marks, ends)
            pairs.append(np.searchsorted(ends, places, side="right") * len(self.word) + words)
        found = np.unique(np.concatenate(pairs)) if pairs else np.zeros(0, dtype=np.int64)
        cuts = np.searchsorted(found, np.arange(1, len(texts)) * len(self.word))
        return np.split(found % len(self.word), cuts)

    def _scan(self, marks: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where words end, and which."""
        n, early = len(marks), self.longest - 1
        lane = max(LANE, 4 * early)
        starts = np.arange(0, n, lane)
        begins = np.zeros(n + 1, dtype=bool)
        begins[ends] = True  # a text begins where another ends: nothing goes on from there
        state, places, words = np.zeros(len(starts), dtype=np.int64), [], []
        for step in range(-early, lane):
            at = starts + step
            inside = (at >= 0) & (at < n)
            which = np.flatnonzero(inside) if not inside.all() else slice(None)
            at = at[which]
            if not len(at):
                continue
            before = np.where(begins[at], 0, state[which])
            after = _follow(self._steps, self.fail, self._classes, before, marks[at])
            state[which] = after
            if step < 0:
                continue
            hit = np.flatnonzero(self._ends[after])
            place, spelt = at[hit], after[hit]
            while len(spelt):
                word = self.word[spelt]
                places.append(place[word >= 0])
                words.append(word[word >= 0])
                spelt = self.next_word[spelt]
                place, spelt = place[spelt > 0], spelt[spelt > 0]
        if not places:
            return np.zeros(0, dtype=np.int64), np.zeros(0, dtype=np.int64)
        return np.concatenate(places), np.concatenate(words).astype(np.int64)


def _follow(steps: Steps, fail: np.ndarray, width: int, state: np.ndarray, mark: np.ndarray) -> np.ndarray:
    """The state after a character: the longest that goes on with it, else the root."""
    found = steps.find(state * width + mark)
    found[mark == 0] = 0
    left = np.flatnonzero((found < 0) & (state > 0))
    back = state[left]
    while len(left):
        back = fail[back].astype(np.int64)
        found[left] = steps.find(back * width + mark[left])
        on = (found[left] < 0) & (back > 0)
        left, back = left[on], back[on]
    return np.maximum(found, 0)
