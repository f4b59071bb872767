"""Induced sorting of suffixes with common-prefix values, by vector operations.

The order of the leftmost-smaller suffixes induces the order of all others in two
sweeps over a monotone priority queue.  The queue is keyed by first character; its
entries (position, common prefix with the entry before it) come and go in runs, so a
whole run is handled at once, and runs that don't fit in memory are kept in files of
`folder` until their turn.  The leftmost-smaller suffixes are sorted by the recursive
step: their substrings are named by one sweep, and the string of names is sorted by
doubling to the depth that is asked for.

Common-prefix values are carried through: an induced entry shares one character more
with its neighbour than the entries that induced both, which is a minimum over the
values between these.  Values, and the order, are exact up to `depth` characters.
"""

from __future__ import annotations

import tempfile
import uuid
from collections import defaultdict

import numpy as np

from .textscan import mix

U = np.uint64
CHARS = 257  # 0 ends a text; byte b is b + 1


class Queue:
    """Runs of (positions, values) by first character, first in first out."""

    def __init__(self, folder: str | None, most: int):
        self.folder, self.most, self.held = folder, most, 0
        self.runs: dict[int, list] = defaultdict(list)

    def push(self, char: int, positions: np.ndarray, values: np.ndarray) -> None:
        self.held += positions.nbytes + values.nbytes
        if self.folder and self.held > self.most:
            path = f"{self.folder}/{uuid.uuid4().hex}.npz"
            with open(path, "wb") as f:
                np.save(f, positions)
                np.save(f, values)
            self.held -= positions.nbytes + values.nbytes
            self.runs[char].append(path)
        else:
            self.runs[char].append((positions, values))

    def pop(self, char: int) -> list[tuple[np.ndarray, np.ndarray]]:
        out = []
        for run in self.runs.pop(char, []):
            if isinstance(run, str):
                with open(run, "rb") as f:
                    run = np.load(f), np.load(f)
            else:
                self.held -= run[0].nbytes + run[1].nbytes
            out.append(run)
        return out


class Suffixes:
    def __init__(self, text: np.ndarray, depth: int, folder: str | None = None, most: int = 1 << 28):
        """text: int16, characters from 0 to 256, its last is 0."""
        self.t, self.depth, self.folder, self.most = text, depth, folder, most
        n = len(text)
        where = np.where(text[:-1] != text[1:], np.arange(n - 1), n - 2)
        ends = np.minimum.accumulate(where[::-1])[::-1]
        self.small = np.ones(n, bool)  # smaller than the suffix after it
        self.small[:-1] = text[ends] < text[ends + 1]
        self.lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1

    def common(self, a: int, b: int) -> int:
        """Common prefix of two suffixes, up to depth."""
        m = min(self.depth, len(self.t) - max(a, b))
        differ = np.flatnonzero(self.t[a : a + m] != self.t[b : b + m])
        return int(differ[0]) if len(differ) else m

    def _send(self, queue: Queue, low: np.ndarray, source: np.ndarray, value: np.ndarray, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """Induces the entries before those of a run; returns the ones that stay in its own bucket."""
        if not len(source):
            return source, value
        char = int(self.t[source[0]])
        at = np.flatnonzero(source > 0)
        before = source[at] - 1
        ok = self.small[before] == small
        at, before = at[ok], before[ok]
        chars = self.t[before]
        order = np.argsort(chars, kind="stable")
        at, before, chars = at[order], before[order], chars[order]
        cuts = np.flatnonzero(np.concatenate([[True], chars[1:] != chars[:-1]])) if len(chars) else np.zeros(0, np.int64)
        if not self.carry:
            same = (source[:0], value)
            for i, a in enumerate(cuts.tolist()):
                run = (before[a : int(cuts[i + 1]) if i + 1 < len(cuts) else len(chars)], value)
                if chars[a] == char:
                    same = run
                else:
                    queue.push(int(chars[a]), *run)
            return same
        total = value.min()
        same = (source[:0], value[:0])
        fresh = {}
        for i, a in enumerate(cuts.tolist()):
            b = int(cuts[i + 1]) if i + 1 < len(cuts) else len(chars)
            c, idx = int(chars[a]), at[a:b]
            least = np.empty(b - a, np.int16)
            least[0] = min(int(low[c]), int(value[: idx[0] + 1].min()))
            if b - a > 1:
                least[1:] = np.minimum.reduceat(value[: idx[-1] + 1], idx[:-1] + 1)
            rest = value[idx[-1] + 1 :]
            fresh[c] = int(rest.min()) if len(rest) else self.depth
            run = (before[a:b], np.minimum(least + 1, self.depth).astype(np.int16))
            if c == char:
                same = run
            else:
                queue.push(c, *run)
        np.minimum(low, total, out=low)
        for c, x in fresh.items():
            low[c] = x
        return same

    def _join(self, runs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        if not runs:
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        return np.concatenate([r[0] for r in runs]), np.concatenate([r[1] for r in runs])

    def _bucket(self, queue: Queue, low: np.ndarray, char: int, small: bool) -> tuple[np.ndarray, np.ndarray]:
        """All entries that the queue holds for a character, with those that they induce themselves."""
        done, todo = [], self._join(queue.pop(char))
        if len(todo[1]):
            todo[1][0] = 0
        while len(todo[0]):
            done.append(todo)
            todo = self._send(queue, low, *todo, small)
        return self._join(done)

    def induce(self, lms: np.ndarray, values: np.ndarray, carry: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """The suffix array and its common-prefix values (empty unless carried), from sorted
        leftmost-smaller suffixes."""
        self.carry = carry
        bounds = np.searchsorted(self.t[lms], np.arange(CHARS + 1)) if len(lms) else np.zeros(CHARS + 1, np.int64)
        queue, low = Queue(self.folder, self.most), np.zeros(CHARS, np.int64)
        large: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for c in range(CHARS):
            low[:] = 0
            run = self._bucket(queue, low, c, False)
            large[c] = run
            own, value = lms[bounds[c] : bounds[c + 1]], values[bounds[c] : bounds[c + 1]].copy()
            if len(own) and not carry:
                self._send(queue, low, own, values, False)
            elif len(own):
                value[0] = self.common(int(run[0][-1]), int(own[0])) if len(run[0]) else 0
                self._send(queue, low, own, value, False)
        queue, low = Queue(self.folder, self.most), np.zeros(CHARS, np.int64)
        out: list[tuple[np.ndarray, np.ndarray]] = []
        for c in range(CHARS - 1, -1, -1):
            low[:] = 0
            down = self._bucket(queue, low, c, True)
            if c == 0:  # the very last end has no suffix after it that could induce it
                last = len(self.t) - 1
                if not carry:
                    down = (np.append(down[0], last), down[1])
                else:
                    value = self.common(int(down[0][-1]), last) if len(down[0]) else 0
                    down = (np.append(down[0], last), np.append(down[1], np.int16(value)))
            up = large[c]
            if not carry:
                self._send(queue, low, up[0][::-1], values, True)
                out.append((np.concatenate([down[0], up[0][::-1]])[::-1], values))
                continue
            back = (up[0][::-1], np.concatenate([np.zeros(min(1, len(up[0])), np.int16), up[1][:0:-1]]))
            if len(back[0]):
                if len(down[0]):
                    back[1][0] = self.common(int(down[0][-1]), int(back[0][0]))
                self._send(queue, low, *back, True)
            # descending values stand between an entry and the one above it: shift for the ascending order
            positions = np.concatenate([down[0], back[0]])[::-1]
            above = np.concatenate([down[1], back[1]])
            out.append((positions, np.concatenate([np.zeros(1, np.int16), above[:0:-1]]) if len(above) else above))
        return self._join(out[::-1])

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        lms, t = self.lms, self.t
        if not len(lms):
            return self.induce(lms, np.zeros(0, np.int16))
        rng = np.random.Generator(np.random.PCG64(7))
        table = rng.integers(0, 2**64, CHARS, np.uint64)
        odd = U(0x9E3779B97F4A7C15)
        power, inverse = np.full(len(t) + 1, odd), np.full(len(t) + 1, U(pow(int(odd), -1, 2**64)))
        power[0] = inverse[0] = 1
        power, inverse = np.cumprod(power), np.cumprod(inverse)
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(table[t] * power[:-1])])
        prefix = lambda a, m: mix((sums[a + m] - sums[a]) * inverse[a])
        # names: one sweep from unsorted suffixes sorts the substrings between them
        first = lms[np.argsort(t[lms], kind="stable")]
        rough, _ = self.induce(first, np.zeros(0, np.int16), carry=False)
        number = np.full(len(t), -1, np.int64)
        number[lms] = np.arange(len(lms))
        order = number[rough]
        order = order[order >= 0]
        length = np.diff(np.append(lms, len(t) - 1)) + 1
        told = prefix(lms, np.minimum(length, len(t) - lms))
        new = np.ones(len(order), bool)
        new[1:] = (told[order][1:] != told[order][:-1]) | (length[order][1:] != length[order][:-1])
        rank = np.empty(len(lms), np.int64)
        rank[order] = np.cumsum(new)
        step = 1
        while 2 * step < self.depth and rank.max() < len(rank):  # a name is two characters or more
            after = np.zeros(len(rank), np.int64)
            after[:-step] = rank[step:]
            both = rank * (len(rank) + 1) + after
            order = np.argsort(both)
            both = both[order]
            new = np.ones(len(order), bool)
            new[1:] = both[1:] != both[:-1]
            rank[order] = np.cumsum(new)
            step *= 2
        order = np.argsort(rank)
        lms = lms[order]
        values = np.zeros(len(lms), np.int64)
        values[1:] = np.minimum(self.depth, len(t) - np.maximum(lms[1:], lms[:-1]))
        # Equal ranks share all of the depth; the others are searched.
        at = np.flatnonzero(rank[order][1:] != rank[order][:-1]) + 1
        a, b, low, high = lms[at - 1], lms[at], np.zeros(len(at), np.int64), values[at]
        while (low < high).any():
            middle = (low + high + 1) >> 1
            equal = prefix(a, middle) == prefix(b, middle)
            low, high = np.where(equal, middle, low), np.where(equal, high, middle - 1)
        values[at] = low
        return self.induce(lms, values.astype(np.int16))


def suffix_array(texts: list[bytes], depth: int, spill_over: int | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts in the joined text, common prefixes with the entry before, offsets of the texts).

    Texts (not empty) are joined with an end after each.  Above spill_over bytes of queue, runs go
    to files that only this call sees and that end with it."""
    sizes = np.array([len(x) + 1 for x in texts], np.int64)
    joined = np.frombuffer(b"\0".join([*texts, b""]), np.uint8).astype(np.int16) + 1
    offsets = np.concatenate([[0], np.cumsum(sizes)])
    joined[offsets[1:] - 1] = 0
    if spill_over is None:
        return (*Suffixes(joined, depth).sort(), offsets)
    with tempfile.TemporaryDirectory() as folder:
        return (*Suffixes(joined, depth, folder, spill_over).sort(), offsets)
