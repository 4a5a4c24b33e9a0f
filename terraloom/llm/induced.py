"""External induced sorting of suffixes, with common prefixes.

Induced sorting places the suffixes of some seed positions and derives all others by two sweeps: left to right for the
suffixes larger than their successor (L), right to left for the smaller ones (S). What a sweep still has to visit waits in
a monotone priority queue: a queue for each first symbol, in arrival order, which is the order of priority, as a sweep
never adds to a symbol that it has left. Queues beyond their share of memory go to files; so do the L suffixes between
the sweeps. A sweep takes a queue a chunk at a time, and works on whole chunks with array operations.

A queue holds tuples (position, common prefix with the tuple before it). The prefix of two suffixes induced one after the
other is one symbol more than the least prefix among the suffixes visited from the first one's to the second one's.

The seeds (LMS positions: S after L) are sorted by the same two sweeps on their substrings, whose carried prefixes tell
equal ones; these get equal names. The string of names is sorted by the same sorter again, with its prefixes, as long as
names repeat much; one of names that are nearly unique is sorted by pairs of names. Prefixes count up to `depth` symbols,
and suffixes that share as many may come in any order. The text may be a memory-mapped file.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Iterator

import numpy as np

CHUNK = 1 << 18
ITEM = np.dtype([("at", "<i8"), ("lcp", "<u2")])
#: A string of names is sorted by pairs of names if it is shorter than LEAST_NAMES or its names occur less than OFTEN times on average.
LEAST_NAMES, OFTEN = 1 << 12, 16


def items(at: np.ndarray, lcp: np.ndarray | int) -> np.ndarray:
    out = np.empty(len(at), ITEM)
    out["at"], out["lcp"] = at, lcp
    return out


class RangeMin:
    """Least values of ranges of an array, by a table of the minima of all ranges whose lengths are powers of two."""

    def __init__(self, values: np.ndarray) -> None:
        n = len(values)
        self.table = np.empty((max(n.bit_length(), 1), n), values.dtype)
        self.table[0] = values
        for k in range(1, n.bit_length()):
            half = 1 << (k - 1)
            np.minimum(self.table[k - 1, : n - 2 * half + 1], self.table[k - 1, half : n - half + 1], out=self.table[k, : n - 2 * half + 1])

    def least(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        k = np.frexp((last - first + 1).astype(float))[1] - 1
        flat, n = self.table.ravel(), self.table.shape[1]
        row = k.astype(np.int64) * n
        return np.minimum(flat[row + first], flat[row + last - np.left_shift(1, k) + 1])


class SymbolQueues:
    """FIFO queues of tuples, one for each symbol; the longest go to files while more than `budget` tuples wait in memory."""

    def __init__(self, symbols: int, budget: int, folder: str) -> None:
        self.memory: list[list[np.ndarray]] = [[] for _ in range(symbols)]
        self.sizes = np.zeros(symbols, np.int64)
        self.files: dict[int, str] = {}
        self.budget, self.held, self.folder, self.made = budget, 0, folder, 0

    def push(self, symbol: int, tuples: np.ndarray) -> None:
        self.memory[symbol].append(tuples)
        self.sizes[symbol] += len(tuples)
        self.held += len(tuples)
        while self.held > self.budget:
            self._spill(int(np.argmax(self.sizes)))

    def _spill(self, symbol: int) -> None:
        if symbol not in self.files:
            self.made += 1
            self.files[symbol] = os.path.join(self.folder, f"{id(self)}-{self.made}")
        with open(self.files[symbol], "ab") as f:
            for part in self.memory[symbol]:
                f.write(part.tobytes())
        self._forget(symbol)

    def _forget(self, symbol: int) -> None:
        self.held -= int(self.sizes[symbol])
        self.memory[symbol], self.sizes[symbol] = [], 0

    def drain(self, symbol: int) -> Iterator[np.ndarray]:
        """Chunks of a symbol's queue until it is empty, with what is pushed to it meanwhile."""
        while self.memory[symbol] or symbol in self.files:
            if symbol in self.files:
                path = self.files.pop(symbol)
                with open(path, "rb") as f:
                    while data := f.read(ITEM.itemsize * CHUNK):
                        yield np.frombuffer(data, ITEM)
                os.unlink(path)
                continue
            parts = self.memory[symbol]
            self._forget(symbol)
            waiting = parts[0] if len(parts) == 1 else np.concatenate(parts)
            for at in range(0, len(waiting), CHUNK):
                yield waiting[at : at + CHUNK]

    def drain_back(self, symbol: int) -> Iterator[np.ndarray]:
        """Chunks of a queue to which nothing is pushed any more, in the order they came; the last chunk first."""
        parts = self.memory[symbol]
        self._forget(symbol)
        yield from reversed(parts)
        if symbol in self.files:
            path = self.files.pop(symbol)
            with open(path, "rb") as f:
                n = f.seek(0, os.SEEK_END) // ITEM.itemsize
                for end in range(n, 0, -CHUNK):
                    start = max(end - CHUNK, 0)
                    f.seek(start * ITEM.itemsize)
                    yield np.frombuffer(f.read((end - start) * ITEM.itemsize), ITEM)
            os.unlink(path)


class Inducing:
    """The queues of one sweep: suffixes are visited in order, and each induces the one that starts a symbol before it."""

    def __init__(self, text: np.ndarray, smaller: np.ndarray, kind: bool, queues: SymbolQueues, cap: int) -> None:
        self.text, self.smaller, self.kind, self.queues, self.cap = text, smaller, kind, queues, cap
        #: The least prefix visited since the last tuple of each symbol came.
        self.since = np.zeros(len(queues.memory), np.uint16)

    def visit(self, seen: np.ndarray) -> None:
        if not len(seen):
            return
        before, lcp = seen["at"] - 1, seen["lcp"].copy()
        fits = self.smaller[before]  # the text's first suffix has none before it
        fits = fits if self.kind else ~fits
        fits &= before >= 0
        which = np.flatnonzero(fits)
        if not len(which):
            np.minimum(self.since, lcp.min(), out=self.since)
            return
        after = np.minimum.accumulate(lcp[::-1])[::-1]
        before = before[which]
        symbols = self.text[before]
        order = np.argsort(symbols, kind="stable")
        which, symbols = which[order], symbols[order]
        fresh = np.concatenate([[True], symbols[1:] != symbols[:-1]])
        edges = np.flatnonzero(fresh)
        firsts = symbols[edges]
        least = np.empty(len(which), np.uint16)
        least[edges] = np.minimum(self.since[firsts], np.minimum.accumulate(lcp)[which[edges]])
        others = np.flatnonzero(~fresh)
        if len(others):
            least[others] = RangeMin(lcp).least(which[others - 1] + 1, which[others])
        induced = items(before[order], np.minimum(least + 1, self.cap))
        ends = np.append(edges[1:], len(which))
        np.minimum(self.since, after[0], out=self.since)
        self.since[firsts] = np.append(after, np.uint16(self.cap))[which[ends - 1] + 1]
        for symbol, a, b in zip(firsts.tolist(), edges.tolist(), ends.tolist(), strict=True):
            self.queues.push(symbol, induced[a:b])


def types_of(text: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its successor; the last one, before the text's end, is larger."""
    n = len(text)
    out = np.zeros(n, bool)
    if n < 2:
        return out
    differs = np.flatnonzero(text[1:] != text[:-1])  # a run of equal symbols has the type of its last one
    rises = text[differs] < text[differs + 1]
    lengths = np.diff(np.concatenate([[-1], differs]))
    out[: int(differs[-1]) + 1 if len(differs) else 0] = np.repeat(rises, lengths)
    return out


class InducedSorter:
    """Sorts the suffixes of a text of small whole numbers by their first `depth` symbols at least; depth is below 65,535."""

    def __init__(self, text: np.ndarray, depth: int, budget: int = 1 << 24, folder: str | None = None) -> None:
        self.text, self.depth, self.budget = text, depth, budget
        self.cap = depth + 1
        self.symbols = int(text.max(initial=0)) + 1
        self.smaller = types_of(text)
        self.folder = folder
        self.spilled = 0

    def sort(self) -> np.ndarray:
        """The positions in the order of their suffixes."""
        return self.sort_with_prefixes()[0]

    def sort_with_prefixes(self) -> tuple[np.ndarray, np.ndarray]:
        """(positions in the order of their suffixes, the prefix that each has in common with the one before, up to depth)."""
        if len(self.text) < 2:
            return np.arange(len(self.text)), np.zeros(len(self.text), np.uint16)
        with tempfile.TemporaryDirectory(dir=self.folder) as folder:
            self.work = folder
            lms = np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1
            order, lcp = self._upward(self._induce(self._sorted_seeds(lms), sorted_=True))
            return order, np.minimum(lcp, self.depth)

    @staticmethod
    def _upward(descending: Iterator[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Tuples from the largest to the smallest, each with the prefix of the one before it, turned round."""
        parts = list(descending)
        whole = np.concatenate(parts) if parts else np.zeros(0, ITEM)
        lcp = np.zeros(len(whole), np.uint16)
        lcp[1:] = whole["lcp"][1:][::-1]
        return whole["at"][::-1].copy(), lcp

    def _sorted_seeds(self, lms: np.ndarray) -> np.ndarray:
        """The seeds as tuples, in the order of their suffixes."""
        n = len(lms)
        if n < 2:
            return items(lms, 0)
        order, lcp = self._upward(self._induce(items(lms, 0), sorted_=False))
        number = np.full(len(self.text), -1, np.int32 if n < 1 << 31 else np.int64)
        number[lms] = np.arange(n)
        rank = number[order]
        at = np.flatnonzero(rank >= 0)
        rank = rank[at]
        del number
        lcp = np.minimum.reduceat(lcp[: at[-1] + 1], np.concatenate([[0], at[:-1] + 1]))  # of each seed and the seed before
        size_of = np.append(lms[1:] + 1, len(self.text)) - lms  # a substring ends with the next seed's first symbol
        sizes = size_of[rank]
        fresh = np.ones(n, bool)
        fresh[1:] = ~((lcp[1:] >= self.cap) | ((sizes[1:] == sizes[:-1]) & (lcp[1:] >= sizes[1:])))
        at_end = int(np.flatnonzero(rank == n - 1)[0])  # the last substring ends with the text and is like no other
        fresh[at_end : at_end + 2] = True
        names = np.empty(n, np.int64)
        names[rank] = np.cumsum(fresh) - 1
        order, shared = self._sort_names(names, self.depth // 2 + 1)
        # names in common, then the least prefix between the two names that differ
        a, b = order[:-1], order[1:]
        shared = shared[1:].astype(np.int64)
        deep = shared >= self.depth // 2 + 1
        x, y = (names[np.minimum(i + shared, n - 1)] for i in (a, b))
        deep |= x == y
        low, high = np.minimum(x, y), np.maximum(x, y)
        between = RangeMin(lcp[fresh]).least(np.where(deep, 0, low + 1), np.where(deep, 0, high))
        a_, b_ = np.minimum(a + shared, n - 1), np.minimum(b + shared, n - 1)
        # where one substring begins the other, its last symbol is of the other type there: its run goes on in both
        size = np.minimum(size_of[a_], size_of[b_])
        begins = np.flatnonzero(~deep & (between >= size))
        ends = size[begins] - 1
        between = between.astype(np.int64)
        between[begins] = ends + np.minimum(self._runs(lms[a_[begins]] + ends), self._runs(lms[b_[begins]] + ends))
        prefix = lms[a_] - lms[a] + between
        return items(lms[order], np.concatenate([[0], np.where(deep, self.cap, np.minimum(prefix, self.cap))]))

    def _sort_names(self, names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """Order of the suffixes of a string of names, and the names that each has in common with the one before, up to depth."""
        n, kinds = len(names), int(names.max()) + 1
        if kinds == n:
            return np.argsort(names), np.zeros(n, np.uint16)
        if n >= LEAST_NAMES and n >= OFTEN * kinds:
            below = InducedSorter(names.astype(np.uint16) if kinds < 1 << 16 else names, depth, self.budget, self.folder)
            found = below.sort_with_prefixes()
            self.spilled += below.spilled
            return found
        return self._by_names(names, depth)

    def _by_names(self, names: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """As _sort_names, by pairs of names that cover twice as much each time; the last name occurs once."""
        n, step = len(names), 1
        order = np.argsort(names)
        levels = [(1, names)]
        while True:
            ranked = names[order]
            fresh = np.concatenate([[True], ranked[1:] != ranked[:-1]])
            open_ = np.flatnonzero(~(fresh & np.append(fresh[1:], True)))  # places whose name isn't unique yet
            if not len(open_) or step >= depth or step >= n:
                break
            first = np.maximum.accumulate(np.where(fresh, np.arange(n), 0))
            names = np.empty(n, np.int64)
            names[order] = first  # a name is the place where its equals start
            held = order[open_]
            after = np.where(held + step < n, names[np.minimum(held + step, n - 1)], -1)
            f = first[open_]
            inner = np.argsort(f * (n + 1) + after)  # one number for both: n is below 2^31; equals may come in any order
            order[open_] = held[inner]
            a = after[inner]
            new = np.concatenate([[True], (f[1:] != f[:-1]) | (a[1:] != a[:-1])])
            names[order[open_]] = open_[np.maximum.accumulate(np.where(new, np.arange(len(open_)), 0))]
            step *= 2
            levels.append((step, names))
        shared, a, b = np.zeros(n, np.int64), order[:-1].copy(), order[1:].copy()
        for step, names in reversed(levels):
            equal = np.where(names[a] == names[b], step, 0)
            shared[1:] += equal
            a += equal
            b += equal
        return order, np.minimum(shared, depth).astype(np.uint16)

    def _run(self, at: int) -> int:
        """How often the symbol at a position is repeated from there on, up to the cap."""
        piece = self.text[at : at + self.cap]
        other = np.flatnonzero(piece != piece[0])
        return int(other[0]) if len(other) else len(piece)

    def _runs(self, at: np.ndarray) -> np.ndarray:
        """How often the symbols at positions are repeated from there on."""
        ends = np.append(np.flatnonzero(self.text[1:] != self.text[:-1]), len(self.text) - 1)
        return ends[np.searchsorted(ends, at)] - at + 1

    def _induce(self, seeds: np.ndarray, sorted_: bool) -> Iterator[np.ndarray]:
        """All suffixes from ordered seeds, from the largest to the smallest, each with the prefix of the one before it.

        Where the seeds aren't sorted, only their first symbols count: what comes out is in the order of substrings up to
        the next seed, with the prefixes of these.
        """
        text, smaller = self.text, self.smaller
        by_symbol = np.argsort(text[seeds["at"]], kind="stable")
        seeds = seeds[by_symbol].copy()
        edges = np.searchsorted(text[seeds["at"]], np.arange(self.symbols + 1))
        if not sorted_:
            seeds["lcp"] = 1
        queues = SymbolQueues(self.symbols, self.budget, self.work)
        larger = SymbolQueues(self.symbols, self.budget, self.work)
        left = Inducing(text, smaller, False, queues, self.cap)
        last = len(text) - 1
        queues.push(int(text[last]), items(np.array([last]), 0))
        for symbol in range(self.symbols):
            largest = -1
            for chunk in queues.drain(symbol):
                if largest < 0:
                    chunk = chunk.copy()
                    chunk["lcp"][0] = 0
                largest = int(chunk["at"][-1])
                larger.push(symbol, chunk)
                left.visit(chunk)
            own = seeds[edges[symbol] : edges[symbol + 1]]
            if len(own):
                smallest = int(own["at"][0])
                own["lcp"][0] = 0 if largest < 0 else min(self._run(largest), self._run(smallest)) if sorted_ else 1
                left.visit(own)
        self.spilled += queues.made + larger.made
        queues = SymbolQueues(self.symbols, self.budget, self.work)
        right = Inducing(text, smaller, True, queues, self.cap)
        for symbol in range(self.symbols - 1, -1, -1):
            before = -1
            for chunk in queues.drain(symbol):  # arrives from the largest to the smallest
                if before < 0:
                    chunk = chunk.copy()
                    chunk["lcp"][0] = 0
                before = int(chunk["at"][-1])
                yield chunk
                right.visit(chunk)
            shared = 0  # of the next chunk's largest and what was visited before it
            for chunk in larger.drain_back(symbol):
                turned = chunk[::-1].copy()
                turned["lcp"][1:] = chunk["lcp"][:0:-1]
                if before >= 0:
                    shared, before = min(self._run(before), self._run(int(turned["at"][0]))), -1
                turned["lcp"][0] = shared
                shared = int(chunk["lcp"][0])
                yield turned
                right.visit(turned)
        self.spilled += queues.made


def repeat_groups(order: np.ndarray, lcp: np.ndarray, depth: int, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, group number): suffixes that share their first `depth` symbols of a text of `size` share a group."""
    number = np.cumsum(lcp < depth)
    whole = order + depth <= size
    return order[whole], number[whole]
