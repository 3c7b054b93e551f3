"""External induced sorting of suffixes, with their common prefixes, over queues that spill to disk.

Suffixes are of type S or L, as the next one is greater or smaller. The leftmost S-suffixes are named
by their substrings, and the string of names is ordered by recursion. From their order all L-suffixes
are induced in one scan and from these all S-suffixes in a second. The scans' priority queue has keys
(character, arrival), so it is a first-in first-out queue for each character, read and filled in whole
chunks. What it carries are tuples of a suffix: its place, the character before it, and the length of the
prefix that it has in common with the suffix before it in order. A suffix that is induced takes its
tuple from the scanned ones: its common prefix is one more than the least of those scanned since the
last suffix for the same character, so neighbours are never compared after the sort.

Chunks and arrays beyond a memory budget lie in files of the task, so a text may be far larger than
memory. Orders and common prefixes hold for the first `depth` characters; runs of one character that
are longer than that are laid out at once.
"""

from __future__ import annotations

import tempfile
from collections import deque

import numpy as np

#: Bytes of queued tuples that a sort keeps in memory, and of its arrays.
QUEUED, ARRAYS = 64 << 20, 256 << 20
#: Suffixes of a chunk.
CHUNK = 1 << 18
#: Strings of names with more different names than this are ordered by doubling: a scan takes a step for each character.
ALPHABET = 2048


class Space:
    """Arrays in memory up to a budget, and beyond it in files."""

    def __init__(self, memory: int):
        self.left = memory

    def array(self, n: int, kind) -> np.ndarray:
        """An array whose values aren't set."""
        size = n * np.dtype(kind).itemsize
        if size <= self.left or not n:
            self.left -= size
            return np.empty(n, kind)
        with tempfile.TemporaryFile() as f:
            f.truncate(size)
            return np.memmap(f, kind, "r+", shape=(n,))


class Queues:
    """One first-in first-out queue of chunks of suffix tuples (place, character before, common prefix) for each character."""

    KINDS = (np.int64, np.int32, np.int32)

    def __init__(self, characters: int, memory: int = QUEUED):
        self.chunks: list[deque] = [deque() for _ in range(characters)]
        self.memory, self.held, self.file = memory, 0, None

    def put(self, c: int, chunk: tuple[np.ndarray, ...]) -> None:
        """Append a chunk to the queue of c."""
        size = 16 * len(chunk[0])
        if self.held + size > self.memory:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            at = self.file.seek(0, 2)
            for x, kind in zip(chunk, self.KINDS):
                self.file.write(x.astype(kind, copy=False).tobytes())
            self.chunks[c].append((at, len(chunk[0])))
        else:
            self.held += size
            self.chunks[c].append(chunk)

    def take(self, c: int, last: bool = False) -> tuple[np.ndarray, ...]:
        """The first chunk of the queue of c, or its last."""
        chunk = self.chunks[c].pop() if last else self.chunks[c].popleft()
        if len(chunk) == 2:
            at, n = chunk
            self.file.seek(at)
            return tuple(np.frombuffer(self.file.read(n * np.dtype(kind).itemsize), kind) for kind in self.KINDS)
        self.held -= 16 * len(chunk[0])
        return chunk

    def close(self) -> None:
        """Drop the file."""
        if self.file is not None:
            self.file.close()


class _Scan:
    """One scan: what is induced, and the least common prefix since the last suffix for each character."""

    def __init__(self, text: np.ndarray, top: int, depth: int, memory: int, lefts: np.ndarray | None):
        self.text, self.depth, self.lefts = text, depth, lefts
        self.queue = Queues(top, memory)
        self.low = np.full(top, -1, np.int64)

    def pass_(self, common: np.ndarray) -> None:
        """Suffixes that induce nothing."""
        np.minimum(self.low, common.min(), out=self.low, where=self.low >= 0)

    def induce(self, at: np.ndarray, to: np.ndarray, chosen: np.ndarray, common: np.ndarray) -> None:
        """Queue the suffix before each chosen one of a chunk at its character `to`; common: common prefixes of the whole chunk, in the order of the scan."""
        where = np.flatnonzero(chosen)
        if not len(where):
            self.pass_(common)
            return
        to = to[where]
        order = np.argsort(to.astype(np.uint16) if len(self.low) <= 65536 else to, kind="stable")
        where, to = where[order], to[order]
        starts = np.flatnonzero(np.diff(to, prepend=-1))
        before = self.low.copy()
        self.pass_(common)
        # Least common prefixes over the places from one suffix of a character to the next.
        table, width = [common], 1
        while 2 * width <= len(common):
            table.append(np.minimum(table[-1][:-width], table[-1][width:]))
            width *= 2
        table = [*table]

        def least(lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
            level = np.frexp((hi - lo).astype(float))[1] - 1
            out = np.empty(len(lo), np.int64)
            for k in np.unique(level):
                sel = level == k
                out[sel] = np.minimum(table[k][lo[sel]], table[k][hi[sel] - (1 << int(k))])
            return out

        lo = np.empty(len(where), np.int64)
        lo[1:] = where[:-1] + 1
        lo[starts] = 0
        got = least(lo, where + 1)
        first = before[to[starts]]
        got[starts] = np.minimum(got[starts], first)
        got = np.minimum(got + 1, self.depth)
        ends = np.append(starts[1:], len(where)) - 1
        rest = where[ends] + 1
        after = np.full(len(rest), self.depth, np.int64)
        some = rest < len(common)
        if some.any():
            after[some] = least(rest[some], np.full(int(some.sum()), len(common)))
        self.low[to[starts]] = after
        place = at[where] - 1
        prev = np.where(place > 0, self.text[np.maximum(place - 1, 0)], -1).astype(np.int32)
        got = got.astype(np.int32)
        for s, e in zip(starts.tolist(), (ends + 1).tolist()):
            self.queue.put(int(to[s]), (place[s:e], prev[s:e], got[s:e]))

    def rounds(self, c: int):
        """The chunks of the queue of c, in order, while it is filled. After `depth` rounds, what is left are suffixes of longer runs of c: they share their first characters, and are laid out run by run."""
        done = 0
        while left := len(self.queue.chunks[c]):
            while left:
                # Small chunks of a round go together.
                held, size = [], 0
                while left and size < CHUNK:
                    held.append(self.queue.take(c))
                    size += len(held[-1][0])
                    left -= 1
                chunk = held[0] if len(held) == 1 else tuple(np.concatenate(x) for x in zip(*held))
                if done <= self.depth or self.lefts is None:
                    yield chunk
                    continue
                at = chunk[0]
                more = self.lefts[at]
                for i in range(len(at)):
                    for e in range(0, int(more[i]) + 1, CHUNK):
                        p = at[i] - np.arange(e, min(e + CHUNK, int(more[i]) + 1))
                        before = np.full(len(p), c, np.int32)
                        if p[-1] == at[i] - more[i]:
                            before[-1] = self.text[p[-1] - 1] if p[-1] else -1
                        yield p, before, np.full(len(p), self.depth, np.int32), True
            done += 1


def _common(text: np.ndarray, a: np.ndarray, b: np.ndarray, depth: int) -> np.ndarray:
    """The lengths, up to depth, of the prefixes that suffixes a and b have in common."""
    out = np.full(len(a), depth, np.int64)
    alive, n = np.arange(len(a)), len(text)
    for k in range(depth):
        x, y = a[alive] + k, b[alive] + k
        same = (x < n) & (y < n)
        same &= text[np.minimum(x, n - 1)] == text[np.minimum(y, n - 1)]
        out[alive[~same]] = k
        alive = alive[same]
        if not len(alive):
            break
    return out


def smaller_than_next(text: np.ndarray) -> np.ndarray:
    """Which suffixes are of type S; the last character is the least and S. Blocks are taken from the end."""
    n = len(text)
    up = np.zeros(n, bool)
    up[-1] = True
    for s in range((n - 2) // CHUNK * CHUNK, -1, -CHUNK):
        e = min(s + CHUNK, n - 1)
        x, y = text[s:e], text[s + 1 : e + 1]
        at = np.where(x != y, np.arange(e - s), e - s)
        after = np.minimum.accumulate(at[::-1])[::-1]  # the next place in the block where the text changes
        up[s:e] = np.append(x < y, up[e])[after]
    return up


def _lefts(text: np.ndarray, depth: int, space: Space) -> np.ndarray | None:
    """For each place, how many of the same character lie directly before it; None if no run is longer than depth."""
    change = np.flatnonzero(text[1:] != text[:-1]) + 1
    if int(np.diff(np.concatenate([[0], change, [len(text)]])).max()) <= depth:
        return None
    start = np.zeros(len(text), np.int64)
    start[change] = change
    out = space.array(len(text), np.int64)
    out[:] = np.arange(len(text)) - np.maximum.accumulate(start)
    return out


def induce(text: np.ndarray, leftmost: np.ndarray, depth: int, memory: int, space: Space, lefts: np.ndarray | None, ordered: bool = True):
    """(suffixes, common prefixes) of all suffixes in order, from the leftmost S-suffixes in order. ordered: whether they are, beyond their first characters."""
    top = int(text.max()) + 1
    kept = Queues(top, memory)  # L-suffixes by character, for the second scan and the result
    scan = _Scan(text, top, depth, memory, lefts)
    of = text[leftmost]
    by = np.argsort(of, kind="stable")
    leftmost = leftmost[by]
    edge = np.searchsorted(of[by], np.arange(top + 1))
    shared = np.zeros(len(leftmost), np.int64)
    if ordered and len(leftmost) > 1:
        shared[1:] = _common(text, leftmost[:-1], leftmost[1:], depth)
    heads = np.full(top, -1, np.int64)  # the last L-suffix of each character
    for c in range(top):
        for at, before, common, *whole in scan.rounds(c):
            chosen = before >= c if not whole else before > c
            kept.put(c, (at, before, common))
            heads[c] = at[-1]
            scan.induce(at, before, chosen, common)
        stars = leftmost[edge[c] : edge[c + 1]]
        if len(stars):
            common = shared[edge[c] : edge[c + 1]].copy()
            common[0] = _common(text, heads[c : c + 1], stars[:1], depth)[0] if heads[c] >= 0 else 0
            before = np.where(stars > 0, text[np.maximum(stars - 1, 0)], -1)
            scan.induce(stars, before, before > c, common)
    scan.queue.close()
    order, common_of = space.array(len(text), np.int64), space.array(len(text), np.int32)
    end = len(text)
    scan = _Scan(text, top, depth, memory, lefts)
    last = len(text) - 1
    scan.queue.put(int(text[-1]), (np.array([last]), np.array([text[last - 1] if last else -1], np.int32), np.zeros(1, np.int32)))
    for c in range(top - 1, -1, -1):
        # From the greatest down: a tuple's common prefix is that with the suffix scanned before it, which is the next in order.
        latest = -1
        for at, before, common, *whole in scan.rounds(c):
            order[end - len(at) : end] = at[::-1]
            if end < len(text):
                common_of[end] = common[0]
            common_of[end - len(at) + 1 : end] = common[:0:-1]
            end -= len(at)
            latest = at[-1]
            scan.induce(at, before, (before >= 0) & ((before <= c) if not whole else (before < c)), common)
        link = 0
        while kept.chunks[c]:
            at, before, common = kept.take(c, last=True)
            if latest >= 0 and not link:
                link = int(_common(text, at[-1:], np.array([latest]), depth)[0])
            order[end - len(at) : end] = at
            if end < len(text):
                common_of[end] = link
            common_of[end - len(at) + 1 : end] = common[1:]
            end -= len(at)
            scan.induce(at[::-1], before[::-1], (before[::-1] >= 0) & (before[::-1] < c), np.append(link, common[:0:-1]))
            link, latest = int(common[0]), -1
    if len(text):
        common_of[0] = 0
    scan.queue.close()
    kept.close()
    return order, common_of


def _names(text: np.ndarray, order: np.ndarray, length: np.ndarray, depth: int) -> np.ndarray:
    """Names of substrings at the places of order, which have these lengths and are in order: those that are equal, or equal in their first depth characters, have equal names."""
    a, b = order[:-1], order[1:]
    length = np.minimum(length, depth)
    alive = np.flatnonzero(length[:-1] == length[1:])
    same = np.zeros(len(a), bool)
    step = 0
    while len(alive):
        done = length[alive] <= step
        same[alive[done]] = True
        alive = alive[~done]
        alive = alive[text[a[alive] + step] == text[b[alive] + step]]
        step += 1
    return np.concatenate([[0], np.cumsum(~same)])


def _doubled(names: np.ndarray, depth: int) -> np.ndarray:
    """The suffixes of a string of names in order, for depth names at least."""
    width = 1
    while width < depth and int(names.max()) + 1 < len(names):
        second = np.zeros(len(names), np.int64)
        second[:-width] = names[width:] + 1
        key = names * (len(names) + 2) + second
        by = np.argsort(key, kind="stable")
        sorted_key = key[by]
        names = np.empty(len(names), np.int64)
        names[by] = np.concatenate([[0], np.cumsum(sorted_key[1:] != sorted_key[:-1])])
        width *= 2
    return np.argsort(names, kind="stable")


def suffix_order(text: np.ndarray, depth: int, memory: int | None = None, arrays: int | None = None, alphabet: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The suffixes of text, ordered by their first `depth` characters at least, and the length, up to depth, of the
    prefix that each has in common with the one before it. The last character must be its only least one."""
    memory, arrays, alphabet = QUEUED if memory is None else memory, ARRAYS if arrays is None else arrays, ALPHABET if alphabet is None else alphabet
    space = Space(arrays)
    lefts = _lefts(text, depth, space)
    s_type = smaller_than_next(text)
    leftmost = np.flatnonzero(s_type[1:] & ~s_type[:-1]) + 1
    star = np.zeros(len(text), bool)
    star[leftmost] = True
    del s_type
    if len(leftmost) > 1:
        order, _ = induce(text, leftmost, depth, memory, space, lefts, ordered=False)
        order = np.concatenate([(x := np.asarray(order[s : s + CHUNK]))[star[x]] for s in range(0, len(order), CHUNK)])
        at = np.searchsorted(leftmost, order)
        length = np.append(np.diff(leftmost), 0) + 1
        names = np.empty(len(leftmost), np.int64)
        names[at] = _names(text, order, length[at], depth)
        del order, at, length
        # Leftmost suffixes are two characters apart or more.
        if int(names.max()) + 1 == len(names):
            by = np.argsort(names, kind="stable")
        elif int(names.max()) < alphabet and depth > 2:
            by = suffix_order(np.append(names + 1, 0), depth // 2 + 1, memory, arrays, alphabet)[0][1:]
        else:
            by = _doubled(names, depth // 2 + 1)
        leftmost = leftmost[by]
    return induce(text, leftmost, depth, memory, space, lefts)
