"""External induced sorting of the suffixes of one shard, with common-prefix values.

Suffixes are S (smaller than the next one) or L. S suffixes after an L (S*) are
named by a first induction that knows only their first symbol, the string of
names is sorted by recursion if names repeat, and a second induction sorts all
suffixes from the S* order. Both inductions are driven by priority queues that
keep a bounded heap and spill sorted runs to disk; a queue's tuples carry the
suffix and the length of its common prefix with the suffix queued before it
under the same symbol, so the values come out of the induction. They are capped
at ``limit``, which is all that removal of repeated strings asks.

One suffix costs several queue operations in Python; see the README for
measured figures and for what the registered query does instead. The folder for
runs is the caller's; on a cluster it is a task's scratch, never a result.
"""

from __future__ import annotations

import bisect
import heapq
import itertools
import os
import struct
import tempfile

import numpy as np


class DiskQueue:
    """A priority queue of integer tuples; past ``memory`` tuples, sorted runs go to files in ``folder``."""

    def __init__(self, width: int, folder: str, memory: int):
        self.row, self.folder, self.memory = struct.Struct(f"<{width}q"), folder, max(memory, 16)
        self.heap: list[tuple] = []
        self.heads: list[tuple] = []  # (tuple, number, iterator) of each run
        self.number = itertools.count()

    def _run(self, path: str):
        with open(path, "rb") as f:
            os.unlink(path)  # the open file keeps it until it is read
            while block := f.read(self.row.size * 1024):
                yield from self.row.iter_unpack(block)

    def push(self, item: tuple) -> None:
        if len(self.heap) >= self.memory:
            handle, path = tempfile.mkstemp(dir=self.folder)
            with os.fdopen(handle, "wb") as f:
                for t in sorted(self.heap):
                    f.write(self.row.pack(*t))
            self.heap = []
            run = self._run(path)
            heapq.heappush(self.heads, (next(run), next(self.number), run))
        heapq.heappush(self.heap, item)

    def peek(self) -> tuple | None:
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return self.heap[0]
        return self.heads[0][0] if self.heads else None

    def pop(self) -> tuple:
        if self.heap and (not self.heads or self.heap[0] <= self.heads[0][0]):
            return heapq.heappop(self.heap)
        item, number, run = heapq.heappop(self.heads)
        after = next(run, None)
        if after is not None:
            heapq.heappush(self.heads, (after, number, run))
        return item


class _Since:
    """Least value since an index, over a growing sequence of capped values."""

    def __init__(self):
        self.at, self.value, self.n = [], [], 0

    def add(self, v: int) -> None:
        self.n += 1
        while self.value and self.value[-1] >= v:
            self.at.pop(), self.value.pop()
        self.at.append(self.n), self.value.append(v)

    def least(self, after: int) -> int:
        return self.value[bisect.bisect_right(self.at, after)]


def _common(t: np.ndarray, a: int, b: int, limit: int) -> int:
    x, y = t[a : a + limit], t[b : b + limit]
    n = min(len(x), len(y))
    d = np.flatnonzero(x[:n] != y[:n])
    return int(d[0]) if len(d) else n


def _types(t: np.ndarray) -> np.ndarray:
    """True for S suffixes; the empty one, at the end, is S."""
    n = len(t)
    s = np.zeros(n + 1, bool)
    s[n] = True
    if n:
        step = np.sign(np.diff(t.astype(np.int64)))  # 1: smaller than the next symbol
        nxt = np.where(step != 0, np.arange(n - 1), n)
        run = np.minimum.accumulate(nxt[::-1])[::-1] if n > 1 else nxt
        ok = run < n
        s[: n - 1][ok] = step[run[ok]] > 0
    return s


def _induce(t: np.ndarray, s: np.ndarray, seeds, exact: bool, folder: str, memory: int, limit: int):
    """L suffixes ascending, then S suffixes descending, as lists of (position, rank, common prefix with the one before).

    ``seeds`` are (symbol, rank, position) of the S* suffixes; equal keys get equal ranks unless ``exact``.
    """
    low, out_l = DiskQueue(5, folder, memory), []
    for c, rank, p in seeds:
        low.push((c, 1, rank, p, 0))
    high = DiskQueue(5, folder, memory)
    since, pushed = _Since(), {}
    key, rank, before = None, 0, None
    while (item := low.peek()) is not None:
        c, kind, parent, p, carried = low.pop()
        if (c, kind, parent) != key or exact:
            rank += 1
        key = (c, kind, parent)
        if exact:
            same = before is not None and before < len(t) and c >= 0 and t[before] == c
            v = 0 if not same else min(limit, carried) if kind == 0 and out_l and out_l[-1][0] == before else _common(t, before, p, limit)
            since.add(v)
        before = p
        if kind == 0:
            out_l.append((p, rank, v if exact else 0))
            if p and s[p - 1]:
                high.push((-c, 1, -rank, p, 0))
        if p and not s[p - 1]:
            d = int(t[p - 1])
            lcp = 0
            if exact:
                lcp = min(limit, 1 + since.least(pushed[d])) if d in pushed else 0
                pushed[d] = since.n
            low.push((d, 0, rank, p - 1, lcp))
    out_s, since, pushed = [], _Since(), {}
    key, rank, before = None, 0, None
    while (item := high.peek()) is not None:
        c, kind, parent, p, carried = high.pop()
        if (c, kind, parent) != key or exact:
            rank += 1
        key = (c, kind, parent)
        if exact:
            same = before is not None and before < len(t) and t[before] == -c
            v = 0 if not same else min(limit, carried) if kind == 0 and out_s and out_s[-1][0] == before else _common(t, before, p, limit)
            since.add(v)
        before = p
        if kind == 0:
            out_s.append((p, rank, v if exact else 0))
        if p and s[p - 1]:
            d = int(t[p - 1])
            lcp = 0
            if exact:
                lcp = min(limit, 1 + since.least(pushed[d])) if d in pushed else 0
                pushed[d] = since.n
            high.push((-d, 0, rank, p - 1, lcp))
    return out_l, out_s


def suffix_order(t: np.ndarray, folder: str, memory: int = 1 << 20, limit: int = 100) -> tuple[np.ndarray, np.ndarray]:
    """(positions in suffix order, common prefix of each with the one before, capped at ``limit``) of non-negative symbols."""
    n = len(t)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    s = _types(t)
    star = np.flatnonzero(s[1:] & ~s[:-1]) + 1
    sym = lambda p: int(t[p]) if p < n else -1
    _, named = _induce(t, s, ((sym(p), 0, p) for p in star.tolist()), False, folder, memory, limit)
    is_star = np.zeros(n + 1, bool)
    is_star[star] = True
    # The induction starts from an S* suffix's first symbol only; a star that it reaches again is a whole named substring.
    name_of = {p: -r for p, r, _ in named if is_star[p]}
    name_of[n] = -(1 << 60)
    ranked = {v: i for i, v in enumerate(sorted(set(name_of.values())))}
    reduced = np.array([ranked[name_of[p]] for p in star.tolist()], np.int64)
    if len(ranked) < len(reduced):
        order, _ = suffix_order(reduced, folder, memory, limit)
    else:
        order = np.argsort(reduced, kind="stable")
    seeds = ((sym(p), i, p) for i, p in enumerate(star[order].tolist()))
    lo, hi = _induce(t, s, seeds, True, folder, memory, limit)
    hi.reverse()
    sa = np.empty(n, np.int64)
    k = i = j = 0
    while i < len(lo) or j < len(hi):
        take_low = j == len(hi) or (i < len(lo) and t[lo[i][0]] <= t[hi[j][0]])
        sa[k] = lo[i][0] if take_low else hi[j][0]
        i, j, k = i + take_low, j + (not take_low), k + 1
    carried = {p: v for p, _, v in lo}
    after = {hi[k][0]: hi[k - 1][2] for k in range(1, len(hi))}  # S values were against the next larger one
    lcp = np.zeros(n, np.int64)
    for k in range(1, n):
        a, b = int(sa[k - 1]), int(sa[k])
        if t[a] != t[b]:
            continue
        if not s[a] and not s[b]:
            lcp[k] = carried[b]
        elif s[a] and s[b]:
            lcp[k] = after[b]
        else:
            lcp[k] = _common(t, a, b, limit)
    return sa, lcp


def removed_mask(texts: list[bytes], folder: str, memory: int = 1 << 20, length: int = 100) -> list[np.ndarray]:
    """For each text, in order, which bytes an earlier ``length``-byte string covers."""
    parts, starts, at = [], [], 0
    for b in texts:
        starts.append(at)
        parts += [np.frombuffer(b, np.uint8).astype(np.int64) + 1, np.zeros(1, np.int64)]
        at += len(b) + 1
    if not parts:
        return []
    t = np.concatenate(parts)
    sa, lcp = suffix_order(t, folder, memory, length)
    end = np.zeros(len(t), np.int64)
    for s, b in zip(starts, texts):
        end[s : s + len(b)] = s + len(b)
    cover = np.zeros(len(t) + 1, np.int64)
    group = np.cumsum(lcp < length)
    first = np.full(group[-1] + 1 if len(group) else 1, len(t))
    np.minimum.at(first, group, sa)
    later = sa[(first[group] < sa) & (sa + length <= end[sa])]
    np.add.at(cover, later, 1)
    np.add.at(cover, later + length, -1)
    mask = np.cumsum(cover)[:-1] > 0
    return [mask[s : s + len(b)] for s, b in zip(starts, texts)]
