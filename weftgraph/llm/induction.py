"""Suffix order and common-prefix values of a text by external, recursive induced sorting.

The text's suffixes are of type L (greater than the next suffix) or S.  Sorted
seeds, the leftmost S suffixes of each S run (LMS), induce the order of all L
suffixes and these that of all S suffixes.  The induction is driven by a
priority queue of (first character, order of arrival): taking everything under
the least character gives suffix tuples in final order, and each of them
pushes the suffix that starts one position before it.  Tuples carry the common
prefix with their predecessor: that of two pushed neighbours is one more than
the least value between the tuples that pushed them.

Seeds are ordered by recursion: a first induction sorts the substrings between
neighbouring LMS positions, equal ones get one name, and the string of names is
sorted in the same way, level by level, until names are distinct or the string
is as short as a block, which is sorted in memory.  Names are a
large alphabet, so the queue is cut into ranges of characters that hold few
tuples each; within a range, what is pushed back into it is merged in before
anything at or after its place is taken.

Texts, types, positions, names and orders beyond a bounded size are mapped files
of the task's own scratch folder; the queue and the finished L suffixes keep a bounded part in
memory and append the rest to files that they read back in order.  Work is done
in blocks of tuples, so memory is bounded by the block, the queue's part and
one number per distinct name, whatever the text's length.

Common prefixes count up to `depth`.  All comparisons are of characters
themselves.
"""

from __future__ import annotations

import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

BLOCK = 1 << 16
#: Bytes up to which an array is no file, and symbols up to which the recursion ends in memory.
IN_MEMORY, SHORT = 16 << 20, 1 << 19
#: Rows of a comparison; symbols in a packed number, and their bits.
ROWS = 1 << 13
PACK, BITS = 7, 9
#: Characters up to which each is a range of its own.
SMALL_ALPHABET = 512


def mapped(folder: str, n: int, dtype) -> np.ndarray:
    """An array of zeros: in a file without a name, which goes with the array, if it is over IN_MEMORY bytes."""
    size = n * np.dtype(dtype).itemsize
    if size <= IN_MEMORY:
        return np.zeros(n, dtype)
    with tempfile.TemporaryFile(dir=folder) as f:
        f.truncate(size)
        return np.asarray(np.memmap(f, dtype, "r+", shape=(n,)))


class Spool:
    """Successive parts that become one array; what is over IN_MEMORY bytes goes to a file."""

    def __init__(self, folder: str, dtype):
        self.folder, self.dtype, self.file, self.parts, self.n = folder, np.dtype(dtype), None, [], 0

    def add(self, part: np.ndarray) -> None:
        self.n += len(part)
        part = np.array(part, self.dtype)
        if self.file is None and self.n * self.dtype.itemsize > IN_MEMORY:
            self.file = tempfile.TemporaryFile(dir=self.folder)
            for p in self.parts:
                self.file.write(p.tobytes())
            self.parts = []
        if self.file is None:
            self.parts.append(part)
        else:
            self.file.write(part.tobytes())

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate(self.parts) if self.parts else np.zeros(0, self.dtype)
        self.file.flush()
        with self.file as f:
            return np.asarray(np.memmap(f, self.dtype, "r+", shape=(self.n,)))


def gathered(folder: str, parts: Iterator[np.ndarray], dtype) -> np.ndarray:
    spool = Spool(folder, dtype)
    for p in parts:
        spool.add(p)
    return spool.array()


class PriorityQueue:
    """Tuples (position, common prefix) by range, first in first out within one; larger parts go to disk."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.held = folder, memory, 0
        self.parts: dict[int, list[np.ndarray]] = {}
        self.files: dict[int, list] = {}
        self.spilled = 0

    def push(self, group: np.ndarray, tuples: np.ndarray) -> None:
        """tuples: rows of (position, common prefix), together by group and in order within it."""
        if not len(group):
            return
        at = np.flatnonzero(np.concatenate(([True], group[1:] != group[:-1], [True])))
        for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
            self.parts.setdefault(int(group[a]), []).append(tuples[a:b].copy())
        self.held += tuples.nbytes
        if self.held > self.memory:
            self.spill()

    def spill(self) -> None:
        """One file holds what is spilled together; groups remember their places in it."""
        f = tempfile.TemporaryFile(dir=self.folder)
        at = 0
        for c, parts in self.parts.items():
            data = b"".join(np.ascontiguousarray(p).tobytes() for p in parts)
            f.write(data)
            self.files.setdefault(c, []).append([f, at, len(data)])
            at += len(data)
        self.spilled += at
        self.parts, self.held = {}, 0

    def pop(self, group: int) -> np.ndarray | None:
        """The next block of a group, in order of arrival; None once it is empty."""
        if group in self.files:
            places = self.files[group]
            f, at, size = places[0]
            f.seek(at)
            got = np.frombuffer(f.read(min(size, BLOCK * 8)), np.int32).reshape(-1, 2)
            if got.nbytes == size:
                places.pop(0)
                if not places:
                    del self.files[group]
            else:
                places[0] = [f, at + got.nbytes, size - got.nbytes]
            return got
        parts = self.parts.pop(group, None)
        if not parts:
            return None
        got = np.concatenate(parts)
        if len(got) > BLOCK:
            self.parts[group] = [got[BLOCK:]]
            got = got[:BLOCK]
        self.held -= got.nbytes
        return got

    def pop_all(self, group: int) -> np.ndarray:
        out = []
        while (block := self.pop(group)) is not None:
            out.append(block)
        return np.concatenate(out) if out else np.zeros((0, 2), np.int32)


class _Store:
    """Blocks per range, kept for reading backwards; larger amounts on disk."""

    def __init__(self, folder: str, memory: int):
        self.folder, self.memory, self.held = folder, memory, 0
        self.blocks: dict[int, list] = {}
        self.file = None

    def add(self, group: int, block: np.ndarray) -> None:
        if self.held + block.nbytes > self.memory:
            self.file = self.file or tempfile.TemporaryFile(dir=self.folder)
            at = self.file.seek(0, os.SEEK_END)
            self.file.write(np.ascontiguousarray(block).tobytes())
            self.blocks.setdefault(group, []).append((at, block.nbytes))
        else:
            self.held += block.nbytes
            self.blocks.setdefault(group, []).append(block)

    def backwards(self, group: int) -> Iterator[np.ndarray]:
        for b in reversed(self.blocks.pop(group, [])):
            if isinstance(b, tuple):
                self.file.seek(b[0])
                b = np.frombuffer(self.file.read(b[1]), np.int32).reshape(-1, 2)
            else:
                self.held -= b.nbytes
            yield b

    def close(self) -> None:
        if self.file:
            self.file.close()


def types(text: np.ndarray, folder: str) -> np.ndarray:
    """True where the suffix is of type S (the end of the text counts as least); in blocks from the end."""
    n = len(text)
    out = mapped(folder, n, bool)
    after, kind = -1, False
    for b in range(n, 0, -BLOCK):
        a = max(0, b - BLOCK)
        here = np.asarray(text[a:b]).astype(np.int64)
        step = np.sign(np.append(here[1:], after) - here)
        at = np.where(step != 0, np.arange(len(step)), len(step))
        nxt = np.minimum.accumulate(at[::-1])[::-1]
        # a tie with what follows has the type of that
        found = np.where(nxt < len(step), np.append(step, 1 if kind else -1)[np.minimum(nxt, len(step))] > 0, kind)
        out[a:b] = found
        after, kind = int(here[0]), bool(found[0])
    return out


def lms_positions(is_s: np.ndarray, folder: str) -> np.ndarray:
    def parts():
        for a in range(1, len(is_s), BLOCK):
            b = min(a + BLOCK, len(is_s))
            yield np.flatnonzero(is_s[a:b] & ~is_s[a - 1 : b - 1]) + a

    return gathered(folder, parts(), np.int32)


def packed(text: np.ndarray, folder: str) -> np.ndarray:
    """At each position the PACK symbols (under 2 ** BITS) from there on as one number; 0 stands for what is beyond the end."""
    out = mapped(folder, len(text), np.uint64)
    for a in range(0, len(text), BLOCK):
        b = min(a + BLOCK, len(text))
        here = np.zeros(b - a + PACK, np.uint64)
        some = text[a : b + PACK]
        here[: len(some)] = some
        value = here[: b - a].copy()
        for k in range(1, PACK):
            value |= here[k : k + b - a] << np.uint64(BITS * k)
        out[a:b] = value
    return out


def common_prefix(text: np.ndarray, a: np.ndarray, b: np.ndarray, most: np.ndarray, packs: np.ndarray | None = None) -> np.ndarray:
    """How many symbols from a and from b on are the same, up to most (which stays inside the text); packs: packed(text)."""
    values, step = (text, 1) if packs is None else (packs, PACK)
    out = np.zeros(len(a), np.int64)
    for lo in range(0, len(a), ROWS):
        live = np.arange(lo, min(lo + ROWS, len(a)))
        live = live[most[live] > 0]
        done, width = 0, 4 if packs is None else 1
        while len(live):
            limit = most[live]
            at = done + step * np.arange(min(width, -(-(int(limit.max()) - done) // step)))
            x, y = a[live][:, None] + at, b[live][:, None] + at
            inside = at[None, :] < limit[:, None]
            differ = np.asarray(values[np.minimum(x, len(text) - 1)]) != np.asarray(values[np.minimum(y, len(text) - 1)])
            differ &= inside
            first = differ.argmax(axis=1)
            stops = differ[np.arange(len(live)), first]
            got = np.minimum(limit, at[-1] + step)
            if stops.any():
                at_stop = done + step * first[stops]
                if packs is not None:
                    bits = packs[a[live[stops]] + at_stop] ^ packs[b[live[stops]] + at_stop]
                    low = bits & (~bits + np.uint64(1))
                    at_stop = at_stop + (np.log2(low.astype(np.float64)).astype(np.int64) // BITS)
                got[stops] = np.minimum(limit[stops], at_stop)
            out[live] = got
            done = int(at[-1]) + step
            live = live[~stops & (limit > done)]
            width = min(2 * width, 32)
    return out


class _Carry:
    """Least common prefix since the last push under each character, across blocks."""

    def __init__(self, size: int):
        self.low = np.full(size, -1, np.int64)

    def push_values(self, char: np.ndarray, index: np.ndarray, lcp: np.ndarray) -> np.ndarray:
        """For pushes grouped by char, made by the tuples at index (rising within a char): their common prefixes."""
        n = len(lcp)
        rows = [lcp]
        while 2 << (len(rows) - 1) <= n:
            h = 1 << (len(rows) - 1)
            rows.append(np.minimum(rows[-1][: n - 2 * h + 1], rows[-1][h : n - h + 1]))
        table = np.full((len(rows), n), np.iinfo(np.int32).max, np.int32)
        for k, r in enumerate(rows):
            table[k, : len(r)] = r

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:
            """Minimum over lcp[a:b], where a < b."""
            k = np.frexp((b - a).astype(np.float64))[1] - 1
            return np.minimum(table[k, a], table[k, b - (1 << k)])

        out = np.empty(len(char), np.int64)
        head = np.concatenate(([True], char[1:] != char[:-1])) if len(char) else np.zeros(0, bool)
        tail = np.concatenate((head[1:], [True])) if len(char) else head
        later = np.flatnonzero(~head)
        out[later] = least(index[later - 1] + 1, index[later] + 1)
        out[head] = np.minimum(self.low[char[head]], least(np.zeros(int(head.sum()), np.int64), index[head] + 1))
        np.minimum(self.low, int(lcp.min()), out=self.low)
        last = index[tail]
        rest = np.full(len(last), np.iinfo(np.int32).max, np.int64)
        more = last + 1 < n
        rest[more] = least(last[more] + 1, np.full(int(more.sum()), n))
        self.low[char[tail]] = rest
        return out + 1


def _bounds(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First characters of the ranges, and which of them are a single character.

    Ranges hold about four times the root of the text's length each; a frequent character is
    a range of its own.
    """
    n, size = len(text), 0
    for a in range(0, n, BLOCK):
        size = max(size, int(text[a : a + BLOCK].max()) + 1)
    if size <= SMALL_ALPHABET:
        return np.arange(size), np.ones(size, bool)
    count = np.zeros(size, np.int64)
    for a in range(0, n, BLOCK):
        count += np.bincount(text[a : a + BLOCK], minlength=size)
    share = (np.cumsum(count) - count) // max(256, int(4 * n**0.5))
    new = np.concatenate(([True], share[1:] != share[:-1]))
    often = np.flatnonzero(count > BLOCK)
    new[often] = True
    new[np.minimum(often + 1, size - 1)] = True
    bounds = np.flatnonzero(new)
    return bounds, np.diff(np.append(bounds, size)) == 1


def induce(text: np.ndarray, is_s: np.ndarray, seeds: np.ndarray, lcp: np.ndarray | None, folder: str, memory: int, depth: int, visit: Callable | None = None, collect: Callable | None = None) -> int:
    """Induce all L suffixes from the seeds, then all S suffixes from these; the bytes that the queues have spilled.

    seeds: LMS positions in order; lcp: their common prefixes, each with the one
    before (None: no common prefixes are carried; else the alphabet is small).
    visit(position before, block) gets the L phase's blocks of (position, common
    prefix) in rising order and the S phase's in falling order, and the pairs
    where both meet.  collect(positions) gets all suffixes in falling order.
    """
    bounds, single = _bounds(text)
    group_of = lambda char: np.searchsorted(bounds, char, "right") - 1
    carry = _Carry(int(bounds[-1]) + 1) if lcp is not None else None
    count = np.zeros(len(bounds) + 1, np.int64)
    for a in range(0, len(seeds), BLOCK):
        count[1:] += np.bincount(group_of(text[seeds[a : a + BLOCK]]), minlength=len(bounds))
    seed_at = np.cumsum(count)

    def before(pos: np.ndarray, want_s: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which of the tuples push a suffix of the wanted type, that suffix, and its character."""
        prev = pos - 1
        index = np.flatnonzero(prev >= 0)
        prev = prev[index]
        # an S suffix is induced only by a greater one, an L suffix only by a smaller one
        own, char = np.asarray(text[pos[index]]), np.asarray(text[prev])
        ok = (is_s[prev] == want_s) & ((char <= own) if want_s else (char >= own))
        return index[ok], prev[ok], char[ok].astype(np.int64)

    def step(queue: PriorityQueue, block: np.ndarray, want_s: bool) -> None:
        """Push what a block of one character induces."""
        index, prev, char = before(block[:, 0], want_s)
        if not len(index):
            if carry:
                np.minimum(carry.low, int(block[:, 1].min()), out=carry.low)
            return
        order = np.argsort(char, kind="stable")
        char, prev, index = char[order], prev[order], index[order]
        value = np.minimum(carry.push_values(char, index, block[:, 1]), depth) if carry else np.zeros(len(char), np.int64)
        queue.push(group_of(char), np.stack((prev, value), 1).astype(np.int32))

    def merge(queue: PriorityQueue, group: int, pos: np.ndarray, kind: np.ndarray, want_s: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Final parts of a range of several characters, (positions, kinds); kind 0 comes before 1 under one character.

        What is pushed back into the range has kind 0 and goes behind its like;
        everything up to the first such place is final.
        """
        sign = -1 if want_s else 1
        key = sign * 2 * np.asarray(text[pos]).astype(np.int64) + kind
        order = np.argsort(key, kind="stable")
        pos, key = pos[order], key[order]
        while len(pos):
            index, prev, char = before(pos, want_s)
            inner = group_of(char) == group
            back = sign * 2 * char
            safe = len(pos) if not inner.any() else int(np.searchsorted(key, back[inner].min(), "right"))
            yield pos[:safe], key[:safe] & 1
            mine = index < safe
            out = mine & ~inner
            by = np.argsort(char[out], kind="stable")
            queue.push(group_of(char[out][by]), np.stack((prev[out][by], np.zeros(len(by), np.int64)), 1).astype(np.int32))
            again = mine & inner
            pos, key = np.concatenate((pos[safe:], prev[again])), np.concatenate((key[safe:], back[again]))
            order = np.argsort(key, kind="stable")
            pos, key = pos[order], key[order]

    def meeting(last: int, pos: int) -> int:
        most = np.array([min(depth, len(text) - max(last, pos))])
        return int(common_prefix(text, np.array([last]), np.array([pos]), most)[0])

    pair = lambda pos: np.stack((pos, np.zeros(len(pos), np.int64)), 1).astype(np.int32)
    done, queue = _Store(folder, memory), PriorityQueue(folder, memory)
    queue.push(group_of(text[-1:].astype(np.int64)), np.array([[len(text) - 1, 0]], np.int32))
    if carry:
        carry.low[int(text[-1])] = 0
    for r in range(len(bounds)):
        mine = slice(int(seed_at[r]), int(seed_at[r + 1]))
        if not single[r]:
            found = queue.pop_all(r)[:, 0].astype(np.int64)
            pos = np.concatenate((found, np.asarray(seeds[mine]).astype(np.int64)))
            for part, kind in merge(queue, r, pos, np.repeat([0, 1], [len(found), len(pos) - len(found)]), False):
                if not kind.all():
                    done.add(r, pair(part[kind == 0]))
            continue
        last = None
        while (block := queue.pop(r)) is not None:
            if visit:
                visit(last, block)
            done.add(r, block)
            last = int(block[-1, 0])
            step(queue, block, False)
        for a in range(mine.start, mine.stop, BLOCK):
            b = min(a + BLOCK, mine.stop)
            block = np.stack((seeds[a:b], lcp[a:b] if carry else np.zeros(b - a, np.int32)), 1).astype(np.int32)
            if carry and a == mine.start:
                block[0, 1] = meeting(last, int(block[0, 0])) if last is not None else 0
            step(queue, block, False)
    spilled = queue.spilled
    queue = PriorityQueue(folder, memory)
    carry = _Carry(int(bounds[-1]) + 1) if lcp is not None else None
    for r in range(len(bounds) - 1, -1, -1):
        if not single[r]:
            found = queue.pop_all(r)[:, 0].astype(np.int64)
            held = [b[::-1, 0] for b in done.backwards(r)]
            pos = np.concatenate((found, *held)).astype(np.int64)
            for part, _ in merge(queue, r, pos, np.repeat([0, 1], [len(found), len(pos) - len(found)]), True):
                if collect:
                    collect(part)
            continue
        last = None
        while (block := queue.pop(r)) is not None:
            if visit:
                visit(last, block)
            if collect:
                collect(block[:, 0])
            last = int(block[-1, 0])
            step(queue, block, True)
        value = None
        for block in done.backwards(r):
            block = block[::-1].copy()
            if collect:
                collect(block[:, 0])
            if carry:
                # turned round, a tuple's common prefix is that with the one after it
                own = block[:, 1].copy()
                block[1:, 1] = own[:-1]
                if value is None:
                    value = meeting(last, int(block[0, 0])) if last is not None else 0
                    if visit and last is not None:
                        visit(last, np.array([[block[0, 0], value]], np.int32))
                block[0, 1] = value
                value = int(own[-1])
            step(queue, block, True)
    done.close()
    return spilled + queue.spilled


def _flipped(folder: str, falling: np.ndarray) -> np.ndarray:
    return gathered(folder, (falling[max(0, b - BLOCK) : b][::-1] for b in range(len(falling), 0, -BLOCK)), np.int32)


class _Falling(Spool):
    """Positions that come in falling order."""

    def __init__(self, folder: str, keep: Callable[[np.ndarray], np.ndarray] | None = None):
        super().__init__(folder, np.int32)
        self.keep = keep

    def __call__(self, pos: np.ndarray) -> None:
        self.add(pos[self.keep(pos)] if self.keep else pos)

    def rising(self) -> np.ndarray:
        return _flipped(self.folder, self.array())


def _by_first(text: np.ndarray, lms: np.ndarray, folder: str, memory: int) -> np.ndarray:
    """Positions in the order of their first characters."""
    bounds, single = _bounds(text)
    queue = PriorityQueue(folder, memory)
    for a in range(0, len(lms), BLOCK):
        pos = np.asarray(lms[a : a + BLOCK])
        group = np.searchsorted(bounds, text[pos], "right") - 1
        by = np.argsort(group, kind="stable")
        queue.push(group[by], np.stack((pos[by], pos[by]), 1).astype(np.int32))

    def parts():
        for r in range(len(bounds)):
            if single[r]:
                while (block := queue.pop(r)) is not None:
                    yield block[:, 0]
            else:
                pos = queue.pop_all(r)[:, 0]
                yield pos[np.argsort(text[pos], kind="stable")]

    return gathered(folder, parts(), np.int32)


def seed_order(text: np.ndarray, is_s: np.ndarray, lms: np.ndarray, folder: str, memory: int) -> np.ndarray:
    """The LMS positions in the order of their suffixes, by names and recursion."""
    if not len(lms):
        return lms
    is_lms = mapped(folder, len(text), bool)
    is_lms[lms] = True
    falling = _Falling(folder, lambda pos: is_lms[pos])
    # the first induction sorts LMS substrings: seeds need no more than the order of their first characters
    induce(text, is_s, _by_first(text, lms, folder, memory), None, folder, memory, 0, collect=falling)
    order = falling.rising()
    names, name = mapped(folder, len(lms), np.int32), 0
    for a in range(0, len(order), BLOCK):
        here = np.asarray(order[max(0, a - 1) : a + BLOCK]).astype(np.int64)
        slot = np.searchsorted(lms, here)
        end = np.where(slot + 1 < len(lms), lms[np.minimum(slot + 1, len(lms) - 1)], len(text) - 1)
        size = end - here + 1
        same = size[1:] == size[:-1]
        # the last substring runs into the end of the text, which no other one does
        same &= (slot[1:] + 1 < len(lms)) & (slot[:-1] + 1 < len(lms))
        at = np.flatnonzero(same)
        equal = common_prefix(text, here[:-1][at], here[1:][at], size[1:][at]) == size[1:][at]
        fresh = np.ones(len(here) - 1, np.int64)
        fresh[at[equal]] = 0
        if a == 0:
            value = np.concatenate(([0], np.cumsum(fresh)))
        else:
            value, slot = name + np.cumsum(fresh), slot[1:]
        names[slot] = value
        name = int(value[-1])
    if name + 1 == len(lms):
        return order
    return gathered(folder, _taken(lms, suffix_order(names, folder, memory)), np.int32)


def _taken(values: np.ndarray, at: np.ndarray) -> Iterator[np.ndarray]:
    for a in range(0, len(at), BLOCK):
        yield values[at[a : a + BLOCK]]


def doubled_order(text: np.ndarray) -> np.ndarray:
    """suffix_order() of a short string, by doubling the length that ranks stand for."""
    n, h = len(text), 1
    rank = np.unique(text, return_inverse=True)[1].astype(np.int64)
    while True:
        after = np.zeros(n, np.int64)
        after[: max(0, n - h)] = rank[h:] + 1
        key = rank * (n + 1) + after
        order = np.argsort(key, kind="stable")
        sorted_ = key[order]
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(np.concatenate(([0], (sorted_[1:] != sorted_[:-1]).astype(np.int64))))
        if rank[order[-1]] == n - 1:
            return order.astype(np.int32)
        h *= 2


def suffix_order(text: np.ndarray, folder: str, memory: int) -> np.ndarray:
    """All positions of a string in the order of their suffixes (a shorter one before those that it begins)."""
    if len(text) < 2:
        return np.arange(len(text), dtype=np.int32)
    if len(text) <= SHORT:
        return doubled_order(np.asarray(text))
    is_s = types(text, folder)
    seeds = seed_order(text, is_s, lms_positions(is_s, folder), folder, memory)
    falling = _Falling(folder)
    induce(text, is_s, seeds, None, folder, memory, 0, collect=falling)
    return falling.rising()


def repeats(text: np.ndarray, length: int, folder: str, memory: int = 64 << 20) -> np.ndarray:
    """Marks each position whose next `length` bytes also start elsewhere in text.

    text: uint16 symbols of 0 to 256, 0 parting strings; marks of positions
    with a 0 in those bytes mean nothing.
    """
    n, depth = len(text), length
    marks = mapped(folder, n, bool)
    if n < 2:
        return marks
    is_s = types(text, folder)
    seeds = seed_order(text, is_s, lms_positions(is_s, folder), folder, memory)
    lcp, packs = mapped(folder, len(seeds), np.int32), packed(text, folder)
    for a in range(1, len(seeds), BLOCK):
        here = np.asarray(seeds[a - 1 : a + BLOCK]).astype(np.int64)
        most = np.minimum(depth, n - np.maximum(here[:-1], here[1:]))
        lcp[a : a + len(most)] = common_prefix(text, here[:-1], here[1:], most, packs)

    def mark(last, block):
        near = block[:, 1] >= length
        if last is not None and near[0]:
            marks[last] = True
        near[0] &= last is not None
        marks[block[near, 0]] = True
        marks[block[np.flatnonzero(near[1:]), 0]] = True

    induce(text, is_s, seeds, lcp, folder, memory, depth, visit=mark)
    return marks
