"""Suffix order and common prefixes by external induced sorting.

The suffixes that begin a rising run after a falling one (the leftmost S-type suffixes) are
sorted first, by naming the pieces between them and sorting the shorter text of names, which
is this same problem again. All other suffixes are induced from them in two sweeps over the
sorted order: a suffix that is read puts the suffix one symbol longer into a priority queue.
The queue's entries carry a position and the common prefix with the entry before them; a new
entry's common prefix is one more than the least one read since the last entry of its symbol.

Queues are first-in first-out per symbol, which is their order of priority, and whatever
exceeds a number of entries lies on disk. Work is done on batches of entries with numpy.
"""

from __future__ import annotations

import heapq
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

BATCH = 1 << 16
QUEUE_ENTRIES = 1 << 20  # 8 MB; the queues of an ordinary shard hold more, and go to disk
IN_MEMORY = 1 << 23
LCP_BITS = 12
MOST_LCP = (1 << LCP_BITS) - 1
SEPARATOR = 0xFF  # no byte of UTF-8
FAR = np.int64(1 << 40)


class Spill:
    """Arrays of entries, kept in memory up to a number of entries and in a file beyond it."""

    def __init__(self, limit: int = QUEUE_ENTRIES):
        self.limit, self.held, self.file = limit, 0, None

    def keep(self, entries: np.ndarray) -> np.ndarray | tuple[int, int]:
        if self.held + len(entries) <= self.limit:
            self.held += len(entries)
            return entries
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        at = self.file.seek(0, os.SEEK_END)
        self.file.write(entries.tobytes())
        return at, len(entries)

    def take(self, kept: np.ndarray | tuple[int, int]) -> np.ndarray:
        if isinstance(kept, np.ndarray):
            self.held -= len(kept)
            return kept
        self.file.seek(kept[0])
        return np.frombuffer(self.file.read(8 * kept[1]), np.int64)

    def close(self) -> None:
        if self.file is not None:
            self.file.close()


class SymbolQueues:
    """A priority queue by symbol; entries of one symbol leave in the order they came."""

    def __init__(self, spill: Spill, descending: bool):
        self.spill, self.sign = spill, -1 if descending else 1
        self.queues: dict[int, list] = {}
        self.heap: list[int] = []

    def announce(self, symbol: int) -> None:
        if symbol not in self.queues:
            self.queues[symbol] = []
            heapq.heappush(self.heap, self.sign * symbol)

    def push(self, symbol: int, entries: np.ndarray) -> None:
        self.announce(symbol)
        self.queues[symbol].append(self.spill.keep(entries))

    def symbols(self) -> Iterator[int]:
        while self.heap:
            symbol = self.sign * heapq.heappop(self.heap)
            yield symbol
            del self.queues[symbol]

    def entries(self, symbol: int) -> Iterator[np.ndarray]:
        queue, at = self.queues[symbol], 0
        while at < len(queue):  # the queue may grow meanwhile
            parts, size = [], 0
            while at < len(queue) and size < BATCH:
                parts.append(self.spill.take(queue[at]))
                queue[at] = None
                size += len(parts[-1])
                at += 1
            yield np.concatenate(parts)


def range_least(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Least value of each range [first, last]; FAR for an empty one."""
    size = last - first + 1
    level = np.zeros(len(size), np.int64)
    some = size > 0
    level[some] = np.frexp(size[some])[1] - 1
    out = np.full(len(size), FAR)
    table = values
    for k in range(int(level.max(initial=-1)) + 1):
        if k:
            half = 1 << (k - 1)
            table = np.minimum(table[:-half], table[half:])
        own = np.flatnonzero(some & (level == k))
        out[own] = np.minimum(table[first[own]], table[last[own] - (1 << k) + 1])
    return out


class Sweep:
    """Induces entries from the entries read, in either direction."""

    def __init__(self, text: np.ndarray, queues: SymbolQueues, with_lcp: bool):
        self.text, self.queues, self.with_lcp = text, queues, with_lcp
        size = int(text.max(initial=0)) + 1 if with_lcp else 0
        self.least = np.full(size, FAR)  # common prefix with what was read since a symbol's last entry

    def read(self, position: np.ndarray, lcp: np.ndarray, wanted: Callable[[np.ndarray], np.ndarray]) -> None:
        """Push the suffixes one symbol longer whose first symbol is wanted."""
        for at in range(0, len(position), BATCH):
            self._read(position[at : at + BATCH], lcp[at : at + BATCH], wanted)

    def _read(self, position: np.ndarray, lcp: np.ndarray, wanted: Callable) -> None:
        before = position - 1
        symbol = self.text[before].astype(np.int64)  # position 0 wraps and is left out
        place = np.flatnonzero((position > 0) & wanted(symbol))
        if not len(place):
            self.least = np.minimum(self.least, lcp.min(initial=FAR))
            return
        symbol, before = symbol[place], before[place]
        order = np.argsort(symbol, kind="stable")
        symbol, before, place = symbol[order], before[order], place[order]
        new = np.r_[True, symbol[1:] != symbol[:-1]]
        starts = np.flatnonzero(new)
        ends = np.r_[starts[1:], len(symbol)]
        own = np.zeros(len(symbol), np.int64)
        if self.with_lcp:
            last = np.r_[-1, place[:-1]]
            last[new] = -1
            own = range_least(lcp, last + 1, place)
            own[new] = np.minimum(own[new], self.least[symbol[new]])
            own = np.minimum(own + 1, MOST_LCP)
            self.least = np.minimum(self.least, lcp.min(initial=FAR))
            final = place[ends - 1]
            self.least[symbol[starts]] = range_least(lcp, final + 1, np.full(len(final), len(lcp) - 1))
        entries = before << LCP_BITS | own
        for a, b in zip(starts.tolist(), ends.tolist(), strict=True):
            self.queues.push(int(symbol[a]), entries[a:b])


def common_prefix(text: np.ndarray, a: int, b: int) -> int:
    """Common prefix of two suffixes, up to the most that entries carry."""
    length = min(len(text) - max(a, b), MOST_LCP)
    other = np.flatnonzero(text[a : a + length] != text[b : b + length])
    return int(other[0]) if len(other) else length


def induce(
    text: np.ndarray, seeds: np.ndarray, seed_lcp: np.ndarray | None, limit: int = QUEUE_ENTRIES
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All suffixes in descending order, from the sorted leftmost S-type ones (``seeds``).

    Yields (positions, common prefix with the suffix given before); 0 where the first symbol
    changes. Without ``seed_lcp`` no common prefixes are carried.
    """
    with_lcp = seed_lcp is not None
    mask = np.int64(MOST_LCP)
    spill = Spill(limit)
    queues = SymbolQueues(spill, descending=False)
    sweep = Sweep(text, queues, with_lcp)
    seed_symbol = text[seeds]
    cuts = np.flatnonzero(np.r_[True, seed_symbol[1:] != seed_symbol[:-1], True]) if len(seeds) else np.zeros(1, int)
    groups = {int(seed_symbol[a]): (a, b) for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)}
    for symbol in groups:
        queues.announce(symbol)
    # the end of the text is the least suffix
    queues.push(int(text[-1]), np.array([(len(text) - 1) << LCP_BITS], np.int64))
    falling: dict[int, list] = {}  # L-type suffixes by symbol, for the second sweep
    for symbol in queues.symbols():
        kept, last = [], -1
        for entries in queues.entries(symbol):
            position, lcp = entries >> LCP_BITS, entries & mask
            if last < 0:
                lcp[0] = 0
            last = int(position[-1])
            sweep.read(position, lcp, lambda s, c=symbol: s >= c)
            kept.append(spill.keep(position << LCP_BITS | lcp))
        falling[symbol] = kept
        if symbol in groups:
            a, b = groups[symbol]
            lcp = seed_lcp[a:b].copy() if with_lcp else np.zeros(b - a, np.int64)
            lcp[0] = common_prefix(text, last, int(seeds[a])) if with_lcp and last >= 0 else 0
            sweep.read(seeds[a:b], lcp, lambda s, c=symbol: s > c)

    queues = SymbolQueues(spill, descending=True)
    sweep = Sweep(text, queues, with_lcp)
    for symbol in falling:
        queues.announce(symbol)
    for symbol in queues.symbols():
        last = -1
        for entries in queues.entries(symbol):
            position, lcp = entries >> LCP_BITS, entries & mask
            if last < 0:
                lcp[0] = 0
            last = int(position[-1])
            sweep.read(position, lcp, lambda s, c=symbol: s <= c)
            yield position, lcp
        carried = None
        for kept in reversed(falling.pop(symbol, [])):
            entries = spill.take(kept)[::-1]
            position, lcp = entries >> LCP_BITS, entries & mask
            if carried is None:
                carried = common_prefix(text, last, int(position[0])) if with_lcp and last >= 0 else 0
            lcp, carried = np.r_[carried, lcp[:-1]], int(lcp[-1])
            sweep.read(position, lcp, lambda s, c=symbol: s < c)
            yield position, lcp
    spill.close()


def leftmost_rising(text: np.ndarray) -> np.ndarray:
    """Positions of the leftmost S-type suffixes, in text order."""
    step = np.sign(np.diff(text.astype(np.int64)))  # the end of the text counts as falling
    changes = np.flatnonzero(step)
    rising = step[changes] > 0
    # a run of equal symbols goes on as the first change after it; it begins after the change before
    first = np.r_[0, changes[:-1] + 1] if len(changes) else np.zeros(0, np.int64)
    leftmost = rising & np.r_[False, ~rising[:-1]]
    return first[leftmost]


def _refine(rank: np.ndarray, members: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Order the members of groups of equal rank by a key; gives those whose rank is still shared.

    A rank is the number of smaller elements, so a group's ranks change within the group only.
    """
    order = np.lexsort((key, rank[members]))
    members, key = members[order], key[order]
    old = rank[members]
    group = np.r_[True, old[1:] != old[:-1]]
    new = group | np.r_[True, key[1:] != key[:-1]]
    place = np.arange(len(members))
    group_start = np.maximum.accumulate(np.where(group, place, 0))
    new_start = np.maximum.accumulate(np.where(new, place, 0))
    rank[members] = old + new_start - group_start
    alone = new & np.r_[new[1:], True]
    return members[~alone]


def name_pieces(text: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Rank of the piece from each start to the next; a piece sorts after those it begins.

    The last piece ends with the text, which sorts before all symbols.
    """
    bits = (int(text.max(initial=0)) + 2).bit_length()
    width = max(1, 63 // bits)
    ends = np.r_[starts[1:] + 1, len(text)]
    end = np.full(len(starts), (1 << bits) - 1)  # greater than any symbol, as those are raised by 1
    end[-1:] = 0
    rank, members, at = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    while len(members):
        key = np.zeros(len(members), np.int64)
        for i in range(at, at + width):
            place = starts[members] + i
            inside = place < ends[members]
            symbol = text[np.minimum(place, len(text) - 1)].astype(np.int64) + 1
            key = key << bits | np.where(inside, symbol, end[members])
        left = _refine(rank, members, key)
        at += width
        members = left[starts[left] + at <= ends[left]] if len(left) else left
    return rank


def suffix_order(names: np.ndarray, in_memory: int = IN_MEMORY) -> np.ndarray:
    """Positions of a text of names in the order of their suffixes."""
    if len(names) > in_memory:
        seeds = leftmost_rising(names)
        seeds = seeds[sort_pieces(names, seeds, in_memory)]
        return np.concatenate([p for p, _ in induce(names, seeds, None)])[::-1]
    rank, members, step = np.zeros(len(names), np.int64), np.arange(len(names)), 1
    members = _refine(rank, members, names.astype(np.int64))
    while len(members):
        place = members + step
        key = np.where(place < len(names), rank[np.minimum(place, len(names) - 1)], -1)
        members = _refine(rank, members, key)
        step *= 2
    order = np.empty(len(names), np.int64)
    order[rank] = np.arange(len(names))
    return order


def sort_pieces(text: np.ndarray, starts: np.ndarray, in_memory: int = IN_MEMORY) -> np.ndarray:
    """The order of the suffixes that start at ``starts`` (leftmost S-type ones)."""
    if not len(starts):
        return starts
    return suffix_order(name_pieces(text, starts), in_memory)


def prefixes_in_order(text: np.ndarray, starts: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Common prefix of each suffix with the one before it in the order.

    If two neighbours follow, in the text, two that were neighbours too, their common prefix
    is what is left of those'. Only the others are compared, eight bytes at a time.
    """
    if not len(starts):
        return np.zeros(0, np.int64)
    before = np.full(len(starts), -1)
    before[order[1:]] = order[:-1]
    after = np.r_[False, (before[1:] == before[:-1] + 1) & (before[:-1] >= 0)]
    # the same distance to the next start, else the two are no shifted pair
    gap = np.diff(starts)
    follows = np.zeros(len(starts), bool)
    mine = np.flatnonzero(after)
    follows[mine] = gap[mine - 1] == gap[before[mine] - 1]
    lcp = np.zeros(len(starts), np.int64)
    own = np.flatnonzero(~follows & (before >= 0))
    lcp[own] = _common_prefixes(text, starts[own], starts[before[own]])
    source = np.maximum.accumulate(np.where(follows, 0, np.arange(len(starts))))
    left = lcp[source] - (starts - starts[source])
    # compared after all: the pair before differs earlier, or its common prefix is longer than it says
    ended = np.flatnonzero(follows & ((left < 0) | (lcp[source] >= MOST_LCP)))
    lcp = np.where(follows, left, lcp)
    lcp[ended] = _common_prefixes(text, starts[ended], starts[before[ended]])
    return np.minimum(lcp, MOST_LCP)[order]


def _common_prefixes(text: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    padded = np.r_[text, np.zeros(16, np.uint8)]
    words = np.ndarray((len(padded) - 7,), "<u8", padded, strides=(1,))
    active, length, most = np.arange(len(a)), np.zeros(len(a), np.int64), len(text)
    while len(active):
        x, y = a[active] + length[active], b[active] + length[active]
        inside = np.minimum(most - np.maximum(x, y), 8)
        other = words[np.minimum(x, most)] ^ words[np.minimum(y, most)]
        equal = np.where(other == 0, 8, np.bitwise_count((other & (~other + np.uint64(1))) - np.uint64(1)) >> 3)
        equal = np.minimum(equal, inside)
        length[active] += equal
        active = active[(equal == 8) & (length[active] < MOST_LCP)]
    return length


def repeated_starts(
    text: np.ndarray, length: int, limit: int = QUEUE_ENTRIES, in_memory: int = IN_MEMORY
) -> np.ndarray:
    """For each position of a text of bytes: whether its next ``length`` symbols stand elsewhere too."""
    if length > MOST_LCP:
        raise ValueError(f"common prefixes are carried up to {MOST_LCP} symbols")
    repeated = np.zeros(len(text), bool)
    if len(text) < 2:
        return repeated
    starts = leftmost_rising(text)
    order = sort_pieces(text, starts, in_memory)
    lcp = prefixes_in_order(text, starts, order)
    last = -1
    for position, common in induce(text, starts[order], lcp, limit):
        long = np.flatnonzero(common >= length)
        repeated[position[long]] = True
        repeated[np.r_[last, position[:-1]][long]] = True
        last = position[-1]
    return repeated
