"""Suffix order of one shard by external induced sorting.

The suffixes that begin right of a descent and left of an ascent (the sampled ones) are sorted by recursion over the names of the
stretches between them. From their order all others are induced: a queue ordered by first symbol, then by the order of arrival,
hands out suffixes from the smallest on, and each one queues the suffix one symbol longer. A pass upwards induces the
descending suffixes, a pass downwards the ascending ones. As the number of suffixes of each symbol is known, the queue is one array
on disk with a write head for each symbol; what is filled without a gap from the read head on is safe to hand out, so whole
blocks leave the queue at once and are handled by numpy.

With each suffix the queue carries the length of the prefix it shares with the one before it: one more than the least such value
among the suffixes handed out between the two that induced them.
"""

from __future__ import annotations

import tempfile

import numpy as np

BLOCK = 1 << 15
MOST = 104  # common prefixes are counted up to here


def on_disk(size: int, kind: type, value: int) -> np.ndarray:
    """An array in a nameless file, which the system may write back and drop from memory; it is gone with its last reader."""
    with tempfile.TemporaryFile() as file:
        array = np.memmap(file, kind, "w+", shape=(max(size, 1),)).view(np.ndarray)
    array[:] = value
    return array[:size]


def shapes(text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Whether each suffix is smaller than the next one (the last one counts so), and how long its first symbol repeats."""
    n = len(text)
    places = np.arange(n, dtype=np.int32)
    change = np.empty(n, bool)
    np.not_equal(text[:-1], text[1:], out=change[:-1])
    change[-1] = True
    last = np.minimum.accumulate(np.where(change, places, n)[::-1])[::-1]
    rising = np.empty(n, bool)
    np.less(text[:-1], text[1:], out=rising[:-1])
    rising[-1] = True
    return rising[last], np.minimum(last - places + 1, MOST).astype(np.uint8)


class RangeMinima:
    """Least value of any stretch of a short array of bytes."""

    def __init__(self, values: np.ndarray):
        self.rows = [values]
        width = 1
        while 2 * width <= len(values):
            row = self.rows[-1]
            self.rows.append(np.minimum(row[:-width], row[width:]))
            width *= 2

    def of(self, first: np.ndarray, last: np.ndarray) -> np.ndarray:
        level = np.frexp((last - first + 1).astype(np.float64))[1] - 1
        out = np.empty(len(first), np.uint8)
        for k in np.unique(level):
            here = level == k
            out[here] = np.minimum(self.rows[k][first[here]], self.rows[k][last[here] + 1 - (1 << k)])
        return out


class Queue:
    """Suffixes by first symbol; of one symbol first the induced ones in order of arrival, then the known ones."""

    def __init__(self, text: np.ndarray, symbols: int, known: np.ndarray, wanted: np.ndarray, shared: np.ndarray | None):
        fill = np.bincount(text[wanted], minlength=symbols)
        held = np.bincount(text[known], minlength=symbols)
        self.heads = np.cumsum(fill + held) - fill - held
        self.known_from = self.heads + fill
        self.places = on_disk(len(known) + int(fill.sum()), np.int32, -1)
        slots = np.arange(len(known)) + np.cumsum(fill)[text[known]]
        self.places[slots] = known
        self.shared = None
        if shared is not None:
            self.shared = on_disk(len(self.places), np.uint8, 0)
            self.shared[slots] = shared
            self.least = np.zeros(symbols, np.uint8)  # of the values handed out since a symbol's last arrival
        self.read, self.size = 0, 1024

    def block(self) -> slice:
        """The next entries up to the first gap."""
        ahead = self.places[self.read : self.read + self.size]
        gaps = ahead < 0
        n = int(gaps.argmax())
        if not gaps[n]:
            n = len(ahead)
        self.size = min(max(2 * n, 256), BLOCK)
        self.read += n
        return slice(self.read - n, self.read)

    def push(self, places: np.ndarray, symbols: np.ndarray, first: np.ndarray, shared: np.ndarray | None) -> None:
        """Arrivals grouped by symbol, in order within each; ``first`` marks where a group begins."""
        starts = first.nonzero()[0]
        rank = np.arange(len(symbols))
        rank -= starts[first.cumsum() - 1]
        slots = self.heads[symbols] + rank
        self.places[slots] = places
        if shared is not None:
            self.shared[slots] = shared
        ends = np.empty(len(starts), np.int64)
        ends[:-1] = starts[1:] - 1
        ends[-1] = len(symbols) - 1
        self.heads[symbols[ends]] = slots[ends] + 1


def induced(text: np.ndarray, symbols: int, known: np.ndarray, wanted: np.ndarray, shared: np.ndarray | None = None, runs: np.ndarray | None = None) -> Queue:
    """The queue after all ``wanted`` suffixes were induced from the ``known`` ones, given in order with their ``shared`` prefixes."""
    queue = Queue(text, symbols, known, wanted, shared)
    before = None  # symbol, whether known, and place of the entry handed out last
    wanted = np.append(wanted, False)  # what stands before the first place
    while queue.read < len(queue.places):
        taken = queue.block()
        places = queue.places[taken]
        if shared is not None:
            own = text[places]
            is_known = np.arange(taken.start, taken.stop) >= queue.known_from[own]
            common = queue.shared[taken]
            _mend(common, own, is_known, places, runs, before)
            before = own[-1], is_known[-1], places[-1]
        longer = places - 1
        ok = wanted[longer].nonzero()[0]
        if len(ok):
            arriving = text[longer[ok]]
            order = arriving.argsort(kind="stable")
            ok, arriving = ok[order], arriving[order]
            first = np.empty(len(ok), bool)
            first[0] = True
            np.not_equal(arriving[1:], arriving[:-1], out=first[1:])
            queue.push(longer[ok], arriving, first, None if shared is None else _carried(queue, common, ok, arriving, first))
        elif shared is not None:
            queue.least = np.minimum(queue.least, common.min())
    return queue


def _mend(common: np.ndarray, own: np.ndarray, is_known: np.ndarray, places: np.ndarray, runs: np.ndarray, before: tuple | None) -> None:
    """Values where a symbol begins (nothing shared) and where its known suffixes follow induced ones (the shorter run)."""
    last = np.append(own[0] if before is None else before[0], own[:-1])
    kind = np.append(is_known[0] if before is None else before[1], is_known[:-1])
    place = np.append(places[0] if before is None else before[2], places[:-1])
    seam = is_known & ~kind
    common[seam] = np.minimum(runs[places[seam]], runs[place[seam]])
    common[own != last] = 0
    if before is None:
        common[0] = 0


def _carried(queue: Queue, common: np.ndarray, source: np.ndarray, arriving: np.ndarray, first: np.ndarray) -> np.ndarray:
    """What each arrival shares with the arrival before it at the same symbol; ``source`` are the entries that induced them."""
    held = queue.least
    queue.least = np.minimum(held, common.min())
    opening, later = first.nonzero()[0], (~first).nonzero()[0]
    least = np.empty(len(source), np.uint8)
    least[later] = RangeMinima(common).of(source[later - 1] + 1, source[later])
    least[opening] = np.minimum(held[arriving[opening]], np.minimum.accumulate(common)[source[opening]])
    closing = np.append(opening[1:], len(source)) - 1
    rest = np.append(np.minimum.accumulate(common[::-1])[::-1], np.uint8(255))
    queue.least[arriving[closing]] = rest[source[closing] + 1]
    return np.minimum(least, MOST - 1) + 1


def _named(text: np.ndarray, symbols: int, sampled: np.ndarray) -> tuple[np.ndarray, int]:
    """Names, in sorted order, of the stretches from each sampled place to the next one, both included.

    Several symbols are compared at once; only stretches that are equal so far go on. One that begins with another whole one
    comes before it, since it goes on downwards where the other turns.
    """
    length = np.append(np.diff(sampled) + 1, 1)
    bits = (symbols + 1).bit_length()
    width, end = 63 // bits, (1 << bits) - 1
    n, order, new = len(sampled), np.arange(len(sampled)), np.zeros(len(sampled), bool)
    new[0] = True
    open_slots, done = np.arange(n), 0
    while len(open_slots):
        here = order[open_slots]
        key = np.zeros(len(here), np.int64)
        for i in range(done, done + width):
            at = np.minimum(sampled[here] + i, len(text) - 1)
            key = (key << bits) | np.where(i < length[here], text[at].astype(np.int64), end)
        group = np.cumsum(new[open_slots])
        sorting = np.lexsort((key, group)) if done else np.argsort(key, kind="stable")
        order[open_slots] = here = here[sorting]
        key, group = key[sorting], group[sorting]
        new[open_slots[1:]] |= (key[1:] != key[:-1]) | (group[1:] != group[:-1])
        done += width
        last = np.append(new[1:], True)
        tied = ~(new & last)
        tied[open_slots] &= length[here] >= done
        settled = np.ones(n, bool)
        settled[open_slots] = False
        tied &= ~settled
        open_slots = np.flatnonzero(tied)
    names = np.empty(n, np.int32)
    names[order] = np.cumsum(new) - 1
    return names, int(new.sum())


def _both_passes(text: np.ndarray, symbols: int, known: np.ndarray, rising: np.ndarray, shared: np.ndarray | None = None, runs: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray | None]:
    """All suffixes in order, induced from the sampled ones, and what each shares with the one before."""
    up = induced(text, symbols, known, ~rising, shared, runs)
    falling = ~rising[up.places]
    end = len(text) - 1
    # downwards: symbols count from the last, and the whole text's end, which nothing induces, is known
    known = np.append(up.places[falling][::-1], np.int32(end))
    wanted = rising.copy()
    wanted[end] = False
    if shared is not None:
        back = up.shared[falling]
        shared = np.append(np.append(np.uint8(0), back[:0:-1]), np.uint8(0)) if len(back) else np.zeros(1, np.uint8)
    down = induced((symbols - 1 - text).astype(text.dtype), symbols, known, wanted, shared, runs)
    if shared is None:
        return down.places[::-1], None
    return down.places[::-1], np.append(np.uint8(0), down.shared[:0:-1])


def sampled_order(text: np.ndarray, symbols: int, rising: np.ndarray) -> np.ndarray:
    """The sampled suffixes in order, by recursion over the names of their stretches."""
    sampled = np.flatnonzero(rising[1:] & ~rising[:-1]).astype(np.int32) + np.int32(1)
    names, distinct = _named(text, symbols, sampled)
    if distinct < len(sampled):
        return sampled[suffix_order(names, distinct)]
    order = np.empty_like(sampled)
    order[names] = sampled
    return order


def suffix_order(text: np.ndarray, symbols: int) -> np.ndarray:
    """Suffixes of a text that ends with its only smallest symbol."""
    if len(text) == 1:
        return np.zeros(1, np.int32)
    rising, _ = shapes(text)
    return _both_passes(text, symbols, sampled_order(text, symbols, rising), rising)[0]


def _shared_by_sight(text: np.ndarray, order: np.ndarray) -> np.ndarray:
    """The common prefixes, up to ``MOST``, of neighbours in the order of the sampled suffixes, read off the text eight bytes at a time."""
    width, n = 8 // text.itemsize, len(text)
    padded = np.append(text, np.zeros(MOST + width, text.dtype))
    words = np.ndarray((n + MOST,), "<u8", padded, strides=(text.itemsize,))
    shared = np.zeros(len(order), np.uint8)
    pairs = np.arange(1, len(order))
    for step in range(0, MOST, width):
        unlike = words[order[pairs - 1] + step] ^ words[order[pairs] + step]
        low = (unlike & (~unlike + np.uint64(1))).astype(np.float64)
        equal = np.where(unlike == 0, width, (np.frexp(low)[1] - 1) // (8 * text.itemsize))
        shared[pairs] = np.minimum(step + equal, MOST)
        pairs = pairs[unlike == 0]
    return shared


def suffixes_with_shared(text: np.ndarray, symbols: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffixes in order and the common prefix (up to ``MOST``) of each with the one before; the text ends with its only smallest symbol."""
    if len(text) == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    rising, runs = shapes(text)
    order = sampled_order(text, symbols, rising)
    return _both_passes(text, symbols, order, rising, _shared_by_sight(text, order), runs)
