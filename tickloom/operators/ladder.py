"""One day's book after every event, by array operations over its level updates.

A level is a running sum with a floor at zero that starts anew at absolute
sizes and clears. The best price after a row is the greatest of the levels whose
stretch of life covers it; depths are carried forward and looked up anew only
where the best price moves. The cost grows with the events and hardly with the
number of levels, even where a side is empty. Slices of a day can be folded
apart: :func:`effects` says what each does to the sizes before it. Any number of
slices is folded in one go, for a slice begins with an empty book as a clear does.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from tickloom.schema import ADD, ASK, BAD_SIZE, BID, CANCEL, CLEAR, CROSSED, LOCKED, MODIFY, NEGATIVE_SIZE, OUT_OF_RANGE, TRADE

#: Rows that depths are worked out for together.
STRETCH = 1 << 14


def refused(action: np.ndarray, price: np.ndarray, size: np.ndarray, known: np.ndarray, window: int, first: int | None) -> np.ndarray:
    """0, or the flag of an event that the book does not take; ``known`` tells which prices are not null, ``first`` is the day's first price."""
    out = np.where((size < 0) | ((size == 0) & (action != MODIFY)), BAD_SIZE, 0)
    if first is not None:
        place = price - first + window // 2
        out = np.where(known & ((place < 0) | (place >= window)), OUT_OF_RANGE, out)
    return np.where(action == CLEAR, 0, out)


@dataclass
class Updates:
    """Level updates of a day by level and row; levels are numbered by side, then price."""

    row: np.ndarray
    level: np.ndarray
    size: np.ndarray
    before: np.ndarray
    epoch: np.ndarray  # clears and slices that begin up to each row
    names: np.ndarray  # side and price of each level

    def at(self, level: np.ndarray, row: np.ndarray) -> np.ndarray:
        """Sizes of ``level`` (-1: none) after ``row``."""
        n = len(self.epoch)
        at = np.searchsorted(self._keys, level * n + row, side="right") - 1
        ok = (level >= 0) & (at >= 0)
        at = np.maximum(at, 0)
        if not len(self.row):
            return np.zeros(len(level), dtype=np.int64)
        ok &= (self.level[at] == level) & (self.epoch[self.row[at]] == self.epoch[row])
        return np.where(ok, self.size[at], 0)

    def __post_init__(self):
        self._keys = self.level * len(self.epoch) + self.row


def _floored(delta: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Running sums with a floor at zero, anew from each start."""
    segment = np.cumsum(starts) - 1
    total = np.cumsum(delta)
    base = (total - delta)[starts]
    total = total - base[segment] if len(total) else total
    reach = 2 * int(np.abs(total).max(initial=0)) + 1
    if reach * (int(segment[-1]) + 1 if len(segment) else 1) < 1 << 62:
        shift = segment * reach
        least = np.minimum.accumulate(total - shift) + shift
    else:
        edges = np.r_[np.flatnonzero(starts), len(total)]
        least = np.concatenate([np.minimum.accumulate(total[a:b]) for a, b in zip(edges[:-1], edges[1:], strict=True)])
    return total - np.minimum(least, 0)


def _named(side: np.ndarray, price: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Levels by side, then price, and the number of each row's."""
    if not len(price):
        return np.zeros((0, 2), dtype=np.int64), np.zeros(0, dtype=np.int64)
    low, high = int(price.min()), int(price.max())
    width = high - low + 1
    place = (side > 0) * width + (price - low)
    if 2 * width > 8 * len(price) + (1 << 20):  # far apart: sort them
        found, level = np.unique(place, return_inverse=True)
    else:
        seen = np.zeros(2 * width, dtype=bool)
        seen[place] = True
        found = np.flatnonzero(seen)
        level = (np.cumsum(seen) - 1)[place]
    return np.c_[np.where(found >= width, BID, ASK), found % width + low], level.astype(np.int64)


def updates_of(action: np.ndarray, side: np.ndarray, price: np.ndarray, size: np.ndarray, taken: np.ndarray, begins: np.ndarray | None = None) -> Updates:
    """The day's level updates; a trade's side is that of who crosses, so it meets the other side. Rows in ``begins`` find an empty book."""
    book_side = np.where(side == BID, BID, ASK)
    book_side = np.where(action == TRADE, -book_side, book_side)
    clear = taken & (action == CLEAR)
    epoch = np.cumsum(clear if begins is None else clear | begins)
    row = np.flatnonzero(taken & ~clear)
    names, level = _named(book_side[row], price[row])
    order = np.argsort(level, kind="stable")
    row, level = row[order], level[order]
    act, amount = action[row], size[row]
    first = np.r_[True, (level[1:] != level[:-1]) | (epoch[row[1:]] != epoch[row[:-1]])][: len(row)]
    after = _floored(np.where((act == ADD) | (act == MODIFY), amount, -amount), first | (act == MODIFY))
    before = np.where(first, 0, np.r_[0, after[:-1]][: len(after)])
    return Updates(row, level, after, before, epoch, names)


def _cover(start: np.ndarray, stop: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """For each of ``n`` places the greatest ``value`` of the stretches [start, stop) that it lies in, -1 for none.

    A stretch is the union of two blocks whose length is a power of two; blocks
    are halved from the longest on and hand what they have to their halves. The
    cost is n log n, whatever the number of values.
    """
    power = np.frexp(np.maximum(stop - start, 1))[1] - 1
    order = np.argsort(power, kind="stable")
    start, stop, value, power = start[order], stop[order], value[order], power[order]
    edges = np.searchsorted(power, np.arange(int(power[-1]) + 2 if len(power) else 1))
    here = np.full(n, -1, dtype=np.int64)
    for k in range(len(edges) - 2, -1, -1):
        if k + 1 < len(edges) - 1:
            halves = here.copy()  # a block of 2^(k+1) at i is one of 2^k at i and one at i + 2^k
            np.maximum(halves[1 << k :], here[: n - (1 << k)], out=halves[1 << k :])
            here = halves
        own = slice(edges[k], edges[k + 1])
        np.maximum.at(here, start[own], value[own])
        np.maximum.at(here, stop[own] - (1 << k), value[own])
    return here


def _best(updates: Updates, side: int) -> np.ndarray:
    """Number of the best live level of ``side`` after each row, -1 for none.

    A level lives from an update that leaves it a size until its next update,
    the next clear or the end; of the levels that live at a row, numbered by
    price, the greatest is the best bid and the least the best ask.
    """
    n = len(updates.epoch)
    if not len(updates.row):
        return np.full(n, -1, dtype=np.int64)
    clears = np.flatnonzero(np.diff(updates.epoch, prepend=0))
    cleared = np.r_[clears, n][updates.epoch[updates.row]]
    following = np.r_[updates.row[1:], n]
    following[np.flatnonzero(updates.level[1:] != updates.level[:-1])] = n
    stop = np.minimum(following, cleared)
    live = np.flatnonzero((updates.size > 0) & (updates.names[updates.level, 0] == side) & (stop > updates.row))
    level, top = updates.level[live], len(updates.names)
    found = _cover(updates.row[live], stop[live], level if side == BID else top - level, n)
    return found if side == BID else np.where(found >= 0, top - found, -1)


def _depth(updates: Updates, side: int, best: np.ndarray, levels: int) -> np.ndarray:
    """Sizes at the best price and the ticks behind it, after each row."""
    n = len(best)
    out = np.zeros((n, levels), dtype=np.int64)
    mine = np.flatnonzero(updates.names[:, 0] == side) if len(updates.names) else np.zeros(0, dtype=np.int64)
    if not len(mine):
        return out
    price = updates.names[:, 1]
    low = int(price[mine[0]])
    number = np.full(int(price[mine[-1]]) - low + 1 + 2 * levels, -1, dtype=np.int64)  # prices lie within the day's window
    number[price[mine] - low + levels] = mine
    own = np.flatnonzero(side == updates.names[updates.level, 0])
    own = own[np.argsort(updates.row[own], kind="stable")]
    own_row, own_price, own_size = updates.row[own], price[updates.level[own]], updates.size[own]
    top = np.where(best >= 0, price[best], 0)
    moved = np.r_[True, (best[1:] != best[:-1]) | (updates.epoch[1:] != updates.epoch[:-1])]
    step = np.arange(levels) * -side
    for a in range(0, n, STRETCH):
        b = min(n, a + STRETCH)
        fresh = moved[a:b].copy()
        fresh[0] = True
        rows = a + np.flatnonzero(fresh)
        rows = rows[best[rows] >= 0]
        fill = np.zeros((b - a, levels), dtype=bool)
        fill[fresh] = True
        asked = number[(top[rows][:, None] + step - low + levels).ravel()]
        out[rows] = updates.at(asked, np.repeat(rows, levels)).reshape(-1, levels)
        part = slice(np.searchsorted(own_row, a), np.searchsorted(own_row, b))
        row, behind = own_row[part], (top[own_row[part]] - own_price[part]) * side
        seen = (behind >= 0) & (behind < levels) & (best[row] >= 0)
        out[row[seen], behind[seen]] = own_size[part][seen]
        fill[row[seen] - a, behind[seen]] = True
        last = np.maximum.accumulate(np.where(fill, np.arange(b - a)[:, None], 0), axis=0)
        out[a:b] = np.take_along_axis(out[a:b], last, axis=0)
    return out


def first_price(price: np.ndarray, known: np.ndarray) -> int | None:
    return int(price[0]) if len(price) and known[0] else None


def _begins(part: np.ndarray) -> np.ndarray:
    """Whether each row is the first of its slice."""
    return np.r_[True, part[1:] != part[:-1]][: len(part)]


@dataclass
class Effects:
    """What slices of a day (``part``) do to their levels: a size x becomes max(x + gain, least), or ``least`` where it is ``fixed``; and which ``parts`` are ``cleared``."""

    part: np.ndarray
    names: np.ndarray
    gain: np.ndarray
    least: np.ndarray
    fixed: np.ndarray
    parts: np.ndarray
    cleared: np.ndarray


def effects(action: np.ndarray, side: np.ndarray, price: np.ndarray, size: np.ndarray, known: np.ndarray, window: int, first: int | None, part: np.ndarray) -> Effects:
    """Effects of each slice's events, in order, on what its levels hold before it; ``part`` is the slice of each row.

    A level's floored sum, from x on, is the greater of x plus all changes and
    of what is left of the changes since their lowest point. A slice with a
    clear fixes the levels that it fills afterwards and empties all others.
    """
    taken = (refused(action, price, size, known, window, first) == 0) & (known | (action == CLEAR))
    begins = _begins(part)
    at = np.flatnonzero(begins)
    updates = updates_of(action, side, price, size, taken, begins)
    cleared = np.logical_or.reduceat(action == CLEAR, at) if len(at) else np.zeros(0, dtype=bool)
    final = updates.epoch[np.r_[at[1:], len(part)] - 1] if len(at) else updates.epoch  # of each slice
    number = np.cumsum(begins) - 1
    own = np.flatnonzero(updates.epoch[updates.row] == final[number[updates.row]])
    row, level, after = updates.row[own], updates.level[own], updates.size[own]
    act, amount, number = action[row], size[row], number[row]
    starts = np.flatnonzero(np.r_[True, (level[1:] != level[:-1]) | (number[1:] != number[:-1])][: len(level)])
    if not len(starts):
        none = np.zeros(0, dtype=np.int64)
        return Effects(none, updates.names[:0], none, none, none.astype(bool), part[at], cleared)
    ends = np.r_[starts[1:], len(level)] - 1
    total = np.cumsum(np.where((act == ADD) | (act == MODIFY), amount, -amount))
    total = total - np.repeat(np.r_[0, total[ends[:-1]]], np.diff(np.r_[starts, len(level)]))
    gain = total[ends]
    fixed = np.logical_or.reduceat(act == MODIFY, starts) | cleared[number[starts]]
    least = np.where(fixed, after[ends], gain - np.minimum.reduceat(total, starts))
    return Effects(part[row[starts]], updates.names[level[starts]], np.where(fixed, 0, gain), least, fixed, part[at], cleared)


def fold(action: np.ndarray, side: np.ndarray, price: np.ndarray, size: np.ndarray, known: np.ndarray, levels: int, window: int, first: int | None = None) -> dict[str, np.ndarray]:
    """Best prices (``has_bid``, ``has_ask`` tell where there are any), depths and flags after each event, in order."""
    reject = refused(action, price, size, known, window, first)
    taken = (reject == 0) & (known | (action == CLEAR))
    return _folded(action, side, price, size, taken, reject, levels)


def fold_slices(action: np.ndarray, side: np.ndarray, price: np.ndarray, size: np.ndarray, known: np.ndarray, levels: int, window: int, first: int | None, part: np.ndarray, opening: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]) -> dict[str, np.ndarray]:
    """:func:`fold` of slices of a day, in order (``part`` is the slice of each row), each from the sizes in ``opening`` (slice, side, price, size).

    These are set before a slice's first event; ``first`` is the day's first price.
    """
    reject = refused(action, price, size, known, window, first)
    taken = (reject == 0) & (known | (action == CLEAR))
    ahead = len(opening[0])
    joined = lambda new, old: np.concatenate([np.asarray(new, dtype=old.dtype), old])
    part = joined(opening[0], part)
    order = np.argsort(part, kind="stable")  # a slice's opening stays before its events
    rows = (joined(np.full(ahead, MODIFY), action), joined(opening[1], side), joined(opening[2], price), joined(opening[3], size), joined(np.ones(ahead), taken), joined(np.zeros(ahead), reject))
    found = _folded(*(x[order] for x in rows), levels, _begins(part[order]))
    own = order >= ahead
    return {k: v[own] for k, v in found.items()}


def _folded(action: np.ndarray, side: np.ndarray, price: np.ndarray, size: np.ndarray, taken: np.ndarray, reject: np.ndarray, levels: int, begins: np.ndarray | None = None) -> dict[str, np.ndarray]:
    updates = updates_of(action, side, price, size, taken, begins)
    out = {}
    for name, own in (("bid", BID), ("ask", ASK)):
        best = _best(updates, own)
        out[f"has_{name}"] = best >= 0
        out[f"{name}_px"] = np.where(best >= 0, updates.names[best, 1], 0) if len(updates.names) else np.zeros(len(action), dtype=np.int64)
        out[f"{name}_depth"] = _depth(updates, own, best, levels)
    both = out["has_bid"] & out["has_ask"]
    state = np.where(out["bid_px"] > out["ask_px"], CROSSED, np.where(out["bid_px"] == out["ask_px"], LOCKED, 0)) * both
    negative = np.zeros(len(action), dtype=np.int64)
    under = np.isin(action[updates.row], (CANCEL, TRADE)) & (size[updates.row] > updates.before)
    negative[updates.row[under]] = NEGATIVE_SIZE
    out["book_flags"] = np.where(reject > 0, reject, np.where(action == CLEAR, 0, negative + state))
    return out
