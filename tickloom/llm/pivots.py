"""Pivot distance tables over runs of 64-bit fingerprints.

A table holds the Hamming distances of fingerprints to reference fingerprints
(pivots). Two fingerprints at most ``radius`` apart differ by at most
``radius`` in every coordinate, so a larger difference discards the pair; the
bits of the survivors are counted.
"""

from __future__ import annotations

import numpy as np

PIVOTS = np.random.default_rng(20240229).integers(0, 1 << 64, 16, dtype=np.uint64)
#: Runs of equal keys up to this length are compared pair by pair, longer ones by growing clusters.
SHORT_RUN = 16


def distance_table(fps: np.ndarray) -> np.ndarray:
    """Hamming distances of fingerprints to all pivots, ``int8[n, pivots]``."""
    return np.bitwise_count(fps[:, None] ^ PIVOTS[None, :]).astype(np.int8)


def near(fps: np.ndarray, table: np.ndarray, i: np.ndarray, j: np.ndarray, radius: int) -> np.ndarray:
    """Which pairs are at most ``radius`` apart: the table discards first, four coordinates at a time, then bits are counted."""
    left = np.arange(len(i))
    for a in range(0, table.shape[1], 4):
        far = np.abs(table[i[left], a : a + 4] - table[j[left], a : a + 4]).max(axis=1) > radius if len(left) else np.zeros(0, dtype=bool)
        left = left[~far]
    out = np.zeros(len(i), dtype=bool)
    out[left[np.bitwise_count(fps[i[left]] ^ fps[j[left]]) <= radius]] = True
    return out


def _grow(fps: np.ndarray, table: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Near pairs that span each cluster of one run: members are met once, by their first neighbour."""
    links, free = [], np.arange(len(fps))
    while len(free) > 1:
        front, free = [free[0]], free[1:]
        while front and len(free):
            x = front.pop()
            new = near(fps, table, np.full(len(free), x), free, radius)
            if new.any():
                found = free[new]
                links += [(int(x), int(y)) for y in found]
                front += found.tolist()
                free = free[~new]
    return links


def near_in_runs(keys: np.ndarray, fps: np.ndarray, radius: int, short_radius: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Places of near pairs with equal keys, all of a short run and enough to connect a long one; equal keys stand together.

    Where nearness decides, a connected run is all there is to know. Where it
    only proposes pairs for another test, pairs of a long run that are left out
    here may pass that test, and the caller looks at such runs once more; the
    pairs of short runs may then be up to ``short_radius`` apart.
    """
    table = distance_table(fps)
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, dtype=np.int64)
    sizes = np.diff(np.r_[first, len(keys)])
    long_runs = sizes > SHORT_RUN
    a, b = [np.zeros(0, dtype=np.int64)], [np.zeros(0, dtype=np.int64)]
    short = np.repeat(~long_runs, sizes)
    for lag in range(1, SHORT_RUN):
        i = np.flatnonzero((keys[lag:] == keys[:-lag]) & short[lag:]) if len(keys) > lag else np.zeros(0, dtype=int)
        if not len(i):
            break
        i = i[near(fps, table, i, i + lag, radius if short_radius is None else short_radius)]
        a.append(i)
        b.append(i + lag)
    for at, n in zip(first[long_runs].tolist(), sizes[long_runs].tolist(), strict=True):
        # Another order for each key: one key's tree is not all others' tree.
        order = at + np.argsort((fps[at : at + n] ^ np.uint64(int(keys[at]) % (1 << 64))) * np.uint64(0x9E3779B97F4A7C15), kind="stable")
        grown = np.array(_grow(fps[order], table[order], radius), dtype=np.int64).reshape(-1, 2)
        a.append(order[grown[:, 0]])
        b.append(order[grown[:, 1]])
    return np.concatenate(a), np.concatenate(b)


def whole_runs(batches, longest: int | None = None):
    """(columns, part of a long run) from record batches sorted by their first column; columns are arrays of whole runs.

    A run that batches cut is put together once. With ``longest``, one that
    batches cut and that is longer comes out piece by piece instead, so what is
    held stays small whatever the length.
    """
    held, size, passed = [], 0, None
    together = lambda parts: [np.concatenate(x) for x in zip(*parts, strict=True)]
    for batch in batches:
        columns = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if passed is not None and batch.num_rows:
            n = int(np.searchsorted(columns[0], passed, side="right"))
            if n:
                yield [c[:n] for c in columns], True
            if n < len(columns[0]):
                passed = None
            columns = [c[n:] for c in columns]
        keys = columns[0]
        if not len(keys):
            continue
        if held and held[-1][0][0] == keys[-1]:
            held.append(columns)
            size += len(keys)
        else:
            cut = int(np.searchsorted(keys, keys[-1]))
            if held or cut:
                yield together([*held, [c[:cut] for c in columns]]), False
            held, size = [[c[cut:] for c in columns]], len(keys) - cut
        if longest is not None and size > longest:
            yield together(held), True
            held, size, passed = [], 0, keys[-1]
    if held:
        yield together(held), False
