"""External induced suffix sorting with common prefixes, in bulk.

Suffixes are induced through a priority queue whose tuples are (symbol, turn, position, common prefix with the tuple of the same
symbol before it). Tuples leave in batches: all symbols below the least that a tuple of the batch can push are final at once. The
queue keeps sorted runs, merges those of a size, and moves runs beyond `most` tuples to scratch files. S* substrings are named,
the text of names is sorted the same way, and its common prefixes, counted in names, become common prefixes of the S* suffixes.
"""

from __future__ import annotations

import tempfile

import numpy as np

#: Queue tuples in memory.
IN_MEMORY = 1 << 20
NONE = np.iinfo(np.int32).max


class RunQueue:
    """Tuples (symbol, position, prefix) in sorted runs; tuples of one symbol leave in the order in which they came."""

    def __init__(self, most: int = IN_MEMORY):
        self.most, self.runs, self.spilled = most, [], 0

    def push(self, symbol: np.ndarray, pos: np.ndarray, prefix: np.ndarray) -> None:
        if len(symbol):
            self.add(self._sorted(np.stack([symbol, pos, prefix]).astype(np.int32)))

    def add(self, run: np.ndarray) -> None:
        """Pushes tuples that are sorted already."""
        self.runs.append(run)
        while len(self.runs) > 1 and not isinstance(self.runs[-2], np.memmap) and 2 * self.runs[-1].shape[1] >= self.runs[-2].shape[1]:
            self.runs[-2:] = [self._sorted(np.concatenate(self.runs[-2:], axis=1))]
        if sum(r.shape[1] for r in self.runs if not isinstance(r, np.memmap)) > self.most:
            self.runs = [r if isinstance(r, np.memmap) else self._stored(r) for r in self.runs]

    @staticmethod
    def _sorted(run: np.ndarray) -> np.ndarray:
        return run.take(run[0].argsort(kind="stable"), axis=1)

    def _stored(self, run: np.ndarray) -> np.ndarray:
        self.spilled += run.shape[1]
        with tempfile.TemporaryFile() as file:
            file.write(np.ascontiguousarray(run).data)
            file.flush()
            return np.memmap(file, np.int32, "r", shape=run.shape)

    def head(self) -> int:
        return min((int(r[0, 0]) for r in self.runs), default=int(NONE))

    def bound(self, want: int) -> int:
        """A symbol below which there are about `want` tuples or less in each run."""
        return min((int(r[0, want]) for r in self.runs if r.shape[1] > want), default=int(NONE))

    def below(self, bound: int, take: bool = False) -> np.ndarray:
        """All tuples with a symbol below the bound, in order."""
        ends = [int(r[0].searchsorted(np.int32(bound))) for r in self.runs]
        found = [np.asarray(r[:, :e]) for r, e in zip(self.runs, ends, strict=True) if e]
        if take:
            self.drop(bound)
        return np.zeros((3, 0), np.int32) if not found else found[0] if len(found) == 1 else self._sorted(np.concatenate(found, axis=1))

    def drop(self, bound: int) -> None:
        """Takes the tuples with a symbol below the bound away."""
        ends = [int(r[0].searchsorted(np.int32(bound))) for r in self.runs]
        self.runs = [r[:, e:] for r, e in zip(self.runs, ends, strict=True) if e < r.shape[1]]


def range_minima(values: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """The least of values[first..last] of each range, both ends included; first <= last."""
    if not len(first):
        return np.zeros(0, np.int32)
    k = np.frexp((last - first + 1).astype(np.float64))[1] - 1
    levels = np.empty((int(k.max()) + 1, len(values)), np.int32)  # a level's last places stay unset and aren't looked up
    levels[0] = values
    for level in range(1, len(levels)):
        step, size = 1 << (level - 1), len(values) - (1 << level) + 1
        np.minimum(levels[level - 1, :size], levels[level - 1, step : step + size], out=levels[level, :size])
    return np.minimum(levels[k, first], levels[k, last - (1 << k) + 1])


def begins(*columns: np.ndarray) -> np.ndarray:
    """Where a row differs from the one before it in any of the columns, the first row included."""
    out = np.ones(len(columns[0]), bool)
    np.not_equal(columns[0][1:], columns[0][:-1], out=out[1:])
    for x in columns[1:]:
        out[1:] |= x[1:] != x[:-1]
    return out


class Minima:
    """The least of all values after a place, for values that come in batches."""

    def __init__(self):
        self.place, self.value = np.zeros(0, np.int64), np.zeros(0, np.int32)

    def after(self, place: np.ndarray) -> np.ndarray:
        at = self.place.searchsorted(place, "right")
        return np.concatenate([self.value, np.array([NONE], np.int32)])[at]

    def add(self, values: np.ndarray, first: int) -> None:
        behind = np.minimum.accumulate(values[::-1])[::-1]
        last = np.append((behind[1:] != behind[:-1]).nonzero()[0], len(behind) - 1)
        older = self.value < behind[0]
        self.place = np.concatenate([self.place[older], first + last])
        self.value = np.concatenate([self.value[older], behind[last]]).astype(np.int32)


def run_lengths(t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(equal symbols in a row before each place, equal symbols in a row from it on)."""
    edge = np.r_[np.flatnonzero(np.r_[True, t[1:] != t[:-1]]), len(t)]
    size = np.diff(edge)
    before = (np.arange(len(t)) - np.repeat(edge[:-1], size)).astype(np.int32)
    return before, (np.repeat(size, size) - before).astype(np.int32)


def induced(u: np.ndarray, before: np.ndarray, onward: np.ndarray, seeds: np.ndarray, prefixes: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """(suffixes, common prefix with the one before): `seeds`, in order, and all suffixes that they induce, by symbols of u.

    A suffix induces the one before it if that begins with a larger symbol, or with an equal one and was induced itself. At one
    symbol induced suffixes stand before seeds. With u reversed in value, the same is the pass for S suffixes from the largest on.
    """
    queue, recent = RunQueue(most), Minima()
    last = np.full(int(u.max(initial=0)) + 1, -1, np.int64)
    order, common = [], []
    symbol_of_seeds, at, done, want = u[seeds], 0, 0, 1024
    while queue.runs or at < len(seeds):
        first = min(queue.head(), int(symbol_of_seeds[at]) if at < len(seeds) else NONE)
        bound = max(first + 1, min(queue.bound(want), int(symbol_of_seeds[at + want]) if at + want < len(seeds) else NONE))
        got = queue.below(bound)
        end = at + int(symbol_of_seeds[at:].searchsorted(bound))
        # The batch ends before the first symbol that one of its own tuples pushes to.
        more = before[got[1]]
        head = np.concatenate([got[1] - more, seeds[at:end]])
        symbol = np.concatenate([got[0], symbol_of_seeds[at:end]])
        pushed = u[head - 1]
        pushed[(head == 0) | (pushed <= symbol)] = NONE
        by = symbol.argsort(kind="stable")
        in_order = symbol[by]
        open_ = (np.minimum.accumulate(pushed[by])[:-1] <= in_order[1:]).nonzero()[0]
        if len(open_):
            cut = int(open_[0]) + 1
            bound = int(in_order[cut])
            end = at + int(symbol_of_seeds[at:].searchsorted(bound))
            want = max(256, 2 * cut)
            kept = int(got[0].searchsorted(np.int32(bound)))
            got, more = got[:, :kept], more[:kept]
        else:
            want = max(256, 2 * len(by))
        queue.drop(bound)
        # Equal symbols before an induced suffix follow generation by generation.
        symbol, pos, prefix = got
        if more.any():
            k = np.repeat(np.arange(len(pos)), more + 1)
            gen = np.arange(len(k)) - np.repeat(np.cumsum(more + 1) - (more + 1), more + 1)
            by = np.lexsort((k, gen, symbol[k]))
            k, gen = k[by], gen[by]
            symbol, pos = symbol[k], (pos[k] - gen).astype(np.int32)
            out, deep = prefix[k], (gen > 0).nonzero()[0]
            out[deep] = gen[deep]
            deep = deep[~begins(symbol, gen)[deep]]
            out[deep] += range_minima(prefix, k[deep - 1] + 1, k[deep])
            prefix = out
        if end > at:
            by = np.concatenate([2 * symbol.astype(np.int64), 2 * symbol_of_seeds[at:end].astype(np.int64) + 1]).argsort(kind="stable")
            seed = by >= len(pos)
            symbol, pos, prefix = (np.concatenate(x)[by] for x in ((symbol, symbol_of_seeds[at:end]), (pos, seeds[at:end]), (prefix, prefixes[at:end])))
            new = begins(symbol)
            meet = (~new[1:] & seed[1:] & ~seed[:-1]).nonzero()[0] + 1
            prefix[meet] = np.minimum(onward[pos[meet]], onward[pos[meet - 1]])
        else:
            prefix, new = prefix.copy(), begins(symbol)
        prefix[new] = 0
        at = end
        order.append(pos)
        common.append(prefix)
        # What the batch induces, with the least common prefix since the last push to the same symbol.
        to = u[pos - 1]
        e = ((to > symbol) & (pos > 0)).nonzero()[0]
        if len(e):
            to = to[e]
            by = to.argsort(kind="stable")
            e_by, to_by = e[by], to[by]
            fresh = begins(to_by)
            value = np.zeros(len(e), np.int32)
            i = (~fresh).nonzero()[0]
            value[i] = 1 + range_minima(prefix, e_by[i - 1] + 1, e_by[i])
            i = fresh.nonzero()[0]
            final = np.append(i[1:], len(e)) - 1
            i = i[last[to_by[i]] >= 0]
            value[i] = 1 + np.minimum(recent.after(last[to_by[i]]), np.minimum.accumulate(prefix)[e_by[i]])
            last[to_by[final]] = done + e_by[final]
            queue.add(np.stack([to_by, pos[e_by] - 1, value]))
        recent.add(prefix, done)
        done += len(pos)
    return (np.concatenate(order), np.concatenate(common)) if order else (np.zeros(0, np.int32),) * 2


def named(t: np.ndarray, small: np.ndarray, stars: np.ndarray) -> tuple[np.ndarray, int]:
    """(name of each S* substring in the order of the substrings, number of names). At equal symbols an L suffix is the smaller."""
    key = 2 * t.astype(np.int64) + small
    end = np.append(stars[1:], len(t) - 1)
    width = max(1, 62 // max(1, int(key.max() + 1).bit_length()))
    place = int(key.max() + 1).bit_length()
    group, active, step = np.zeros(len(stars), np.int64), np.arange(len(stars)), 0
    while len(active):
        packed = np.zeros(len(active), np.int64)
        for j in range(step, step + width):
            at = stars[active] + j
            packed = packed << place | np.where(at <= end[active], key[np.minimum(at, len(t) - 1)] + 1, 0)
        by = np.lexsort((packed, group[active]))
        g, p = group[active][by], packed[by]
        new = np.r_[True, (g[1:] != g[:-1]) | (p[1:] != p[:-1])]
        start = np.maximum.accumulate(np.where(new, np.arange(len(by)), 0))
        base = np.maximum.accumulate(np.where(np.r_[True, g[1:] != g[:-1]], np.arange(len(by)), 0))
        group[active[by]] = g + start - base  # a group's number is how many substrings are before it
        size = np.diff(np.r_[np.flatnonzero(new), len(by)])
        step += width
        going = (np.repeat(size, size) > 1) & (stars[active[by]] + step <= end[active[by]])
        active = active[by][going]
    kinds, names = np.unique(group, return_inverse=True)
    return names.astype(np.int32), len(kinds)


def suffixes(t: np.ndarray, most: int = IN_MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array of t, symbols that each suffix shares with the one before it); the last symbol is the least and occurs once."""
    n = len(t)
    if n == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.int32)
    turn = np.flatnonzero(t[1:] != t[:-1])
    small = np.r_[np.repeat(t[turn + 1] > t[turn], np.diff(np.r_[-1, turn])), np.ones(1, bool)]
    before, onward = run_lengths(t)
    stars = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)
    names, kinds = named(t, small, stars)
    if kinds < len(stars):
        order, common = suffixes(names, most)
    else:
        order, common = np.argsort(names).astype(np.int32), np.zeros(len(stars), np.int32)
    # Names in common stand for symbols in common; the rest lies within the first substrings that differ, or just behind them.
    x, y = order[:-1], order[1:]
    whole = common[1:]
    a, b = stars[np.minimum(x + whole, len(stars) - 1)].astype(np.int64), stars[np.minimum(y + whole, len(stars) - 1)].astype(np.int64)
    prefix = np.zeros(len(stars), np.int32)
    prefix[1:] = a - stars[x]
    active = np.arange(len(a))
    while len(active):
        active = active[t[a[active]] == t[b[active]]]
        step = np.minimum(onward[a[active]], onward[b[active]])
        prefix[active + 1] += step
        a[active] += step
        b[active] += step
    large, share = induced(t, before, onward, stars[order], prefix, most)
    keep = ~small[large]
    least = _minima_between(share, keep)
    top = int(t.max())
    down, seeds = (top - t).astype(np.int32), large[keep][::-1]
    order, common = induced(down, before, onward, seeds, np.r_[np.zeros(1, np.int32), least[1:][::-1]][: len(seeds)], most)
    out = np.r_[order, np.array([n - 1], np.int32)][::-1]  # the last suffix is the least
    return out, np.r_[np.zeros(2, np.int32), common[1:][::-1]][:n]


def _minima_between(values: np.ndarray, keep: np.ndarray) -> np.ndarray:
    """For each kept place the least value after the kept place before it."""
    at = np.flatnonzero(keep)
    if not len(at):
        return np.zeros(0, np.int32)
    edge = np.r_[0, at[:-1] + 1]
    return np.minimum.reduceat(values[: at[-1] + 1], edge).astype(np.int32)
