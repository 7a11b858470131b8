"""Suffix arrays by induced sorting and permuted common prefixes, as NumPy array steps.

Induced sorting (SA-IS; Nong, Zhang, Chan, 2009): suffixes are classified as smaller or larger than their right
neighbour; leftmost smaller ones are sorted through the string of names of their substrings; all others are induced from
them in linear scans.  A scan goes bucket by bucket: what a bucket holds when the scan reaches it is one array, and its
predecessors are dealt to their buckets by one stable sort.
"""
import numpy as np

#: Alphabets up to here are sorted by buckets; the names of a reduced string are usually more than that.
BUCKETED = 1024


def smaller_type(t: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one.  The last symbol is the unique smallest."""
    n = len(t)
    differs = np.flatnonzero(t[1:] != t[:-1])
    nearest = differs[np.minimum(np.searchsorted(differs, np.arange(n - 1)), max(len(differs) - 1, 0))] if n > 1 else differs
    out = np.ones(n, bool)
    out[:-1] = t[nearest] < t[nearest + 1]
    return out


def _deal(found: np.ndarray, t: np.ndarray, queues: list[list[np.ndarray]]) -> None:
    """Append suffixes to the queues of their first symbols, order kept."""
    if not len(found):
        return
    symbol = t[found]
    order = np.argsort(symbol, kind="stable")
    found, symbol = found[order], symbol[order]
    cuts = np.flatnonzero(symbol[1:] != symbol[:-1]) + 1
    for part, s in zip(np.split(found, cuts), symbol[np.concatenate([[0], cuts])]):
        queues[s].append(part)


def _scan(symbols: range, queues: list[list[np.ndarray]], later: list[np.ndarray], t: np.ndarray, wanted: np.ndarray) -> list[np.ndarray]:
    """One inducing scan.  ``queues`` hold what is known to start each bucket, ``later[c]`` follows in bucket c; every entry
    puts its predecessor, where ``wanted``, behind its bucket's queue.  Returns the buckets without ``later``."""
    done: list[np.ndarray] = [np.zeros(0, np.int32)] * len(queues)
    for c in symbols:
        seen = []
        while queues[c]:
            wave = np.concatenate(queues[c])
            queues[c] = []
            seen.append(wave)
            before = wave[wave > 0] - 1
            _deal(before[wanted[before]], t, queues)
        if seen:
            done[c] = np.concatenate(seen)
        before = later[c][later[c] > 0] - 1
        _deal(before[wanted[before]], t, queues)
    return done


def induce(t: np.ndarray, k: int, smaller: np.ndarray, leftmost: np.ndarray) -> np.ndarray:
    """Suffix order induced from the given order of the leftmost smaller suffixes."""
    none = np.zeros(0, np.int32)
    starts: list[list[np.ndarray]] = [[] for _ in range(k)]
    _deal(leftmost, t, starts)
    larger = _scan(range(k), [[] for _ in range(k)], [p[0] if p else none for p in starts], t, ~smaller)
    end: list[list[np.ndarray]] = [[] for _ in range(k)]
    end[t[-1]] = [np.array([len(t) - 1], np.int32)]
    small = _scan(range(k - 1, -1, -1), end, [x[::-1] for x in larger], t, smaller)
    return np.concatenate([x for c in range(k) for x in (larger[c], small[c][::-1])])


def _names(t: np.ndarray, positions: np.ndarray, order: np.ndarray) -> tuple[np.ndarray, int]:
    """Number of each leftmost substring (in text order) among the distinct ones, and how many there are."""
    length = np.append(positions[1:] - positions[:-1] + 1, 1)
    rank = np.empty(len(t), np.int32)
    rank[positions] = np.arange(len(positions))
    size = length[rank[order]]
    same = size[1:] == size[:-1]
    left = np.flatnonzero(same)
    at = 0
    while len(left):
        equal = t[order[left] + at] == t[order[left + 1] + at]
        same[left[~equal]] = False
        at += 1
        left = left[equal & (size[left] > at)]
    name = np.concatenate([[0], np.cumsum(~same)])
    out = np.empty(len(positions), np.int32)
    out[rank[order]] = name
    return out, int(name[-1]) + 1


def doubled(t: np.ndarray) -> np.ndarray:
    """Suffix order by rank doubling (Manber and Myers): for alphabets too large to go through bucket by bucket."""
    rank, step, n = t.astype(np.int64), 1, len(t)
    while True:
        after = np.zeros(n, np.int64)
        after[:-step] = rank[step:] + 1
        key = rank * (n + 2) + after
        order = np.argsort(key)
        ordered = key[order]
        fresh = np.concatenate([[0], np.cumsum(ordered[1:] != ordered[:-1])])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1 or step >= n:
            return order.astype(np.int32)
        step *= 2


def suffix_array(t: np.ndarray, k: int) -> np.ndarray:
    """Positions of all suffixes of ``t`` (symbols below ``k``, the last one 0 and nowhere else) in order."""
    if k > BUCKETED:
        return doubled(t)
    smaller = smaller_type(t)
    first = np.zeros(len(t), bool)
    first[1:] = smaller[1:] & ~smaller[:-1]
    positions = np.flatnonzero(first).astype(np.int32)
    if len(positions) < 2:
        return induce(t, k, smaller, positions)
    roughly = induce(t, k, smaller, positions)
    names, count = _names(t, positions, roughly[first[roughly]])
    if count < len(positions):
        order = suffix_array(names.astype(np.uint16) if count <= BUCKETED else names, count)
    else:
        order = np.empty(count, np.int32)
        order[names] = np.arange(count, dtype=np.int32)
    return induce(t, k, smaller, positions[order])


def permuted_prefixes(t: np.ndarray, order: np.ndarray, borders: int) -> np.ndarray:
    """For each position, the common prefix with the suffix before it in order, not going over symbols <= ``borders``.

    Where the symbols before both suffixes agree, the value is that of the position before, less one; only the others
    (Kaerkkaeinen, Manzini, Puglisi, 2009) are compared, eight symbols at a time.
    """
    n = len(t)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    here = np.arange(n)
    compared = np.ones(n, bool)
    back = before[1:] - 1
    compared[1:] = (back < 0) | (before[1:] < 0) | (t[here[1:] - 1] != t[back]) | (t[here[1:] - 1] <= borders)
    starts = np.flatnonzero(compared)
    stop = np.where(t <= borders, here, n)
    stop = np.minimum.accumulate(stop[::-1])[::-1] - here  # symbols up to the next border
    low = np.concatenate([(t & 0xFF).astype(np.uint8), np.zeros(8, np.uint8)])
    words = np.lib.stride_tricks.sliding_window_view(low, 8)
    a, b = starts, before[starts]
    most = np.where(b < 0, 0, np.minimum(stop[a], stop[np.maximum(b, 0)]))
    value = np.zeros(len(a), np.int64)
    left = np.flatnonzero(most > 0)
    at = 0
    while len(left):
        x = np.ascontiguousarray(words[np.minimum(a[left] + at, n)]).view("<u8").ravel() ^ np.ascontiguousarray(words[np.minimum(b[left] + at, n)]).view("<u8").ravel()
        equal = x == 0
        low_bit = x & (~x + np.uint64(1))
        same = np.where(equal, 8, np.log2(np.where(equal, 1, low_bit).astype(np.float64)).astype(np.int64) // 8)
        value[left] += same
        at += 8
        left = left[equal & (most[left] > at)]
    value = np.minimum(value, most)
    full = np.zeros(n, np.int64)
    full[starts] = value + starts
    return np.maximum(np.maximum.accumulate(np.where(compared, full, 0)) - here, 0)
