"""Suffix and common-prefix arrays by external induced sorting.

Suffixes that are smaller than the one before them and not than the one after (LMS suffixes) are
sorted first; the rest follow by two scans. A scan takes the smallest (largest) known suffixes and
puts the suffixes that begin one symbol earlier into a queue, whose priority is the first symbol and
then the order of arrival. As that order is the sorted order of what induced it, all suffixes of one
symbol that are known when its turn comes are handled as one array. Each tuple carries its suffix and
the length of the prefix it shares with its predecessor in the queue; that length is one more than
the least length met since, by range minima over the scan.

Queues keep their arrays in memory up to a budget and beyond it in an unlinked temporary file; the
types, orders and names are memory-mapped where they are larger than the budget. LMS suffixes are
sorted by the same induction over their substrings and, where names repeat, by recursion on the string
of names. That has as many symbols as names, each of few suffixes, so a queue for each would be all
overhead: the recursion induces in rounds instead, all symbols at once, larger suffixes from the sorted
LMS ones and smaller from the larger, and goes on until names are distinct. Its arrays, of about a third
of the string's length, are in memory.
"""

from __future__ import annotations

import tempfile

import numpy as np

BUDGET, CAP = 1 << 20, 255


class Arrays:
    """Arrays of a given kind, in memory or, if large, in unlinked files."""

    def __init__(self, budget: int = BUDGET):
        self.budget = budget

    def zeros(self, n: int, kind) -> np.ndarray:
        if n * np.dtype(kind).itemsize <= self.budget:
            return np.zeros(n, kind)
        with tempfile.TemporaryFile() as f:
            return np.memmap(f, kind, "w+", shape=(n,))


class SymbolQueue:
    """A priority queue of (suffix, shared prefix) by first symbol, then arrival."""

    def __init__(self, budget: int = BUDGET):
        self.chunks: dict[int, list] = {}
        self.budget, self.held, self.file = budget, 0, None

    def push(self, symbol: np.ndarray, suffix: np.ndarray, shared: np.ndarray) -> None:
        """Rows of one symbol must lie together."""
        cuts = np.flatnonzero(np.diff(symbol)) + 1
        for a, b in zip([0, *cuts.tolist()], [*cuts.tolist(), len(symbol)], strict=True):
            self.chunks.setdefault(int(symbol[a]), []).append((suffix[a:b].copy(), shared[a:b].copy()))
        self.held += suffix.nbytes + shared.nbytes
        if self.held > self.budget:
            self._spill()

    def _spill(self) -> None:
        if self.file is None:
            self.file = tempfile.TemporaryFile()
        self.file.seek(0, 2)
        for chunks in self.chunks.values():
            for i, c in enumerate(chunks):
                if not isinstance(c[0], int):
                    chunks[i] = (self.file.tell(), len(c[0]), c[0].dtype, c[1].dtype)
                    self.file.write(c[0].tobytes())
                    self.file.write(c[1].tobytes())
        self.held = 0

    def pop(self, symbol: int) -> tuple[np.ndarray, np.ndarray] | None:
        """All that has arrived for the symbol, in order of arrival."""
        chunks = self.chunks.pop(symbol, None)
        if not chunks:
            return None
        out = []
        for c in chunks:
            if isinstance(c[0], int):
                at, n, a, b = c
                self.file.seek(at)
                out.append((np.frombuffer(self.file.read(n * a.itemsize), a), np.frombuffer(self.file.read(n * b.itemsize), b)))
            else:
                self.held -= c[0].nbytes + c[1].nbytes
                out.append(c)
        return np.concatenate([c[0] for c in out]), np.concatenate([c[1] for c in out])


class _Carry:
    """The least common prefix met in the scan since a symbol's last push."""

    def __init__(self, n_symbols: int):
        self.least = np.full(n_symbols, CAP, np.uint8)

    def shared(self, lcp: np.ndarray, at: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """lcp of a batch with its predecessors; elements `at` push to `symbol` (sorted by symbol, then
        place). Gives the least lcp since the last push to the same symbol, and moves on."""
        size = len(lcp)
        table = [lcp]
        while (1 << len(table)) <= size:
            half = 1 << (len(table) - 1)
            table.append(np.minimum(table[-1][:-half], table[-1][half:]))

        def least(a: np.ndarray, b: np.ndarray) -> np.ndarray:  # of lcp[a:b], CAP where empty
            out = np.full(len(a), CAP, np.uint8)
            length = b - a
            some = length > 0
            level = np.zeros(len(a), np.int64)
            level[some] = np.log2(length[some]).astype(np.int64)
            for k in np.unique(level[some]):
                m = some & (level == k)
                out[m] = np.minimum(table[k][a[m]], table[k][b[m] - (1 << int(k))])
            return out

        if len(at):
            first = np.ones(len(at), bool)
            first[1:] = symbol[1:] != symbol[:-1]
            begin = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]))
            out = least(begin, at + 1)
            out[first] = np.minimum(out[first], self.least[symbol[first]])
            last = np.concatenate([first[1:], [True]])
            after = least(at[last] + 1, np.full(int(last.sum()), size))
        if size:
            self.least = np.minimum(self.least, lcp.min())
        if not len(at):
            return np.zeros(0, np.uint8)
        self.least[symbol[last]] = after
        return out


def _types(s: np.ndarray, arrays: Arrays) -> np.ndarray:
    """True where a suffix is smaller than the next one; the last suffix counts as the larger."""
    n = len(s)
    small = arrays.zeros(n, bool)
    if n > 1:
        step = np.sign(s[1:].astype(np.int64) - s[:-1])
        place = np.where(step != 0, np.arange(n - 1), n)
        nxt = np.minimum.accumulate(place[::-1])[::-1]
        known = nxt < n
        small[:-1][known] = step[nxt[known]] > 0
    return small


def _runs(s: np.ndarray) -> np.ndarray:
    """How often the symbol at a place repeats from there on, CAP at most."""
    n = len(s)
    place = np.where(np.concatenate([s[1:] != s[:-1], [True]]), np.arange(n), n)
    end = np.minimum.accumulate(place[::-1])[::-1]
    return np.minimum(end - np.arange(n) + 1, CAP).astype(np.uint8)


def _induce(s, small, n_symbols, seeds, seed_lcp, arrays, lengths: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """The order of all suffixes, and the common prefixes of neighbours, from sorted LMS suffixes. With
    unsorted seeds, in order of their first symbols, it sorts the LMS substrings; `lengths` off then leaves
    the common prefixes at 1."""
    n = len(s)
    kind = np.int32 if n < 2**31 else np.int64
    run = _runs(s)
    seed_symbol = s[seeds]
    seed_at = np.searchsorted(seed_symbol, np.arange(n_symbols + 1))
    queue, carry = SymbolQueue(arrays.budget), _Carry(n_symbols)
    larges: list[list] = [[] for _ in range(n_symbols)]

    def scan(batch, lcp, wanted):
        """Push those predecessors of the batch whose type is `wanted`."""
        at = np.flatnonzero(batch > 0)
        before = batch[at] - 1
        ok = small[before] == wanted
        at, before = at[ok], before[ok]
        symbol = s[before]
        order = np.argsort(symbol, kind="stable")
        at, before, symbol = at[order], before[order], symbol[order]
        if not lengths:
            shared = np.zeros(len(at), np.uint8)
        else:
            shared = carry.shared(lcp, at, symbol)
        if len(at):
            queue.push(symbol, before, (np.minimum(shared, CAP - 1) + 1).astype(np.uint8))

    # the last suffix is larger than the empty one, which comes before all
    queue.push(s[n - 1 : n], np.array([n - 1], kind), np.zeros(1, np.uint8))
    carry.least[:] = 0
    for c in range(n_symbols):
        first, last = True, None
        while (got := queue.pop(c)) is not None:
            batch, lcp = got
            if first:
                lcp = lcp.copy()
                lcp[0] = 0
            larges[c].append((batch, lcp))
            first, last = False, batch[-1]
            scan(batch, lcp, False)
        a, b = seed_at[c], seed_at[c + 1]
        if b > a:
            lcp = seed_lcp[a:b].copy()
            lcp[0] = 0 if last is None else min(run[last], run[seeds[a]])
            scan(seeds[a:b], lcp, False)

    order, common = arrays.zeros(n, kind), arrays.zeros(n, np.uint8)
    queue, carry = SymbolQueue(arrays.budget), _Carry(n_symbols)
    carry.least[:] = 0
    end = n
    gap = np.zeros(1, np.uint8)  # between what was taken last and what comes next, going down
    for c in range(n_symbols - 1, -1, -1):
        smalls = []
        gap[:] = 0
        first = None
        while (got := queue.pop(c)) is not None:
            batch, lcp = got  # shared with the predecessor in the queue, which is the larger neighbour
            lcp = lcp.copy()
            if first is None:
                lcp[0] = 0
            first = batch[-1]
            smalls.append((batch, lcp))
            scan(batch, lcp, True)
        if larges[c]:
            batch = np.concatenate([x[0] for x in larges[c]])
            lcp = np.concatenate([x[1] for x in larges[c]])
            down = np.concatenate([[0 if first is None else min(run[first], run[batch[-1]])], lcp[1:][::-1]]).astype(np.uint8)
            scan(batch[::-1], down, True)
        if smalls:
            batch_s = np.concatenate([x[0] for x in smalls])
            lcp_s = np.concatenate([x[1] for x in smalls])
            k = len(batch_s)
            order[end - k : end] = batch_s[::-1]
            # lcp_s[i] is shared by the i-th and the (i-1)-th from the end
            common[end - k + 1 : end] = lcp_s[1:][::-1]
            common[end - k] = min(run[first], run[larges[c][-1][0][-1]]) if larges[c] else 0
            end -= k
        if larges[c]:
            k = len(batch)
            order[end - k : end] = batch
            common[end - k : end] = lcp
            end -= k
        larges[c] = []
    return order, common


def _common(s: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The lengths of the common prefixes of suffixes a[i] and b[i], CAP at most."""
    out = np.zeros(len(a), np.uint8)
    live = np.arange(len(a))
    n = len(s)
    for k in range(CAP):
        live = live[(a[live] + k < n) & (b[live] + k < n)]
        live = live[s[a[live] + k] == s[b[live] + k]]
        if not len(live):
            break
        out[live] = k + 1
    return out


def _chains(value: np.ndarray, last: np.ndarray) -> np.ndarray:
    """Ranks of positions by the values along their chains: each goes on to the next position until it comes
    to one that is `last`. Equal chains get equal ranks. Chains are joined in rounds of twice the length."""
    n = len(value)
    rank = np.unique(value, return_inverse=True)[1].astype(np.int64)
    onward = np.where(last, np.arange(n), np.arange(1, n + 1))
    while (live := ~last[onward] | (onward > np.arange(n))).any():
        key = rank * (n + 1) + np.where(live, rank[onward] + 1, 0)
        order = np.argsort(key)  # equal keys get equal ranks, whatever their order
        fresh = np.concatenate([[0], np.cumsum(np.diff(key[order]) != 0)])
        rank = np.empty(n, np.int64)
        rank[order] = fresh
        done = last[onward]
        last = last | done  # what follows is in the rank
        onward = np.where(done, np.arange(n), onward[onward])
    return rank


def _induced(s: np.ndarray, small: np.ndarray, lms: np.ndarray, seeds: np.ndarray) -> np.ndarray:
    """Ranks of all suffixes from those of the LMS suffixes: larger ones from what follows them, then smaller
    ones from the larger. With equal seeds the ranks of LMS suffixes are those of their substrings."""
    n = len(s)
    most = int(seeds.max()) + 2 if len(seeds) else 1
    # one position more: the empty suffix, before all
    value = np.append(s.astype(np.int64) * most, -1)
    last = np.zeros(n + 1, bool)
    value[lms] += seeds + 1
    last[lms] = last[n] = True
    first = small.copy()
    first[lms] = False
    value[:n][first] = -1  # smaller suffixes that no larger one precedes lie on no chain of these
    last[:n][first] = True
    large = _chains(value, last)
    most = n + 2
    value = np.append(s.astype(np.int64) * most, -1)
    value[:n][~small] += large[:n][~small]
    value[:n][small] += n + 1  # a smaller suffix follows the larger ones of its symbol
    return _chains(value, np.append(~small, True))[:n]


def order_of(s: np.ndarray) -> np.ndarray:
    """The suffixes of a string of any number of symbols in order, by recursive induction in rounds."""
    n = len(s)
    small = _types(s, Arrays())
    lms = np.flatnonzero(small[1:] & ~small[:-1]) + 1
    seeds = np.zeros(len(lms), np.int64)
    if len(lms) > 1:
        seeds = np.unique(_induced(s, small, lms, seeds)[lms], return_inverse=True)[1].astype(np.int64)
        if seeds.max() + 1 < len(lms):
            seeds[order_of(seeds)] = np.arange(len(lms))
    out = np.empty(n, np.int64)
    out[_induced(s, small, lms, seeds) - 1] = np.arange(n)  # the empty suffix has rank 0
    return out


def sort_suffixes(s: np.ndarray, n_symbols: int, budget: int = BUDGET) -> tuple[np.ndarray, np.ndarray]:
    """(order, common): the suffixes of s in order, and the length (CAP at most) of the prefix that each
    shares with the one before it. Symbols are 0 to n_symbols - 1."""
    arrays = Arrays(budget)
    n = len(s)
    if n == 0:
        return np.zeros(0, np.int32), np.zeros(0, np.uint8)
    kind = np.int32 if n < 2**31 else np.int64
    small = _types(s, arrays)
    lms = (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(kind)
    if len(lms):
        rough = lms[np.argsort(s[lms], kind="stable")]
        order, _ = _induce(s, small, n_symbols, rough, np.zeros(len(rough), np.uint8), arrays, lengths=False)
        is_lms = arrays.zeros(n, bool)
        is_lms[lms] = True
        found = order[is_lms[order]]
        name = arrays.zeros(n, np.int64)
        ends = np.append(lms[1:], n - 1)
        length = arrays.zeros(n, np.int64)
        length[lms] = ends - lms + 1
        name[found] = np.concatenate([[0], np.cumsum(_differ(s, found, length, n))])
        names = name[lms]
        if names.max() + 1 < len(lms):
            found = lms[order_of(np.asarray(names))]
        seed_lcp = np.concatenate([[0], _common(s, found[:-1], found[1:])]).astype(np.uint8)
    else:
        found, seed_lcp = lms, np.zeros(0, np.uint8)
    return _induce(s, small, n_symbols, found, seed_lcp, arrays)


def _differ(s: np.ndarray, found: np.ndarray, length: np.ndarray, n: int) -> np.ndarray:
    """Whether each LMS substring differs from the one before it in `found`."""
    a, b = found[:-1].astype(np.int64), found[1:].astype(np.int64)
    out = length[a] != length[b]
    live = np.flatnonzero(~out)
    k = 0
    while len(live):
        live = live[k < length[a[live]]]
        other = s[a[live] + k] != s[b[live] + k]
        out[live[other]] = True
        live = live[~other]
        k += 1
    return out
