"""Jaccard similarity join of n-gram sets by prefix trees.

A text's set holds the hashes of its distinct word 5-grams. One pass over all texts makes each set's
digest, a frequency sketch and a filter of repeated grams (those that several documents of one chunk
hold), both of fixed size; equal sets count once from there on. The order of grams is by whether the
filter has them, by the sketch's frequency class, rare first, and then by hash: any function of the
gram would do for exact results, and rare grams first keep shared passages out of the prefixes.

Two sets of similarity 0.8 share at least COMMON grams within their first n - ceil(0.8 n) + COMMON.
Only those grams are dealt out, sorted by gram. Groups of up to SMALL sets give their pairs, counted
for each pair; larger groups are `hot`: they give pairs with one pivot for each gram, first the set
with most hot grams and then others, and components of verified links then settle most of their
members. Hot groups that still hold several components make families, by way of the components that
they join. A family is dealt out in tiles of whole sets, by length and hash: the sets outside a main
component walk the prefix tree of the family's sets. No pair leaves a tile unless it joins two
components, so what a hot group sends is proportional to its members.

In a block or tile the members are stored in a prefix tree in the global order. Sets walk the tree once
for all members that share a beginning, and a subtree is left as soon as the overlap so far and the
lengths that remain can't reach the threshold.

Defined results: text with fewer words than a gram has its whole word sequence as the one gram; null
or wordless text has an empty set, links with nothing and is its own component. Texts are read whole,
however long. Rows that repeat a doc_id are one document with several sets: what is linked to either is
in one component. Sets that only rows without a doc_id have are not linked; such a row has a null
component_id unless an equal set has one. An empty table gives no rows; columns other than doc_id and
text are not read. Sets are told apart by 64 bits of their digest.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, spread, stored
from .components import components

GRAM, NUM, DEN = 5, 80, 100
SKETCH_BITS, SKETCH_ROWS, FILTER_BITS = 20, 64, 26
COMMON, SMALL, ROUNDS = 12, 32, 2
WORDS_KEPT, PAIRS_KEPT, BLOCK, DENSE, COUNTED, SEEN = 150_000, 120_000, 256, 32, 2_000_000, 300_000
#: Grams of a side of a tile; cells of a tile's tables; most grams that one step of a walk goes down.
TILE, CELLS, STEP = 200_000, 400_000, 32
#: Odd multipliers of the hash of a word sequence.
MULTIPLIER, MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)
LEVEL_BITS = 7


class Shingler:
    def __init__(self, gram: int = GRAM):
        self.gram, self.words = gram, {}

    def hashes(self, text: str | None) -> np.ndarray:
        """The sorted distinct hashes of a text's grams."""
        words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
        if not words:
            return np.zeros(0, np.uint64)
        known = self.words
        if len(known) > WORDS_KEPT:
            known.clear()
        for w in set(words).difference(known):
            known[w] = xxhash.xxh3_64_intdigest(w)
        codes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
        size = min(self.gram, len(words))
        out = np.full(len(words) - size + 1, size, np.uint64)
        for k in range(size):
            out = out * MULTIPLIER + codes[k : len(codes) - size + 1 + k]
        out ^= out >> np.uint64(31)
        out *= MIX
        out ^= out >> np.uint64(29)
        return np.unique(out)


def set_id(hashes: np.ndarray) -> int:
    return int.from_bytes(hashlib.blake2b(hashes.tobytes(), digest_size=8).digest(), "little", signed=True)


def least_overlap(n: int) -> int:
    """The least number of grams that a set of n shares with any set of similarity NUM / DEN."""
    return -(-NUM * n // DEN)


def _survey(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n, sid) of all documents; for each task rows (slot, counts) of its sketch; and rows
    (slot below 0, counts) of the places in the filter that its repeated grams take."""
    slots = (1 << SKETCH_BITS) // SKETCH_ROWS
    repeated: list[np.ndarray] = []

    def tally(held: list[np.ndarray], counts: np.ndarray) -> None:
        h = np.concatenate(held)
        counts += np.bincount((h & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64), minlength=len(counts)).astype(np.uint32)
        h.sort()
        twice = h[1:] == h[:-1]
        repeated.append(np.unique((h[1:][twice] >> np.uint64(64 - FILTER_BITS)).astype(np.uint32)))

    def run(batches):
        shingler, counts = Shingler(), np.zeros(1 << SKETCH_BITS, np.uint32)
        seen: set[int] = set()  # equal sets are tallied once
        held: list[np.ndarray] = []
        size = 0
        repeated.clear()
        names = ["doc_id", "n", "sid", "slot", "counts"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()]
        for batch in batches:
            n, sid = [], []
            for text in batch.column(1):
                h = shingler.hashes(text.as_py())
                n.append(len(h))
                sid.append(set_id(h) if len(h) else None)
                if len(h) and sid[-1] not in seen:
                    if len(seen) > SEEN:
                        seen.clear()
                    seen.add(sid[-1])
                    held.append(h)
                    size += len(h)
                if size > COUNTED:
                    tally(held, counts)
                    held, size = [], 0
            rows = batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, kinds[1]), pa.array(sid, kinds[2]), pa.nulls(rows, kinds[3]), pa.nulls(rows, kinds[4])], names)
        if held:
            tally(held, counts)
        if counts.any():
            places = np.unique(np.concatenate(repeated))
            cuts = np.searchsorted(places, np.arange(SKETCH_ROWS + 1, dtype=np.uint64) << np.uint64(FILTER_BITS - 6))
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SKETCH_ROWS, k) for k in kinds[:3]), pa.array([-1 - i for i in range(SKETCH_ROWS)], kinds[3]), pa.array([places[cuts[i] : cuts[i + 1]].tobytes() for i in range(SKETCH_ROWS)], kinds[4])], names)
            yield pa.RecordBatch.from_arrays([*(pa.nulls(SKETCH_ROWS, k) for k in kinds[:3]), pa.array(range(SKETCH_ROWS), kinds[3]), pa.array([counts[i * slots : (i + 1) * slots].tobytes() for i in range(SKETCH_ROWS)], kinds[4])], names)

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, "doc_id long, n long, sid long, slot int, counts binary")


def _levels(survey: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The frequency class of each slot of the sketch, and the filter as packed bits: 2 ** SKETCH_BITS and
    2 ** FILTER_BITS / 8 bytes, whatever the input."""
    part = (1 << FILTER_BITS) // SKETCH_ROWS

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        slot = int(pdf["slot"].iloc[0])
        if slot >= 0:
            total = sum(np.frombuffer(c, np.uint32).astype(np.uint64) for c in pdf["counts"])
        else:
            total = np.zeros(part, bool)
            for c in pdf["counts"]:
                total[np.frombuffer(c, np.uint32) - np.uint32((-1 - slot) * part)] = True
            total = np.packbits(total)
        return pd.DataFrame({"slot": [slot], "counts": [total.tobytes()]})

    rows = survey.where("slot is not null").select("slot", "counts").groupBy("slot").applyInPandas(add, "slot int, counts binary").collect()
    if not rows:
        return np.zeros(1 << SKETCH_BITS, np.uint8), np.zeros((1 << FILTER_BITS) // 8, np.uint8)
    counts = np.concatenate([np.frombuffer(r["counts"], np.uint64) for r in sorted(rows, key=lambda r: r["slot"]) if r["slot"] >= 0])
    repeated = np.concatenate([np.frombuffer(r["counts"], np.uint8) for r in sorted(rows, key=lambda r: -r["slot"]) if r["slot"] < 0])
    # a slot counts as rare up to four standard deviations of what chance puts there; classes above double
    mean = counts.mean()
    over = (counts - mean) / (4 * np.sqrt(mean + 1))
    level = np.where(over < 1, 0, np.clip(1 + np.floor(2 * np.log2(np.maximum(over, 1))), 1, (1 << LEVEL_BITS - 1) - 1)).astype(np.uint8)
    return level, repeated


def ordered(hashes: np.ndarray, levels: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """The set in the global order, as numbers that sort so."""
    place = (hashes >> np.uint64(64 - FILTER_BITS)).astype(np.int64)
    repeated = (levels[1][place >> 3] >> (7 - (place & 7)).astype(np.uint8)) & 1
    level = levels[0][(hashes & np.uint64((1 << SKETCH_BITS) - 1)).astype(np.int64)]
    level = (level + (repeated << np.uint8(LEVEL_BITS - 1))).astype(np.uint64)
    return np.sort(level << np.uint64(64 - LEVEL_BITS) | hashes >> np.uint64(LEVEL_BITS))


def _prefixes(docs: DataFrame, levels) -> DataFrame:
    """gram, sid, n: the first grams of each set; a task gives equal sets once."""

    def run(batches):
        shingler, seen = Shingler(), set()
        for batch in batches:
            grams, sids, sizes = [], [], []
            for text in batch.column(0):
                h = shingler.hashes(text.as_py())
                if not len(h) or (sid := set_id(h)) in seen:
                    continue
                if len(seen) > SEEN:
                    seen.clear()
                seen.add(sid)
                least = least_overlap(len(h))
                own = ordered(h, levels.value)[: len(h) - least + min(COMMON, least)]
                grams.append(own)
                sids.append(np.full(len(own), sid, np.int64))
                sizes.append(np.full(len(own), len(h), np.int32))
                if sum(map(len, grams)) > 100_000:
                    yield _rows(grams, sids, sizes)
                    grams, sids, sizes = [], [], []
            if grams:
                yield _rows(grams, sids, sizes)

    return docs.select("text").mapInArrow(run, "gram long, sid long, n int")


def _rows(grams, sids, sizes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.concatenate(grams).view(np.int64)), pa.array(np.concatenate(sids)), pa.array(np.concatenate(sizes))], ["gram", "sid", "n"])


def _needed(n: int, m: int) -> int:
    return min(COMMON, least_overlap(n), least_overlap(m))


def _meet(prefixes: DataFrame) -> DataFrame:
    """From grams that several sets share: (a, b, n_a, n_b, shared) of small groups, partly counted, and
    (gram, a, n_a) of hot ones. Groups stream by in gram order; no group is held whole."""
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64()]
    names = ["gram", "a", "b", "n_a", "n_b", "shared"]

    def run(batches):
        pairs: dict[tuple, int] = {}
        group: list[tuple[int, int]] = []  # the open group, until it proves hot
        gram, hot, last = None, False, None
        cells: list[tuple] = []

        def close():
            if not hot and len(group) > 1:
                for i, (a, n) in enumerate(group):
                    for b, m in group[i + 1 :]:
                        if DEN * min(n, m) >= NUM * max(n, m):
                            key = (a, b, n, m)
                            pairs[key] = pairs.get(key, 0) + 1

        def flush():
            rows = [(None, a, b, n, m, c) for (a, b, n, m), c in pairs.items()] + cells
            pairs.clear()
            cells.clear()
            for at in range(0, len(rows), 50_000):
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows[at : at + 50_000], strict=True), kinds, strict=True)], names)

        for batch in batches:
            g, s, n = (np.asarray(batch.column(i)) for i in range(3))
            # rows whose neighbours have other grams are alone
            same = np.zeros(len(g) + 1, bool)
            same[1:-1] = g[1:] == g[:-1]
            keep = same[:-1] | same[1:]
            keep[0] = keep[-1] = True
            for gi, si, ni in zip(g[keep].tolist(), s[keep].tolist(), n[keep].tolist(), strict=True):
                if gi != gram:
                    close()
                    gram, hot, last = gi, False, None
                    group.clear()
                if si == last:
                    continue
                last = si
                if hot:
                    cells.append((gi, si, None, ni, None, None))
                    continue
                group.append((si, ni))
                if len(group) > SMALL:
                    hot = True
                    cells.extend((gi, a, None, m, None, None) for a, m in group)
                    group.clear()
            if len(pairs) + len(cells) > PAIRS_KEPT:
                yield from flush()
        close()
        yield from flush()

    sorted_ = prefixes.repartition("gram").sortWithinPartitions("gram", "sid")
    return sorted_.mapInArrow(run, "gram long, a long, b long, n_a int, n_b int, shared long")


def walk_tree(members: list[np.ndarray], next_common: np.ndarray, probe: np.ndarray) -> list[int]:
    """Indices of the members similar to probe. members: in lexicographic order; next_common[i]: length of
    the common beginning of members i and i + 1. The range of members below a node stands for the node."""
    found: list[int] = []
    n = len(probe)
    stack = [(0, len(members), 0, 0, 0)]  # members from, to; depth; overlap so far; place in probe
    while stack:
        lo, hi, depth, overlap, place = stack.pop()
        sizes = [len(m) for m in members[lo:hi]] if hi - lo > 1 else [len(members[lo])]
        least = -(-NUM * (n + min(sizes)) // (NUM + DEN))
        if overlap + min(max(sizes) - depth, n - place) < least:
            continue
        end = int(next_common[lo : hi - 1].min()) if hi - lo > 1 else len(members[lo])
        segment = members[lo]
        while depth < end:
            part = segment[depth : min(end, depth + 64)]
            at = np.searchsorted(probe[place:], part) + place
            overlap += int((probe[np.minimum(at, n - 1)] == part).sum())
            depth += len(part)
            place = int(np.searchsorted(probe, part[-1], side="right"))
            if overlap + min(max(sizes) - depth, n - place) < least:
                break
        else:
            begin = lo
            while begin < hi and len(members[begin]) == depth:  # members that end here
                if (NUM + DEN) * overlap >= NUM * (n + depth):
                    found.append(begin)
                begin += 1
            if begin < hi:  # children differ in their next gram
                cuts = [i + 1 for i in range(begin, hi - 1) if next_common[i] <= depth]
                stack += [(a, b, depth, overlap, place) for a, b in zip([begin, *cuts], [*cuts, hi], strict=True)]
    return found


def lexicographic(sets: list[np.ndarray]) -> tuple[list[int], np.ndarray]:
    """The order of sets by their grams, and the common beginning of each set with the next."""
    order = sorted(range(len(sets)), key=lambda i: sets[i].astype(">u8").tobytes())
    common = np.zeros(max(0, len(order) - 1), np.int64)
    for i in range(len(common)):
        a, b = sets[order[i]], sets[order[i + 1]]
        m = min(len(a), len(b))
        differ = np.flatnonzero(a[:m] != b[:m])
        common[i] = differ[0] if len(differ) else m
    return order, common


def tree_join(sets: dict[int, np.ndarray], wanted: dict[int, set[int]]) -> list[tuple[int, int]]:
    """The pairs (a, b) of wanted[a] that are similar. One tree holds all sets; a walk sees the branches
    that lead to wanted ones."""
    links = []
    names = list(sets)
    order, common = lexicographic([sets[s] for s in names])
    place = {names[i]: k for k, i in enumerate(order)}
    for a, others in wanted.items():
        if a not in sets:  # a set of rows without a doc_id only
            continue
        at = sorted(place[b] for b in others if b in place)
        if at:
            between = np.array([common[x:y].min() for x, y in zip(at, at[1:], strict=False)], np.int64)
            members = [sets[names[order[k]]] for k in at]
            links += [(a, names[order[at[i]]]) for i in walk_tree(members, between, sets[a])]
    return links


class Tree:
    """Sets as a prefix tree that many sets walk at once. A node at depth d is the range of sets, in
    lexicographic order, that share their first d grams; the range's first set stands for it."""

    def __init__(self, sets: list[np.ndarray]):
        order, common = lexicographic(sets)
        self.order = np.array(order, np.int64)
        self.sizes = np.array([len(sets[i]) for i in order], np.int64)
        self.begin = np.cumsum(self.sizes) - self.sizes
        self.grams = np.concatenate([sets[i] for i in order])
        self.before = np.append(-1, common)  # common beginning with the set before
        ends = np.unique(np.concatenate([common, self.sizes]))
        steps = [np.arange(a + STEP, b, STEP) for a, b in zip([0, *ends.tolist()], ends.tolist(), strict=False) if b - a > STEP]
        self.depths = np.unique(np.concatenate([ends, *steps]))
        self.depths = self.depths[self.depths > 0]

    def walk(self, probes: list[np.ndarray], wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(i, j): probes[i] is similar to the j-th set given, and wanted[i, j]."""
        wanted = wanted[:, self.order]
        n = np.array([len(p) for p in probes], np.int64)
        grams = np.unique(np.concatenate(probes))
        column = np.searchsorted(grams, self.grams)
        known = grams[np.minimum(column, len(grams) - 1)] == self.grams
        passed_at = column + known
        column = np.where(known, column, len(grams))
        holds = np.zeros((len(probes), len(grams) + 1), bool)
        for i, p in enumerate(probes):
            holds[i, np.searchsorted(grams, p)] = True
        passed = np.zeros((len(probes), len(grams) + 1), np.int32)  # a probe's grams that lie before a column
        np.cumsum(holds[:, :-1], axis=1, out=passed[:, 1:])
        asked = np.zeros((len(probes), len(self.sizes) + 1), np.int32)
        np.cumsum(wanted, axis=1, out=asked[:, 1:])
        found_p, found_s = [], []
        probe, node, overlap, place = np.arange(len(probes)), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64), np.zeros(len(probes), np.int64)
        depth, stop = 0, np.array([len(self.sizes)])
        starts = np.zeros(1, np.int64)
        for deeper in self.depths.tolist():
            stops = stop[np.searchsorted(starts, node)]
            starts = np.flatnonzero(self.before < deeper)
            stop = np.append(starts[1:], len(self.sizes))
            low, high = np.minimum.reduceat(self.sizes, starts), np.maximum.reduceat(self.sizes, starts)
            live = self.sizes[starts] >= deeper
            nodes, node_stop, low, high = starts[live], stop[live], low[live], high[live]
            first, count = np.searchsorted(nodes, node), np.searchsorted(nodes, stops)
            count -= first
            probe, overlap, place = np.repeat(probe, count), np.repeat(overlap, count), np.repeat(place, count)
            k = np.repeat(first, count) + np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
            least = -(-NUM * (n[probe] + low[k]) // (NUM + DEN))
            keep = (asked[probe, node_stop[k]] > asked[probe, nodes[k]]) & (overlap + np.minimum(high[k] - depth, n[probe] - place) >= least)
            probe, overlap, k, least = probe[keep], overlap[keep], k[keep], least[keep]
            node = nodes[k]
            at = self.begin[node] + depth
            down = np.arange(deeper - depth)
            for x in range(0, len(at), max(1, CELLS // len(down))):
                part = slice(x, x + max(1, CELLS // len(down)))
                overlap[part] += holds[probe[part, None], column[at[part, None] + down]].sum(axis=1)
            place = passed[probe, passed_at[at + (deeper - depth - 1)]].astype(np.int64)
            keep = overlap + np.minimum(high[k] - deeper, n[probe] - place) >= least
            probe, node, overlap, place = probe[keep], node[keep], overlap[keep], place[keep]
            if not len(probe):
                break
            depth = deeper
            done = (self.sizes[node] == depth) & ((NUM + DEN) * overlap >= NUM * (n[probe] + depth)) & wanted[probe, node]
            found_p.append(probe[done])
            found_s.append(self.order[node[done]])
        return np.concatenate([np.zeros(0, np.int64), *found_p]), np.concatenate([np.zeros(0, np.int64), *found_s])


def joined_classes(sets: list[np.ndarray], classes: list[int], probes: list[int]) -> list[tuple[int, int]]:
    """Pairs (i, j) of similar sets, i among probes, that join the sets' classes as far as such pairs do."""
    tree, kind = Tree(sets), np.array(classes, np.int64)
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = y
        return x

    links, at = [], 0
    while at < len(probes):
        width, k = 0, 0
        while at + k < len(probes) and (k == 0 or (k + 1) * max(width + len(sets[probes[at + k]]), len(sets)) <= CELLS):
            width += len(sets[probes[at + k]])
            k += 1
        part = probes[at : at + k]
        own = np.array([find(x) for x in kind.tolist()], np.int64)  # classes joined so far are one
        i, j = tree.walk([sets[p] for p in part], own[part][:, None] != own[None, :])
        for x, y in zip(i.tolist(), j.tolist(), strict=True):
            a, b = find(int(kind[part[x]])), find(int(kind[y]))
            if a != b:
                root[max(a, b)] = min(a, b)
                links.append((part[x], y))
        at += k
    return links


def _sets(docs: DataFrame, wanted: DataFrame, levels) -> DataFrame:
    """sid, grams for the documents in wanted (doc_id, sid)."""

    def run(batches):
        shingler = Shingler()
        for batch in batches:
            sids, grams = [], []
            for sid, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                h = shingler.hashes(text.as_py())
                if len(h) and set_id(h) == sid:  # else another text of the same doc_id
                    sids.append(sid)
                    grams.append(ordered(h, levels.value).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(sids, pa.int64()), pa.array(grams, pa.binary())], ["sid", "grams"])

    chosen = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(wanted.hint("merge"), "doc_id").select("sid", "text")
    return chosen.mapInArrow(run, "sid long, grams binary")  # repeated rows give a set again


def _verified(edges: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b) of edges whose sets are similar. A block gets all edges of some sets `a`; those of sets with many
    edges are dealt in tiles of sets by sets, so that each set goes to few blocks."""
    n = edges.count()
    blocks = max(128, -(-n // BLOCK))
    degree = stored(edges.groupBy("a").agg(F.count(F.lit(1)).alias("degree")), "degrees")
    rows = edges.join(degree, "a")
    dense = F.col("degree") > DENSE
    nodes = rows.where(dense).select("b").union(degree.where(dense).select("a")).distinct().count()
    tiles = F.lit(-(-nodes // (BLOCK // 2)) or 1)
    tile = F.xxhash64(F.pmod(F.xxhash64("a"), tiles), F.pmod(F.xxhash64("b"), tiles), F.lit(1))
    dealt = rows.withColumn("block", F.when(dense, tile).otherwise(F.pmod(F.xxhash64("a"), F.lit(blocks))))
    dealt = stored(dealt.select("a", "b", "block"), "edges")
    asked = dealt.select("block", F.col("a").alias("sid")).union(dealt.select("block", F.col("b").alias("sid"))).distinct()
    have = asked.join(sets, "sid").select("block", "sid", F.lit(None).cast("long").alias("b"), "grams")
    want = dealt.select("block", F.col("a").alias("sid"), "b", F.lit(None).cast("binary").alias("grams"))

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        has = pdf["grams"].notna()
        held = {int(s): np.frombuffer(g, np.uint64) for s, g in zip(pdf.loc[has, "sid"], pdf.loc[has, "grams"], strict=True)}
        wanted: dict[int, set[int]] = {}
        for a, b in zip(pdf.loc[~has, "sid"].astype("int64"), pdf.loc[~has, "b"].astype("int64"), strict=True):
            wanted.setdefault(int(a), set()).add(int(b))
        links = tree_join(held, wanted)
        return pd.DataFrame({"a": np.array([x for x, _ in links], np.int64), "b": np.array([x for _, x in links], np.int64)})

    # 64-bit ids beside nulls would pass through floating point: the two kinds of rows come as strings
    rows = have.unionByName(want).withColumn("sid", F.col("sid").cast("string")).withColumn("b", F.col("b").cast("string"))
    return rows.groupBy("block").applyInPandas(join, "a long, b long")


def _families(cells: DataFrame, roots: DataFrame) -> DataFrame | None:
    """sid, n, root, outside, family of the sets that hot groups leave in several components. A pair that
    small groups count is a candidate already, so others share all their grams in hot groups."""
    group = cells.join(roots, cells["sid"] == roots["node"], "left").select("gram", "sid", "n", F.coalesce("root", "sid").alias("root"))
    classes = group.groupBy("gram", "root").agg(F.count(F.lit(1)).alias("m"))
    main = classes.groupBy("gram").agg(F.max_by("root", F.struct("m", "root")).alias("main"), F.count(F.lit(1)).alias("classes")).where("classes > 1")
    group = group.join(main.drop("classes"), "gram")
    # the least number of grams that a set shares with any similar one
    least = F.least(F.lit(COMMON), F.ceil(F.ceil(F.col("n") * NUM / DEN) * NUM / DEN))
    members = group.groupBy("sid", "n", "root").agg(F.count(F.lit(1)).alias("hot"), F.max(F.col("root") != F.col("main")).alias("outside")).where(F.col("hot") >= least)
    members = stored(members, "unsettled")
    if not members.where("outside").take(1):
        return None
    pairs = stored(group.where("root <> main").select(F.col("main").alias("a"), F.col("root").alias("b")).distinct(), "family-links")
    family = components(pairs).select(F.col("node").alias("root"), F.col("root").alias("family"))
    return stored(members.select("sid", "n", "root", "outside").join(family, "root"), "families")


def _tiled(families: DataFrame, sets: DataFrame) -> DataFrame:
    """(root_a, root_b): components of a family that hold similar sets."""
    # lengths of similar sets differ by a quarter, so they lie in one band or two neighbouring ones
    placed = families.withColumn("band", F.floor(F.log("n") / F.lit(float(np.log(1.26)))).cast("int"))
    total = placed.groupBy("family", "band").agg(
        F.ceil(F.sum("n") / TILE).cast("int").alias("rows"), F.ceil(F.sum(F.when(F.col("outside"), F.col("n")).otherwise(0)) / TILE).cast("int").alias("columns"))
    total = stored(total, "bands")
    near = F.explode(F.array(*(F.col("band") + F.lit(k) for k in (-1, 0, 1))))
    probes = placed.where("outside").join(total.select("family", "band", "columns"), ["family", "band"]).select("sid", "root", "family", F.col("band").alias("of"), F.pmod(F.xxhash64("sid"), "columns").alias("column"), near.alias("band"))
    probes = probes.join(total.select("family", "band", "rows"), ["family", "band"]).withColumn("row", F.explode(F.sequence(F.lit(0), F.col("rows") - 1)))
    members = placed.join(total.select("family", "band", "rows"), ["family", "band"]).select("sid", "root", "family", "band", F.pmod(F.xxhash64("sid", F.lit(1)), "rows").alias("row"), near.alias("of"))
    members = members.join(total.where("columns > 0").select("family", F.col("band").alias("of"), "columns"), ["family", "of"]).withColumn("column", F.explode(F.sequence(F.lit(0), F.col("columns") - 1)))
    tile = F.xxhash64("family", "of", "band", F.col("row").cast("int"), F.col("column").cast("int"))
    rows = probes.select(tile.alias("tile"), "sid", "root", F.lit(True).alias("probe")).unionByName(members.select(tile.alias("tile"), "sid", "root", F.lit(False).alias("probe")))
    rows = rows.groupBy("tile", "sid", "root").agg(F.max("probe").alias("probe")).join(sets, "sid")

    def join(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.drop_duplicates("sid")
        roots = pdf["root"].tolist()
        links = joined_classes([np.frombuffer(g, np.uint64) for g in pdf["grams"]], roots, np.flatnonzero(pdf["probe"].to_numpy(bool)).tolist())
        return pd.DataFrame({"a": np.array([roots[x] for x, _ in links], np.int64), "b": np.array([roots[x] for _, x in links], np.int64)})

    return rows.groupBy("tile").applyInPandas(join, "a long, b long")


def link(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame | None]:
    """(doc_id, n, sid) of all documents; (node, root), the components of verified links between their
    sets; and the same again between those components, where hot groups had left some apart."""
    docs = spread(docs.select("doc_id", "text"))
    survey = stored(_survey(docs), "survey")
    levels = spark.sparkContext.broadcast(_levels(survey))
    own = survey.where("slot is null").select("doc_id", "n", "sid")
    met = stored(_meet(_prefixes(docs, levels)), "met")
    cells = met.where("gram is not null").select("gram", F.col("a").alias("sid"), F.col("n_a").alias("n"))
    hot_of = stored(cells.groupBy("sid").agg(F.count(F.lit(1)).alias("hot")), "hot-counts")
    counted = cells.join(hot_of, "sid")

    def least(n: str):
        return F.ceil(F.col(n) * NUM / DEN)

    pairs = met.where("gram is null").groupBy("a", "b", "n_a", "n_b").agg(F.sum("shared").alias("shared"))
    needed = F.least(F.lit(COMMON), least("n_a"), least("n_b"))
    sure = pairs.where(F.col("shared") >= needed)
    open_ = pairs.where(F.col("shared") < needed)
    # a pair that shares fewer grams of small groups may share the rest in hot ones
    open_ = open_.join(hot_of.withColumnsRenamed({"sid": "a", "hot": "hot_a"}), "a").join(hot_of.withColumnsRenamed({"sid": "b", "hot": "hot_b"}), "b")
    open_ = open_.where(F.col("shared") + F.least("hot_a", "hot_b") >= F.least(F.lit(COMMON), least("n_a"), least("n_b")))
    near = lambda n, m: F.lit(DEN) * F.least(n, m) >= F.lit(NUM) * F.greatest(n, m)

    def stars(k: int) -> DataFrame:
        """Each hot group's members with the group's k-th pivot."""
        # edits take hot grams away: a set with many of them is like most of its group
        first = F.when(F.lit(k == 0), F.col("hot")).otherwise(0)
        pivot = counted.groupBy("gram").agg(F.max_by(F.struct("sid", "n"), F.struct(first, F.xxhash64("sid", F.lit(k)))).alias("p"))
        with_pivot = cells.join(pivot, "gram").where((F.col("p.sid") != F.col("sid")) & near(F.col("p.n"), F.col("n")))
        met = with_pivot.groupBy(F.col("p.sid").alias("a"), F.col("sid").alias("b")).count()
        return met.where(F.col("count") >= COMMON).select("a", "b")  # others are left to the families

    edges = sure.select("a", "b").unionByName(open_.select("a", "b"))
    for k in range(ROUNDS):
        edges = edges.unionByName(stars(k))
    edges = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "candidates")
    named = own.where("sid is not null and doc_id is not null")
    reps = stored(named.groupBy("sid").agg(F.min("doc_id").alias("doc_id")), "reps")

    def sets(asked: DataFrame) -> DataFrame:
        return stored(_sets(docs, stored(reps.join(asked.distinct(), "sid"), "asked"), levels), "sets")

    asked = edges.select(F.col("a").alias("sid")).union(edges.select(F.col("b").alias("sid")))
    whole = sets(asked)
    links = verified = stored(_verified(edges, whole), "verified")
    discard(whole, edges, hot_of)
    # sets of one doc_id belong together
    several = named.groupBy("doc_id").agg(F.min("sid").alias("a"), F.max("sid").alias("z")).where("a <> z").select("doc_id", "a")
    links = links.unionByName(named.join(several, "doc_id").select("a", F.col("sid").alias("b")).where("a <> b"))
    roots = components(links)
    discard(verified)
    families = _families(cells, roots)
    discard(met)
    if families is None:
        return own, roots, None
    whole = sets(families.select("sid"))
    joins = stored(_tiled(families, whole), "family-joins")
    discard(whole, families)
    return own, roots, components(joins)


def group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, one row per document."""
    own, roots, above = link(spark, docs)
    least = own.where("sid is not null").groupBy("sid").agg(F.min("doc_id").alias("first"))
    named = least.join(roots, least["sid"] == roots["node"], "left").select("sid", "first", F.coalesce("root", "sid").alias("root"))
    if above is not None:
        above = above.withColumnsRenamed({"node": "below", "root": "top"})
        named = named.join(above, named["root"] == above["below"], "left").select("sid", "first", F.coalesce("top", "root").alias("root"))
    named = stored(named, "named")
    named = named.join(named.groupBy("root").agg(F.min("first").alias("component_id")), "root").select("sid", "component_id")
    named = stored(named, "component-ids")
    return own.join(named, "sid", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def keep_one(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs less the documents that are not their component's first; rows without a doc_id stay."""
    gone = group(spark, docs).where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(stored(gone, "near-copies"), "doc_id", "left_anti").select(docs.columns)


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END) AS gram FROM d),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
pair AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.gram = y.gram AND x.doc_id < y.doc_id GROUP BY ALL),
link AS (SELECT a, b FROM pair JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 80 * (p.n + q.n - shared)),
sides AS (SELECT a, b FROM link UNION ALL SELECT b, a FROM link),
reach AS (SELECT a AS doc_id, b AS other FROM sides UNION SELECT reach.doc_id, sides.b FROM reach JOIN sides ON reach.other = sides.a)
SELECT d.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, least(d.doc_id, coalesce(min(reach.other), d.doc_id)) AS component_id
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN reach ON d.doc_id = reach.doc_id GROUP BY d.doc_id
"""
