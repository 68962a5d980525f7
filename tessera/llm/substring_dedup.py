"""Removal of passages that an earlier document holds, by suffix arrays of shards.

A 50-byte window belongs to its anchor, the 16 bytes within it with the least hash, which its content
alone decides. Only windows whose anchors several documents share can
match, and all windows that match have one anchor, so shards by anchor need not look at each other.

1. Equal texts count once: all but the first of a group of copies are removed whole.
2. Anchors are dealt out by hash, one row for each hash and chunk of a task, and those of several
   documents stay. Rows that their chunk already finds shared are dealt by document instead, so a
   frequent passage fills no partition.
3. Of each shared anchor the cover goes to the anchor's shard: the bytes of all neighbouring windows
   that belong to it, so a run of one byte or a short period is one cover. Such a run goes cut to the
   windows that differ. Covers of hot anchors go in pieces to shards of their own, by the bytes around the
   anchor and in the end by window. A cover that a task has met in an earlier document is settled there.
4. A shard takes the parts of its distinct covers in which a window's fingerprint occurs more than once,
   lays them end to end and sorts their suffixes by external induced sorting.
   Neighbours with a common prefix of 50 bytes or more are one window; it is removed from every
   document but the first that holds it.
5. The windows of each document are united.

Texts travel twice: once to meet their shared anchors, and once more to meet their removed spans. Documents go by a key, their doc_id; where several texts share a doc_id, the others
get keys below all ids.

Defined results: null text is empty; texts are read whole, however long; rows without a doc_id neither
lose bytes nor take them from others; rows of one doc_id are never earlier than each other, and equal
rows get equal results; an empty table gives no rows. Columns other than doc_id and text are carried by
remove_repeats, whatever their names, and not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, spread, stored
from .induced_sort import sort_suffixes

SPAN, GRAM = 50, 16
WINDOW = SPAN - GRAM + 1
CHUNK, SHARD, COVERS_KEPT = 2 << 20, 2 << 20, 300_000
#: Documents of a hot anchor, and of one whose windows are dealt one by one; parts of the former's windows.
HOT, HOTTEST, PARTS = 5000, 500_000, 4
_RANDOM = np.random.default_rng(5).integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_BASE = 0x9E3779B97F4A7C15


def gram_hashes(data: np.ndarray, size: int) -> np.ndarray:
    """The hash of the `size` bytes from each place on, put together from powers of two."""
    part, k, factor = _RANDOM[data], 1, _BASE
    h, done = None, 0
    while True:
        if size & k:
            n = len(data) - done - k + 1
            h = part if h is None else h[:n] * np.uint64(factor) + part[done : done + n]
            done += k
        if done == size:
            break
        part = part[:-k] * np.uint64(factor) + part[k:]
        factor = factor * factor % (1 << 64)
        k *= 2
    h = h ^ h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    return h ^ h >> np.uint64(29)


def anchors(data: np.ndarray) -> np.ndarray:
    """For each window of SPAN bytes in data, the least hash of its grams."""
    value, size = gram_hashes(data, GRAM), 1
    while size * 2 <= WINDOW:
        value = np.minimum(value[:-size], value[size:])
        size *= 2
    return np.minimum(value[: len(value) - (WINDOW - size)], value[WINDOW - size :]) if size < WINDOW else value


def period(cover: bytes) -> int:
    """The least period of a cover of more than WINDOW windows, up to WINDOW; 0 if it has none."""
    return next((p for p in range(1, WINDOW + 1) if cover[p:] == cover[:-p]), 0)


def chunks(texts):
    """Lists of (index, bytes) of about CHUNK bytes, whole texts only."""
    held, size = [], 0
    for i, text in enumerate(texts):
        raw = text.as_py()
        raw = raw.encode() if isinstance(raw, str) else raw or b""
        if len(raw) >= SPAN:
            held.append((i, raw))
            size += len(raw)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


class Chunk:
    """Texts laid end to end: their windows' anchors, as groups of neighbouring windows of one anchor hash."""

    def __init__(self, held):
        self.raw = b"".join(r for _, r in held)
        sizes = np.array([len(r) for _, r in held])
        ends = np.cumsum(sizes)
        self.starts = ends - sizes
        least = anchors(np.frombuffer(self.raw, np.uint8))
        valid = np.concatenate([np.arange(e - s, e - SPAN + 1) for s, e in zip(sizes, ends, strict=True)])
        doc = np.repeat(np.arange(len(held)), sizes - SPAN + 1)
        least = least[valid]
        new = np.concatenate([[True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])])
        at = np.flatnonzero(new)
        self.doc, self.hash = doc[at], least[at].view(np.int64)
        self.first = valid[at]
        self.last = np.append(valid[at[1:] - 1], valid[-1])  # first and last window of each group


def _shared_anchors(docs: DataFrame) -> DataFrame:
    """From (key, text): key, hash of each document's anchors that other documents have too."""

    def run(batches):
        for batch in batches:
            ids = np.asarray(batch.column(0))
            for held in chunks(batch.column(1)):
                c = Chunk(held)
                doc = ids[np.array([i for i, _ in held])][c.doc]
                order = np.lexsort((doc, c.hash))
                h, d = c.hash[order], doc[order]
                fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (d[1:] != d[:-1])])
                h, d = h[fresh], d[fresh]
                head = np.concatenate([[True], h[1:] != h[:-1]])
                known = np.zeros(len(h), bool)  # shared within the chunk
                known[1:] |= ~head[1:]
                known[:-1] |= ~head[1:]
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([d[known], d[head]])), pa.array(np.concatenate([h[known], h[head]])), pa.array(np.concatenate([np.ones(int(known.sum()), bool), np.zeros(int(head.sum()), bool)]))], ["key", "hash", "known"])

    def meet(batches):
        carry = None  # the last row so far, and whether it has been given
        for batch in batches:
            h, d, known = (np.asarray(batch.column(i)) for i in range(3))
            given_h, given_d = h[known], d[known]
            h, d = h[~known], d[~known]
            if len(h):
                if carry is not None:
                    h, d = np.concatenate([carry[0], h]), np.concatenate([carry[1], d])
                same = h[1:] == h[:-1]
                keep = np.zeros(len(h), bool)
                keep[1:] |= same
                keep[:-1] |= same
                last_given = bool(keep[-1])
                if carry is not None and carry[2]:
                    keep[0] = False
                carry = (h[-1:], d[-1:], last_given)
                given_h, given_d = np.concatenate([given_h, h[keep]]), np.concatenate([given_d, d[keep]])
            yield pa.RecordBatch.from_arrays([pa.array(given_d), pa.array(given_h)], ["key", "hash"])

    rows = docs.select("key", "text").mapInArrow(run, "key long, hash long, known boolean")
    # rows that are known to be shared meet no others: they are dealt by document
    dealt = rows.select("hash", "key", "known").repartition(F.when(F.col("known"), F.col("key")).otherwise(F.col("hash"))).sortWithinPartitions("hash", "key")
    return dealt.mapInArrow(meet, "key long, hash long")


SPAN_KIND = "key long, doc_id long, start long, stop long, period int, hash long, cover binary"


def split_windows(cover: bytes, value: int, parts: int) -> list[tuple[int, int, int]]:
    """(first window, end window, hash) of the pieces in which a hot anchor's cover is dealt: neighbouring
    windows that hold the anchor's first occurrence in one part of its possible places. Such windows share
    the bytes around it, whose hash is the piece's; with as many parts as places a piece is one window. The
    content of a window alone decides its piece's hash."""
    grams = gram_hashes(np.frombuffer(cover, np.uint8), GRAM).view(np.int64)
    places = np.flatnonzero(grams == value)
    window = np.arange(len(cover) - SPAN + 1)
    at = places[np.searchsorted(places, window)]
    bounds = np.linspace(0, WINDOW, parts + 1).astype(int)
    part = np.searchsorted(bounds, at - window, side="right") - 1
    cuts = (np.flatnonzero((np.diff(at) != 0) | (np.diff(part) != 0)) + 1).tolist()
    out = []
    for a, b in zip([0, *cuts], [*cuts, len(window)], strict=True):
        low, high = int(bounds[part[a]]), int(bounds[part[a] + 1]) - 1
        shared = cover[int(at[a]) - low : int(at[a]) - high + SPAN]
        digest = hashlib.blake2b(shared, digest_size=8, salt=int(part[a]).to_bytes(2, "little"), person=value.to_bytes(8, "little", signed=True)).digest()
        out.append((a, b, int.from_bytes(digest, "little", signed=True)))
    return out


def _covers(held: DataFrame) -> DataFrame:
    """From (key, doc_id, text, hashes, hot): the covers of shared anchors, as rows of SPAN_KIND; and without
    hash and cover, spans that are settled: to be removed. hot: (hash, parts) of anchors that are dealt in
    pieces. A row with a period stands for a run: its cover holds one period of windows or a piece of that."""

    def run(batches):
        met: dict[bytes, int] = {}  # cover -> the least doc_id that has been given with it
        kinds = [pa.int64()] * 4 + [pa.int32(), pa.int64(), pa.binary()]
        for batch in batches:
            keys, ids, wanted, hot = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(3), batch.column(4)
            for part in chunks(batch.column(2)):
                c = Chunk(part)
                rows: list[tuple] = []
                cuts = np.searchsorted(c.doc, np.arange(len(part) + 1))
                for k, (i, _) in enumerate(part):
                    own, own_id, begin = np.sort(np.asarray(wanted[i].values)), ids[i], int(c.starts[k])
                    parts = {x["hash"]: x["parts"] for x in hot[i].as_py() or ()}
                    a, b = cuts[k], cuts[k + 1]
                    at = np.minimum(np.searchsorted(own, c.hash[a:b]), len(own) - 1)
                    spans: list[list[int]] = []
                    for g in (np.flatnonzero(own[at] == c.hash[a:b]) + a).tolist():
                        first, stop, value = int(c.first[g]), int(c.last[g]) + SPAN, int(c.hash[g])
                        cover, p = c.raw[first:stop], 0
                        if stop - first - SPAN >= WINDOW and (p := period(cover)):
                            cover = cover[: SPAN + p - 1]  # one period of windows
                        pieces = [(cover, first, stop, value)]
                        if value in parts:
                            last = stop - first - SPAN  # of the whole group's windows
                            pieces = [
                                (cover[x : y - 1 + SPAN], first + x, first + (max(w + (last - w) // p * p for w in range(x, y)) if p else y - 1) + SPAN, name)
                                for x, y, name in split_windows(cover, value, parts[value])]
                        for piece, begun, ended, name in pieces:
                            digest = xxhash.xxh3_128_digest(piece)
                            before = met.get(digest)
                            if before is not None and before < own_id:
                                if spans and spans[-1][1] >= begun:
                                    spans[-1][1] = max(spans[-1][1], ended)
                                else:
                                    spans.append([begun, ended])
                            else:
                                met[digest] = own_id
                                rows.append((keys[i], own_id, begun - begin, ended - begin, p, name, piece))
                    rows += [(keys[i], own_id, begun - begin, ended - begin, None, None, None) for begun, ended in spans]
                    if len(met) > COVERS_KEPT:
                        met.clear()
                for at in range(0, len(rows), 20_000):
                    yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows[at : at + 20_000], strict=True), kinds, strict=True)], ["key", "doc_id", "start", "stop", "period", "hash", "cover"])

    return held.select("key", "doc_id", "text", "hashes", "hot").mapInArrow(run, SPAN_KIND)


def promising(covers: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each cover the part, from and to, outside which no window has a fingerprint that occurs twice."""
    sizes = np.array([len(c) for c in covers])
    begin = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(covers)), sizes - SPAN + 1)
    place = np.arange(len(owner)) + np.repeat(np.arange(len(covers)), sizes - SPAN + 1) * (SPAN - 1)
    h = gram_hashes(np.frombuffer(b"".join(covers), np.uint8), SPAN)[place]
    order = np.argsort(h)
    same = np.zeros(len(h) + 1, bool)
    same[1:-1] = h[order][1:] == h[order][:-1]
    twice = np.sort(order[same[1:] | same[:-1]])
    start, stop = np.zeros(len(covers), np.int64), np.zeros(len(covers), np.int64)
    own, at = owner[twice], place[twice]
    start[own[::-1]] = at[::-1]  # the first of each cover is written last
    stop[own] = at + SPAN
    return np.where(stop > 0, start - begin, 0), np.where(stop > 0, stop - begin, 0)


def repeated_windows(covers: list[bytes], first_doc: np.ndarray) -> list[np.ndarray]:
    """For each cover the windows, by their starts, that a cover of an earlier document holds. Only the
    promising parts of covers are sorted."""
    start, stop = promising(covers)
    some = np.flatnonzero(stop > start)
    out = [np.zeros(0, np.int64)] * len(covers)
    if len(some):
        found = _sorted_windows([covers[i][a:b] for i, a, b in zip(some.tolist(), start[some].tolist(), stop[some].tolist(), strict=True)], first_doc[some])
        for i, a, starts in zip(some.tolist(), start[some].tolist(), found, strict=True):
            out[i] = starts + a
    return out


def _sorted_windows(covers: list[bytes], first_doc: np.ndarray) -> list[np.ndarray]:
    """repeated_windows by the suffix array of all covers."""
    sizes = np.array([len(c) for c in covers])
    text = np.frombuffer(b"\0".join(covers) + b"\0", np.uint8).astype(np.int16)
    begin = np.concatenate([[0], np.cumsum(sizes + 1)[:-1]])
    symbols = text + np.int16(1)
    symbols[begin + sizes] = 0  # ends of covers; they lie within no window
    order, common = sort_suffixes(symbols, 257)
    owner = np.repeat(np.arange(len(covers)), sizes + 1)[order]
    whole = order - begin[owner] + SPAN <= sizes[owner]
    order, owner = order[whole], owner[whole]
    # suffixes without a whole window end within it, so none of them lies between two equal windows
    run = np.cumsum(common[whole] < SPAN)
    doc = first_doc[owner]
    head = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]])) if len(run) else np.zeros(0, np.int64)
    least = np.repeat(np.minimum.reduceat(doc, head), np.diff(np.append(head, len(doc)))) if len(run) else doc
    gone = least < doc
    place, owner = order[gone], owner[gone]
    by = np.argsort(place, kind="stable")
    place, owner = place[by].astype(np.int64), owner[by]
    cuts = np.searchsorted(owner, np.arange(len(covers) + 1))
    return [place[cuts[k] : cuts[k + 1]] - begin[k] for k in range(len(covers))]


def _compared(covers: DataFrame) -> DataFrame:
    """key, start, stop: the spans that earlier documents hold, by shards of whole anchors. covers: (hash,
    doc_id, key, start, stop, period, cover), all rows of a hash in a row and in order of doc_id."""

    def run(batches):
        held: dict[bytes, tuple[int, list]] = {}  # cover -> its first document and where that has it
        own: dict[bytes, tuple[int, list]] = {}  # the same for the open anchor
        size, anchor = 0, None
        out: list[tuple[int, int, int]] = []
        settled: list[np.ndarray] = []

        def shard():
            texts = list(held)
            found = repeated_windows(texts, np.array([held[t][0] for t in texts]))
            for text, starts in zip(texts, found, strict=True):
                if len(starts):
                    cuts = (np.flatnonzero(np.diff(starts) > SPAN) + 1).tolist()
                    for a, b in zip([0, *cuts], [*cuts, len(starts)], strict=True):
                        first, last = int(starts[a]), int(starts[b - 1])
                        for key, at, stop, p in held[text][1]:
                            end = last
                            if p:  # a run: windows a whole number of periods on are equal
                                most = stop - at - SPAN
                                end = max(x + (most - x) // p * p for x in starts.tolist())
                            out.append((key, at + first, at + end + SPAN))
            held.clear()

        def close():
            nonlocal size
            if len(own) > 1:  # else all of the anchor is settled
                held.update(own)
                size += sum(map(len, own))
            own.clear()
            if size > SHARD:
                shard()
                size = 0

        def one_by_one(part):
            """Rows of an anchor that may have begun in another batch or go on in one."""
            for doc, key, start, stop, p, cover in zip(*(c.to_pylist() for c in part.columns[1:7]), strict=True):
                known = own.get(cover)
                if known is None:
                    own[cover] = (doc, [(key, start, stop, p)])
                elif known[0] < doc:
                    out.append((key, start, stop))
                else:
                    known[1].append((key, start, stop, p))

        def at_once(part):
            """Rows of whole anchors. A cover has one anchor, so its number stands for both."""
            nonlocal size
            h, doc, key, start, stop, p = (np.asarray(c) for c in part.columns[:6])
            coded = part.column(6).dictionary_encode()
            code = np.asarray(coded.indices)
            first = np.unique(code, return_index=True)[1]  # in order of doc_id, so the least
            gone = doc > doc[first[code]]
            settled.append(np.stack([key[gone], start[gone], stop[gone]]))
            anchor_of = np.concatenate([[0], np.cumsum(h[1:] != h[:-1])])
            several = np.bincount(anchor_of[first], minlength=int(anchor_of[-1]) + 1) > 1
            rest = np.flatnonzero(~gone & several[anchor_of])
            texts = coded.dictionary.take(pa.array(code[rest])).to_pylist()
            for text, *row in zip(texts, doc[rest].tolist(), key[rest].tolist(), start[rest].tolist(), stop[rest].tolist(), p[rest].tolist(), strict=True):
                known = held.get(text)
                if known is None:
                    held[text] = known = (row[0], [])
                    size += len(text)
                known[1].append(tuple(row[1:]))
            if size > SHARD:
                shard()
                size = 0

        def rows():
            every = np.concatenate([*settled, np.array(out, np.int64).reshape(-1, 3).T], axis=1)
            settled.clear()
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(x) for x in every], ["key", "start", "stop"])

        for batch in batches:
            h = np.asarray(batch.column(0))
            if not len(h):
                continue
            change = np.flatnonzero(h[1:] != h[:-1]) + 1
            goes_on = anchor is not None and h[0] == anchor
            begin = 0 if not goes_on else int(change[0]) if len(change) else len(h)
            if begin:
                one_by_one(batch.slice(0, begin))
            if begin < len(h):
                close()
                tail = int(change[-1]) if len(change) else 0
                if tail > begin:
                    at_once(batch.slice(begin, tail - begin))
                one_by_one(batch.slice(tail))
                anchor = h[-1]
            if len(out) + sum(x.shape[1] for x in settled) > 100_000:
                yield rows()
        close()
        if held:
            shard()
        if out or settled:
            yield rows()

    return covers.mapInArrow(run, "key long, start long, stop long")


def _cut(found: DataFrame) -> DataFrame:
    """From (key, text, spans): key, n_removed, n_spans, kept_sha256, kept."""

    def run(batches):
        for batch in batches:
            out: list[tuple] = []
            for key, text, spans in zip(batch.column(0), batch.column(1), batch.column(2), strict=True):
                raw, kept, at, runs = (text.as_py() or "").encode(), [], 0, 0
                for a, b in sorted((x["start"], x["stop"]) for x in spans.as_py()):
                    if a > at or not runs:
                        kept.append(raw[at:a])
                        runs += 1
                    at = max(at, b)
                kept.append(raw[at:])
                rest = b"".join(kept)
                out.append((key.as_py(), len(raw) - len(rest), runs, hashlib.sha256(rest).hexdigest(), rest))
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary()), strict=True)], ["key", "n_removed", "n_spans", "kept_sha256", "kept"])

    return found.mapInArrow(run, "key long, n_removed long, n_spans long, kept_sha256 string, kept binary")


def _keyed(docs: DataFrame) -> DataFrame:
    """doc_id, digest, n_bytes, copy, key of every row. copy: an earlier document has the same text."""
    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    own = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.sha2(raw, 256).alias("digest"), F.octet_length(raw).cast("long").alias("n_bytes")), "text-digests")
    first = stored(own.groupBy("digest").agg(F.min("doc_id").alias("first")), "first-copies")
    rows = own.join(first, "digest").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False))).drop("first")
    texts = own.where("doc_id is not null").select("doc_id", "digest").distinct()
    several = texts.groupBy("doc_id").agg(F.count(F.lit(1)).alias("texts"), F.min("digest").alias("least")).where("texts > 1")
    if not several.take(1):
        return stored(rows.withColumn("key", F.col("doc_id")), "keyed")
    others = stored(texts.join(several, "doc_id").where("digest <> least").select("doc_id", "digest"), "other-texts")
    low = own.agg(F.min("doc_id")).first()[0]
    others = stored(others.withColumn("_key", F.lit(low) - 1 - F.monotonically_increasing_id()), "other-keys")
    return stored(rows.join(others, ["doc_id", "digest"], "left").withColumn("key", F.coalesce("_key", "doc_id")).drop("_key"), "keyed")


def find_repeats(spark: SparkSession, docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(keyed rows, cut texts): cut texts hold n_removed, n_spans, kept_sha256 and kept for the keys that
    lose bytes otherwise than as copies."""
    docs = spread(docs.select("doc_id", "text"))
    keyed = _keyed(docs)
    raw = docs.where("doc_id is not null and octet_length(text) >= 50").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    if keyed.where("key <> doc_id").take(1):
        special = stored(keyed.where("copy or key <> doc_id").select("doc_id", "digest", "copy", "key").distinct(), "special-rows")
        raw = raw.withColumn("digest", F.sha2(F.col("text").cast("binary"), 256)).join(special, ["doc_id", "digest"], "left")
        raw = raw.where("copy is null or not copy").select(F.coalesce("key", "doc_id").alias("key"), "doc_id", "text")
    else:  # each doc_id has one text
        copies = stored(keyed.where("copy").select("doc_id").distinct(), "copies")
        raw = raw.join(copies, "doc_id", "left_anti").select(F.col("doc_id").alias("key"), "doc_id", "text")
    shared = stored(_shared_anchors(raw), "shared-anchors")
    many = shared.groupBy("hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= HOT)
    hot = stored(many.select("hash", F.when(F.col("n") >= HOTTEST, WINDOW).otherwise(PARTS).alias("parts")), "hot-anchors")
    lists = shared.join(hot, "hash", "left").groupBy("key").agg(F.collect_set("hash").alias("hashes"), F.collect_set(F.when(F.col("parts").isNotNull(), F.struct("hash", "parts"))).alias("hot"))
    covers = stored(_covers(raw.join(lists, "key")), "covers")
    discard(shared, hot)
    open_ = covers.where("hash is not null").select("hash", "doc_id", "key", "start", "stop", "period", "cover")
    compared = stored(_compared(open_.repartition("hash").sortWithinPartitions("hash", "doc_id")), "compared")
    spans = covers.where("hash is null").select("key", "start", "stop").unionByName(compared)
    spans = spans.groupBy("key").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    # rows that repeat a document have one cut text
    texts = raw.select("key", "text")
    if keyed.groupBy("doc_id", "digest").count().where("count > 1 and doc_id is not null").take(1):
        texts = texts.dropDuplicates(["key"])
    cut = stored(_cut(texts.join(spans, "key").select("key", "text", "spans")), "cut-texts")
    discard(covers, compared)
    return keyed, cut


def repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256, one row per document."""
    keyed, cut = find_repeats(spark, docs)
    rows = keyed.join(cut.drop("kept"), "key", "left")
    gone = F.col("copy") & (F.col("n_bytes") >= SPAN)
    zero = F.lit(0).cast("long")
    return rows.select(
        "doc_id", "n_bytes",
        F.when(gone, F.col("n_bytes")).otherwise(F.coalesce("n_removed", zero)).alias("n_removed"),
        F.when(gone, F.lit(1).cast("long")).otherwise(F.coalesce("n_spans", zero)).alias("n_spans"),
        F.when(gone, F.sha2(F.lit("").cast("binary"), 256)).otherwise(F.coalesce("kept_sha256", "digest")).alias("kept_sha256"))


def remove_repeats(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with the repeated spans cut out of text (bytes that no longer decode become U+FFFD)."""
    keyed, cut = find_repeats(spark, docs)
    new = keyed.where("doc_id is not null").select("doc_id", "digest", "key", (F.col("copy") & (F.col("n_bytes") >= SPAN)).alias("gone")).distinct()
    new = new.join(cut.select("key", "kept"), "key", "left").where("gone or kept is not null")
    new = stored(new.select("doc_id", "digest", F.when(F.col("gone"), F.lit("").cast("binary")).otherwise(F.col("kept")).alias("kept")), "new-texts")
    left = F.when(F.col("kept").isNull(), F.col("text")).otherwise(F.decode("kept", "UTF-8"))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col("doc_id").cast("long").alias("doc_id"), F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("digest"), "text")
    rows = rows.join(new, ["doc_id", "digest"], "left").select("row", left.alias("text"))
    return rows.select(*(F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns))


ORACLE = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (SELECT doc_id, i, b[i + 1 : i + 50] AS span FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS i FROM d)),
f AS (SELECT span, min(doc_id) AS first FROM w GROUP BY span),
hit AS (SELECT doc_id, i, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, false) AS apart FROM w JOIN f ON w.span = f.span WHERE first < doc_id),
run AS (SELECT doc_id, i, sum(apart::INT) OVER (PARTITION BY doc_id ORDER BY i ROWS UNBOUNDED PRECEDING) AS r FROM hit),
cut AS (SELECT doc_id, min(i) AS start, max(i) + 50 AS stop FROM run GROUP BY doc_id, r),
part AS (SELECT doc_id, start, stop, lag(stop, 1, 0) OVER (PARTITION BY doc_id ORDER BY start) AS before FROM cut),
kept AS (SELECT part.doc_id, count(*) AS n_spans, sum(stop - start)::BIGINT AS n_removed, unhex(string_agg(hex(b[before + 1 : start]), '' ORDER BY start) || hex(any_value(b)[max(stop) + 1 :])) AS rest FROM part JOIN d ON part.doc_id = d.doc_id GROUP BY part.doc_id)
SELECT d.doc_id, octet_length(b)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(coalesce(rest, b)) AS kept_sha256
FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id
"""
