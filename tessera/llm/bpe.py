"""Byte-pair encoding by a deterministic automaton over tokens.

The automaton starts as one state with an arc for each byte. Each merge (u, v) -> t, in order,
applies the merge gadget: states with an arc u into a state with an arc v get an arc t to where
that v led, and u is redirected into a copy of its target without the arc v. All arcs of one label
always share a target, so a state is a pair (label, time): the copies made of a label's target form
a strand, which begins in the strand of the label's right part at the time of the label's own
merge. Only cut arcs are stored, a dictionary for each strand; the table of transitions between
labels is filled as it is used.

A split word is encoded by following arcs, the longest label first, until the word's end; exactly
one path of a word is in the automaton, and a position from which no arc leads on is not tried
again. Decoding emits the labels of the arcs.

Defined results: null text is empty and has no tokens; an added token's string in the text becomes
that token, the longest of several; texts are encoded whole, and very long words are not kept in the
worker's word table; rows that repeat, and rows without a doc_id, each get a row; an empty table gives
no rows. encode_documents and decode_documents carry all columns, whatever their names, and replace
token_ids and text. Vocabularies that strip around added tokens, match them as whole words or lack a
byte are refused.
"""

from __future__ import annotations

import hashlib
import json
from array import array

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import spread

NEVER = 1 << 60
#: Words and transitions that a worker keeps, and the longest word kept; a full table is emptied.
WORDS_KEPT, ARCS_KEPT, WORD_BYTES = 250_000, 300_000, 64
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: The same pattern for ASCII text, in characters.
SPLIT_ASCII = r"'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+"


def byte_symbols() -> dict[str, int]:
    """The printable stand-ins of byte-level vocabularies: printable Latin-1 for itself, the rest from U+0100 on."""
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Automaton:
    """labels: bytes of each id (None where unused); merges: (left id, right id, id) in order."""

    def __init__(self, labels: list[bytes | None], merges: list[tuple[int, int, int]]):
        self.labels = labels
        self.left, self.right, self.born = [-1] * len(labels), [-1] * len(labels), [-1] * len(labels)
        self.cuts: list[dict[int, int]] = [{} for _ in labels]
        self.ids: dict[bytes, int] = {}
        made = {t for _, _, t in merges}
        for i, b in enumerate(labels):
            if b is not None and len(b) == 1 and i not in made:
                self.ids[b] = i
        for time, (u, v, t) in enumerate(merges):
            known = self.ids.get(labels[u]) == u and self.ids.get(labels[v]) == v
            if known and self.has_arc(u, time, v):  # else the merge can never happen
                self.left[t], self.right[t], self.born[t] = u, v, time
                self.cuts[u][v] = time
                self.ids[labels[t]] = t
        self.longest = max(map(len, self.ids), default=0)
        self.shorter = [-1] * len(labels)  # of a label, the longest label that begins it
        for b, t in self.ids.items():
            self.shorter[t] = next((self.ids[b[:n]] for n in range(len(b) - 1, 0, -1) if b[:n] in self.ids), -1)

    def _cut(self, state: int, time: int, t: int) -> bool:
        """Whether the arc t is cut in state's strand or in those it began in, as of time."""
        while state >= 0:
            at = self.cuts[state].get(t)
            if at is not None and at <= time:
                return True
            time = min(time, self.born[state] - 1)
            state = self.right[state]
        return False

    def has_arc(self, state: int, time: int, t: int) -> bool:
        """Whether the state after label `state`, as of time, has an arc t: t isn't cut, and when t was
        made its left part was an arc."""
        while True:
            if self._cut(state, time, t):
                return False
            if self.left[t] < 0:
                return True
            time = min(time, self.born[t])
            # the ancestor of the state that was there when t was made
            while state >= 0 and self.born[state] > time:
                time_in = self.born[state] - 1
                state = self.right[state]
                time = min(time, time_in)
            t = self.left[t]

    def encode(self, word: bytes, arcs: dict[int, bool]) -> list[int]:
        """The labels of the path of `word`. arcs: the transitions known so far."""
        ids, shorter, labels, n = self.ids, self.shorter, self.labels, len(word)
        path: list[int] = []
        at, last, dead = 0, -1, set()
        ends = [0]
        t = self._longest(word, 0)
        while at < n:
            while t >= 0:
                end = at + len(labels[t])
                if end not in dead:
                    if last < 0:
                        break
                    key = last << 20 | t
                    ok = arcs.get(key)
                    if ok is None:
                        ok = arcs[key] = self.has_arc(last, NEVER, t)
                    if ok:
                        break
                t = shorter[t]
            if t >= 0:
                path.append(t)
                at, last = end, t
                ends.append(at)
                if at < n:
                    t = self._longest(word, at)
            else:
                dead.add(at)
                t = shorter[path.pop()]
                ends.pop()
                at, last = ends[-1], path[-1] if path else -1
        return path

    def _longest(self, word: bytes, at: int) -> int:
        ids = self.ids
        for end in range(min(len(word), at + self.longest), at, -1):
            t = ids.get(word[at:end])
            if t is not None:
                return t
        raise ValueError(f"no token for byte {word[at]}")


class _Words(dict):
    """Word -> ids as little-endian 32-bit integers."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton, self.arcs = automaton, {}

    def __missing__(self, word: str) -> bytes:
        raw = word.encode()
        out = array("I", self.automaton.encode(raw, self.arcs)).tobytes()
        if len(self.arcs) > ARCS_KEPT:
            self.arcs.clear()
        if len(raw) <= WORD_BYTES:
            if len(self) >= WORDS_KEPT:
                self.clear()
            self[word] = out
        return out


class Tokenizer:
    def __init__(self, automaton: Automaton, added: dict[str, int]):
        self.automaton, self.added = automaton, added
        self.labels = [b or b"" for b in automaton.labels]
        for text, i in added.items():
            self.labels[i] = text.encode()

    @classmethod
    def from_file(cls, path: str) -> Tokenizer:
        with open(path, encoding="utf-8") as f:
            return cls.from_json(f.read())

    @classmethod
    def from_json(cls, text: str) -> Tokenizer:
        """A byte-level BPE of the tokenizers library."""
        spec = json.loads(text)
        vocab, symbols = spec["model"]["vocab"], byte_symbols()
        added = {a["content"]: a["id"] for a in spec["added_tokens"]}
        odd = [a["content"] for a in spec["added_tokens"] if a.get("lstrip") or a.get("rstrip") or a.get("single_word")]
        if odd or spec.get("normalizer"):
            raise ValueError(f"not a plain byte-level vocabulary: normalizer {spec.get('normalizer')}, added tokens {odd}")
        labels: list[bytes | None] = [None] * (max([*vocab.values(), *added.values()]) + 1)
        for token, i in vocab.items():
            if token not in added:
                labels[i] = bytes(symbols[c] for c in token)
        if missing := set(range(256)) - {b[0] for b in labels if b and len(b) == 1}:
            raise ValueError(f"no token for bytes {sorted(missing)}")
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        return cls(Automaton(labels, [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]), added)

    def prepare(self) -> None:
        """What a worker makes once and doesn't pickle."""
        if not hasattr(self, "_words"):
            import re

            self._words = _Words(self.automaton)
            self._find = regex.compile(SPLIT).findall
            self._find_ascii = re.compile(SPLIT_ASCII, re.ASCII).findall
            self._added = re.compile("(" + "|".join(sorted(map(re.escape, self.added), key=len, reverse=True)) + ")") if self.added else None

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k in ("automaton", "added", "labels")}

    def _plain(self, text: str) -> bytes:
        # \s of ASCII holds U+001C to U+001F for one library and not for the other
        find = self._find_ascii if text.isascii() and not any(c in text for c in "\x1c\x1d\x1e\x1f") else self._find
        return b"".join(map(self._words.__getitem__, find(text)))

    def encode(self, text: str | None) -> bytes:
        """ids as little-endian unsigned 32-bit integers."""
        self.prepare()
        if not text:
            return b""
        if self._added is None or not any(a in text for a in self.added):
            return self._plain(text)
        parts = self._added.split(text)
        return b"".join(array("I", [self.added[p]]).tobytes() if k % 2 else self._plain(p) for k, p in enumerate(parts))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, array("I", ids))).decode("utf-8", "replace")


def _texts(batch: pa.RecordBatch, column: str):
    """The texts one at a time, so that a batch of long texts is not held twice."""
    return (x.as_py() for x in batch.column(batch.schema.get_field_index(column)))


def _on_workers(spark: SparkSession, tokenizer: Tokenizer):
    """The vocabulary has a fixed size, some 50 thousand labels, so it is broadcast."""
    return spark.sparkContext.broadcast(tokenizer)


def digest_documents(spark: SparkSession, docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row."""
    held = _on_workers(spark, tokenizer)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])

    def run(batches):
        t = held.value
        for batch in batches:
            rows = []
            for text in _texts(batch, "text"):
                ids = t.encode(text)
                rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(t.decode(ids).encode()).hexdigest()))
            n, a, b = zip(*rows, strict=True) if rows else ((), (), ())
            yield pa.record_batch([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], schema=schema)

    return spread(docs.selectExpr("cast(doc_id as long) doc_id", "text")).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(spark: SparkSession, docs: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """docs with a column token_ids, an array of integers; a column of that name is replaced."""
    from pyspark.sql import types as T

    held = _on_workers(spark, tokenizer)
    kept = docs.drop("token_ids")
    place = kept.columns.index("text")

    def run(batches):
        t = held.value
        for batch in batches:
            parts = [t.encode(x.as_py()) for x in batch.column(place)]
            offsets = [0]
            for p in parts:
                offsets.append(offsets[-1] + len(p) // 4)
            values = pa.Array.from_buffers(pa.int32(), offsets[-1], [None, pa.py_buffer(b"".join(parts))])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), values)], [*batch.schema.names, "token_ids"])

    return spread(kept).mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("token_ids", T.ArrayType(T.IntegerType()))]))


def decode_documents(spark: SparkSession, encoded: DataFrame, tokenizer: Tokenizer) -> DataFrame:
    """encoded with `text` from token_ids; null ids give the empty text."""
    from pyspark.sql import functions as F

    held = _on_workers(spark, tokenizer)

    @F.pandas_udf("string")
    def text_of(ids):
        return ids.map(lambda x: "" if x is None else held.value.decode(array("I", list(x)).tobytes()))

    return encoded.withColumn("text", text_of("token_ids"))
