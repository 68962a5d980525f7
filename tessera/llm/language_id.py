"""Language of each word by a linear-chain conditional random field, of each text by its words.

A word's features are hashed bytes of its lower-cased form: prefixes, suffixes, trigrams and the
word itself (the lexicon); their weights and a matrix of transitions between labels are learned
together from the gradient of the log-likelihood, by forward-backward. Training sequences join
pieces of documents in several languages, so that switches are seen. Words longer than WIDTH bytes, as
in text without spaces, are cut into consecutive pieces, and each piece counts as a word of its own. A
text's language is the label with the highest mean posterior over its words with letters, and that
mean is its score.

Training takes a bounded sample to the driver: PER_LANG documents for each of the MOST_LABELS most
frequent labels, and of longer ones TRAIN_WORDS words in runs that are spread evenly over the whole
text. Labels beyond MOST_LABELS are not learned. The model of 2 ** BITS rows is broadcast. Prediction
reads whole texts.

Defined results: null text, or text without a letter, is `und` with score 0; with no labelled row
to learn from, every text is `und`; ties go to the label first in order. Rows that repeat a doc_id
each get a row; a row without one is not held out and can be learned from. An empty table gives no
rows. keep_known carries all columns, whatever their names; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread

UND = "und"
BITS, PER_LANG, TRAIN_WORDS, RUNS, MOST_LABELS = 17, 400, 600, 12, 200
STEPS, BATCH, LENGTH, RATE, SEED = 150, 64, 48, 0.5, 7
WIDTH = 32  # bytes of a piece at most
PREFIXES, SUFFIXES = (1, 2, 3, 4), (1, 2, 3, 4, 5)
WORDS_KEPT, CHUNK_WORDS = 300_000, 500_000
PUNCTUATION = ".,;:!?|\"'()[]{}*&%$#-_<>/\\«»¡¿"


def held_out(doc_id: Column) -> Column:
    """Rows whose labels are not learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def cut(word: str) -> list[str]:
    """Consecutive pieces of WIDTH bytes at most, all of the word; the word itself where it fits."""
    plain = word.lower().strip(PUNCTUATION)
    raw = plain.encode()
    if len(raw) <= WIDTH:
        return [word]
    out, at = [], 0
    while at < len(raw):
        end = min(at + WIDTH, len(raw))
        while end < len(raw) and raw[end] & 0xC0 == 0x80:  # not within a character
            end -= 1
        out.append(raw[at:end].decode())
        at = end
    return out


def pieces(text: str) -> tuple[list[str], np.ndarray | None]:
    """The words of a text, long ones in pieces, and where each word begins among them; None if none is cut."""
    words = text.split()
    # a character in lower case has four bytes at most
    if not words or max(map(len, words)) <= (WIDTH if text.isascii() else WIDTH // 4):
        return words, None
    out: list[str] = []
    starts = []
    for w in words:
        starts.append(len(out))
        if len(w) <= WIDTH // 4 or len(w) <= WIDTH and w.isascii():
            out.append(w)
        else:
            out += cut(w)
    return out, np.array(starts) if len(out) > len(words) else None


def features(words: list[str]) -> np.ndarray:
    """Rows of W for each word of WIDTH bytes at most; 0 stands for none."""
    raw = [w.lower().strip(PUNCTUATION).encode() for w in words]
    n = len(raw)
    if not n:
        return np.zeros((0, 1), np.int32)
    if max(map(len, raw)) > WIDTH:
        raise ValueError("a word is longer than a piece")
    flat = np.array(raw, dtype=f"S{WIDTH}").view(np.uint8).reshape(n, WIDTH).astype(np.uint32)
    size = np.fromiter(map(len, raw), np.int32, n)
    out = []

    def add(code: np.ndarray, kind: int, ok: np.ndarray) -> None:
        h = (code * np.uint32(2654435761) + np.uint32(kind * 40503 + 1)) * np.uint32(2246822519)
        h ^= h >> np.uint32(15)
        row = (h * np.uint32(3266489917)) >> np.uint32(32 - BITS)
        out.append(np.where(ok, np.maximum(row, 1), 0).astype(np.int32))

    code = np.zeros(n, np.uint32)
    whole = np.zeros(n, np.uint32)
    for k in range(WIDTH):
        whole = whole * np.uint32(16777619) + flat[:, k] + np.uint32(k < 1)
        if k + 1 in PREFIXES:
            code = whole
            add(code, k + 1, size >= k + 1)
    add(whole, 20, size > 0)
    at = np.arange(n)
    code = np.zeros(n, np.uint32)
    for k in range(1, max(SUFFIXES) + 1):
        code = code * np.uint32(16777619) + flat[at, np.maximum(size - k, 0)]
        if k in SUFFIXES:
            add(code, 30 + k, size >= k)
    most = int(size.max()) if n else 0
    for k in range(max(0, most - 2)):
        add((flat[:, k] << np.uint32(16)) | (flat[:, k + 1] << np.uint32(8)) | flat[:, k + 2], 50, size >= k + 3)
    return np.stack(out, axis=1)


def _pad(rows: np.ndarray, width: int) -> np.ndarray:
    return np.pad(rows, ((0, 0), (0, width - rows.shape[1])))


class Model:
    def __init__(self, labels: list[str], weights: np.ndarray, moves: np.ndarray):
        self.labels, self.weights, self.moves = labels, weights, moves

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of each label for each word; zeros for a word without letters."""
        out = np.zeros((len(words), len(self.labels)), np.float32)
        for at in range(0, len(words), 20_000):
            part = words[at : at + 20_000]
            rows = features(part)
            for k in range(rows.shape[1]):
                out[at : at + len(part)] += self.weights[rows[:, k]]
        out[[not any(map(str.isalpha, w)) for w in words]] = 0
        return out


def forward_backward(scores: np.ndarray, lengths: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Posteriors of the labels for sequences laid end to end, longest first, and the log-likelihoods'
    normalisers. Each step takes all sequences that are long enough at once."""
    total, n_labels = scores.shape
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    peak = scores.max(axis=1, keepdims=True) if total else scores
    local = np.exp(scores - peak)
    step = np.exp(moves).astype(np.float32)
    alpha = np.empty_like(local)
    norm = np.zeros(len(lengths))
    longest = int(lengths[0]) if len(lengths) else 0
    active = np.searchsorted(-lengths, -np.arange(longest), side="left")  # sequences longer than t
    prev = None
    for t in range(longest):
        k = active[t]
        at = starts[:k] + t
        now = local[at] if prev is None else (prev[:k] @ step) * local[at]
        s = now.sum(axis=1, keepdims=True)
        now /= s
        norm[:k] += np.log(s[:, 0]) + peak[at, 0]
        alpha[at] = prev = now
    back = np.ones((len(lengths), n_labels), np.float32)
    for t in range(longest - 1, -1, -1):
        k = active[t]
        at = starts[:k] + t
        post = alpha[at] * back[:k]
        post /= post.sum(axis=1, keepdims=True)
        alpha[at] = post
        if t:
            nxt = (back[:k] * local[at]) @ step.T
            back[:k] = nxt / nxt.sum(axis=1, keepdims=True)
    return alpha, norm


def train(rows: list[tuple[str, str]]) -> Model:
    """rows: (text, label)."""
    labels = sorted({label for _, label in rows})
    n_labels = len(labels)
    weights, moves = np.zeros((1 << BITS, n_labels), np.float32), np.zeros((n_labels, n_labels), np.float32)
    rng = np.random.default_rng(SEED)
    texts: list[list[np.ndarray]] = [[] for _ in labels]
    ids: dict[str, int] = {}
    for text, label in rows:
        words = [ids.setdefault(w, len(ids)) for w in pieces(text)[0] if any(map(str.isalpha, w))]
        if words:
            texts[labels.index(label)].append(np.array(words))
    usable = [k for k in range(n_labels) if texts[k]]
    if not usable:
        return Model(labels, weights, moves)
    rows_of = features(list(ids))
    sums, move_sums = np.full_like(weights, 1e-6), np.full_like(moves, 1e-6)
    shape = (BATCH, LENGTH)
    for _ in range(STEPS):
        word, gold = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        for i in range(BATCH):
            at, mixed = 0, rng.random() < 0.5
            label = rng.choice(usable)
            while at < LENGTH:
                doc = texts[label][rng.integers(len(texts[label]))]
                size = min(LENGTH - at, len(doc), int(rng.integers(4, 24)) if mixed else LENGTH)
                begin = rng.integers(len(doc) - size + 1)
                word[i, at : at + size], gold[i, at : at + size] = doc[begin : begin + size], label
                at += size
                label = rng.choice(usable) if mixed else label
        used = rows_of[word.ravel()]
        scores = weights[used].sum(axis=1)
        # pairs of neighbours need joint posteriors: T steps over the batch
        e = np.exp(scores - scores.max(axis=1, keepdims=True)).reshape(*shape, n_labels)
        step = np.exp(moves)
        alpha, beta = np.empty_like(e), np.empty_like(e)
        alpha[:, 0] = e[:, 0] / e[:, 0].sum(axis=1, keepdims=True)
        for t in range(1, LENGTH):
            a = (alpha[:, t - 1] @ step) * e[:, t]
            alpha[:, t] = a / a.sum(axis=1, keepdims=True)
        beta[:, -1] = 1
        for t in range(LENGTH - 2, -1, -1):
            b = (beta[:, t + 1] * e[:, t + 1]) @ step.T
            beta[:, t] = b / b.sum(axis=1, keepdims=True)
        post = alpha * beta
        post /= post.sum(axis=2, keepdims=True)
        pair = alpha[:, :-1, :, None] * step * (beta * e)[:, 1:, None, :]
        pair /= pair.sum(axis=(2, 3), keepdims=True)
        slope = post.reshape(-1, n_labels)
        slope[np.arange(len(slope)), gold.ravel()] -= 1
        grad = np.zeros_like(weights)
        for k in range(n_labels):
            grad[:, k] = np.bincount(used.ravel(), np.repeat(slope[:, k], used.shape[1]), minlength=len(grad))
        grad /= BATCH
        grad[0] = 0
        sums += grad * grad
        weights -= RATE * grad / np.sqrt(sums)
        move = pair.sum(axis=(0, 1))
        np.subtract.at(move, (gold[:, :-1].ravel(), gold[:, 1:].ravel()), 1)
        move /= BATCH
        move_sums += move * move
        moves -= RATE * move / np.sqrt(move_sums)
    return Model(labels, weights, moves)


def spread_words(text: str | None) -> str:
    """A text's words, of more than TRAIN_WORDS as many in RUNS runs over all of it."""
    words = pieces(text)[0] if text else []
    if len(words) <= TRAIN_WORDS:
        return " ".join(words)
    size = TRAIN_WORDS // RUNS
    return " ".join(w for at in np.linspace(0, len(words) - size, RUNS).astype(int).tolist() for w in words[at : at + size])


def fit(docs: DataFrame, per_lang: int = PER_LANG) -> Model:
    """From rows with a label that are not held out; about per_lang of each label, drawn by a hash of the id."""
    usable = docs.where(F.col("lang").isNotNull() & ~held_out(F.col("doc_id"))).select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.col("lang").cast("string").alias("lang"))
    most = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(MOST_LABELS)
    counts = {r["lang"]: r["n"] for r in most.collect()}
    if not counts:
        return train([])
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(per_lang / n))])
    drawn = F.pmod(F.xxhash64("doc_id", F.lit(SEED)), F.lit(1 << 30))
    sample = usable.withColumn("draw", drawn).where(F.col("draw") / float(1 << 30) < share[F.col("lang")])

    def run(batches):
        for batch in batches:
            texts = pa.array([spread_words(t.as_py()) for t in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), texts, batch.column(2), batch.column(3)], ["doc_id", "text", "lang", "draw"])

    bounded = sample.select("doc_id", "text", "lang", "draw").mapInArrow(run, "doc_id long, text string, lang string, draw long")
    rows = bounded.orderBy("draw", "doc_id", "lang", "text").limit(2 * per_lang * len(counts)).collect()
    return train([(r["text"], r["lang"]) for r in rows])


class _Worker:
    """A worker's table of word scores; emptied between chunks when full."""

    def __init__(self, model: Model):
        self.model = model
        self.empty()

    def empty(self) -> None:
        self.rows: dict[str, int] = {}
        self.scores = np.zeros((1024, len(self.model.labels)), np.float32)
        self.letters = np.zeros(1024, bool)

    def of(self, words: list[str]) -> np.ndarray:
        new = list(set(words).difference(self.rows))
        if new:
            begin, end = len(self.rows), len(self.rows) + len(new)
            while end > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.letters = np.concatenate([self.letters, np.zeros_like(self.letters)])
            self.rows.update(zip(new, range(begin, end), strict=True))
            self.scores[begin:end] = self.model.emissions(new)
            self.letters[begin:end] = [any(map(str.isalpha, w)) for w in new]
        return np.fromiter(map(self.rows.__getitem__, words), np.int64, len(words))

    def posteriors(self, texts: Iterable[str | None]):
        """(index of the text, where its words begin, posteriors of pieces, which have letters), in chunks of bounded size."""
        chunk, size = [], 0
        for i, text in enumerate(texts):
            words, starts = pieces(text) if text else ([], None)
            if not words:
                continue
            chunk.append((i, words, starts))
            size += len(words)
            if size >= CHUNK_WORDS:
                yield from self._chunk(chunk)
                chunk, size = [], 0
        yield from self._chunk(chunk)

    def _chunk(self, chunk):
        if not chunk:
            return
        if len(self.rows) > WORDS_KEPT:
            self.empty()
        chunk.sort(key=lambda x: -len(x[1]))
        lengths = np.array([len(words) for _, words, _ in chunk])
        at = self.of([w for _, words, _ in chunk for w in words])
        post, _ = forward_backward(self.scores[at], lengths, self.model.moves)
        letters = self.letters[at]
        begin = 0
        for (i, _, starts), n in zip(chunk, lengths, strict=True):
            yield i, starts, post[begin : begin + n], letters[begin : begin + n]
            begin += n


def _decide(model: Model, post: np.ndarray, letters: np.ndarray) -> tuple[str, float]:
    if not model.labels or not letters.any():
        return UND, 0.0
    mean = post[letters].mean(axis=0, dtype=np.float64)
    best = int(mean.argmax())
    return model.labels[best], float(min(1.0, max(0.0, mean[best])))


def predict(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row."""
    held = spark.sparkContext.broadcast(model)  # 2 ** BITS rows, whatever the input

    def run(batches):
        worker = _Worker(held.value)
        for batch in batches:
            n = batch.num_rows
            pred, score = [UND] * n, [0.0] * n
            if held.value.labels:
                for i, _, post, letters in worker.posteriors(x.as_py() for x in batch.column(2)):
                    pred[i], score[i] = _decide(held.value, post, letters)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(pred, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return spread(rows).mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")


def label_words(spark: SparkSession, docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, runs: the runs of words of one language in each text, as (lang, first word, end word)."""
    held = spark.sparkContext.broadcast(model)

    def run(batches):
        worker = _Worker(held.value)
        for batch in batches:
            out: list[list[tuple]] = [[] for _ in range(batch.num_rows)]
            for i, starts, post, letters in worker.posteriors(x.as_py() for x in batch.column(1)):
                best = (post if starts is None else np.add.reduceat(post, starts, axis=0)).argmax(axis=1)  # pieces of a word decide together
                breaks = np.flatnonzero(np.diff(best)) + 1
                out[i] = [{"lang": held.value.labels[best[a]], "first": int(a), "end": int(b)} for a, b in zip([0, *breaks], [*breaks, len(best)], strict=True)] if letters.any() else []
            kind = pa.list_(pa.struct([("lang", pa.string()), ("first", pa.int64()), ("end", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, kind)], ["doc_id", "runs"])

    return spread(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")).mapInArrow(run, "doc_id long, runs array<struct<lang:string,first:long,end:long>>")


def keep_known(spark: SparkSession, docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """docs without the rows whose language can't be told: those without letters, and those whose words, each
    by itself, have a label of less than `least` on average. A text in several languages stays. All columns stay."""
    held = spark.sparkContext.broadcast(model)
    place = docs.columns.index("text")

    def run(batches):
        worker = _Worker(held.value)
        for batch in batches:
            keep = np.zeros(batch.num_rows, bool)
            for i, _, post, letters in worker.posteriors(x.as_py() for x in batch.column(place)):
                lang, _ = _decide(held.value, post, letters)
                keep[i] = lang != UND and post[letters].max(axis=1).mean(dtype=np.float64) >= least
            yield batch.filter(pa.array(keep))

    return spread(docs).mapInArrow(run, docs.schema)
