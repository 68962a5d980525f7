"""Quality classifier with empirical Bayes shrinkage of sites.

A logistic model over hashed words and the shape of a text gives each document's evidence. Evidence
is summed for each path and host in one aggregation. Hosts shrink to the global rate and paths to
their host's, each with the strength that the spread of the grouped rates calls for (method of
moments), so a sparse site stays near its prior. A document's posterior odds are its evidence times
its path's odds over the global ones.

A second head of the same model finds toxic texts. The model is fitted on the driver from the features
of at most FIT_ROWS labelled documents, which executors take from whole texts; everything else covers
all documents.

Defined results: null text is empty, and texts are read whole, however long; null host or path is a
site of its own; of several labels of a document the lowest quality and the highest toxicity count; of
several texts of one doc_id that of the largest digest is fitted; rows that repeat each count for their
site and get a row; without labels all evidence is 0.5. An empty table gives no rows; other columns
aren't read.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import spread, stored

BITS, FIT_ROWS = 18, 8000
EPOCHS, BATCH, RATE, DECAY, SEED, LEAST_RATIO = 16, 16, 0.3, 1e-5, 3, 25.0
WORDS_KEPT = 200_000
SHAPES, PREFIXES = 12, (4, 5, 6)
EDGES = ".,;:!?\"'()[]{}"
#: Weight of a site's odds, and the bounds of prior strength in documents.
SITE_WEIGHT, LEAST_STRENGTH, MOST_STRENGTH = 0.5, 5.0, 1e6


class Features:
    def __init__(self):
        self.known: dict[str, int] = {}

    def of(self, text: str | None) -> tuple[np.ndarray, np.ndarray]:
        """Rows of the hashed words and beginnings of words that occur, and the shape of the text."""
        text = text or ""
        words = text.split()
        known = self.known
        if len(known) > WORDS_KEPT:
            known.clear()
        distinct = set(words)
        for w in distinct.difference(known):
            plain = w.strip(EDGES).lower()
            forms = {plain, *(plain[:k] + "\0" for k in PREFIXES if len(plain) > k)}
            known[w] = [xxhash.xxh32_intdigest(f) & ((1 << BITS) - 1) for f in forms]
        found: set[int] = set()
        for w in distinct:
            found.update(known[w])
        rows = np.fromiter(found, np.int64, len(found))
        n, chars = max(1, len(words)), max(1, len(text))
        letters = sum(map(len, words))
        lines = text.split("\n")
        ends = [w[-1] for w in words]
        shape = np.array([
            1.0, math.log1p(len(words)) / 5, len(distinct) / n, letters / n / 8,
            sum(not c.isalnum() for c in ends) / n,
            sum(c in "%&$#*!|" for c in ends) / n,
            words.count("|") / n,
            sum(map(str.isupper, words)) / n,
            sum(map(str.isdigit, words)) / n,
            sum(a == b for a, b in zip(words, words[1:], strict=False)) / n,
            len(set(lines)) / len(lines),
            text.count("\n") / chars * 50,
        ])
        return rows, shape


def logistic(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def telling(rows: list[np.ndarray], gold: np.ndarray) -> np.ndarray:
    """Which words' occurrence depends on a label: those of a log-likelihood ratio above LEAST_RATIO."""
    flat, sizes = np.concatenate(rows), [len(r) for r in rows]
    seen = np.bincount(flat, minlength=1 << BITS)
    use = np.zeros(1 << BITS, bool)
    for k in range(gold.shape[1]):
        n, n1 = len(gold), gold[:, k].sum()
        with_label = np.bincount(flat, np.repeat(gold[:, k], sizes), minlength=1 << BITS)
        table = (with_label, seen - with_label, n1 - with_label, n - n1 - seen + with_label)
        expected = (seen * n1 / n, seen * (n - n1) / n, (n - seen) * n1 / n, (n - seen) * (n - n1) / n)
        ratio = 2 * sum(o * np.log(np.maximum(o, 1e-9) / np.maximum(e, 1e-9)) for o, e in zip(table, expected, strict=True))
        use |= (ratio > LEAST_RATIO) & (seen >= 5)
    return use


class Model:
    """Two heads: quality and toxicity."""

    def __init__(self):
        self.words, self.shape = np.zeros((1 << BITS, 2), np.float32), np.zeros((SHAPES, 2))
        self.fitted = False

    def score(self, rows: np.ndarray, shape: np.ndarray) -> np.ndarray:
        return logistic(self.words[rows].sum(axis=0) + shape @ self.shape) if self.fitted else np.full(2, 0.5)

    def fit(self, found: list[tuple[np.ndarray, np.ndarray]], quality: list[int], toxic: list[int]) -> Model:
        """found: features of each text."""
        if not found:
            return self
        gold = np.array([quality, toxic], float).T
        # only words that go with a label beyond chance carry over to other documents
        use = np.flatnonzero(telling([r for r, _ in found], gold))
        place = np.full(1 << BITS, -1)
        place[use] = np.arange(len(use))
        rows = [p[p >= 0] for p in (place[r] for r, _ in found)]
        shapes = np.array([s for _, s in found])
        sizes = np.array([len(r) for r in rows])
        begin, flat = np.cumsum(sizes) - sizes, np.concatenate(rows)
        words, sums, shape_sums = np.zeros((len(use), 2)), np.full((len(use), 2), 1e-2), np.full_like(self.shape, 1e-2)
        rng = np.random.default_rng(SEED)
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for at in range(0, len(order), BATCH):
                part = order[at : at + BATCH]
                of = np.repeat(np.arange(len(part)), sizes[part])
                ids = flat[np.repeat(begin[part], sizes[part]) + np.arange(len(of)) - np.repeat(np.cumsum(sizes[part]) - sizes[part], sizes[part])]
                known = np.stack([np.bincount(of, words[ids, k], minlength=len(part)) for k in range(2)], axis=1)
                slope = logistic(known + shapes[part] @ self.shape) - gold[part]
                seen, inverse = np.unique(ids, return_inverse=True)
                g = np.stack([np.bincount(inverse, slope[of, k], minlength=len(seen)) for k in range(2)], axis=1) + DECAY * words[seen]
                sums[seen] += g * g
                words[seen] -= RATE / 2 * g / np.sqrt(sums[seen])
                g = shapes[part].T @ slope
                shape_sums += g * g
                self.shape -= RATE * g / np.sqrt(shape_sums)
        self.words[use] = words
        self.fitted = True
        return self


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS) -> Model:
    """From at most `rows` labelled documents, drawn by a hash of their ids."""
    known = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.min("quality").alias("_quality"), F.max(F.coalesce("toxic", F.lit(0))).alias("_toxic"))
    drawn = known.orderBy(F.xxhash64("doc_id", F.lit(SEED)), "doc_id").limit(rows)
    text = F.coalesce("text", F.lit(""))
    one = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).join(F.broadcast(drawn), "doc_id").groupBy("doc_id").agg(
        F.max_by("text", F.sha2(F.col("text").cast("binary"), 256)).alias("text"), F.first("_quality").alias("quality"), F.first("_toxic").alias("toxic"))

    def run(batches):
        features = Features()
        for batch in batches:
            found = [features.of(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([np.sort(r).astype(np.int32).tobytes() for r, _ in found], pa.binary()), pa.array([s.tobytes() for _, s in found], pa.binary()), batch.column(2), batch.column(3)],
                ["doc_id", "words", "shape", "quality", "toxic"])

    # a row for each drawn document, of 2 ** BITS numbers at most
    got = one.selectExpr("doc_id", "text", "cast(quality as int) quality", "cast(toxic as int) toxic").mapInArrow(run, "doc_id long, words binary, shape binary, quality int, toxic int").collect()
    got = sorted(got, key=lambda r: r["doc_id"])
    found = [(np.frombuffer(r["words"], np.int32).astype(np.int64), np.frombuffer(r["shape"])) for r in got]
    return Model().fit(found, [int(r["quality"] > 0) for r in got], [int(r["toxic"] > 0) for r in got])


def evidence(spark: SparkSession, sited: DataFrame, model: Model) -> DataFrame:
    """From (doc_id, host, path, text): doc_id, host, path, evidence, toxic."""
    held = spark.sparkContext.broadcast(model)  # 2 ** BITS rows, whatever the input

    def run(batches):
        features = Features()
        for batch in batches:
            scores = np.array([held.value.score(*features.of(t.as_py())) for t in batch.column(3)]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(scores[:, 0]), pa.array(scores[:, 1])], ["doc_id", "host", "path", "evidence", "toxic"])

    return spread(sited.select("doc_id", "host", "path", "text")).mapInArrow(run, "doc_id long, host string, path string, evidence double, toxic double")


def _strength(mean, spread):
    """Prior strength from the mean and the variance between groups."""
    return F.least(F.greatest(mean * (1 - mean) / F.greatest(spread, F.lit(1e-9)) - 1, F.lit(LEAST_STRENGTH)), F.lit(MOST_STRENGTH))


def shrink(scored: DataFrame) -> DataFrame:
    """host, path -> n, global_rate, host_rate, path_rate. Null sites take part as sites."""
    paths = stored(scored.groupBy("host", "path").agg(F.count(F.lit(1)).alias("n"), F.sum("evidence").alias("s"), F.sum(F.col("evidence") * F.col("evidence")).alias("ss")), "paths")
    total = paths.agg(F.sum("n").alias("N"), (F.sum("s") / F.sum("n")).alias("global_rate"))

    def between(groups: DataFrame, prior: str) -> DataFrame:
        """Variance of the groups' rates around `prior` beyond what sampling gives: a single row."""
        rate = F.col("s") / F.col("n")
        within = (F.col("ss") / F.col("n") - rate * rate) / F.col("n")
        gap = rate - F.col(prior)
        return groups.agg((F.sum(F.col("n") * (gap * gap - within)) / F.sum("n")).alias("spread"))

    hosts = paths.groupBy("host").agg(*(F.sum(c).alias(c) for c in ("n", "s", "ss"))).join(F.broadcast(total.select("global_rate")))
    hosts = stored(hosts, "hosts")
    k = _strength(F.col("global_rate"), F.col("spread"))
    hosts = hosts.join(F.broadcast(between(hosts, "global_rate"))).select("host", "global_rate", ((F.col("s") + k * F.col("global_rate")) / (F.col("n") + k)).alias("host_rate"))
    joined = paths.join(hosts.withColumnRenamed("host", "_h"), F.col("host").eqNullSafe(F.col("_h"))).drop("_h")
    joined = stored(joined, "paths-of-hosts")
    k = _strength(F.col("host_rate"), F.col("spread"))
    return joined.join(F.broadcast(between(joined, "host_rate"))).select("host", "path", "n", "global_rate", "host_rate", ((F.col("s") + k * F.col("host_rate")) / (F.col("n") + k)).alias("path_rate"))


def classify(spark: SparkSession, sited: DataFrame, model: Model) -> DataFrame:
    """From (doc_id, host, path, text): doc_id, evidence, host_rate, path_rate, quality, toxic, keep."""
    scored = stored(evidence(spark, sited, model), "evidence")
    sites = stored(shrink(scored).withColumnsRenamed({"host": "_host", "path": "_path"}), "sites")
    rows = scored.join(sites, F.col("host").eqNullSafe(F.col("_host")) & F.col("path").eqNullSafe(F.col("_path")), "left")

    def logit(c):
        c = F.least(F.greatest(c, F.lit(1e-9)), F.lit(1 - 1e-9))
        return F.log(c / (1 - c))

    odds = logit(F.col("evidence")) + F.lit(SITE_WEIGHT) * (logit(F.col("path_rate")) - logit(F.col("global_rate")))
    quality = 1 / (1 + F.exp(-odds))
    return rows.withColumn("quality", quality).select("doc_id", "evidence", "host_rate", "path_rate", "quality", "toxic", ((F.col("quality") >= 0.5) & (F.col("toxic") < 0.5)).alias("keep"))


def sites_of_documents(docs: DataFrame) -> DataFrame:
    """The source stands for a document's host, the source with the language for its path."""
    lang = F.coalesce(F.col("lang").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("host"), F.concat_ws("/", "source", lang).alias("path"), "text")
