"""Queries of the prefix index and of scheduling by it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import lookup, prefix, striping
from tessera.plans import query
from tessera.plans.tables import BLK, BLOCK, REQ, requests

KNOWN = "known AS (SELECT DISTINCT model, block_key FROM blk WHERE turn = 0)"
MATCH = f"""m AS (SELECT b.request, coalesce(min(CASE WHEN k.block_key IS NULL THEN block_idx END), max(n_blocks)) * {BLOCK} AS matched
  FROM blk b LEFT JOIN known k ON b.model = k.model AND b.block_key = k.block_key GROUP BY b.request),
lp AS (SELECT req.request, req.model, conv_id, turn, len(tokens) AS n_tokens, coalesce(matched, 0) AS matched FROM req LEFT JOIN m ON req.request = m.request)"""


def _matches(spark, d):
    r = requests(spark, d)
    known = prefix.register_blocks(None, r.where("turn = 0"), BLOCK)
    m = prefix.longest_prefix(r, known, BLOCK)
    return m.join(r.select("request", "conv_id", "turn", F.size("tokens").alias("n_tokens")), "request")


@query("PFX-01 PFX-06 JOIN-07 WIN-01", f"WITH {REQ}, {BLK}, {KNOWN}, {MATCH} SELECT request, model, matched FROM lp")
def longest_prefix(spark, d):
    r = requests(spark, d)
    return prefix.longest_prefix(r, prefix.register_blocks(None, r.where("turn = 0"), BLOCK), BLOCK)


@query("PFX-02 PFX-05", f"WITH {REQ}, {BLK} SELECT model, count(DISTINCT block_key) AS registered FROM blk WHERE turn <= 1 GROUP BY model")
def registered_blocks(spark, d):
    r = requests(spark, d)
    first = prefix.register_blocks(None, r.where("turn = 0"), BLOCK)
    return prefix.register_blocks(first, r.where("turn = 1"), BLOCK).groupBy("model").agg(F.count(F.lit(1)).alias("registered"))


@query("PFX-03", f"WITH {REQ}, {BLK} SELECT model, block_key, count(*) AS prefix_count FROM blk GROUP BY model, block_key")
def prefix_counts(spark, d):
    return prefix.register_prefixes(requests(spark, d), BLOCK)


@query("PFX-04 SET-03", f"""WITH {REQ}, {BLK}, known AS (SELECT model, block_key FROM blk WHERE turn = 0 EXCEPT SELECT model, block_key FROM blk WHERE block_idx = 1), {MATCH}
SELECT request, model, matched FROM lp""")
def removed_blocks(spark, d):
    r = requests(spark, d)
    known = prefix.register_blocks(None, r.where("turn = 0"), BLOCK)
    gone = prefix.blocks(r, BLOCK).where("block_idx = 1")
    return prefix.longest_prefix(r, prefix.matchable(prefix.remove_blocks(known, gone)), BLOCK)


@query("PFX-04 PRD-04", f"""WITH {REQ}, {BLK}, known AS (SELECT model, block_key FROM blk WHERE turn = 0 EXCEPT SELECT model, block_key FROM blk WHERE block_idx = 1),
k2 AS (SELECT * FROM known UNION SELECT model, block_key FROM blk WHERE turn = 1) SELECT model, count(*) AS matchable FROM k2 GROUP BY model""")
def matchable_blocks(spark, d):
    r = requests(spark, d)
    known = prefix.register_blocks(None, r.where("turn = 0"), BLOCK)
    left = prefix.remove_blocks(known, prefix.blocks(r, BLOCK).where("block_idx = 1"))
    return prefix.matchable(left, prefix.register_prefixes(r.where("turn = 1"), BLOCK)).groupBy("model").agg(F.count(F.lit(1)).alias("matchable"))


@query("PFX-07", f"WITH {REQ}, {BLK}, {KNOWN}, {MATCH} SELECT request, greatest(0, least(matched - turn, n_tokens - turn - 1)) AS new_tokens FROM lp")
def new_external_tokens(spark, d):
    m = _matches(spark, d)
    return m.select("request", prefix.new_tokens(F.col("matched"), F.col("turn"), F.col("n_tokens")).alias("new_tokens"))


LAYERS = "lay AS (SELECT request, 'blocks_' || (n_tokens // 4) || '_tp' || r AS layer, conv_id, turn, r FROM lp, (SELECT unnest(range(4)) AS r))"
FOUND = "fnd AS (SELECT request, count(*) AS n_layers, string_agg(CASE WHEN (conv_id + r) % 5 = 4 AND turn % 2 = 1 THEN layer END, ',' ORDER BY layer) AS missing, count(CASE WHEN (conv_id + r) % 5 = 4 AND turn % 2 = 1 THEN 1 END) = 0 AS hit FROM lay GROUP BY request)"


def _probe(spark, d):
    m = _matches(spark, d)
    name = F.concat(F.lit("blocks_"), F.floor(F.col("n_tokens") / 4).cast("string"), F.lit("_tp"), F.col("r").cast("string"))
    layers = m.withColumn("r", F.explode(F.sequence(F.lit(0), F.lit(3)))).select(F.col("request").alias("key"), name.alias("layer"), "conv_id", "turn", "r")
    existing = layers.where(~(((F.col("conv_id") + F.col("r")) % 5 == 4) & (F.col("turn") % 2 == 1)))
    return m, lookup.universal_probe(m.select(F.col("request").alias("key")), layers.select("key", "layer"), existing)


@query("PRD-06 PRD-05", f"WITH {REQ}, {BLK}, {KNOWN}, {MATCH}, {LAYERS}, {FOUND} SELECT request, n_layers, coalesce(missing, '') AS missing, hit FROM fnd")
def universal_probe(spark, d):
    _, p = _probe(spark, d)
    return p.select(F.col("key").alias("request"), "n_layers", F.array_join("missing", ",").alias("missing"), "hit")


@query("PFX-08", f"""WITH {REQ}, {BLK}, {KNOWN}, {MATCH}, {LAYERS}, {FOUND} SELECT lp.request, CASE WHEN matched < n_tokens // 4 * 4 AND hit THEN n_tokens // 4 * 4 ELSE matched END AS matched, matched < n_tokens // 4 * 4 AND hit AS promoted
FROM lp JOIN fnd ON lp.request = fnd.request""")
def probe_and_promote(spark, d):
    m, p = _probe(spark, d)
    rows = m.withColumn("full", F.floor(F.col("n_tokens") / 4) * 4)
    return prefix.promote(rows, p.select(F.col("key").alias("request"), F.col("hit").alias("all_found")))


BLOCK_IDS = "bid AS (SELECT *, list_transform(range((n_tokens + 3) // 4), lambda i: i * 2 + conv_id) AS block_ids FROM lp)"


def _allocated(m, short="false"):
    """A block id for every block of a request, the last begun one included; for short requests one less than they need."""
    n = F.when(F.expr(short), F.floor(F.col("n_tokens") / BLOCK) - 1).otherwise(F.ceil(F.col("n_tokens") / BLOCK)).cast("int")
    return m.select("request", F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: i * 2 + F.col("conv_id"))).otherwise(F.array().cast("array<bigint>")).alias("block_ids"))


@query("JOIN-08 SET-04 CON-01", f"WITH {REQ}, {BLK}, {KNOWN}, {MATCH}, {BLOCK_IDS} SELECT request, matched // 4 AS n_blocks, array_to_string(block_ids[1:matched // 4], ',') AS blocks FROM bid WHERE matched >= 4")
def load_specs(spark, d):
    m = _matches(spark, d)
    s = lookup.load_specs(m, _allocated(m), BLOCK)
    return s.select("request", "n_blocks", F.array_join(F.transform("block_ids", lambda x: x.cast("string")), ",").alias("blocks"))


@query("JOIN-09 CON-10", f"WITH {REQ}, {BLK}, {KNOWN}, {MATCH}, {BLOCK_IDS} SELECT request, n_tokens // 4 AS need, conv_id % 5 = 4 AND turn % 2 = 1 AS deferred FROM bid WHERE n_tokens // 4 > 0 AND matched < n_tokens // 4 * 4")
def store_specs(spark, d):
    m = _matches(spark, d)
    return lookup.store_specs(m, _allocated(m, "conv_id % 5 = 4 and turn % 2 = 1"), BLOCK)


@query("PFX-10", """WITH e AS (SELECT user_id AS request, event_id AS seq, CASE event_type WHEN 'signup' THEN 'new' WHEN 'purchase' THEN 'resumed' ELSE 'cached' END AS kind FROM events),
s AS (SELECT request, max(seq) AS start FROM e WHERE kind <> 'cached' GROUP BY request)
SELECT e.request, string_agg(seq || ',' || (seq + 1), ',' ORDER BY seq) AS blocks FROM e LEFT JOIN s ON e.request = s.request WHERE start IS NULL OR seq >= start GROUP BY e.request""")
def accumulated_blocks(spark, d):
    from tessera.plans.tables import table

    e = table(spark, d, "events")
    kind = F.when(F.col("event_type") == "signup", "new").when(F.col("event_type") == "purchase", "resumed").otherwise("cached")
    rows = e.select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), kind.alias("kind"), F.array(F.col("event_id"), F.col("event_id") + 1).alias("block_ids"))
    return prefix.accumulate_blocks(rows).select("request", F.array_join(F.transform("block_ids", lambda x: x.cast("string")), ",").alias("blocks"))


@query("KEY-18 CON-10", f"WITH {REQ}, p AS (SELECT request, conv_id, unnest(range(len(tokens))) AS pos FROM req) SELECT request, pos, ((conv_id + pos // 4 * 3) * 4 + pos % 4)::BIGINT AS slot FROM p")
def slot_mapping(spark, d):
    r = requests(spark, d)
    n = F.size("tokens")
    blocks = F.when(n > 0, F.transform(F.sequence(F.lit(0), F.ceil(n / BLOCK).cast("int") - 1), lambda b: F.col("conv_id") + 3 * b)).otherwise(F.array().cast("array<bigint>"))
    return striping.slots(r.select("request", n.alias("n"), blocks.alias("block_ids")), BLOCK)
