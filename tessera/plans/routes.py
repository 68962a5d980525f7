"""Queries of routing, sharding and striping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.functions import numeric, routing, xxh3
from tessera.operators import placement, striping
from tessera.plans import query
from tessera.plans.tables import OBJ, objects, table
from tessera.plans.xxh3_sql import hash_sql


def md5_mod_sql(x: str, n: int) -> str:
    out = "0::HUGEINT"
    for i in (1, 9, 17, 25):
        out = f"(({out} * 4294967296 + ('0x' || substr(md5({x}), {i}, 8))::BIGINT) % {n})"
    return out + "::INT"


@query("RTE-01 RTE-02 SRC-07", f"""WITH {OBJ} SELECT doc_id, {md5_mod_sql('object_key', 7)} AS child, CASE WHEN doc_id % 2 = 0 AND namespace <> '' THEN {md5_mod_sql('namespace', 4)} ELSE {md5_mod_sql('object_key', 4)} END AS shard FROM obj""")
def route_md5(spark, d):
    o = objects(spark, d)
    policy = F.when(F.col("doc_id") % 2 == 0, "layer").otherwise("block")
    return o.select("doc_id", routing.md5_mod(F.col("object_key"), 7).alias("child"), routing.shard(F.col("object_key"), F.col("namespace"), policy, 4).alias("shard"))


@query("RTE-06 IOX-10", f"WITH {OBJ} SELECT {md5_mod_sql('object_key', 8)} AS device, count(*) AS n, sum(size)::BIGINT AS bytes, min(object_key) AS first_key FROM obj GROUP BY 1")
def group_by_device(spark, d):
    o = objects(spark, d).withColumn("device", routing.md5_mod(F.col("object_key"), 8))
    return o.groupBy("device").agg(F.count(F.lit(1)).alias("n"), F.sum("size").alias("bytes"), F.min("object_key").alias("first_key"))


@query("RTE-03 RTE-05", f"WITH {OBJ}, h AS (SELECT doc_id, {hash_sql('object_key')} AS h FROM obj) SELECT doc_id, (h % 8)::INT AS device, ((h % 3)::INT + doc_id % 5) % 3 AS node FROM h")
def route_xxh3(spark, d):
    o = objects(spark, d)
    return o.select("doc_id", xxh3.xxh3_mod(F.col("object_key"), 8).alias("device"), placement.data_node(F.col("object_key"), F.col("doc_id") % 5, 3).alias("node"))


STRIPES = """cut AS (SELECT doc_id, size, unnest(range((size + 511) // 512)) AS stripe_index FROM obj)"""


@query("RTE-08 RTE-04 STG-03 PLC-02 MUT-11 API-07", f"WITH {OBJ}, {STRIPES} SELECT doc_id::VARCHAR AS key, stripe_index, stripe_index * 512 AS \"offset\", least(512, size - stripe_index * 512) AS length, (({md5_mod_sql('doc_id::VARCHAR', 4)} + stripe_index) % 4)::INT AS device FROM cut")
def stripes_placed(spark, d):
    o = objects(spark, d).select(F.col("doc_id").cast("string").alias("key"), "size")
    return striping.placed(striping.stripes(o, 512), 4)


@query("PRD-11 STG-02 RTE-07 WIN-03", f"WITH {OBJ} SELECT doc_id, size > 4096 AS striped, CASE WHEN doc_id % 3 = 0 THEN '/old/' || doc_id ELSE '/new/' || {md5_mod_sql('object_key', 4)} END AS path, CASE WHEN doc_id % 6 < 4 THEN doc_id % 6 ELSE 0 END AS device FROM obj")
def stripe_decision(spark, d):
    o = objects(spark, d)
    stored_path = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("/old/"), F.col("doc_id").cast("string"))).otherwise("")
    routed = F.concat(F.lit("/new/"), routing.md5_mod(F.col("object_key"), 4).cast("string"))
    device = F.col("doc_id") % 6
    return o.select("doc_id", routing.should_stripe(F.col("size"), 4096, 4).alias("striped"), routing.stored_or_routed(stored_path, routed).alias("path"), routing.valid_device(device, F.lit(0), 4).alias("device"))


@query("RTE-09 WIN-05", "SELECT p_partkey, n, i AS lane, (p_size // n + CASE WHEN i < p_size % n THEN 1 ELSE 0 END)::INT AS lane_size FROM (SELECT *, unnest(range(n)) AS i FROM (SELECT *, 4 AS n FROM part))")
def partition_counts(spark, d):
    p = table(spark, d, "part").withColumn("n", F.lit(4))
    return p.select("p_partkey", "n", F.posexplode(routing.partition_counts(F.col("p_size"), 4)).alias("lane", "lane_size"))


@query("RTE-10 CON-05 PYC-05", """SELECT conv_id, turn, i AS chunk, octet_length(c)::BIGINT AS nbytes, sha256(c) AS digest FROM (SELECT conv_id, turn, i, raw[i * 64 + 1 : i * 64 + 64] AS c FROM
(SELECT *, unnest(range(greatest(1, (octet_length(raw) + 63) // 64))) AS i FROM (SELECT conv_id, turn, encode(coalesce(text, '')) AS raw FROM conversations)))""")
def byte_chunks(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select("conv_id", "turn", F.posexplode(routing.byte_chunks(F.coalesce("text", F.lit("")), 64)).alias("chunk", "c"))
    return rows.select("conv_id", "turn", "chunk", F.octet_length("c").cast("long").alias("nbytes"), F.sha2("c", 256).alias("digest"))


ITEMS = "CASE s_suppkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'a' WHEN 2 THEN 'a, b ,c' ELSE ' x,,y ' END"


@query("RTE-12 RTE-13 RTE-14", f"""WITH s AS (SELECT s_suppkey, {ITEMS} AS csv FROM supplier), t AS (SELECT *, list_filter(list_transform(string_split(csv, ','), lambda x: trim(x)), lambda x: x <> '') AS l FROM s)
SELECT s_suppkey, array_to_string(l, '|') AS items, CASE WHEN len(l) = 0 THEN csv WHEN len(l) = 3 THEN l[s_suppkey % 3 + 1] WHEN len(l) = 1 THEN l[1] ELSE l[s_suppkey % 3 % len(l) + 1] END AS own, (s_suppkey % 2)::INT AS nic FROM t""")
def csv_slices(spark, d):
    m = F.col("s_suppkey") % 4
    csv = F.when(m == 0, "").when(m == 1, "a").when(m == 2, "a, b ,c").otherwise(" x,,y ")
    s = table(spark, d, "supplier").withColumn("csv", csv)
    return s.select("s_suppkey", F.array_join(routing.csv_items(F.col("csv")), "|").alias("items"), routing.slice_csv(F.col("csv"), F.lit(3), (F.col("s_suppkey") % 3).cast("int")).alias("own"), F.pmod("s_suppkey", F.lit(2)).cast("int").alias("nic"))


SEG = "seg AS (SELECT l_orderkey::VARCHAR AS key, l_linenumber AS seg, (l_quantity * 20)::BIGINT AS length FROM lineitem)"


def _segments(spark, d):
    t = table(spark, d, "lineitem")
    return t.select(F.col("l_orderkey").cast("string").alias("key"), F.col("l_linenumber").alias("seg"), (F.col("l_quantity") * 20).cast("long").alias("length"))


def _unique_segments(spark, d):
    return _segments(spark, d).groupBy("key", "seg").agg(F.sum("length").alias("length"))


USEG = SEG + ", useg AS (SELECT key, seg, sum(length)::BIGINT AS length FROM seg GROUP BY key, seg)"


@query("JOIN-10 STG-02", f"""WITH {USEG}, o AS (SELECT *, sum(length) OVER w - length AS a, sum(length) OVER w AS b FROM useg WINDOW w AS (PARTITION BY key ORDER BY seg)),
s AS (SELECT *, unnest(range((a // 512)::BIGINT, ((b - 1) // 512 + 1)::BIGINT)) AS stripe_index FROM o WHERE length > 0)
SELECT key, stripe_index, seg, (greatest(a, stripe_index * 512) - a)::BIGINT AS seg_offset, (greatest(a, stripe_index * 512) - stripe_index * 512)::BIGINT AS stripe_offset, (least(b, (stripe_index + 1) * 512) - greatest(a, stripe_index * 512))::BIGINT AS length FROM s""")
def rebucket(spark, d):
    return striping.rebucket(_unique_segments(spark, d), 512)


@query("RTE-11 STR-02 WIN-02 API-08", f"""WITH {USEG}, p AS (SELECT key, seg, i, least(256, length - i * 256) AS n FROM (SELECT *, unnest(range((length + 255) // 256)) AS i FROM useg)),
r AS (SELECT key, row_number() OVER w AS seq, sum(n) OVER w - n AS "offset", n AS length, sum(n) OVER (PARTITION BY key) AS total_size, count(*) OVER (PARTITION BY key) AS c FROM p WINDOW w AS (PARTITION BY key ORDER BY seg, i ROWS UNBOUNDED PRECEDING))
SELECT key, seq::INT AS seq, "offset"::BIGINT AS "offset", length::BIGINT AS length, total_size::BIGINT AS total_size, seq = c AS is_last FROM r""")
def sub_chunks(spark, d):
    return striping.sub_chunks(_unique_segments(spark, d), 256)


@query("STR-03 PYC-05", f"""WITH {USEG}, p AS (SELECT key, seg, i FROM (SELECT *, unnest(range((length + 255) // 256)) AS i FROM useg)), r AS (SELECT key, row_number() OVER (PARTITION BY key ORDER BY seg, i) AS seq FROM p)
SELECT key, seq::INT AS seq, CASE WHEN seq = 1 THEN 'd' || key END AS descriptor FROM r""")
def descriptor_stream(spark, d):
    rows = striping.sub_chunks(_unique_segments(spark, d), 256).select("key", "seq", F.concat(F.lit("d"), F.col("key")).alias("descriptor"))
    return striping.first_only(rows, ["descriptor"])


LANES = "n AS (SELECT key, count(*) AS c FROM useg GROUP BY key), ln AS (SELECT key, seg, ntile(4) OVER (PARTITION BY key ORDER BY seg) - 1 AS lane FROM useg), every AS (SELECT key, unnest(range(4)) AS lane FROM n)"


@query("STR-07 RTE-09", f"WITH {USEG}, {LANES} SELECT e.key, e.lane, seg, seg IS NULL AS is_padding FROM every e LEFT JOIN ln ON e.key = ln.key AND e.lane = ln.lane")
def lane_split(spark, d):
    return striping.lanes(_unique_segments(spark, d), 4)


@query("STR-07 STR-08", f"WITH {USEG}, {LANES}, f AS (SELECT e.key, e.lane, seg FROM every e LEFT JOIN ln ON e.key = ln.key AND e.lane = ln.lane WHERE NOT (e.lane = 3 AND e.key LIKE '%7')) SELECT key, count(DISTINCT lane) = 4 AS hit, CASE WHEN count(DISTINCT lane) = 4 THEN string_agg(seg, ',' ORDER BY seg) END AS segs FROM f GROUP BY key")
def lane_gather(spark, d):
    rows = striping.lanes(_unique_segments(spark, d), 4).where(~((F.col("lane") == 3) & F.col("key").endswith("7")))
    return striping.gather_lanes(rows, 4).select("key", "hit", F.array_join(F.transform("segs", lambda x: x.cast("string")), ",").alias("segs"))


@query("RTE-17", f"WITH {USEG} SELECT key, seg AS pos, length AS nbytes, coalesce(sum(length) OVER (PARTITION BY key ORDER BY seg ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS \"offset\", sum(length) OVER (PARTITION BY key)::BIGINT AS total FROM useg")
def byte_layout(spark, d):
    return striping.byte_layout(_unique_segments(spark, d).withColumnsRenamed({"seg": "pos", "length": "nbytes"}))


PIECES = "SELECT conv_id, turn, encode(coalesce(text, '')) AS data FROM conversations"


@query("STR-01 STR-04 PLC-03 PLC-08 WIN-06", """WITH c AS (SELECT conv_id, turn, coalesce(text, '') AS t, turn >= 3 AND turn % 3 = 0 AS is_last FROM conversations), e AS (SELECT conv_id, min(turn) AS e FROM c WHERE is_last GROUP BY conv_id)
SELECT c.conv_id::VARCHAR AS stream_id, arg_min('h' || turn, turn) AS header, sha256(string_agg(t, '' ORDER BY turn)) AS digest, count(*) AS chunks, 'ok' AS status FROM c LEFT JOIN e ON c.conv_id = e.conv_id WHERE e IS NULL OR turn <= e GROUP BY c.conv_id""")
def assembled_streams(spark, d):
    c = table(spark, d, "conversations")
    rows = c.select(F.col("conv_id").cast("string").alias("stream_id"), F.col("turn").alias("seq"), F.coalesce("text", F.lit("")).cast("binary").alias("data"), F.concat(F.lit("h"), F.col("turn").cast("string")).alias("header"), ((F.col("turn") >= 3) & (F.col("turn") % 3 == 0)).alias("is_last"))
    return striping.assemble_stream(rows).select("stream_id", "header", F.sha2("data", 256).alias("digest"), "chunks", "status")


@query("WIN-06 WIN-07 PLC-03 COD-08", """WITH c AS (SELECT conv_id::VARCHAR AS key, turn AS chunk, (conv_id + turn) % 5 <> 3 AS found FROM conversations), g AS (SELECT key, min(CASE WHEN NOT found THEN chunk END) AS g FROM c GROUP BY key)
SELECT c.key, chunk, found FROM c JOIN g ON c.key = g.key WHERE g IS NULL OR chunk < g""")
def leading_run(spark, d):
    c = table(spark, d, "conversations").select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("chunk"), ((F.col("conv_id") + F.col("turn")) % 5 != 3).alias("found"))
    return striping.leading_run(c)


@query("AGG-17 STG-06", f"WITH {OBJ}, {STRIPES} SELECT doc_id, min(least(512, size - stripe_index * 512)) AS min_len, max(least(512, size - stripe_index * 512)) AS max_len, count(*) AS n, sum((least(512, size - stripe_index * 512) + 4095) // 4096 * 4096)::BIGINT AS aligned FROM cut GROUP BY doc_id")
def stripe_plan(spark, d):
    o = objects(spark, d).select(F.col("doc_id").alias("key"), "size")
    s = striping.stripes(o, 512)
    return s.groupBy(F.col("key").alias("doc_id")).agg(F.min("length").alias("min_len"), F.max("length").alias("max_len"), F.count(F.lit(1)).alias("n"), F.sum(numeric.align_up(F.col("length"), 4096)).cast("long").alias("aligned"))


@query("STG-07 API-07 API-08", "SELECT l_orderkey, l_linenumber, CASE WHEN l_suppkey % 3 > 0 AND (l_suppkey % 3) * 10 <> l_quantity::INT % 3 * 10 THEN 'length_mismatch' ELSE 'ok' END AS status FROM lineitem")
def placement_chunk_writes(spark, d):
    t = table(spark, d, "lineitem")
    return t.select("l_orderkey", "l_linenumber", placement.chunk_write(F.col("l_suppkey") % 3 * 10, F.col("l_quantity").cast("int") % 3 * 10).alias("status"))


#: Where a versioned object or chunk lies, by its device, generation and chunk number (null for a whole object).
STEM = """'/dev' || device || '/data/' || (CASE WHEN namespace = '' THEN '_' ELSE regexp_replace(namespace, '[^A-Za-z0-9._-]', '_', 'g') END) || '/' || md5(c)[1:2] || '/' || md5(c)[3:4] || '/' || md5(c)[5:]
|| '.g' || generation || '.l1' || coalesce('.chunk' || chunk, '') || '.bin'"""


@query("RDM-04", f"""WITH {OBJ}, k AS (SELECT *, strlen(namespace) || ':' || namespace || object_key AS c, doc_id % 5 AS generation, size > 4096 AS striped FROM obj),
h AS (SELECT *, ({hash_sql('c')} % 4)::INT AS home, CASE WHEN generation = 0 THEN 'bad_version' WHEN striped AND doc_id % 7 = 0 THEN 'no_layout' ELSE 'ok' END AS status FROM k),
e AS (SELECT *, unnest(CASE WHEN status <> 'ok' THEN [NULL] WHEN striped THEN range((size + 1023) // 1024) ELSE [0] END)::INT AS stripe_index FROM h),
p AS (SELECT *, (home + stripe_index) % 4 AS device, CASE WHEN striped THEN stripe_index END AS chunk FROM e)
SELECT namespace, object_key, status, stripe_index, device, CASE WHEN stripe_index IS NOT NULL THEN {STEM} END AS path FROM p""")
def rebuilt_layouts(spark, d):
    o = objects(spark, d)
    striped = F.col("size") > 4096
    return placement.rebuilt_layout(o.select(
        "namespace", "object_key", (F.col("doc_id") % 5).alias("object_generation"), F.lit(1).alias("layout_version"), "size", striped.alias("is_striped"),
        F.when(striped & (F.col("doc_id") % 7 != 0), F.ceil(F.col("size") / 1024)).otherwise(0).cast("int").alias("stripe_count"), F.lit(1024).alias("chunk_size")), 4)


@query("PLC-01", f"""WITH {OBJ}, k AS (SELECT *, strlen(namespace) || ':' || namespace || object_key AS c, 2 AS generation FROM obj),
h AS (SELECT *, {hash_sql('c')} AS h FROM k), e AS (SELECT *, unnest(range((size + 511) // 512)) AS chunk FROM h), p AS (SELECT *, (((h % 4)::INT + chunk) % 4)::INT AS device FROM e)
SELECT namespace, object_key, chunk::INT AS stripe_index, chunk * 512 AS "offset", least(512, size - chunk * 512) AS length, (((h % 3)::INT + chunk) % 3)::INT AS node, device, {STEM} AS storage_handle FROM p""")
def stripe_locations(spark, d):
    o = objects(spark, d)
    cut = o.select("namespace", "object_key", F.explode(routing.stripe_list(F.col("size"), 512)).alias("s")).select("namespace", "object_key", F.col("s.index").alias("stripe_index"), F.col("s.offset").alias("offset"), F.col("s.length").alias("length"))
    return placement.stripe_locations(cut, 3, 4, F.lit(2), F.lit(1))


@query("STG-04", """WITH c AS (SELECT conv_id::VARCHAR AS key, turn, coalesce(text, '') AS t, 'c' || conv_id || '/' || turn AS path, (conv_id + turn) % 6 <> 5 AS there FROM conversations)
SELECT key, CASE WHEN bool_and(there) THEN sha256(string_agg(t, '' ORDER BY turn)) END AS digest, arg_min(path, turn) FILTER (NOT there) AS missing, CASE WHEN bool_and(there) THEN 'ok' ELSE 'not_found' END AS status FROM c GROUP BY key""")
def striped_reads(spark, d):
    """Turns as the stripes of a conversation; some are gone, and the first of those is named."""
    c = table(spark, d, "conversations")
    path = F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"))
    pieces = c.where("(conv_id + turn) % 6 <> 5").select(path.alias("path"), F.coalesce("text", F.lit("")).cast("binary").alias("data"))
    found = striping.read_striped(c.select(F.col("conv_id").cast("string").alias("key"), F.col("turn").alias("stripe_index"), path.alias("path")), pieces)
    return found.select("key", F.sha2("data", 256).alias("digest"), "missing", "status")


#: A model of two layers: bytes of a block.
LAYERS = [("k", 6), ("v", 10)]
KV = """sp AS (SELECT o_custkey AS request, list(o_orderkey ORDER BY o_orderdate, o_orderkey) AS block_ids FROM orders GROUP BY o_custkey), bl AS (SELECT request, unnest(block_ids) AS block_id, generate_subscripts(block_ids, 1) AS b FROM sp)"""


def _specs(spark, d):
    each = F.array_sort(F.collect_list(F.struct("o_orderdate", "o_orderkey")))
    return table(spark, d, "orders").groupBy(F.col("o_custkey").alias("request")).agg(F.transform(each, lambda x: x["o_orderkey"]).alias("block_ids"))


def _cache(spark, d):
    k = F.col("o_orderkey").cast("string")
    o = table(spark, d, "orders")
    return o.select(F.lit("k").alias("layer"), F.col("o_orderkey").alias("block_id"), F.lpad(k, 6, "k").cast("binary").alias("data")).unionByName(
        o.select(F.lit("v").alias("layer"), F.col("o_orderkey").alias("block_id"), F.lpad(k, 10, "v").cast("binary").alias("data")))


@query("COD-10", f"WITH {KV} SELECT request, string_agg(lpad(block_id::VARCHAR, 6, 'k'), '' ORDER BY b) || string_agg(lpad(block_id::VARCHAR, 10, 'v'), '' ORDER BY b) AS data FROM bl GROUP BY request")
def gathered_specs(spark, d):
    """Orders as the blocks of their customers' requests: all of layer k, then all of layer v."""
    return striping.gather_specs(_specs(spark, d), _cache(spark, d), LAYERS).withColumn("data", F.col("data").cast("string"))


@query("COD-10", f"WITH {KV} SELECT request, l AS layer, block_id, CASE l WHEN 'k' THEN lpad(block_id::VARCHAR, 6, 'k') ELSE lpad(block_id::VARCHAR, 10, 'v') END AS data FROM bl, (VALUES ('k'), ('v')) x(l)")
def scattered_specs(spark, d):
    specs = _specs(spark, d)
    return striping.scatter_specs(specs, striping.gather_specs(specs, _cache(spark, d), LAYERS), LAYERS).withColumn("data", F.col("data").cast("string"))


@query("CON-08 COD-10", "SELECT o_orderkey AS block_id, lpad(o_orderkey::VARCHAR, 6, 'k') || lpad(o_orderkey::VARCHAR, 10, 'v') AS data FROM orders")
def serialized_blocks(spark, d):
    """The form by blocks: one block id makes a spec."""
    specs = table(spark, d, "orders").select(F.col("o_orderkey").alias("request"), F.array("o_orderkey").alias("block_ids"))
    return striping.gather_specs(specs, _cache(spark, d), LAYERS).select(F.col("request").alias("block_id"), F.col("data").cast("string").alias("data"))
