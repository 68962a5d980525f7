"""Queries of caches, allocators and breakers. SQL folds a trace by recursion, an access of each cache at a time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tessera.operators import cache, health
from tessera.plans import query
from tessera.plans.tables import accesses, calls, table


ACCESSES = """acc AS (SELECT 'c' || (user_id % 8) AS cache, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'put' WHEN 'signup' THEN 'delete' ELSE 'get' END AS op, 'k' || (event_id * 7919 % 37) AS key,
floor(value)::BIGINT + 1 AS size, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i FROM events)"""


def count_sql(limit: int, fifo: bool) -> str:
    """The keys as a list, the next to go first."""
    again = "l" if fifo else "list_append(list_filter(l, lambda x: x <> key), key)"
    return f"""WITH RECURSIVE {ACCESSES},
st(cache, i, seq, hit, evicted, l) AS (SELECT DISTINCT cache, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, 0, []::VARCHAR[] FROM acc
UNION ALL SELECT acc.cache, acc.i, acc.seq, list_contains(l, key), CASE WHEN op <> 'delete' AND NOT list_contains(l, key) AND len(l) >= {limit} THEN 1 ELSE 0 END,
CASE WHEN op = 'delete' THEN list_filter(l, lambda x: x <> key) WHEN list_contains(l, key) THEN {again} WHEN len(l) >= {limit} THEN list_append(l[2:], key) ELSE list_append(l, key) END
FROM st JOIN acc ON acc.cache = st.cache AND acc.i = st.i + 1)
SELECT cache, seq, hit, evicted, len(l)::BIGINT AS used FROM st WHERE i > 0"""


def byte_sql(capacity: int, bypass: bool) -> str:
    """Keys and sizes as a list, the next to go first; n is how many go."""
    rest, total = "list_filter(l, lambda x: x.k <> key)", "coalesce(list_sum(list_transform({}, lambda x: x.s)), 0)"
    if bypass:
        fits = f"{total.format('r[n + 1 :]')} + size <= {capacity} OR n = len(r)"
        kept = f"CASE WHEN size <= {capacity} THEN list_append(r[n + 1 :], {{'k': key, 's': size}}) WHEN op = 'put' THEN r ELSE l END"
        gone = f"op = 'delete' OR hit OR size > {capacity}"
    else:
        fits, kept, gone = f"{total.format('a[n + 1 :]')} <= {capacity}", "a[n + 1 :]", "op = 'delete' OR hit"
    return f"""WITH RECURSIVE {ACCESSES},
st(cache, i, seq, hit, evicted, l) AS (SELECT DISTINCT cache, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, 0::BIGINT, []::STRUCT(k VARCHAR, s BIGINT)[] FROM acc
UNION ALL SELECT cache, i, seq, CASE WHEN op = 'delete' THEN there ELSE hit END, CASE WHEN {gone} THEN 0 ELSE n END,
CASE WHEN op = 'delete' THEN r WHEN hit THEN list_concat(r, list_filter(l, lambda x: x.k = key)) ELSE {kept} END
FROM (SELECT *, list_filter(range(len(a) + 1), lambda n: {fits})[1] AS n FROM (SELECT *, op = 'get' AND there AS hit, list_append(r, {{'k': key, 's': size}}) AS a FROM
(SELECT acc.*, l, {rest} AS r, len({rest}) < len(l) AS there FROM st JOIN acc ON acc.cache = st.cache AND acc.i = st.i + 1))))
SELECT cache, seq, hit, evicted::INT AS evicted, {total.format('l')}::BIGINT AS used FROM st WHERE i > 0"""


def two_map_sql(capacity: int) -> str:
    """As byte_sql, with a list for each form; a write makes room in its own."""
    total = "coalesce(list_sum(list_transform({}, lambda x: x.s)), 0)"
    item = "{'k': key, 's': size}"

    def after(form: str, old: str, rest: str) -> str:
        return (f"CASE WHEN op = 'delete' THEN {rest} WHEN hit THEN list_concat({rest}, list_filter({old}, lambda x: x.k = key)) WHEN size > {capacity} THEN CASE WHEN op = 'put' THEN {rest} ELSE {old} END "
                f"WHEN form = '{form}' THEN list_append({rest}[n + 1 :], {item}) ELSE {rest} END")

    return f"""WITH RECURSIVE {ACCESSES}, two AS (SELECT *, CASE WHEN size % 2 = 0 THEN 'chunks' ELSE 'single' END AS form FROM acc),
st(cache, i, seq, hit, evicted, a, b) AS (SELECT DISTINCT cache, 0::BIGINT, NULL::BIGINT, NULL::BOOLEAN, 0::BIGINT, []::STRUCT(k VARCHAR, s BIGINT)[], []::STRUCT(k VARCHAR, s BIGINT)[] FROM two
UNION ALL SELECT cache, i, seq, CASE WHEN op = 'delete' THEN there ELSE hit END, CASE WHEN op = 'delete' OR hit OR size > {capacity} THEN 0 ELSE n END, {after('chunks', 'a', 'ra')}, {after('single', 'b', 'rb')}
FROM (SELECT *, op = 'get' AND there AS hit, list_filter(range(len(own) + 1), lambda n: {total.format('own[n + 1 :]')} + {total.format('other')} + size <= {capacity} OR n = len(own))[1] AS n
FROM (SELECT *, len(ra) < len(a) OR len(rb) < len(b) AS there, CASE WHEN form = 'chunks' THEN ra ELSE rb END AS own, CASE WHEN form = 'chunks' THEN rb ELSE ra END AS other
FROM (SELECT two.*, a, b, list_filter(a, lambda x: x.k <> key) AS ra, list_filter(b, lambda x: x.k <> key) AS rb FROM st JOIN two ON two.cache = st.cache AND two.i = st.i + 1))))
SELECT cache, seq, hit, evicted::INT AS evicted, ({total.format('a')} + {total.format('b')})::BIGINT AS used FROM st WHERE i > 0"""


def best_fit_sql(total: int, unit: int = 4096) -> str:
    """Free blocks and held ones as lists: the smallest free block that fits, the lowest of equal ones."""
    block = "STRUCT(s BIGINT, a BIGINT)[]"
    return f"""WITH RECURSIVE {ACCESSES}, al AS (SELECT cache, seq, i, op = 'delete' AS free, key, greatest(1, (size * 64 + {unit - 1}) // {unit}) * {unit} AS need FROM acc),
st(cache, i, seq, place, used, high, f, h) AS (SELECT DISTINCT cache, 0::BIGINT, NULL::BIGINT, NULL::BIGINT, 0::BIGINT, 0::BIGINT, [{{'s': {total}, 'a': 0}}]::{block}, []::STRUCT(k VARCHAR, s BIGINT, a BIGINT)[] FROM al
UNION ALL SELECT cache, i, seq, place, now, greatest(high, now), f2, h2 FROM (SELECT *,
CASE WHEN place IS NULL THEN used WHEN free THEN used - own.s ELSE used + need END AS now,
CASE WHEN place IS NULL THEN f WHEN free THEN list_append(list_filter(f, lambda x: x.a <> own.a + own.s AND x.a + x.s <> own.a), {{'s': own.s + coalesce(below.s, 0) + coalesce(above.s, 0), 'a': own.a - coalesce(below.s, 0)}})
WHEN best.s > need THEN list_append(list_filter(f, lambda x: x.a <> best.a), {{'s': best.s - need, 'a': best.a + need}}) ELSE list_filter(f, lambda x: x.a <> best.a) END AS f2,
CASE WHEN place IS NULL THEN h WHEN free THEN list_filter(h, lambda x: x.k <> key) ELSE list_append(h, {{'k': key, 's': need, 'a': place}}) END AS h2
FROM (SELECT *, CASE WHEN free THEN own.a WHEN own IS NULL THEN best.a END AS place, list_filter(f, lambda x: x.a = own.a + own.s)[1] AS above, list_filter(f, lambda x: x.a + x.s = own.a)[1] AS below
FROM (SELECT al.*, used, high, f, h, list_filter(h, lambda x: x.k = key)[1] AS own, list_min(list_filter(f, lambda x: x.s >= need)) AS best FROM st JOIN al ON al.cache = st.cache AND al.i = st.i + 1))))
SELECT cache, seq, place, used, high FROM st WHERE i > 0"""


def retry_sql(total: int, unit: int = 4096, rounds: int = 5) -> str:
    """A step either evicts the oldest entry or tries to allocate; a request is done when that works or its rounds are over."""
    return f"""WITH RECURSIVE {ACCESSES}, al AS (SELECT cache, seq, i, seq::VARCHAR AS id, size * 64 AS size, greatest(1, (size * 64 + {unit - 1}) // {unit}) * {unit} AS need FROM acc),
st(cache, i, seq, done, place, rounds, evicted, freed, target, f, h, o) AS (SELECT DISTINCT cache, 0::BIGINT, NULL::BIGINT, true, NULL::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT,
[{{'s': {total}, 'a': 0}}]::STRUCT(s BIGINT, a BIGINT)[], []::STRUCT(k VARCHAR, s BIGINT, a BIGINT)[], []::STRUCT(k VARCHAR, s BIGINT)[] FROM al
UNION ALL SELECT cache, i, seq, CASE WHEN evicting THEN false ELSE ok OR r >= {rounds} END, CASE WHEN ok THEN best.a END, CASE WHEN evicting OR ok THEN r ELSE least(r + 1, {rounds}) END, e + evicting::INT,
CASE WHEN evicting THEN freed + old.s ELSE 0 END, CASE WHEN evicting THEN target ELSE least(size * (2 ** (r + 1))::BIGINT, {total}) END,
CASE WHEN evicting THEN list_append(list_filter(f, lambda x: x.a <> own.a + own.s AND x.a + x.s <> own.a), {{'s': own.s + coalesce(below.s, 0) + coalesce(above.s, 0), 'a': own.a - coalesce(below.s, 0)}})
WHEN ok AND best.s > need THEN list_append(list_filter(f, lambda x: x.a <> best.a), {{'s': best.s - need, 'a': best.a + need}}) WHEN ok THEN list_filter(f, lambda x: x.a <> best.a) ELSE f END,
CASE WHEN evicting THEN list_filter(h, lambda x: x.k <> old.k) WHEN ok THEN list_append(h, {{'k': id, 's': need, 'a': best.a}}) ELSE h END,
CASE WHEN evicting THEN o[2:] WHEN ok THEN list_append(o, {{'k': id, 's': size}}) ELSE o END
FROM (SELECT *, NOT evicting AND best IS NOT NULL AS ok, list_filter(f, lambda x: x.a = own.a + own.s)[1] AS above, list_filter(f, lambda x: x.a + x.s = own.a)[1] AS below
FROM (SELECT *, list_filter(h, lambda x: x.k = old.k)[1] AS own FROM (SELECT al.*, f, h, o, freed, target, o[1] AS old, NOT done AND freed < target AND len(o) > 0 AS evicting,
CASE WHEN done THEN 0 ELSE rounds END AS r, CASE WHEN done THEN 0 ELSE evicted END AS e, list_min(list_filter(f, lambda x: x.s >= need)) AS best
FROM st JOIN al ON al.cache = st.cache AND al.i = CASE WHEN done THEN st.i + 1 ELSE st.i END))))
SELECT cache, seq, place, rounds::INT AS rounds, evicted::INT AS evicted FROM st WHERE i > 0 AND done"""


def slab_sql(capacity: int, slab: int, unit: int = 4096) -> str:
    """A write first drops the key's old entry, then with each step the oldest one until it fits, then goes in."""
    return f"""WITH RECURSIVE {ACCESSES}, al AS (SELECT cache, seq, i, op, key, size * 64 AS size, (size * 64 + {unit - 1}) // {unit} * {unit} AS need FROM acc),
st(cache, i, seq, done, outcome, evicted, used, f, l) AS (SELECT DISTINCT cache, 0::BIGINT, NULL::BIGINT, true, NULL::VARCHAR, 0::BIGINT, 0::BIGINT, [{{'s': {slab}, 'a': 0}}]::STRUCT(s BIGINT, a BIGINT)[], []::STRUCT(k VARCHAR, s BIGINT, a BIGINT, n BIGINT)[] FROM al
UNION ALL SELECT cache, i, seq, going OR op <> 'put',
CASE WHEN going THEN CASE WHEN best IS NULL THEN 'heap' ELSE 'slab' END WHEN op = 'delete' THEN CASE WHEN own IS NULL THEN 'miss' ELSE 'deleted' END WHEN op = 'get' THEN CASE WHEN own IS NULL THEN 'miss' WHEN own.a IS NULL THEN 'heap' ELSE 'slab' END END,
CASE WHEN fresh THEN 0 ELSE evicted + (out IS NOT NULL)::INT END, used - coalesce(out.s, 0) + CASE WHEN going THEN size ELSE 0 END,
CASE WHEN going AND best.s > need THEN list_append(list_filter(f, lambda x: x.a <> best.a), {{'s': best.s - need, 'a': best.a + need}}) WHEN going AND best IS NOT NULL THEN list_filter(f, lambda x: x.a <> best.a)
WHEN out.a IS NOT NULL THEN list_append(list_filter(f, lambda x: x.a <> out.a + out.n AND x.a + x.s <> out.a), {{'s': out.n + coalesce(below.s, 0) + coalesce(above.s, 0), 'a': out.a - coalesce(below.s, 0)}}) ELSE f END,
CASE WHEN going THEN list_append(l, {{'k': key, 's': size, 'a': best.a, 'n': need}}) WHEN out IS NOT NULL THEN list_filter(l, lambda x: x.k <> out.k) WHEN fresh AND op = 'get' AND own IS NOT NULL THEN list_append(list_filter(l, lambda x: x.k <> key), own) ELSE l END
FROM (SELECT *, NOT fresh AND out IS NULL AS going, list_filter(f, lambda x: x.a = out.a + out.n)[1] AS above, list_filter(f, lambda x: x.a + x.s = out.a)[1] AS below
FROM (SELECT *, CASE WHEN fresh THEN CASE WHEN op <> 'get' THEN own END WHEN used + size > {max(capacity, slab)} THEN l[1] END AS out
FROM (SELECT al.*, used, evicted, f, l, done AS fresh, list_filter(l, lambda x: x.k = key)[1] AS own, list_min(list_filter(f, lambda x: x.s >= need)) AS best
FROM st JOIN al ON al.cache = st.cache AND al.i = CASE WHEN done THEN st.i + 1 ELSE st.i END))))
SELECT cache, seq, outcome, evicted::INT AS evicted, used FROM st WHERE i > 0 AND done"""


BREAKER = """WITH RECURSIVE c AS (SELECT user_id % 8 AS child, event_id AS seq, epoch_us(ts) / 1e6 AS ts, event_type <> 'error' AS ok, event_type AS op, row_number() OVER (PARTITION BY user_id % 8 ORDER BY event_id) AS i FROM events),
st(child, i, seq, op, ok, admitted, state, opened) AS (SELECT DISTINCT child, 0::BIGINT, NULL::BIGINT, NULL::VARCHAR, NULL::BOOLEAN, NULL::BOOLEAN, 'closed', 0::DOUBLE FROM c
UNION ALL SELECT child, i, seq, op, ok, NOT shut, CASE WHEN shut THEN state WHEN ok THEN 'closed' ELSE 'open' END, CASE WHEN shut OR ok THEN opened ELSE ts END
FROM (SELECT c.*, state, opened, state = 'open' AND ts - opened < 1800 AS shut FROM st JOIN c ON c.child = st.child AND c.i = st.i + 1))"""


@query("LRU-01 SRC-05", byte_sql(1500, False))
def byte_lru(spark, d):
    return cache.byte_lru(accesses(spark, d), 1500)


@query("LRU-02", byte_sql(400, True))
def bypassing_lru(spark, d):
    return cache.byte_lru(accesses(spark, d), 400, bypass=True)


@query("LRU-03", two_map_sql(1500))
def two_map_lru(spark, d):
    forms = accesses(spark, d).withColumn("form", F.when(F.col("size") % 2 == 0, "chunks").otherwise("single"))
    return cache.byte_lru(forms, 1500, bypass=True, shared=True)


@query("LRU-09 MEM-09", slab_sql(4096, 40 * 4096))
def slab_lru(spark, d):
    return cache.slab_lru(accesses(spark, d).withColumn("size", F.col("size") * 64), 4096, 40 * 4096)


TIER = """ev AS (SELECT 'c' || (user_id % 8) AS cache, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'put' WHEN 'signup' THEN 'delete' WHEN 'click' THEN 'put_if_absent' ELSE 'get' END AS op, 'k' || (event_id * 7919 % 37) AS key, event_id % 10 > 0 AS ok FROM events),
lo AS (SELECT 'c' || c AS cache, -1 - k AS seq, 'load' AS op, 'k' || k AS key, true AS ok FROM (SELECT unnest(range(8)) AS c), (SELECT unnest(range(0, 37, 3)) AS k)),
tr AS (SELECT *, coalesce(count_if(op = 'delete') OVER (PARTITION BY cache, key ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS life FROM (SELECT * FROM ev UNION ALL SELECT * FROM lo)),
sto AS (SELECT *, coalesce(bool_or(op = 'load' OR op IN ('put', 'put_if_absent') AND ok) OVER (PARTITION BY cache, key, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS there FROM tr),
mem AS (SELECT *, coalesce(bool_or(op = 'put' AND ok OR op = 'get' AND there OR op = 'put_if_absent' AND ok AND NOT there) OVER (PARTITION BY cache, key, life ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS held FROM sto),
res AS (SELECT cache, seq, op, CASE op WHEN 'load' THEN 'loaded' WHEN 'get' THEN CASE WHEN held THEN 'memory' WHEN there THEN 'storage' ELSE 'miss' END WHEN 'delete' THEN CASE WHEN there THEN 'deleted' ELSE 'absent' END
WHEN 'put_if_absent' THEN CASE WHEN there THEN 'exists' WHEN ok THEN 'stored' ELSE 'failed' END ELSE CASE WHEN ok THEN 'stored' ELSE 'failed' END END AS outcome FROM mem)"""


def _tier_trace(spark, d):
    """Reads, writes, deletes and writes if absent, every tenth of which fails; a third of the keys was there before."""
    e = table(spark, d, "events")
    a = accesses(spark, d).join(e.select(F.col("event_id").alias("seq"), "event_type"), "seq")
    op = F.when(F.col("event_type") == "click", "put_if_absent").otherwise(F.col("op"))
    trace = a.select("cache", "seq", op.alias("op"), "key", "size", (F.col("seq") % 10 > 0).alias("ok"))
    k = F.explode(F.sequence(F.lit(0), F.lit(36), F.lit(3)))
    loads = spark.range(8).select(F.concat(F.lit("c"), F.col("id").cast("string")).alias("cache"), k.alias("k"))
    return trace.unionByName(loads.select("cache", (-1 - F.col("k")).cast("long").alias("seq"), F.lit("load").alias("op"), F.concat(F.lit("k"), F.col("k").cast("string")).alias("key"), F.lit(10).cast("long").alias("size"), F.lit(True).alias("ok")))


@query("MEM-01 MEM-03 MEM-04 MEM-05 MEM-07 SRC-05", f"WITH {TIER} SELECT cache, seq, outcome FROM res")
def memory_tier(spark, d):
    """A cache that is large enough for all; smaller ones are held against a model."""
    return cache.memory_tier(_tier_trace(spark, d), 1 << 50).select("cache", "seq", "outcome")


@query("MEM-08 MEM-01", f"WITH {TIER} SELECT cache, count_if(outcome = 'memory') AS hits, count_if(op = 'get' AND outcome <> 'memory') AS misses FROM res GROUP BY cache")
def memory_tier_counters(spark, d):
    folded = cache.memory_tier(_tier_trace(spark, d), 1 << 50)
    return folded.groupBy("cache").agg(F.max("hits").alias("hits"), F.max("misses").alias("misses"))


@query("PYC-01 LRU-06", """WITH ev AS (SELECT 'c' || (user_id % 8) AS cache, event_id AS seq, CASE event_type WHEN 'purchase' THEN 'put' WHEN 'signup' THEN 'delete' ELSE 'get' END AS op, 'k' || (event_id * 7919 % 37) AS key FROM events),
w AS (SELECT *, lag(op) OVER (PARTITION BY cache, key ORDER BY seq) AS before FROM ev) SELECT cache, seq, coalesce(before = 'get', false) AS hit FROM w""")
def descriptor_cache(spark, d):
    """A descriptor is there for the next access only if the last one of its key was a get."""
    return cache.descriptor_cache(accesses(spark, d)).select("cache", "seq", "hit")


@query("MEM-08 AGG-11", f"SELECT cache, count(*) FILTER (WHERE hit) AS hits, count(*) FILTER (WHERE NOT hit) AS misses, sum(evicted)::BIGINT AS evictions, arg_max(used, seq) AS used FROM ({byte_sql(1500, False)}) GROUP BY cache")
def cache_stats(spark, d):
    return cache.stats(cache.byte_lru(accesses(spark, d), 1500))


@query("LRU-04", """WITH e AS (SELECT 'c' || (user_id % 8) AS cache, 'k' || event_id AS key, floor(value)::BIGINT + 1 AS size, event_id AS last_access FROM events)
SELECT cache, key, size, last_access FROM (SELECT *, sum(size) OVER (PARTITION BY cache ORDER BY last_access, key ROWS UNBOUNDED PRECEDING) - size AS before FROM e) WHERE before < 5000""")
def evicted_to_free(spark, d):
    e = table(spark, d, "events")
    rows = e.select(F.concat(F.lit("c"), (F.col("user_id") % 8).cast("string")).alias("cache"), F.concat(F.lit("k"), F.col("event_id").cast("string")).alias("key"), (F.floor("value") + 1).alias("size"), F.col("event_id").alias("last_access"))
    return cache.evict_to_free(rows, 5000)


@query("LRU-05 RDM-03", retry_sql(64 * 4096))
def evict_and_retry(spark, d):
    t = accesses(spark, d).withColumn("id", F.col("seq").cast("string")).withColumn("size", F.col("size") * 64)
    return cache.evict_and_retry(t, 64 * 4096)


@query("LRU-06", count_sql(16, False))
def count_lru(spark, d):
    return cache.count_lru(accesses(spark, d), 16)


@query("LRU-07", count_sql(8, True))
def fifo_cache(spark, d):
    return cache.count_lru(accesses(spark, d), 8, fifo=True)


@query("LRU-07", """WITH f AS (SELECT 'c' || (user_id % 8) AS cache, 'k' || (event_id * 7919 % 37) AS key, min(event_id) AS seq FROM events GROUP BY 1, 2)
SELECT cache, key, seq FROM (SELECT *, row_number() OVER (PARTITION BY cache ORDER BY seq DESC) AS r FROM f) WHERE r <= 8""")
def last_distinct_keys(spark, d):
    return cache.last_distinct(accesses(spark, d), 8)


@query("LRU-08", best_fit_sql(40 * 4096))
def best_fit_allocations(spark, d):
    t = accesses(spark, d)
    op = F.when(F.col("op") == "delete", "free").otherwise("alloc")
    return cache.best_fit(t.select("cache", "seq", op.alias("op"), F.col("key").alias("id"), (F.col("size") * 64).alias("size")), 40 * 4096)


@query("HA-01", f"{BREAKER} SELECT child, seq, admitted, state FROM st WHERE i > 0")
def breaker_states(spark, d):
    return health.breaker(calls(spark, d), 1800.0)


@query("HA-02 HA-01", f"{BREAKER} SELECT child, seq, CASE WHEN admitted AND ok THEN op ELSE 'miss' END AS result FROM st WHERE i > 0")
def guarded_calls(spark, d):
    c = calls(spark, d)
    return health.guarded(c, health.breaker(c, 1800.0), F.col("op"), F.lit("miss")).select("child", "seq", "result")


@query("HA-03", "SELECT event_id AS region, user_id % 4 AS child, CASE WHEN user_id % 4 <> 3 AND event_id % 2 = 0 THEN event_id * 10 + user_id % 4 END AS child_region FROM events")
def translated_regions(spark, d):
    e = table(spark, d, "events").select(F.col("event_id").alias("region"), (F.col("user_id") % 4).alias("child"))
    known = e.where("child <> 3 AND region % 2 = 0").select("region", "child", (F.col("region") * 10 + F.col("child")).alias("child_region"))
    return health.translate_regions(e, known)


@query("STA-01", """WITH e AS (SELECT user_id AS request, CASE event_type WHEN 'signup' THEN 'enqueue' WHEN 'view' THEN 'done' WHEN 'error' THEN CASE WHEN event_id % 50 = 0 THEN 'fail' ELSE 'finish' END ELSE 'finish' END AS kind FROM events),
c AS (SELECT request, count_if(kind = 'enqueue') - count_if(kind IN ('done', 'fail')) AS pending, count_if(kind = 'finish') > 0 AS finished, count_if(kind = 'fail') AS failed FROM e GROUP BY request)
SELECT *, CASE WHEN failed > 0 THEN 'failed' WHEN finished AND pending <= 0 THEN 'done' ELSE 'in_flight' END AS status FROM c""")
def store_tracking(spark, d):
    t = F.col("event_type")
    kind = F.when(t == "signup", "enqueue").when(t == "view", "done").when((t == "error") & (F.col("event_id") % 50 == 0), "fail").otherwise("finish")
    return health.store_tracking(table(spark, d, "events").select(F.col("user_id").alias("request"), F.col("event_id").alias("seq"), kind.alias("kind")))


@query("STA-02", "SELECT l_orderkey AS barrier, bool_and(l_linestatus = 'F') AS open, count(*) AS waiting_for FROM lineitem GROUP BY l_orderkey")
def layer_barriers(spark, d):
    return health.barrier(table(spark, d, "lineitem").select(F.col("l_orderkey").alias("barrier"), (F.col("l_linestatus") == "F").alias("done")))
