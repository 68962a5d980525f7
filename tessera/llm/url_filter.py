"""URL filter: given rules, and for what they leave open a path-template tree for each host.

A url's path becomes a template by turning variable segments (numbers, long hex or mixed ids) into
wildcards. The tree is built over distinct templates with their counts, level by level: siblings
whose labelled rate of bad pages doesn't differ from their parent's merge into a wildcard branch.
A finished template is blocked if its share of bad pages, smoothed by the share over all pages,
exceeds a threshold. Everything is DataFrame operations; joins are on (host, template) between
stored tables, so that Spark can split a host that holds much of the data.

Defined results: a url that is null or lacks `://` has empty host and path; paths count to their last
segment, however deep, and urls are read whole, however long; several labels for one page count one by
one; repeated pages, and pages without an id, count and get a row each; of equally long rules none can
fit together; a share of bad pages that equals the threshold is allowed. An empty table gives no rows;
columns other than page_id and url are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import stored

RULES = (("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/"))
#: Levels that oracle() writes out; the tree itself has as many as the deepest path.
DEPTH = 4
#: Standard deviations within which a branch counts as similar; pseudo-labels; highest share of bad pages.
Z, PSEUDO, MOST_BAD = 2.0, 10.0, 0.4
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URL = r"(?s)^.*?://([^/?#]*)([^?#]*)"
VARIABLE = r"^([0-9]+|[0-9a-fA-F-]{8,}|[^.]*[0-9]{4,}[^.]*)(\.[A-Za-z0-9]{1,5})?$"


def host_and_path(url: Column) -> tuple[Column, Column]:
    text = F.coalesce(url, F.lit(""))
    return F.translate(F.regexp_extract(text, URL, 1), UPPER, LOWER), F.regexp_extract(text, URL, 2)


def _rules(rules) -> list[tuple[str, str, str]]:
    return sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[1] + r[2]))


def ruled(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest fitting rule as a string, and its verdict; null where none fits."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in reversed(_rules(rules)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def template(path: Column) -> Column:
    """The path's segments as an array, variable ones as `*` with their suffix."""
    parts = F.filter(F.split(path, "/"), lambda x: x != "")
    return F.transform(parts, lambda x: F.regexp_replace(x, VARIABLE, "*$2"))


def tree(raw: DataFrame) -> DataFrame:
    """host, t (array), n, lab, bad for each distinct template -> host, t, n, lab, bad, merged. A level
    takes the rows that still have a segment; the last is the one that leaves none. A row that is alone
    below its branch has no siblings at any deeper level, so the rest of its path is taken as it is."""
    rows = raw.withColumn("merged", F.lit(""))
    done = []
    k = 0
    while True:
        ended = F.size("t") <= k
        done.append(rows.where(ended))
        rows = rows.where(~ended)
        if rows.isEmpty():
            break
        k += 1
        rows = stored(rows.withColumn("seg", F.get(F.col("t"), F.lit(k - 1))), f"tree-{k}")
        child = rows.groupBy("host", "merged", "seg").agg(F.sum("lab").alias("clab"), F.sum("bad").alias("cbad"), F.count(F.lit(1)).alias("held"))
        parent = child.groupBy("host", "merged").agg(((F.sum("cbad") + 0.5) / (F.sum("clab") + 1.0)).alias("rate"), (F.sum("held") == 1).alias("alone"))
        judged = stored(child.join(parent, ["host", "merged"]), "tree-children")
        near = F.abs(F.col("cbad") - F.col("clab") * F.col("rate")) <= Z * F.sqrt(F.col("clab") * F.col("rate") * (1 - F.col("rate")) + 0.25)
        judged = judged.select("host", "merged", "seg", "alone", near.alias("near"))
        many = judged.where("near").groupBy("host", "merged").agg((F.count(F.lit(1)) > 1).alias("many"))
        step = judged.join(many, ["host", "merged"], "left")
        step = stored(step.select("host", "merged", "seg", "alone", F.when(F.col("near") & F.col("many"), "*").otherwise(F.col("seg")).alias("as")), "tree-step")
        rest = F.array_join(F.slice("t", F.lit(k), F.size("t")), "/")
        rows = stored(rows.join(step, ["host", "merged", "seg"]).select(
            "host", "t", "n", "lab", "bad", "alone", F.concat("merged", F.lit("/"), F.when(F.col("alone"), rest).otherwise(F.col("as"))).alias("merged")), f"tree-merged-{k}")
        done.append(rows.where("alone").drop("alone"))
        rows = rows.where("not alone").drop("alone")
    return reduce(DataFrame.unionByName, done)


def judge(spark: SparkSession, pages: DataFrame, labels: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, template, bad_share: one row per page. labels: (doc_id,
    quality); a page shows the document whose number ends its path."""
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"))
    number = F.regexp_extract("path", r"([0-9]{1,18})[^0-9/]*/?$", 1)
    rows = stored(rows.withColumn("t", template(F.col("path"))).withColumn("shown", F.when(number != "", number.cast("long"))), "urls")
    marked = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("lab"), F.count_if(F.col("quality") == 0).alias("bad"))
    zero = F.lit(0).cast("long")
    known = rows.join(marked, rows["shown"] == marked["doc_id"], "left")
    raw = known.groupBy("host", "t").agg(F.count(F.lit(1)).alias("n"), F.sum(F.coalesce("lab", zero)).alias("lab"), F.sum(F.coalesce("bad", zero)).alias("bad"))
    merged = stored(tree(raw), "templates")
    total = merged.agg(((F.sum("bad") + 0.1) / (F.sum("lab") + 1.0)).alias("all_bad"))  # a single row; 0.1 without labels
    final = merged.groupBy("host", "merged").agg(F.sum("lab").alias("lab"), F.sum("bad").alias("bad"))
    share = (F.col("bad") + PSEUDO * F.col("all_bad")) / (F.col("lab") + PSEUDO)
    final = stored(final.join(F.broadcast(total)).select("host", "merged", share.alias("bad_share")), "template-shares")
    # host and merged of `templates` are few beside pages, but nothing bounds them: Spark chooses the join
    found = stored(merged.join(final, ["host", "merged"]).select("host", "t", F.col("merged").alias("template"), "bad_share"), "judged")
    rule, verdict = ruled(F.col("host"), F.col("path"), rules)
    method = F.when(F.col("bad_share") > MOST_BAD, "block").otherwise("allow")
    return rows.join(found, ["host", "t"], "left").select(
        "page_id", "host", "path", rule.alias("rule"), F.coalesce(verdict, method).alias("verdict"), "template", "bad_share")


def oracle() -> str:
    """The same in DuckDB's SQL, for RULES; without template and bad_share."""
    cases = [(f"(host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}')", h + p, kind) for kind, h, p in _rules(RULES)]
    rule = "CASE " + " ".join(f"WHEN {c} THEN '{r}'" for c, r, _ in cases) + " END"
    verdict = "CASE " + " ".join(f"WHEN {c} THEN '{v}'" for c, _, v in cases) + " END"
    levels, last = "", "l0"
    for k in range(1, DEPTH + 2):
        levels += f""",
c{k} AS (SELECT host, merged, t[{k}] AS seg, sum(lab) AS clab, sum(bad) AS cbad FROM {last} WHERE t[{k}] IS NOT NULL GROUP BY ALL),
p{k} AS (SELECT host, merged, (sum(cbad) + 0.5::DOUBLE) / (sum(clab) + 1.0::DOUBLE) AS rate FROM c{k} GROUP BY ALL),
j{k} AS (SELECT host, merged, seg, abs(cbad - clab * rate) <= {Z}::DOUBLE * sqrt(clab * rate * (1 - rate) + 0.25::DOUBLE) AS near FROM c{k} JOIN p{k} USING (host, merged)),
s{k} AS (SELECT *, CASE WHEN near AND count_if(near) OVER (PARTITION BY host, merged) > 1 THEN '*' ELSE seg END AS nxt FROM j{k}),
l{k} AS (SELECT a.host, a.t, a.lab, a.bad, CASE WHEN s.seg IS NULL THEN a.merged ELSE a.merged || '/' || s.nxt END AS merged
         FROM {last} a LEFT JOIN s{k} s ON a.host = s.host AND a.merged = s.merged AND a.t[{k}] = s.seg)"""
        last = f"l{k}"
    return f"""
WITH u AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '{URL}', 1), '{UPPER}', '{LOWER}') AS host, regexp_extract(coalesce(url, ''), '{URL}', 2) AS path FROM pages),
v AS (SELECT *, list_transform(list_filter(string_split(path, '/'), lambda x: x <> ''), lambda x: regexp_replace(x, '{VARIABLE}', '*\\2')) AS parts,
             try_cast(nullif(regexp_extract(path, '([0-9]{{1,18}})[^0-9/]*/?$', 1), '') AS BIGINT) AS shown FROM u),
w AS (SELECT page_id, host, path, shown, CASE WHEN len(parts) > {DEPTH} THEN parts[1:{DEPTH}] || ['**'] ELSE parts END AS t FROM v),
m AS (SELECT doc_id, count(*) AS lab, count_if(quality = 0) AS bad FROM labels WHERE doc_id IS NOT NULL AND quality IS NOT NULL GROUP BY doc_id),
l0 AS (SELECT host, t, sum(coalesce(lab, 0))::BIGINT AS lab, sum(coalesce(bad, 0))::BIGINT AS bad, '' AS merged FROM w LEFT JOIN m ON shown = m.doc_id GROUP BY host, t){levels},
g AS (SELECT (sum(bad) + 0.1::DOUBLE) / (sum(lab) + 1.0::DOUBLE) AS all_bad FROM {last}),
f AS (SELECT host, merged, (sum(bad) + {PSEUDO}::DOUBLE * any_value(all_bad)) / (sum(lab) + {PSEUDO}::DOUBLE) AS bad_share FROM {last}, g GROUP BY host, merged),
z AS (SELECT {last}.host, {last}.t, bad_share FROM {last} JOIN f USING (host, merged))
SELECT w.page_id, w.host, w.path, {rule.replace('host', 'w.host').replace('path', 'w.path')} AS rule,
       coalesce({verdict.replace('host', 'w.host').replace('path', 'w.path')}, CASE WHEN bad_share > {MOST_BAD}::DOUBLE THEN 'block' ELSE 'allow' END) AS verdict
FROM w LEFT JOIN z ON w.host = z.host AND w.t = z.t
"""
