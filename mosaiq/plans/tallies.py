"""Outcome tallies, verification joins, de-duplication, caps, gates and choices."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from mosaiq.operators.outcomes import ladder, tally, verify, with_zeros
from mosaiq.operators.ranking import cap, gate, prefer
from mosaiq.plans.catalogue import query
from mosaiq.session import table


@query(
    "outcome_tally",
    """
WITH s AS (SELECT o_orderkey, CASE WHEN n IS NULL THEN 'NO_LINES' WHEN abs(o_totalprice - total) > 0.05 * o_totalprice THEN 'TOTAL_MISMATCH' ELSE 'OK' END AS status
  FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice) AS total FROM lineitem GROUP BY 1) ON o_orderkey = l_orderkey)
SELECT status, count(*) AS n, min(o_orderkey) AS first_sample FROM s GROUP BY status""",
)
def _outcome_tally(spark, d):
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("n_lines"), F.sum("l_extendedprice").alias("total"))
    both = table(spark, d, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    status = ladder(("NO_LINES", F.col("n_lines").isNull()), ("TOTAL_MISMATCH", F.abs(F.col("o_totalprice") - F.col("total")) > 0.05 * F.col("o_totalprice")), otherwise="OK")
    return tally(both.withColumn("status", status), "status", F.col("o_orderkey"), F.col("o_orderkey"))


_KINDS = ["click", "view", "purchase", "signup", "scroll", "error", "refund"]


@query(
    "outcome_tally_zero_filled",
    "SELECT s.status, CAST(count(e.event_id) AS BIGINT) AS n FROM (VALUES ('click'),('view'),('purchase'),('signup'),('scroll'),('error'),('refund')) s(status) LEFT JOIN events e ON e.event_type = s.status GROUP BY 1",
)
def _zero_filled(spark, d):
    counts = table(spark, d, "events").groupBy(F.col("event_type").alias("status")).agg(F.count("*").alias("n"))
    return with_zeros(counts, "status", _KINDS)


@query("dedup_preferred", "SELECT text_md5, doc_id, source FROM (SELECT md5(text) AS text_md5, doc_id, source, row_number() OVER (PARTITION BY md5(text) ORDER BY source, doc_id) AS rn FROM documents) WHERE rn = 1")
def _dedup(spark, d):
    df = table(spark, d, "documents").select(F.md5("text").alias("text_md5"), "doc_id", "source")
    return prefer(df, ["text_md5"], [F.col("source"), F.col("doc_id")])


@query(
    "verify_outer_classify",
    """
WITH a AS (SELECT CASE WHEN o_orderkey % 7 = 0 THEN -o_orderkey ELSE o_orderkey END AS k, round(o_totalprice) AS s FROM orders), b AS (SELECT l_orderkey AS k, round(sum(l_extendedprice)) AS s FROM lineitem GROUP BY 1)
SELECT status, count(*) AS n FROM (SELECT CASE WHEN b.k IS NULL THEN 'MISSING' WHEN a.k IS NULL THEN 'UNRECORDED' WHEN abs(a.s - b.s) > 1000 THEN 'SIZE_MISMATCH' ELSE 'OK' END AS status FROM a FULL JOIN b ON a.k = b.k) GROUP BY status""",
)
def _verify(spark, d):
    key = F.col("o_orderkey")
    a = table(spark, d, "orders").select(F.when(key % 7 == 0, -key).otherwise(key).alias("k"), F.round("o_totalprice").alias("s"))
    b = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("k")).agg(F.round(F.sum("l_extendedprice")).alias("s"))
    return verify(a, b, "k", "s", tolerance=1000).groupBy("status").agg(F.count("*").alias("n"))


@query("unlabelled_anti", "SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)")
def _anti(spark, d):
    return table(spark, d, "documents").select("doc_id", "source").join(table(spark, d, "labels").select("doc_id"), "doc_id", "left_anti")


@query(
    "instrument_status",
    """
SELECT n_name AS instrument, CASE WHEN count(s_suppkey) = 0 THEN 'ABSENT' WHEN count(*) FILTER (WHERE s_acctbal < 0) > 0 THEN 'PARTIAL' ELSE 'PRESENT' END AS status, count(s_suppkey) AS n_entries
FROM nation LEFT JOIN supplier ON s_nationkey = n_nationkey GROUP BY n_name""",
)
def _instruments(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "supplier"), F.col("s_nationkey") == F.col("n_nationkey"), "left")
    out = both.groupBy(F.col("n_name").alias("instrument")).agg(F.count("s_suppkey").alias("n_entries"), F.count_if(F.col("s_acctbal") < 0).alias("_bad"))
    return out.select("instrument", ladder(("ABSENT", F.col("n_entries") == 0), ("PARTIAL", F.col("_bad") > 0), otherwise="PRESENT").alias("status"), "n_entries")


@query(
    "manifest_summary",
    "SELECT c_mktsegment AS sensor, count(*) AS n, count(DISTINCT c_nationkey) AS n_regions, round(min(c_acctbal), 2) AS min_v, round(max(c_acctbal), 2) AS max_v, count(*) FILTER (WHERE c_acctbal < 0) AS n_unresolved FROM customer GROUP BY 1",
)
def _summary(spark, d):
    return (
        table(spark, d, "customer")
        .groupBy(F.col("c_mktsegment").alias("sensor"))
        .agg(F.count("*").alias("n"), F.countDistinct("c_nationkey").alias("n_regions"), F.round(F.min("c_acctbal"), 2).alias("min_v"), F.round(F.max("c_acctbal"), 2).alias("max_v"), F.count_if(F.col("c_acctbal") < 0).alias("n_unresolved"))
    )


@query(
    "dashboard_filter_sort",
    "SELECT o_orderkey, o_totalprice, o_orderpriority, c_mktsegment FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_mktsegment IN ('BUILDING','MACHINERY') AND o_totalprice >= 100000 AND o_orderstatus <> 'P' ORDER BY o_totalprice DESC, o_orderkey LIMIT 100",
)
def _dashboard(spark, d):
    orders = table(spark, d, "orders").filter((F.col("o_totalprice") >= 100000) & (F.col("o_orderstatus") != "P"))
    both = orders.join(table(spark, d, "customer").filter(F.col("c_mktsegment").isin("BUILDING", "MACHINERY")), F.col("o_custkey") == F.col("c_custkey"))
    return both.select("o_orderkey", "o_totalprice", "o_orderpriority", "c_mktsegment").orderBy(F.col("o_totalprice").desc(), "o_orderkey").limit(100)


@query(
    "null_safe_filter",
    "SELECT l_returnflag, count(*) AS n, count(v) AS n_known, count(*) FILTER (WHERE v IS NULL OR v >= 0.05) AS n_shown FROM (SELECT l_returnflag, CASE WHEN l_orderkey % 7 = 0 THEN NULL ELSE l_discount END AS v FROM lineitem) GROUP BY 1",
)
def _null_safe(spark, d):
    v = F.when(F.col("l_orderkey") % 7 != 0, F.col("l_discount"))
    df = table(spark, d, "lineitem").select("l_returnflag", v.alias("v"))
    return df.groupBy("l_returnflag").agg(F.count("*").alias("n"), F.count("v").alias("n_known"), F.count_if(F.col("v").isNull() | (F.col("v") >= 0.05)).alias("n_shown"))


_LINE = "l_orderkey, l_linenumber, l_partkey, l_quantity, l_extendedprice"


@query(
    "topk_cap_per_group",
    f"SELECT l_suppkey, {_LINE} FROM (SELECT l_suppkey, {_LINE}, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_extendedprice DESC, {_LINE}) AS rn FROM lineitem) WHERE rn <= 5",
)
def _topk(spark, d):
    cols = _LINE.split(", ")
    df = table(spark, d, "lineitem").select("l_suppkey", *cols)
    return cap(df, ["l_suppkey"], [F.col("l_extendedprice").desc(), *[F.col(c) for c in cols]], 5)


@query("stable_cap_reordered", "SELECT event_type, event_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM events) WHERE rn <= 50 ORDER BY event_id")
def _stable(spark, d):
    df = table(spark, d, "events").select("event_type", "event_id", "value")
    return cap(df, ["event_type"], [F.col("value").desc(), F.col("event_id")], 50).orderBy("event_id")


@query(
    "gate_per_group",
    """
WITH r AS (SELECT c_mktsegment AS tag, o_orderpriority AS grp, o_orderstatus AS variant, count(*) AS n_inliers, round(avg(CASE WHEN o_totalprice >= 100000 THEN 1.0 ELSE 0.0 END), 6) AS u, max(o_orderkey) % 3 <> 0 AS agrees
  FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
b AS (SELECT *, n_inliers >= 20 AND u >= 0.7 AND agrees AS passes FROM (SELECT *, row_number() OVER (PARTITION BY tag, grp ORDER BY u >= 0.7 DESC, n_inliers DESC, u DESC, variant) AS rn FROM r) WHERE rn = 1)
SELECT tag, grp, n_inliers, u, passes FROM (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY passes DESC, n_inliers DESC, grp) AS k FROM b) WHERE k = 1""",
)
def _gate(spark, d):
    both = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    r = both.groupBy(F.col("c_mktsegment").alias("tag"), F.col("o_orderpriority").alias("grp"), F.col("o_orderstatus").alias("variant")).agg(
        F.count("*").alias("n_inliers"), F.round(F.avg((F.col("o_totalprice") >= 100000).cast("double")), 6).alias("u"), (F.max("o_orderkey") % 3 != 0).alias("agrees")
    )
    return gate(r, ["tag"], ["grp"], "n_inliers", "u", "agrees").select("tag", "grp", "n_inliers", "u", "passes")


@query(
    "lexicographic_choice",
    """
WITH p AS (SELECT o_orderpriority AS preset, count(*) FILTER (WHERE o_totalprice > 150000) AS passes, median(o_totalprice) FILTER (WHERE o_orderstatus = 'F') AS rms FROM orders GROUP BY 1)
SELECT preset, passes, round(rms, 4) AS rms, CAST(row_number() OVER (ORDER BY passes DESC, rms ASC NULLS LAST, preset) AS INT) AS choice FROM p""",
)
def _choice(spark, d):
    p = table(spark, d, "orders").groupBy(F.col("o_orderpriority").alias("preset")).agg(F.count_if(F.col("o_totalprice") > 150000).alias("passes"), F.percentile(F.when(F.col("o_orderstatus") == "F", F.col("o_totalprice")), 0.5).alias("rms"))
    w = Window.orderBy(F.col("passes").desc(), F.col("rms").asc_nulls_last(), "preset")  # one row a preset
    return p.select("preset", "passes", F.round("rms", 4).alias("rms"), F.row_number().over(w).alias("choice"))


@query("self_pairs_unordered", "SELECT a.n_name AS source, b.n_name AS reference, r_name FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey AND a.n_nationkey < b.n_nationkey JOIN region ON r_regionkey = a.n_regionkey")
def _pairs(spark, d):
    n = table(spark, d, "nation")
    a, b = n.alias("a"), n.alias("b")
    pairs = a.join(b, (F.col("a.n_regionkey") == F.col("b.n_regionkey")) & (F.col("a.n_nationkey") < F.col("b.n_nationkey")))
    return pairs.join(table(spark, d, "region"), F.col("a.n_regionkey") == F.col("r_regionkey")).select(F.col("a.n_name").alias("source"), F.col("b.n_name").alias("reference"), "r_name")


#: Ground sampling distance of each sensor in metres, fixed values of the data model.
GSD = {"OHRC": 0.25, "LRO_NAC": 0.5, "TMC2": 5.0, "SELENE_TC": 10.0, "IIRS": 80.0}
_GSD_SQL = "(VALUES ('OHRC',0.25),('LRO_NAC',0.5),('TMC2',5.0),('SELENE_TC',10.0),('IIRS',80.0)) {}(s, g)"


@query(
    "bridge_lookup",
    f"""
WITH p AS (SELECT a.s AS a, b.s AS b, greatest(a.g / b.g, b.g / a.g) AS direct, a.g AS ga, b.g AS gb FROM {_GSD_SQL.format('a')} JOIN {_GSD_SQL.format('b')} ON a.s < b.s),
c AS (SELECT p.a, p.b, direct, c.s, greatest(greatest(ga / c.g, c.g / ga), greatest(gb / c.g, c.g / gb)) AS worst FROM p JOIN {_GSD_SQL.format('c')} ON c.s <> p.a AND c.s <> p.b WHERE direct > 8),
k AS (SELECT *, row_number() OVER (PARTITION BY a, b ORDER BY worst, s) AS rn FROM c WHERE worst < direct)
SELECT p.a, p.b, CAST(p.direct AS DOUBLE) AS direct, k.s AS bridge FROM p LEFT JOIN k ON k.a = p.a AND k.b = p.b AND rn = 1""",
)
def _bridge(spark, d):
    g = spark.createDataFrame(list(GSD.items()), "s string, g double")

    def ratio(x, y):
        return F.greatest(x / y, y / x)

    p = g.select(F.col("s").alias("a"), F.col("g").alias("ga")).join(g.select(F.col("s").alias("b"), F.col("g").alias("gb")), F.col("a") < F.col("b")).withColumn("direct", ratio(F.col("ga"), F.col("gb")))
    c = p.filter("direct > 8").join(g, (F.col("s") != F.col("a")) & (F.col("s") != F.col("b"))).withColumn("worst", F.greatest(ratio(F.col("ga"), F.col("g")), ratio(F.col("gb"), F.col("g")))).filter("worst < direct")
    best = prefer(c, ["a", "b"], [F.col("worst"), F.col("s")]).select("a", "b", F.col("s").alias("bridge"))
    return p.select("a", "b", "direct").join(best, ["a", "b"], "left")


@query("ablation_configs", "SELECT concat_ws('+', CASE WHEN a THEN 'shadow' END, CASE WHEN b THEN 'stretch' END, CASE WHEN c THEN 'clahe' END) AS config, CAST(a AS INT) + CAST(b AS INT) + CAST(c AS INT) AS n_steps FROM (VALUES (true),(false)) x(a), (VALUES (true),(false)) y(b), (VALUES (true),(false)) z(c)")
def _ablation(spark, d):
    flags = [spark.createDataFrame([(True,), (False,)], f"{c} boolean") for c in "abc"]
    every = flags[0].join(flags[1]).join(flags[2])  # eight literal rows
    name = F.concat_ws("+", *[F.when(F.col(c), n) for c, n in zip("abc", ("shadow", "stretch", "clahe"))])
    return every.select(name.alias("config"), sum(F.col(c).cast("int") for c in "abc").alias("n_steps"))


@query("pair_id_clean", "SELECT doc_id, regexp_replace(lower(source || '__' || lang || ' ' || text), '[^a-z0-9_]+', '-', 'g') AS pair_id FROM documents")
def _pair_id(spark, d):
    raw = F.lower(F.concat(F.col("source"), F.lit("__"), F.col("lang"), F.lit(" "), F.col("text")))
    return table(spark, d, "documents").select("doc_id", F.regexp_replace(raw, "[^a-z0-9_]+", "-").alias("pair_id"))


@query("json_props_extract", "SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def _json(spark, d):
    return table(spark, d, "events").groupBy(F.get_json_object("props", "$.k").cast("long").alias("k")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query(
    "conversation_outcomes",
    """
WITH c AS (SELECT conv_id, count(*) AS n_turns, count(DISTINCT turn) AS d, min(turn) AS lo, max(turn) AS hi, min_by(role, turn) AS first_role FROM conversations GROUP BY 1)
SELECT CASE WHEN d < n_turns THEN 'DUPLICATE_TURN' WHEN lo > 0 OR hi - lo + 1 > d THEN 'MISSING_TURN' WHEN first_role NOT IN ('system', 'user') THEN 'BAD_START' ELSE 'OK' END AS status, count(*) AS n, min(conv_id) AS first_sample FROM c GROUP BY 1""",
)
def _conversations(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("n_turns"), F.countDistinct("turn").alias("d"), F.min("turn").alias("lo"), F.max("turn").alias("hi"), F.min_by("role", "turn").alias("first_role"))
    status = ladder(("DUPLICATE_TURN", F.col("d") < F.col("n_turns")), ("MISSING_TURN", (F.col("lo") > 0) | (F.col("hi") - F.col("lo") + 1 > F.col("d"))), ("BAD_START", ~F.col("first_role").isin("system", "user")), otherwise="OK")
    return tally(c.withColumn("status", status), "status", F.col("conv_id"), F.col("conv_id"))


@query("union_index", "SELECT source, CAST(count(*) AS BIGINT) AS n, CAST(count(extra) AS BIGINT) AS n_extra FROM (SELECT 'documents' AS source, lang AS extra FROM documents UNION ALL SELECT 'pages', NULL FROM pages) GROUP BY 1")
def _union(spark, d):
    a = table(spark, d, "documents").select(F.lit("documents").alias("source"), F.col("lang").alias("extra"))
    return a.unionByName(table(spark, d, "pages").select(F.lit("pages").alias("source")), allowMissingColumns=True).groupBy("source").agg(F.count("*").alias("n"), F.count("extra").alias("n_extra"))
