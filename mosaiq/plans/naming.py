"""Plans over names and paths: every rule of ``functions.names`` on names made from the tables' keys."""

from __future__ import annotations

from pyspark.sql import functions as F

from mosaiq.functions import names as n
from mosaiq.plans.catalogue import query
from mosaiq.session import table

_FILE = "CASE p_partkey % 6 WHEN 0 THEN 'ch2_ohr_ncp_' WHEN 1 THEN 'ch2_tmc_ndn_' WHEN 2 THEN 'ch2_iir_nri_' WHEN 3 THEN 'M1_NAC_' WHEN 4 THEN 'tco_map_02_' ELSE 'ch2_ohr_nrp_' END || '20210405T' || lpad(p_partkey::varchar, 10, '0') || CASE p_partkey % 5 WHEN 0 THEN '_d_img_d18.xml' WHEN 1 THEN '_b_brw_d18.xml' WHEN 2 THEN '_g_grd_d18.csv' WHEN 3 THEN '_100cm.xml' ELSE '.IMG' END"


def _files(spark, d):
    key = F.col("p_partkey")
    head = F.element_at(F.array(*map(F.lit, ("ch2_ohr_ncp_", "ch2_tmc_ndn_", "ch2_iir_nri_", "M1_NAC_", "tco_map_02_", "ch2_ohr_nrp_"))), (key % 6 + 1).cast("int"))
    tail = F.element_at(F.array(*map(F.lit, ("_d_img_d18.xml", "_b_brw_d18.xml", "_g_grd_d18.csv", "_100cm.xml", ".IMG"))), (key % 5 + 1).cast("int"))
    return table(spark, d, "part").select(key, "p_name", F.concat(head, F.lit("20210405T"), F.lpad(key.cast("string"), 10, "0"), tail).alias("f"))


@query(
    "file_name_rules",
    f"""
WITH f AS (SELECT p_partkey, {_FILE} AS f FROM part)
SELECT p_partkey, CASE WHEN contains(lower(f), '_b_brw_') THEN 'browse' WHEN contains(lower(f), '_g_grd_') THEN 'geometry' WHEN contains(lower(f), '_d_img_') OR f LIKE '%\\_100cm.xml' ESCAPE '\\' THEN 'data' ELSE 'other' END AS product_type,
 CASE WHEN f LIKE 'ch2\\_ohr%' ESCAPE '\\' THEN 'OHRC' WHEN f LIKE 'ch2\\_tmc%' ESCAPE '\\' THEN 'TMC2' WHEN f LIKE 'ch2\\_iir%' ESCAPE '\\' THEN 'IIRS' ELSE 'UNKNOWN' END AS sensor,
 CASE WHEN f LIKE '%ohr%' THEN 'OHRC' WHEN f LIKE '%iir%' THEN 'IIRS' WHEN f LIKE '%tmc%' THEN 'TMC2' WHEN f LIKE '%NAC%' THEN 'LRO_NAC' END AS guessed,
 CASE WHEN f LIKE '%ohr%' THEN CASE split_part(f, '_', 3) WHEN 'nrp' THEN 'raw' WHEN 'ncp' THEN 'calibrated' ELSE 'unknown' END WHEN f LIKE '%tmc%' OR f LIKE '%iir%' THEN CASE substr(split_part(f, '_', 3), 2, 1) WHEN 'r' THEN 'raw' WHEN 'c' THEN 'calibrated' ELSE 'unknown' END ELSE 'unknown' END AS level,
 regexp_extract(f, '[0-9]{{8}}T[0-9]{{10}}') AS grid_key, regexp_replace(f, '\\.[^.]*$', '') AS stem, lower(regexp_extract(f, '\\.[^.]+$')) AS suffix FROM f""",
)
def _rules(spark, d):
    f = F.col("f")
    return _files(spark, d).select("p_partkey", n.product_type(f).alias("product_type"), n.sensor_of_file(f).alias("sensor"), n.guess_sensor(f).alias("guessed"), n.level(n.sensor_of_file(f), n.stem(f)).alias("level"), n.grid_key(f, F.lit(None).cast("string")).alias("grid_key"), n.stem(f).alias("stem"), n.suffix(f).alias("suffix"))


@query(
    "label_path_segments",
    """
WITH s AS (SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN p_name WHEN 1 THEN p_name || '[kind=' || p_brand || ']' WHEN 2 THEN p_name || '[kind' ELSE p_name || '[a=]' END AS s FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 4 <> 2 THEN split_part(s, '[', 1) END AS name, CASE WHEN p_partkey % 4 = 1 THEN 'kind' WHEN p_partkey % 4 = 3 THEN 'a' END AS child,
  CASE WHEN p_partkey % 4 = 1 THEN split_part(split_part(s, '=', 2), ']', 1) WHEN p_partkey % 4 = 3 THEN '' END AS value, p_partkey % 4 <> 2 AS whole FROM s""",
)
def _segments(spark, d):
    key, name = F.col("p_partkey"), F.col("p_name")
    s = F.when(key % 4 == 0, name).when(key % 4 == 1, F.concat(name, F.lit("[kind="), "p_brand", F.lit("]"))).when(key % 4 == 2, F.concat(name, F.lit("[kind"))).otherwise(F.concat(name, F.lit("[a=]")))
    seg = n.path_segment(s)
    return table(spark, d, "part").select("p_partkey", seg["name"].alias("name"), seg["child"].alias("child"), seg["value"].alias("value"), n.path_segments(F.concat(F.lit("a/"), s)).isNotNull().alias("whole"))


@query(
    "archive_members",
    """
WITH m AS (SELECT c_custkey, CASE c_custkey % 6 WHEN 0 THEN './data/' || c_name WHEN 1 THEN 'data/' || c_name WHEN 2 THEN '/etc/' || c_name WHEN 3 THEN 'data/../' || c_name WHEN 4 THEN 'other/' || c_name ELSE 'data/' END AS name,
  CASE WHEN c_custkey % 6 = 5 THEN 'dir' WHEN c_custkey % 7 = 0 THEN 'link' ELSE 'file' END AS kind FROM customer)
SELECT CASE WHEN name LIKE '/%' OR contains('/' || name || '/', '/../') OR kind = 'link' THEN 'REFUSED_UNSAFE' WHEN NOT regexp_matches(name, '^(\\./)?data/') THEN 'REFUSED_OUTSIDE_DATA' ELSE 'OK' END AS status, CAST(count(*) AS BIGINT) AS n, min(name) AS sample FROM m GROUP BY 1""",
)
def _members(spark, d):
    k = F.col("c_custkey") % 6
    name = F.when(k == 0, F.concat(F.lit("./data/"), "c_name")).when(k == 1, F.concat(F.lit("data/"), "c_name")).when(k == 2, F.concat(F.lit("/etc/"), "c_name")).when(k == 3, F.concat(F.lit("data/../"), "c_name")).when(k == 4, F.concat(F.lit("other/"), "c_name")).otherwise("data/")
    kind = F.when(k == 5, "dir").when(F.col("c_custkey") % 7 == 0, "link").otherwise("file")
    m = table(spark, d, "customer").select(name.alias("name"), kind.alias("kind"))
    return m.select(F.coalesce(n.tar_member_status(F.col("name"), F.col("kind")), F.lit("OK")).alias("status"), "name").groupBy("status").agg(F.count("*").alias("n"), F.min("name").alias("sample"))


@query(
    "safe_names",
    """
SELECT s_suppkey, right(regexp_replace(s_name || ':' || s_suppkey || '/x', '[^A-Za-z0-9_-]', '_', 'g'), 60) AS stem, regexp_replace('2024-01-02T03:04:05+00:00', '[^A-Za-z0-9_.-]', '-', 'g') AS stamp,
  regexp_matches(s_name, '^[A-Za-z0-9][A-Za-z0-9._-]*$') AS is_pair_id, CASE WHEN s_suppkey % 2 = 0 THEN '20210405T' || lpad(s_suppkey::varchar, 10, '0') ELSE regexp_replace(s_name, '[^A-Za-z0-9._]', '_', 'g') END AS tag,
  CASE WHEN s_suppkey % 3 = 0 THEN 'CH2_OHRC_RAW' WHEN s_suppkey % 3 = 1 THEN 'CH2_OHRC_CAL' ELSE 'CH2_TMC2_DERIVED' END AS sensor,
  CASE WHEN s_suppkey % 2 = 0 THEN '' ELSE '_affine' END || CASE WHEN s_suppkey % 3 = 0 THEN '' ELSE '_pp-clahe' END AS variant,
  CASE WHEN s_suppkey % 2 = 0 THEN s_suppkey::int ELSE 100009 END AS crs, CASE s_suppkey % 3 WHEN 0 THEN 'ODE' WHEN 1 THEN 'DARTS' END AS source, CASE WHEN s_suppkey % 2 = 0 THEN 'data' ELSE 'misc' END AS role FROM supplier""",
)
def _safe(spark, d):
    key, name = F.col("s_suppkey"), F.col("s_name")
    third, even = key % 3, key % 2 == 0
    tagged = F.when(even, F.concat(F.lit("x_20210405T"), F.lpad(key.cast("string"), 10, "0"))).otherwise(name)
    record = n.recorded_as(F.concat(F.when(third == 0, "ode_").when(third == 1, "tc_dtm_").otherwise("zz_"), name), F.concat(F.lit("a/b."), F.when(even, "IMG").otherwise("bin")))
    return table(spark, d, "supplier").select(
        "s_suppkey",
        n.safe_stem(F.concat(name, F.lit(":"), key.cast("string"), F.lit("/x")), F.lit("none")).alias("stem"),
        n.stamp(F.lit("2024-01-02T03:04:05+00:00")).alias("stamp"),
        n.is_pair_id(name).alias("is_pair_id"),
        n.timestamp_tag(tagged).alias("tag"),
        n.sensor_name(F.when(third < 2, "OHRC").otherwise("TMC2"), F.when(third == 0, "raw").when(third == 1, "calibrated").otherwise("derived")).alias("sensor"),
        n.variant(F.when(even, "homography").otherwise("affine"), F.when(third == 0, "none").otherwise("clahe")).alias("variant"),
        n.crs_code(F.concat(F.lit("urn:ogc:def:crs:EPSG::"), F.when(even, key.cast("string")).otherwise("abc"))).alias("crs"),
        record["source"].alias("source"),
        record["role"].alias("role"),
    )


@query(
    "strip_mid_times",
    """
WITH t AS (SELECT o_orderkey, CAST(o_orderdate AS TIMESTAMP) AS a, CAST(o_orderdate AS TIMESTAMP) + to_seconds(CAST(o_orderkey % 977 AS BIGINT)) AS b FROM orders)
SELECT o_orderkey, strftime(make_timestamp(epoch_us(a) + (epoch_us(b) - epoch_us(a)) // 2), '%Y-%m-%dT%H:%M:%S') AS mid, strftime(b, '%Y-%m-%dT%H:%M:%S') AS stop, o_orderkey % 5 <> 0 AS parsed FROM t""",
)
def _mid(spark, d):
    a = F.col("o_orderdate").cast("timestamp")
    b = F.timestamp_micros(F.unix_micros(a) + (F.col("o_orderkey") % 977) * 1_000_000)
    text = F.when(F.col("o_orderkey") % 5 == 0, F.lit("no time")).otherwise(F.concat(n.utc_text(a), F.lit("Z")))
    return table(spark, d, "orders").select("o_orderkey", n.utc_text(n.mid_time(a, b)).alias("mid"), n.utc_text(b).alias("stop"), n.utc(text).isNotNull().alias("parsed"))


@query(
    "option_lists",
    """
WITH t AS (SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN '512, 768,' || c_custkey WHEN 1 THEN '512,-1' WHEN 2 THEN ' , ' ELSE '64,x' END AS t FROM customer)
SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 AND c_custkey > 0 THEN CAST(1280 + c_custkey AS BIGINT) END AS total, c_custkey % 4 IN (2) AS empty, c_custkey % 4 = 3 AS header FROM t""",
)
def _options(spark, d):
    k = F.col("c_custkey") % 4
    text = F.when(k == 0, F.concat(F.lit("512, 768,"), F.col("c_custkey").cast("string"))).when(k == 1, "512,-1").when(k == 2, " , ").otherwise("64,x")
    total = F.aggregate(n.tile_sizes(text), F.lit(0).cast("long"), lambda a, x: a + x)
    return table(spark, d, "customer").select("c_custkey", total.alias("total"), (F.size(n.csv_list(text)) == 0).alias("empty"), n.looks_like_header(n.csv_list(text)).alias("header"))


@query(
    "element_categories",
    """
WITH e AS (SELECT DISTINCT lower(unnest(string_split(p_name || ' Solar_Azimuth corner_latitude start_time Orbit', ' '))) AS w FROM part)
SELECT w, CASE WHEN regexp_matches(w, 'solar|sun|incidence|emission|phase|illum') THEN 'illumination' WHEN regexp_matches(w, 'lat|lon|corner|coordinate') THEN 'coordinate' WHEN regexp_matches(w, 'time|date|utc|sclk') THEN 'time' END AS category FROM e""",
)
def _categories(spark, d):
    words = F.explode(F.split(F.lower(F.concat("p_name", F.lit(" Solar_Azimuth corner_latitude start_time Orbit"))), " "))
    return table(spark, d, "part").select(words.alias("w")).distinct().select("w", n.element_category(F.col("w")).alias("category"))
