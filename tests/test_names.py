import pytest
from pyspark.sql import functions as F

from mosaiq.functions import names as n


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_product_types_levels_and_sensors(spark):
    def kinds(*names):
        return one(spark, *[n.product_type(F.lit(x)) for x in names])

    assert kinds("/a/X_B_BRW_1.png", "b_g_grd_d18.csv", "q_D_CUB_.qub", "m_100CM.XML", "k.LBL", "k.img") == ("browse", "geometry", "data", "data", "data", "other")
    pairs = [("OHRC", "ch2_ohr_nrp_x"), ("OHRC", "ch2"), ("TMC2", "a_b_ndn_d_oth_x"), ("IIRS", "a_b_ncn"), ("LRO_NAC", "x"), ("SELENE_TC", "TCO_MAP_x"), ("SELENE_TC", "x"), ("DFSAR", "x")]
    assert one(spark, *[n.level(F.lit(i), F.lit(s)) for i, s in pairs]) == ("raw", "unknown", "derived", "calibrated", "derived", "derived", "raw", "unknown")
    assert one(spark, n.guess_sensor(F.lit(None), F.lit("x_nac_y")), n.guess_sensor(F.lit("none")), n.sensor_of_file(F.lit("CH2_SAR_1"))) == ("LRO_NAC", None, "DFSAR")


def test_paths_segments_and_tags(spark):
    s = n.path_segments(F.lit("a/b[c=d]/e"))
    assert [tuple(x) for x in one(spark, s)[0]] == [("a", None, None), ("b", "c", "d"), ("e", None, None)]
    assert one(spark, n.path_segments(F.lit("a//b")), n.path_segment(F.lit("a[b]")), n.local_name(F.lit("{u}x")), n.namespace(F.lit("{u}x")), n.namespace(F.lit("x"))) == (None, None, "x", "u", None)
    assert one(spark, *[n.is_contained(F.lit(x)) for x in ("a/b", "/a", "../a", "a/../b", "a..b")]) == (True, False, False, False, True)
    assert one(spark, n.stem(F.lit("a/b.tar.gz")), n.stem(F.lit(".hidden")), n.suffix(F.lit("a/.hidden")), n.suffix(F.lit("b.IMG"))) == ("b.tar", ".hidden", "", ".img")


def test_ids_stems_and_samples(spark):
    assert one(spark, n.safe_stem(F.lit("urn:a/ü-" + "x" * 80), F.lit("f")), n.safe_stem(F.lit(""), F.lit("f"))) == ("x" * 60, "f")
    assert one(spark, n.is_pair_id(F.lit("a-b_c.1")), n.is_pair_id(F.lit("-a")), n.is_pair_id(F.lit(None).cast("string"))) == (True, False, False)
    with pytest.raises(Exception, match="invalid pair_id"):
        one(spark, n.checked_pair_id(F.lit("a b")))
    assert one(spark, n.grid_key(F.lit("/x/a_20210405t1234567890_b.xml"), F.lit("none")), n.grid_key(F.lit("x"), F.lit(None).cast("string"))) == ("20210405T1234567890", None)
    assert one(spark, n.variant_of_pair(F.lit("s-REF_sift_affine"), F.lit("REF"), F.lit("sift")), n.variant_of_pair(F.lit("other"), F.lit("REF"), F.lit("sift"))) == ("_affine", "other")
    text = one(spark, n.fit_sample(F.lit("OHRC"), F.lit("/p" * 150 + "/name.xml"), F.lit("e" * 130)))[0]
    assert len(text) == 200 and text.startswith("OHRC ...") and text.endswith("/name.xml: " + "e" * 117 + "...")


def test_maps_numbers_and_times(spark):
    assert one(spark, n.field_index(F.array(F.lit("Lon "), F.lit("LAT"), F.lit("lon"))))[0] == {"lat": 1, "lon": 2}
    meta = F.create_map(F.lit("a"), F.lit("1"), F.lit("b"), F.lit(None).cast("string"))
    assert one(spark, n.scalar_meta(meta))[0] == {"matcher_a": "1"}
    assert one(spark, n.as_float(F.lit("1e3")), n.as_float(F.lit("x")), n.plain_cell(F.lit(float("nan"))), n.crs_code(F.lit("EPSG:30120")), n.crs_code(F.lit(None).cast("string"))) == (1000.0, None, None, 30120, 100009)
    assert one(spark, n.utc_text(n.utc(F.lit("2021-04-05T06:07:08.9+01:00"))), n.utc(F.lit("soon"))) == ("2021-04-05T05:07:08", None)
    odd = n.mid_time(F.timestamp_micros(F.lit(10)), F.timestamp_micros(F.lit(13)))
    assert one(spark, F.unix_micros(odd))[0] == 11
    rule = n.is_excluded(F.col("p"), files=("a.txt",), names=("README",), prefixes=("old/",), patterns=("nac/%.IMG",))
    got = spark.createDataFrame([(x,) for x in ("a.txt", "x/README", "old/z", "nac/1.IMG", "b.txt")], "p string").select(rule).collect()
    assert [r[0] for r in got] == [True, True, True, True, False]
    assert one(spark, n.sha256(F.lit("abc")))[0].startswith("ba7816bf")
