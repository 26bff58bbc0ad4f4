import numpy as np
import pytest
from pyspark.sql import functions as F

from mosaiq.operators import fitting, graph
from mosaiq.sources import catalogues, files, labels, store
from mosaiq.streaming import jobs

XML = """<?xml version="1.0"?>
<Product_Observational xmlns="http://base/v1" xmlns:g="http://geo/v1">
  <Identification_Area><logical_identifier>urn:a:b</logical_identifier><g:height>12.5</g:height></Identification_Area>
  <Array_2D_Image>
    <Axis_Array><axis_name>Sample</axis_name><elements>400</elements><sequence_number>2</sequence_number></Axis_Array>
    <Axis_Array><axis_name>Line</axis_name><elements>300</elements><sequence_number>1</sequence_number></Axis_Array>
    <Axis_Array><axis_name>Bad</axis_name><elements>many</elements><sequence_number>3</sequence_number></Axis_Array>
  </Array_2D_Image>
</Product_Observational>"""


@pytest.fixture(scope="module")
def found(spark):
    df = spark.createDataFrame([("a.xml", XML), ("bad.xml", "<a><b></a>"), ("empty.xml", None)], "path string, content string")
    return labels.elements(df)


def test_elements_leaves_and_namespaces(found):
    rows = {(r["path"], r["name"]): r for r in labels.leaves(found).collect()}
    assert rows["a.xml", "height"]["is_numeric"] and rows["a.xml", "height"]["namespace"] == "http://geo/v1"
    assert rows["a.xml", "logical_identifier"]["element"] == "Product_Observational/Identification_Area/logical_identifier"
    assert {r["path"] for r in found.filter("status = 'UNREADABLE'").collect()} == {"bad.xml", "empty.xml"}
    assert {r["namespace"]: r["n"] for r in labels.namespaces(found).collect()}["http://geo/v1"] == 1


def test_fields_by_candidate_paths(found):
    wanted = {
        "id": ("string", ["Nowhere/logical_identifier", "Product_Observational/logical_identifier"]),
        "height": ("double", ["height"]),
        "size": ("int", ["Axis_Array/axis_name"]),
        "none": ("double", ["missing"]),
    }
    rows = {r["field"]: r for r in labels.fields(found, wanted).collect()}
    assert (rows["id"]["raw"], rows["id"]["status"]) == ("urn:a:b", "RESOLVED")
    assert (rows["height"]["number"], rows["height"]["status"]) == (12.5, "RESOLVED")
    assert (rows["size"]["raw"], rows["size"]["status"]) == ("Sample", "COERCE_FAILED")
    assert (rows["none"]["raw"], rows["none"]["status"]) == (None, "UNRESOLVED")


def test_axes_by_sequence(found):
    (row,) = labels.axes(found).collect()
    assert [(a["sequence"], a["name"], a["elements"]) for a in row["axes"]] == [(1, "Line", 300), (2, "Sample", 400)]


def test_keywords_stop_at_the_end_and_keep_the_first(spark):
    text = 'PDS_VERSION_ID = PDS3\r\nlines = "10"\r\nLINES = 20\r\n^IMAGE = ("x.img")\r\nEND\r\nAFTER = 1\r\n'
    got = {r["key"]: r["value"] for r in labels.keywords(spark.createDataFrame([("a", text)], "path string, content string")).collect()}
    assert got == {"PDS_VERSION_ID": "PDS3", "LINES": "10", "^IMAGE": '("x.img")'}


def test_formats_and_files_without_label(spark, tmp_path):
    for name, text in {"a.xml": XML, "b.lbl": "PDS_VERSION_ID = PDS3", "c.lbl": "object = isiscube", "d.lbl": "?"}.items():
        (tmp_path / name).write_text(text)
    got = {r["path"].rsplit("/", 1)[1]: r["f"] for r in files.listing(spark, str(tmp_path), ["*.xml", "*.lbl"]).select("path", files.label_format(F.col("content")).alias("f")).collect()}
    assert got == {"a.xml": "pds4", "b.lbl": "pds3", "c.lbl": "isis3", "d.lbl": None}
    data = spark.createDataFrame([("/x/a.IMG",), ("/x/e.img",), ("/y/a.img",), ("/y/r.img",)], "path string")
    left = files.without_label(data, spark.createDataFrame([("/x/A.xml",)], "path string"), spark.createDataFrame([("/y/r.img",)], "path string"))
    assert {r["path"] for r in left.collect()} == {"/x/e.img", "/y/a.img"}


def test_geojson_outcomes(spark):
    square = "[[[0,0],[1,0],[1,1],[0,1],[0,0]]]"

    def feature(i, g):
        return f'{{"properties":{{"PRODUCT_ID":{i}}},"geometry":{g}}}'

    text = '{"features":[' + ",".join(
        [
            feature('"ok"', f'{{"type":"Polygon","coordinates":{square}}}'),
            feature('"multi"', f'{{"type":"MultiPolygon","coordinates":[{square}]}}'),
            feature("null", f'{{"type":"Polygon","coordinates":{square}}}'),
            feature('"none"', "null"),
            feature('"empty"', '{"type":"Polygon","coordinates":[[]]}'),
            feature('"flat"', '{"type":"Polygon","coordinates":[[[0,0],[1,0],[0,0]]]}'),
            feature('"far"', '{"type":"Polygon","coordinates":[[[50,0],[51,0],[51,1],[50,1],[50,0]]]}'),
        ]
    ) + "]}"
    df = spark.createDataFrame([("a", text), ("b", "nothing")], "path string, text string")
    rows = {(r["path"], r["ordinal"]): r for r in catalogues.geojson(df, box=(-5, 5, -5, 5)).collect()}
    assert [rows["a", i]["status"] for i in range(7)] == ["OK", "OK", "MISSING_ID", "NO_GEOMETRY", "EMPTY_RING", "DEGENERATE_FOOTPRINT", "OUTSIDE_BOX"]
    assert abs(rows["a", 0]["area_km2"] - 919.4) < 0.5 and rows["b", None]["status"] == "UNREADABLE"


def test_grid_rows_and_repeats(spark):
    text = ["1,2,3,4", "1,2,3,4", "", "1,2,3", "x,2,3,4", "1,2,3.0,4", "1,91,3,4", "nan,2,3,4", "1,2,-3,4", "1,2,3,99", None]
    df = spark.createDataFrame(list(enumerate(text)), "lineno int, line string")
    got = catalogues.assembled(catalogues.grid_rows(df, ["Longitude", "Latitude", "Pixel", "Scan"], 50, 50))
    want = ["OK", "DUPLICATE_POINT", "EMPTY_ROW", "WRONG_FIELD_COUNT", "NON_NUMERIC", "NON_NUMERIC", "COORDINATE_OUT_OF_RANGE", "COORDINATE_OUT_OF_RANGE", "INDEX_OUT_OF_RANGE", "INDEX_OUT_OF_RANGE", "EMPTY_ROW"]
    assert [r["status"] for r in got.orderBy("lineno").collect()] == want


def test_records(spark):
    cols = "pdsid, product_name, minimum_latitude, maximum_latitude, westernmost_longitude, easternmost_longitude, incidence_angle".split(", ")
    df = spark.createDataFrame([("a", "x", "1", "2", "3", "4", "30"), (None, "b", "1", "2", "3", None, "?"), (None, None, "1", "2", "3", "4", None)], ", ".join(f"{c} string" for c in cols))
    assert [(r["product_id"], r["status"], r["elevation_deg"]) for r in catalogues.records(df).collect()] == [("a", "OK", 60.0), ("b", "NO_GEOMETRY", None), (None, "MISSING_ID", None)]


def test_radius_dedup_against_brute_force(spark):
    rng = np.random.default_rng(7)
    p = np.round(rng.uniform(0, 30, (150, 4)), 3)
    p[:, 2:] = p[:, :2] + rng.choice([0, 0, 5], (150, 1))
    p[100:] = p[:50] + rng.uniform(-0.4, 0.4, (50, 4))
    p[140:] = p[0]
    score = rng.integers(0, 4, 150).astype(float)
    root = list(range(150))
    for _ in range(150):
        for i in range(150):
            close = (np.hypot(*(p[:, :2] - p[i, :2]).T) <= 1.5) & (np.hypot(*(p[:, 2:] - p[i, 2:]).T) <= 1.5)
            root[i] = min(root[j] for j in np.flatnonzero(close))
    want = {max((i for i in range(150) if root[i] == r), key=lambda i: (score[i], i)) for r in set(root)}
    df = spark.createDataFrame([(i, *map(float, p[i]), float(score[i])) for i in range(150)], "id long, sx double, sy double, dx double, dy double, score double")
    assert {r["id"] for r in graph.radius_dedup(df, 1.5, "score").collect()} == want
    assert graph.radius_dedup(df.limit(0), 1.5).count() == 0


@pytest.mark.parametrize("fits", [500_000, 300])
def test_groups_of_shuffled_and_adverse_chains(spark, fits):
    rng = np.random.default_rng(4)
    shuffled = rng.permutation(5000) + 1
    zigzag = [20_001] + [x for pair in zip(range(23_000, 22_000, -1), range(20_002, 21_002)) for x in pair]
    edges = [(int(a), int(b)) for a, b in zip(shuffled, shuffled[1:])] + list(zip(zigzag, zigzag[1:])) + [(40_000, i) for i in range(40_001, 40_400)] + [(50_000, 50_000)]
    found = {r["id"]: r["first"] for r in graph.groups(spark.createDataFrame(edges + [(None, 3)], "a long, b long"), fits=fits).collect()}
    assert len(found) == 5000 + len(zigzag) + 400
    assert all(f == (1 if i <= 5000 else 20_001 if i < 40_000 else 40_000) for i, f in found.items())


def test_groups_of_a_long_chain_and_a_star(spark):
    pairs = spark.range(1, 60).selectExpr("id as a", "id + 1 as b").union(spark.range(101, 140).selectExpr("id as a", "100L as b"))
    got = {r["id"]: r["first"] for r in graph.groups(pairs).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, **{i: 100 for i in range(100, 140)}}


def test_agreement(spark):
    def shift(v):
        return [1.0, 0.0, v, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0]

    df = spark.createDataFrame([("t", "a", shift(0.0)), ("t", "b", shift(0.6)), ("t", "c", [0.0] * 9), ("u", "a", shift(0.0)), ("v", "a", shift(0.0)), ("v", "b", shift(1.5))], "tag string, name string, matrix array<double>")
    got = {r["tag"]: (r["n_usable"], r["worst"] and round(r["worst"], 6), r["agrees"]) for r in graph.agreement(df, "tag", 64.0, 64.0, 1.0).collect()}
    assert got == {"t": (2, 0.6, True), "u": (1, None, False), "v": (2, 1.5, False)}


def _points(spark, n, astray, seed=3):
    rng = np.random.default_rng(seed)
    x, y = rng.uniform(0, 500, (2, n))
    u, v = 1.1 * x - 0.2 * y + 5, 0.15 * x + 0.9 * y - 8
    u[:astray] += rng.uniform(20, 200, astray)
    rows = [("p", i, *map(float, r)) for i, r in enumerate(zip(x, y, u, v))]
    return spark.createDataFrame(rows + [("few", 1, 0.0, 0.0, 1.0, 1.0), ("line", 1, 0.0, 0.0, 1.0, 1.0), ("line", 2, 1.0, 1.0, 2.0, 2.0), ("line", 3, 2.0, 2.0, 3.0, 3.0)], "pair string, id long, sx double, sy double, dx double, dy double")


def test_robust_affine_finds_the_inliers(spark):
    got = {r["pair"]: r for r in fitting.robust_affine(_points(spark, 100, 40)).collect()}
    assert (got["p"]["n"], got["p"]["n_inliers"]) == (100, 60)
    assert np.allclose(got["p"]["affine"], [1.1, -0.2, 5, 0.15, 0.9, -8], atol=1e-6)
    assert got["few"]["affine"] is None and got["line"]["affine"] is None and got["few"]["n_inliers"] == 0


def test_bootstrap_of_exact_and_of_loose_points(spark):
    exact = {r["pair"]: r for r in fitting.bootstrap(_points(spark, 60, 0), 500, 500).collect()}
    loose = {r["pair"]: r for r in fitting.bootstrap(_points(spark, 60, 30), 500, 500).collect()}
    assert exact["p"]["p95_px"] < 1e-6 and exact["p"]["n_fits"] == 40 and exact["few"]["p95_px"] == float("inf")
    assert 1 < loose["p"]["median_px"] <= loose["p"]["p95_px"] <= loose["p"]["max_px"] < 1e3


def test_principal_component_against_numpy(spark):
    x = np.random.default_rng(5).normal(size=(80, 4)) @ np.diag([1, 5, 2, 0.5])
    df = spark.createDataFrame([(r.tolist(),) for r in x] + [([float("nan")] * 4,), (None,)], "bands array<double>")
    mean, direction, share = fitting.principal_component(df)
    values, vectors = np.linalg.eigh(np.cov(x.T, bias=True))
    assert np.allclose(mean, x.mean(axis=0)) and np.allclose(abs(direction @ vectors[:, -1]), 1) and np.isclose(share, values[-1] / values.sum())
    assert fitting.principal_component(df.limit(0))[2] == 0.0


def test_azimuth_fit_finds_the_sun(spark):
    rng = np.random.default_rng(2)
    s, a = rng.uniform(0, 0.6, 400), rng.uniform(0, 2 * np.pi, 400)
    image = np.clip(np.sin(0.5) * np.cos(s) + np.cos(0.5) * np.sin(s) * np.cos(np.radians(140) - a), 0, 1)
    df = spark.createDataFrame([("k", *map(float, r)) for r in zip(s, a, image)], "k string, slope double, aspect double, image double")
    (r,) = fitting.azimuth_fit(fitting.azimuth_scores(df, ["k"], np.degrees(0.5), 5.0), ["k"]).collect()
    assert r["azimuth"] == 140.0 and r["ncc"] > 0.999 and 0 < r["margin"] < 1


def test_bilinear_holds_on_nodes_and_never_extrapolates(spark):
    nodes = spark.createDataFrame([(x, y, 2.0 * x + 3 * y) for x in (0, 10, 20) for y in (0, 10)], "col int, row int, value double")
    q = spark.createDataFrame([(1, 0.0, 0.0), (2, 20.0, 10.0), (3, 12.5, 4.0), (4, 21.0, 1.0), (5, None, 1.0)], "id int, x double, y double")
    assert {r["id"]: r["value"] for r in fitting.bilinear(q, nodes, 10).collect()} == {1: 0.0, 2: 70.0, 3: 37.0, 4: None, 5: None}


def test_store_refuses_and_rebuilds(spark, tmp_path):
    root = str(tmp_path / "s")
    one = spark.createDataFrame([("a", 1, [1.0]), ("b", 2, [2.0])], "pair_id string, n int, points array<double>")
    store.save_results(one, root)
    with pytest.raises(store.StoreError):
        store.save_results(one.filter("pair_id = 'a'"), root)
    with pytest.raises(store.StoreError):
        store.save_results(one.union(one), f"{root}2")
    store.save_results(spark.createDataFrame([("b", 7, [2.0]), ("c", 3, [2.0])], one.schema), root, overwrite=True)
    index = store.load(spark, f"{root}/index", "pair_id string, n int, extra string")
    assert [(r["pair_id"], r["n"], r["extra"]) for r in index.orderBy("pair_id").collect()] == [("a", 1, None), ("b", 7, None), ("c", 3, None)]
    assert store.load(spark, f"{root}/nothing", "x int").count() == 0
    (tmp_path / "s" / "index").rename(tmp_path / "s" / "index.old")
    assert store.load(spark, f"{root}/index", "pair_id string").count() == 3


def test_reindex_keeps_the_old_index_when_pairs_failed(spark, tmp_path):
    root = str(tmp_path)
    full = spark.createDataFrame([("a", 1), ("b", 2)], "pair_id string, n int")
    store.save_results(full, root)
    full.limit(1).write.mode("overwrite").partitionBy("pair_id").parquet(f"{root}/pairs")
    assert not store.reindex(spark, root, failed=1)
    assert spark.read.parquet(f"{root}/index").count() == 2
    assert store.reindex(spark, root, failed=1, force=True) and spark.read.parquet(f"{root}/index").count() == 1


def test_failures_upserts_documents_and_violations(spark, tmp_path):
    root = str(tmp_path)
    assert store.load_failures(spark, root).count() == 0
    store.save_failures(spark.createDataFrame([("a", "BAD", "x")], "pair_id string, status string, error string"), root)
    store.save_failures(spark.createDataFrame([("b", "BAD", 3)], "pair_id string, status string, x_n int"), root)
    assert {(r["pair_id"], r["error"], r["x_n"]) for r in store.load_failures(spark, root).collect()} == {("a", "x", None), ("b", None, 3)}
    old, new = spark.createDataFrame([(1, "o"), (2, "o")], "k int, v string"), spark.createDataFrame([(2, "n", 1)], "k int, v string, w int")
    assert {tuple(r) for r in store.upsert(old, new, "k").collect()} == {(1, "o", None), (2, "n", 1)}
    assert store.documents_of(spark.createDataFrame([(float("nan"), None)], "a double, b string")).first()[0] == '{"a":null,"b":null}'
    assert store.violations('{"a": 1}', {"a": str, "b": int}) == ["a: not str", "b: absent"] and store.violations("?", {})[0].startswith("no JSON")


def test_streams_keep_failures_and_results(spark, tmp_path):
    source, root = str(tmp_path / "in"), str(tmp_path / "out")
    schema = "pair_id string, status string, error string, n int"
    spark.createDataFrame([("a", "OK", None, 1), ("b", "BAD", "x", 2), ("c", None, "y", 3), ("a", "OK", None, 5)], schema).write.parquet(source)
    for turn in range(2):  # the second start finds nothing new
        stream = spark.readStream.schema(schema).parquet(source)
        jobs.keep_failures(stream, root, f"{root}/_c1").awaitTermination(120)
        jobs.keep_results(stream.select("pair_id", "n"), root, f"{root}/_c2").awaitTermination(120)
        assert {r["pair_id"] for r in store.load_failures(spark, root).collect()} == {"b", "c"}
        assert {(r["pair_id"], r["n"]) for r in spark.read.parquet(f"{root}/index").collect()} == {("a", 5), ("b", 2), ("c", 3)}


def test_window_tally_of_a_stream_equals_the_table(spark, tmp_path):
    events = spark.createDataFrame([(f"2024-01-0{d} {h:02}:30:00", k, 1.0) for d in (1, 2, 3) for h in (1, 5) for k in "xy"], "t string, k string, v double").select(F.to_timestamp("t").alias("t"), "k", "v")
    events.write.parquet(str(tmp_path / "e"))
    stream = jobs.window_tally(spark.readStream.schema(events.schema).parquet(str(tmp_path / "e")), "t", "k", "v", "1 day")
    q = stream.writeStream.format("memory").queryName("tally").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {tuple(r) for r in spark.table("tally").collect()} == {tuple(r) for r in jobs.window_tally(events, "t", "k", "v", "1 day").collect()}
