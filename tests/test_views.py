import numpy as np
from pyspark.sql import functions as F

from mosaiq import cli
from mosaiq.operators import views as v


def test_pictures_of_two_images():
    a, b = np.zeros((8, 8)), np.arange(64.0).reshape(8, 8)
    c = v.checkerboard(a, b, 4)
    assert (c[:2, :2] == 0).all() and (c[:2, 2:4] == b[:2, 2:4]).all() and (c[2:4, :2] == b[2:4, :2]).all()
    assert (v.blended(a, b, 0.25) == b / 4).all() and v.anaglyph(a, b).shape == (8, 8, 3) and v.overlay(a, b)[..., 2].max() == 0
    both, at = v.side_by_side(a, b[:4])
    assert both.shape == (8, 16) and at == 8 and (both[:4, 8:] == b[:4]).all()
    small, scale = v.thumbnail(b, 4)
    assert small.shape == (4, 4) and scale == 0.5 and v.thumbnail(b)[1] == 1


def test_tables_of_a_viewer(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, float("nan")), (4, 1.0)], "id int, x double")
    assert [r["id"] for r in v.sorted_nulls_last(df, "x", tie="id").collect()] == [4, 1, 2, 3]
    assert [r["id"] for r in v.sorted_nulls_last(df, "x", False, tie="id").collect()] == [1, 4, 2, 3]
    r = spark.range(1).select(v.self_by_truth(F.lit(2.0), F.lit(4.0)), v.self_by_truth(F.lit(2.0), F.lit(0.0)), v.ratio(F.lit(1.0), F.lit(0.0))).first()
    assert tuple(r) == (0.5, None, None)


def test_commands(spark, tmp_path, capsys):
    label = "<P><logical_identifier>urn:ohr_%d</logical_identifier>" + "".join(f"<{s}_{c}>{{{s}_{c}}}</{s}_{c}>" for s in ("upper_left", "upper_right", "lower_left", "lower_right") for c in ("latitude", "longitude")) + "</P>"
    (tmp_path / "in").mkdir()
    for i in (0, 1):
        at = {"upper_left": (2, 0), "upper_right": (2, 2), "lower_left": (0, 0), "lower_right": (0, 2)}
        text = (label % i).format(**{f"{s}_{c}": q + i * 0.5 for s, p in at.items() for c, q in zip(("latitude", "longitude"), p)})
        (tmp_path / "in" / f"a{i}_d_img_.xml").write_text(text)
    assert cli.main(["catalog", str(tmp_path / "in"), "--out", str(tmp_path / "m")], spark) == 0
    m = spark.read.parquet(str(tmp_path / "m"))
    assert m.count() == 2 and {r["sensor"] for r in m.collect()} == {"OHRC"} and len(m.columns) == 36
    cli.main(["overlap", str(tmp_path / "m"), "--out", str(tmp_path / "o")], spark)
    assert spark.read.parquet(str(tmp_path / "o")).filter("source_fraction between 0.5 and 0.6").count() == 1
    cli.main(["inspect", str(tmp_path / "in")], spark)
    cli.main(["outcomes", str(tmp_path / "in")], spark)
    assert "logical_identifier" in capsys.readouterr().out
