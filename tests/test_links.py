"""Closed-form and golden values of the link evaluation."""

import pytest
from pyspark.sql import functions as F

from airlattice.functions import rf
from airlattice.operators import links


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_formulas(spark):
    d = F.lit
    assert value(spark, rf.fspl_db(d(1000.0), 869.5)) == pytest.approx(91.2248, abs=1e-3)
    assert value(spark, rf.knife_edge_db(d(-0.78))) == 0
    assert value(spark, rf.knife_edge_db(d(0.0))) == pytest.approx(6.0328, abs=1e-3)
    assert value(spark, rf.knife_edge_v(d(1.0), d(0.0), d(1.0), 869.5)) == float("-inf")
    assert value(spark, rf.fresnel_radius_m(d(0.0), d(0.0), 869.5)) == 0
    assert value(spark, rf.earth_bulge_m(d(5000.0), d(10000.0))) == pytest.approx(25e6 / (2 * 6371000))
    assert value(spark, rf.lora_sensitivity_dbm(d(125000.0), d(6.0), d(12))) == pytest.approx(-137.031, abs=1e-3)
    points = F.array(*(F.struct(d(a).alias("angle"), d(g).alias("gain")) for a, g in ((-10.0, 0.0), (0.0, 2.0), (10.0, 0.0))))
    for angle, gain in ((-20.0, 0.0), (-5.0, 1.0), (0.0, 2.0), (2.5, 1.5), (30.0, 0.0)):
        assert value(spark, rf.gain_at(points, d(angle))) == pytest.approx(gain)
    assert value(spark, rf.peak_gain(points)) == 2.0


def terrain(spark, height):
    xs = spark.range(21).select(F.col("id").cast("int").alias("ix"))
    ys = spark.range(21).select(F.col("id").cast("int").alias("iy"))
    return links.tile_lattice(xs.join(ys).withColumn("z", height), 8)


def run(spark, height, **more):
    rows = [("l", 200.0, 1000.0, 100.0, 1800.0, 1000.0, 1.5)]
    df = spark.createDataFrame(rows, "link_id string, ax double, ay double, ah double, bx double, by double, bh double")
    radio = rf.Radio(strict=True, sample_step_m=100.0, client_tx_power_dbm=22.0, **more)
    return links.evaluate(df, terrain(spark, height), radio, 100.0).first()


@pytest.fixture
def small_tiles(monkeypatch):
    original = links.with_ground
    monkeypatch.setattr(links, "with_ground", lambda p, t, x, y, o, r: original(p, t, x, y, o, r, 8))


def test_ridge_and_flat(spark, small_tiles):
    """Published golden numbers: a ridge of 200 m half way, and flat ground."""
    flat = run(spark, F.lit(0.0))
    assert flat.fresnel_radius_m == pytest.approx(11.743716374962917, abs=1e-10)
    assert flat.clearance_m == pytest.approx(7.644477907706796, abs=1e-10)
    assert flat.fresnel_ratio == pytest.approx(1.344579957788927, abs=1e-10) and flat.ratio_at_m == 1500
    assert flat.diffraction_db == 0 and flat.two_way_db == pytest.approx(48.99220862010688, abs=1e-9) and flat.valid
    ridge = run(spark, F.when(F.col("ix") == 10, 200.0).otherwise(0.0))
    assert ridge.clearance_m == pytest.approx(-149.30022759378434, abs=1e-10)
    assert ridge.fresnel_ratio == pytest.approx(-12.71320107083698, abs=1e-10) and ridge.ratio_at_m == 800
    assert ridge.diffraction_db == pytest.approx(47.98844327794896, abs=1e-9)
    assert ridge.two_way_db == pytest.approx(1.0037653421579193, abs=1e-9)
    assert not ridge.los_clear and not ridge.valid
    missing = run(spark, F.when(F.col("ix") != 10, 0.0))
    assert missing.state == "missing terrain" and missing.two_way_db is None
    assert run(spark, F.lit(0.0), max_samples=5).state == "profile cap"


def test_surface_and_clutter(spark, small_tiles):
    """A surface of 10 m on flat ground obstructs, and costs its height; where it is missing the ground counts."""
    rows = [("l", 200.0, 1000.0, 100.0, 1800.0, 1000.0, 1.5)]
    df = spark.createDataFrame(rows, "link_id string, ax double, ay double, ah double, bx double, by double, bh double")
    surface = terrain(spark, F.when(F.col("ix") == 10, 10.0).when(F.col("ix") != 4, 0.0))
    radio = rf.Radio(strict=True, sample_step_m=100.0, client_tx_power_dbm=22.0, clutter_db_per_m=0.5)
    got = links.evaluate(df, terrain(spark, F.lit(0.0)), radio, 100.0, surface=surface).first()
    assert got.two_way_db == pytest.approx(48.99220862010688 - 5.0, abs=1e-9) and got.state is None
