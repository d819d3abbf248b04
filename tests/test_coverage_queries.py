"""Coverage queries on small made-up runs, against plain Python; runs of different sizes and places."""

import math
from collections import defaultdict

import pytest

from airlattice.plans import coverage, planning, radio

CELL = "job_id string, endpoint string, `index` bigint, x double, y double, state string, best_margin_db double"


def grids(spark, tmp_path, size=500.0, **jobs):
    """coverage.parquet of square runs: job=(columns, west, north), cells from the top row on; a repeated cell."""
    rows = [(j, "ep", i, west + (i % n + 0.5) * size, north - (i // n + 0.5) * size, "covered", 1.0) for j, (n, west, north) in jobs.items() for i in range(n * n)]
    spark.createDataFrame(rows + rows[:1], CELL).write.parquet(str(tmp_path / "coverage.parquet"))
    return str(tmp_path), rows


def test_marks_of_a_whole_line(spark, tmp_path):
    """Every 1.2 km up to the run's own end, each on the last cell that starts at or before it; an end that is a mark counts."""
    d, _ = grids(spark, tmp_path, one=(1, 0.0, 0.0), three=(3, 0.0, 0.0), five=(5, 0.0, 0.0), ten=(10, -2500.0, 2500.0))
    want = {(j, k, k * 1200 // 500) for j, n in (("one", 1), ("three", 9), ("five", 25), ("ten", 100)) for k in range((n - 1) * 500 // 1200 + 1)}
    got = [tuple(r) for r in planning.QUERIES["w8_segment_lookup"](spark, d).collect()]
    assert len(got) == len(want) and set(got) == want
    assert max(k for j, k, _ in got if j == "five") == 10 and max(k for j, k, _ in got if j == "ten") == 41


@pytest.mark.parametrize("size", [500.0, 400.0])
def test_footprints_of_all_cells(spark, tmp_path, size):
    """No cell of a large run, or of one away from the origin, is lost or cut: the grid's bounds and steps are its own."""
    d, cells = grids(spark, tmp_path, size, far=(2, 40_000.0, 9_000.0), large=(20, -5000.0, 5000.0), small=(4, -1000.0, 1000.0))
    got = [tuple(r) for r in coverage.QUERIES["k7_geojson_bounds"](spark, d).collect()]
    want = {(j, i, x - size / 2, x + size / 2, y - size / 2, y + size / 2) for j, _, i, x, y, *_ in cells}
    assert len(got) == len(want) == 420 and set(got) == want


def test_long_links_are_evaluated(spark, tmp_path):
    """A link of more than 60 samples is evaluated like others, and its profile is there in full."""
    rows = [("j", "ep", 0, 100.0, 100.0, [("s00001",)]), ("j", "ep", 1, 60_000.0, 100.0, [("s00001",)])]
    spark.createDataFrame(rows, "job_id string, endpoint string, `index` bigint, x double, y double, sources array<struct<source_id: string>>").write.parquet(str(tmp_path / "coverage.parquet"))
    n = {r.link_id: r.n_samples for r in radio.QUERIES["f16_profile_sampling"](spark, str(tmp_path)).collect()}
    assert max(n.values()) > 60 and len(n) == 2
    assert "profile cap" not in {r.state for r in radio.evaluated(spark, str(tmp_path)).collect()}
    assert {r.link_id: r.samples for r in radio.QUERIES["j20_profile_explode"](spark, str(tmp_path)).collect()} == n
    for name in ("f17_sample_points", "a17_thin_profiles"):
        assert {r.link_id for r in planning.QUERIES[name](spark, str(tmp_path)).select("link_id").collect()} == set(n)


def test_thin_profiles_join_nothing_back(spark, tmp_path):
    """No list of kept samples is joined, so none is broadcast; those kept are the extremes of a stride and the ends, once each,
    also of a cell that is given at two places, whose links share an id."""
    cells = [(0, 900.0, 350.0), (1, 7_300.0, -2_150.0), (1, 26_250.0, 4_650.0), (2, -3_450.0, 19_750.0)]
    rows = [("j", "ep", i, x, y, [("s00001",), ("s00002",)]) for i, x, y in cells]
    spark.createDataFrame(rows, "job_id string, endpoint string, `index` bigint, x double, y double, sources array<struct<source_id: string>>").write.parquet(str(tmp_path / "coverage.parquet"))
    want, bins = [], defaultdict(list)
    for i, bx, by in cells:
        for num in (1, 2):
            ax, ay = num * 7919 % 10000 - 5000.0, num * 104729 % 10000 - 5000.0
            d = math.sqrt((bx - ax) ** 2 + (by - ay) ** 2)
            n = max(math.ceil(d / 200) + 1, 3)
            for k in range(n):
                t = (d if k == n - 1 else k * (d / (n - 1))) / d
                h = float((math.floor(ax + t * (bx - ax)) * 7 + math.floor(ay + t * (by - ay)) * 13) % 200)
                bins[f"j/{i}/s0000{num}", k // max(math.ceil(n * 2 / 18), 1)].append((k, n, h))
    for (link, _), s in bins.items():
        low, high = min(s, key=lambda r: (r[2], r[0])), min(s, key=lambda r: (-r[2], r[0]))
        want += [(link, *r) for r in s if r in (low, high) or r[0] in (0, r[1] - 1)]
    thin = planning.QUERIES["a17_thin_profiles"](spark, str(tmp_path))
    assert sorted(tuple(r) for r in thin.collect()) == sorted(want)
    assert "Join" not in thin._jdf.queryExecution().executedPlan().toString()
