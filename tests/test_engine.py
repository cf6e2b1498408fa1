"""Operators and kernels against hand-made expectations."""

import math

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from trackfold import schema
from trackfold.functions import plates, scalar
from trackfold.functions.kernels import filters, gp, morph, register, segment
from trackfold.operators import conditions, describe, growth, lineage, lysis, scoring, segmentation, series, spatial, timebin
from trackfold.plans import catalog
from trackfold.sources import frameset, images, tables


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def test_describe_of_no_one_and_many_parts(spark):
    owners = spark.createDataFrame([(1,), (2,), (3,)], "k long")
    parts = spark.createDataFrame([(2, 5.0), (3, 1.0), (3, 2.0), (3, 4.0), (3, float("nan"))], "k long, v double")
    r = {x.k: x for x in describe.describe_owned(owners, parts, ["k"], ["v"]).collect()}
    assert r[1].v_count == 0 and r[1].v_mean is None and r[1].v_total is None
    assert r[2].v_count == 1 and r[2].v_std is None and r[2].v_total == 5.0
    d = pd.Series([1.0, 2.0, 4.0]).describe()
    assert [r[3][f"v_{k}"] for k in ("count", "mean", "std", "min", "p25", "p50", "p75", "max")] == pytest.approx(list(d))


@settings(max_examples=30, deadline=None)
@given(st.lists(st.floats(-100, 100), min_size=13, max_size=40))
def test_low_pass_keeps_lines_and_is_linear(x):
    x = np.array(x)
    assert filters.low_pass(np.arange(len(x)) * 2.0 + 1).shape == x.shape
    assert np.allclose(filters.low_pass(3 * x), 3 * filters.low_pass(x), atol=1e-6)
    assert np.allclose(filters.low_pass(np.full(len(x), 7.0)), 7.0)


def test_time_bins(spark):
    df = spark.createDataFrame([(3599.0,), (3600.0,), (899.9,)], "time double")
    out = rows(timebin.with_time_bins(timebin.with_units(df)).select("round_time", "time_bin_30min", "time_bin_15min"))
    assert out == [(2700, 0.5, 0.75), (3600, 1.0, 1.0), (0, 0.0, 0.0)]


def test_series_ties_take_the_first_maximum(spark):
    df = spark.createDataFrame([("a", 0, 1.0), ("a", 1, 5.0), ("a", 2, 5.0)], "s string, t int, v double")
    r = series.edges(df, ["s"], "t", "v").first()
    assert (r.max_at, r.max_value, r.first_at, r.last_value) == (1, 5.0, 0, 5.0)


def test_stack_depth(spark):
    t = [0, 1, 2, 100, 101, 102, 200, 201, 202]
    df = spark.createDataFrame([("a", i, float(x)) for i, x in enumerate(t)], "s string, i int, t double")
    assert rows(series.stack_depth(df, ["s"], ["i"], "t")) == [("a", 0, 3)]


def test_turning_of_a_square(spark):
    df = spark.createDataFrame([([(0, 0), (1, 0), (1, 1), (0, 1)],)], "c array<struct<x:int,y:int>>")
    r = df.select(series.turning(F.col("c")).alias("k"), scalar.contour_area(F.col("c")).alias("a"), scalar.arc_length(F.col("c")).alias("l")).first()
    assert r.k == pytest.approx([math.pi / 2] * 4) and (r.a, r.l) == (1.0, 4.0)


def test_conditions(spark):
    df = spark.createDataFrame([(1.0, float("nan"), None), (2.0, 2.0, 1.0), (None, None, None)], "`drug a (uM)` double, `b` double, `c` double")
    assert rows(conditions.dominant(df, df.columns).select("antibiotic", "concentration")) == [("drug", 1.0), ("drug", 2.0), (None, None)]
    r = spark.createDataFrame([("x", 1.0, None), ("x", 1.0, "b"), ("x", 1.0, "a"), ("x", None, "a")], "t string, n double, k string")
    assert rows(conditions.repeats(r, ["t"], ["n"], "k").select("n", "k", "repeat"), "n", "k") == [(None, "a", None), (1.0, None, 3), (1.0, "a", 1), (1.0, "b", 2)]
    with pytest.raises(ValueError):
        conditions.union([None])


def test_lineage_prefix_rules(spark):
    df = spark.createDataFrame([("f", x) for x in ("1", "1.0", "1.0.1", "10", "2")], "label string, lineage string")
    assert sorted(r[1] for r in rows(lineage.roots(df, "label", "lineage"))) == ["1", "2"]
    assert sorted(r[1] for r in rows(lineage.roots(df, "label", "lineage", strict=True))) == ["1", "10", "2"]
    assert rows(df.select(lineage.parent(F.col("lineage")))) == [("",), ("1",), ("1.0",), ("",), ("",)]


def test_child_numbers():
    ids = ["0", "1", "2", "3", "1.0", "1.1", "2.0", "2.1", "1.0.1"]
    assert [lineage.child_number(ids, x) for x in ("", "1", "1.0.1")] == ["4", "1.2", "1.0.1.0"]


def test_fold_splits_backwards():
    # two colonies at first, one from the second frame on; the last frame has no ids
    hits = {1: [-1], 0: [0, 0]}
    ids, paths, names = lineage.fold([2, 1, 1], lambda t, after: hits[t])
    assert ids == [[1, 2], [0]] and paths == ["0", "0.0", "0.1"] and names == {0: "2", 1: "1", 2: "0"}


def test_lysis(spark):
    def one(key, lin, areas):
        return [("f", key, lin, i, i * 1.0, i * 1.0, a, 2.0, 0.1, 0.2) for i, a in enumerate(areas)]

    df = spark.createDataFrame(one("a", "1", [1.0, 9.0, 3.0, 3.0, 3.0, 3.0]) + one("b", "2", [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]) + one("c", "f1.0", [1.0, 2.0]), "label string, series_key string, lineage string, time_index int, time_hours double, round_time_hours double, colony_area double, ss_area_count double, ss_area_total_growth_rate double, ss_area_count_growth_rate double")
    out = {r.series_key: r for r in lysis.with_lysis(df).collect()}
    assert out["a"].colony_lysis and out["a"].cmax_colony_area == 9.0 and out["a"].cmax_time_index == 1 and out["a"].present_at_start
    assert not out["b"].colony_lysis and out["b"].cmax_at_eop and out["b"].cmax_colony_area == 6.0
    assert out["c"].cmax_time == 5.0 and out["c"].cmax_colony_area == pytest.approx(2.4) and out["c"].cmax_cell_count == pytest.approx(0.2 * 4 + 2.4)
    fixed = {r.series_key: r for r in lysis.with_lysis(df, fixed=True).collect()}
    assert fixed["c"].cmax_cell_count == pytest.approx(0.2 * 4 + 2)


def test_scoring(spark):
    px = [("i", p, g) for p, g, n in ((1, 1, 3), (0, 1, 1), (2, 2, 2), (3, 2, 2), (4, 0, 1), (0, 3, 2), (0, 0, 5)) for _ in range(n)]
    ct = scoring.contingency(spark.createDataFrame(px, "img string, pred int, gt int"))
    e = scoring.errors(ct).first()
    assert (e.errors, e.unmatched, e.errors_per_label) == (3, 1, {1: 0, 2: 1, 3: 1})
    c = scoring.compare(ct).first()
    assert c.iou == pytest.approx(7 / 11) and c.precision == pytest.approx(7 / 8) and c.fnr == pytest.approx(3 / 13)
    assert scoring.matched_iou(ct).first().matched_iou == pytest.approx((0.75 + 0.5) / 2)
    assert rows(scoring.areas(ct).select("gt", "area"), "gt") == [(1, 4), (2, 4), (3, 2)]


def test_nearest_and_tracks(spark):
    p = spark.createDataFrame([("a", 0, 1, 0.0, 0.0), ("a", 1, 2, 3.0, 4.0), ("a", 1, 3, 50.0, 0.0), ("a", 2, 4, 51.0, 0.0)], "label string, time_index int, id long, x double, y double")
    before = p.withColumn("time_index", F.col("time_index") + 1)
    out = {r.left_id: (r.right_id, r.distance) for r in spatial.nearest_within(p, before, ["label", "time_index"], 10.0).collect()}
    assert out == {1: (-1, None), 2: (1, 5.0), 3: (-1, None), 4: (3, 1.0)}
    assert [r[3] for r in rows(spatial.tracked(p), "id")] == [0, 0, 1, 1]


def test_registration_finds_a_shift():
    a = np.random.default_rng(0).uniform(0, 400, (25, 2))
    assert register.offset(a, a + np.array([13, -7]), (400, 400)) == (13, -7)
    assert register.offset(np.zeros((0, 2)), a, (400, 400)) == (0, 0)


def test_scalars(spark):
    df = spark.createDataFrame([("1.5",), ("x",), (None,), ("Infinity",), ("0.0123",), ("1234",)], "s string")
    assert rows(df.select(scalar.is_float(F.col("s")))) == [(True,), (False,), (False,), (False,), (True,), (True,)]
    assert [r[0] for r in rows(df.select(scalar.two_figures(F.col("s"))))][::4] == ["1.5", "0.012"]
    assert scalar.listify("ab") == ["ab"] and scalar.listify(None) == [] and scalar.listify((1, 2)) == [1, 2]
    assert rows(spark.createDataFrame([("a_b_c",)], "s string").select(scalar.pad_label(F.col("s")))) == [("Pad c, a-b",)]


def test_plates(spark):
    p = plates.PLATES[96]
    assert plates.pads("A1-B2", p) == ["A1", "A2", "B1", "B2"] and plates.parsed("B10", p) == ("B", 10)
    with pytest.raises(ValueError):
        plates.parsed("I1", p)
    df = spark.createDataFrame([(0.0, 0.0)], "x double, y double")
    assert rows(df.select(plates.pad_at(F.col("x"), F.col("y"), plates.PLATES[60]))) == [("D6",)]
    assert plates.table(spark).count() == 3


def test_disc_and_distances():
    yy, xx = np.mgrid[:60, :70]
    m = (yy - 30) ** 2 + (xx - 33) ** 2 <= 15**2
    (c,) = morph.contours(m)
    assert (morph.mask_of(c, m.shape) == m).all() and morph.centroid(c) == (30, 33) and morph.inner_point(c) == (33, 30)
    r = np.zeros((20, 30), bool)
    r[5:15, 4:26] = True
    d = morph.distance(r)
    assert d.max() == 5 and d[5, 10] == 1 and d[9, 15] == 5
    brute = np.array([[min(math.hypot(y - a, x - b) for a, b in zip(*np.nonzero(~r), strict=True)) if r[y, x] else 0 for x in range(30)] for y in range(20)])
    assert np.allclose(d, brute)
    lab, n = morph.label(np.array([[1, 0, 1], [0, 1, 0], [0, 0, 1]], bool), 8)
    assert n == 1 and morph.label(np.array([[1, 0, 1], [0, 1, 0]], bool), 4)[1] == 3


def test_segmentation_of_discs(spark):
    f = catalog.synthetic_frames(spark, 1, 3)
    o = segmentation.objects(f)
    col = [r for r in o.where("kind = 'colony'").collect()]
    assert len(col) == 6 and all(not r.on_border for r in col)
    out = segmentation.lineages(o)
    assert out.where("kind = 'colony'").select("time_index").distinct().count() == 2
    assert {r.lineage for r in out.where("kind = 'colony'").collect()} == {"0", "1"}


def test_split_at_a_notch_on_one_side_and_of_long_chains():
    m = np.zeros((40, 80), bool)
    m[10:30, 10:70] = True
    for k in range(13):  # a notch from above that leaves seven rows
        m[10 + k, 40 - (13 - k) // 2 : 41 + (13 - k) // 2] = False
    (c,) = morph.contours(m)
    parts = morph.split(c, 0.6, 50)
    assert len(parts) == 2 and sorted(int(p[:, 0].mean() > 40) for p in parts) == [0, 1]

    yy, xx = np.mgrid[:40, : 60 * 17 + 40]
    chain = np.zeros(yy.shape, bool)
    for k in range(60):
        chain |= (yy - 20) ** 2 + (xx - 20 - 17 * k) ** 2 <= 9**2
    (c,) = morph.contours(chain)
    parts = morph.split(c, 0.6, 50)
    assert len(parts) == 60 and all(np.ptp(p[:, 0]) < 20 for p in parts)


def test_focus_picks_the_sharp_plane():
    rng = np.random.default_rng(1)
    sharp = rng.integers(0, 255, (64, 64)).astype(np.uint8)
    stack = np.stack([filters.gaussian(sharp.astype(float), 3).astype(np.uint8), sharp])
    assert segment.sharpness(stack[1].astype(float)) > segment.sharpness(stack[0].astype(float))
    assert segment.flatten(stack).shape == (64, 64) and segment.tilt(np.array([[1.0, 2.0], [3.0, 4.0]])) == pytest.approx((2, 1, 1))


@pytest.mark.parametrize("kernel", ["sqexp", "matern"])
def test_growth_of_an_exponential(kernel):
    t = np.linspace(0, 5, 25)
    y = np.exp(0.7 * t) * np.exp(np.random.default_rng(0).normal(0, 0.01, 25))
    assert gp.derivatives(t, y, kernel)["df"].mean() == pytest.approx(0.7, abs=0.03)
    with pytest.raises(ValueError):
        gp.derivatives(t, np.where(t > 4, 0, y))


def test_growth_rates_do_not_depend_on_row_order(spark):
    t = np.linspace(0, 3, 8)
    data = [("a", float(x), float(np.exp(0.5 * x + 0.01 * i % 0.03))) for i, x in enumerate(t)] + [("b", 0.0, 1.0)]
    one = rows(growth.growth_rates(spark.createDataFrame(data, "s string, h double, v double"), ["s"], "h", ["v"]), "s", "h")
    two = rows(growth.growth_rates(spark.createDataFrame(data[::-1], "s string, h double, v double"), ["s"], "h", ["v"]), "s", "h")
    assert [r[3] for r in one[:-1]] == pytest.approx([r[3] for r in two[:-1]]) and one[-1][3] is None


def test_image_files(spark, tmp_path):
    a = (np.arange(600).reshape(20, 30) * 100).astype(np.uint16)
    assert (images.read_png(images.write_png(a)) == a).all() and (images.read_tiff(images.write_tiff(a)) == a).all()
    b = a.astype(np.uint8)
    assert (images.read_png(images.write_png(b)) == b).all()
    (tmp_path / "x.png").write_bytes(images.write_png(a))
    (tmp_path / "y.tif").write_bytes(b"broken")
    m = spark.createDataFrame([("f", 0, None, 0.0, None, "x.png"), ("f", 1, None, 1.0, "b", "y.tif")], "label string, time_index int, z_index int, time_s double, frame_label string, path string")
    r = images.frames(spark, m, str(tmp_path)).orderBy("time_index").collect()
    assert r[0].image.h == 20 and r[0].corrupt is None and r[0].frame_label == "0" and r[1].image is None and r[1].corrupt
    assert (tmp_path / "y.tif").exists()


def test_plate_reader(spark):
    text = "h\nt 0.0 900.0 C 37.0 37.1 A1 x 0.1 -0.2 B2 5 0.3 0.4;\n"
    out = tables.plate_reader(spark.createDataFrame([("p", text)], "path string, content string"), "e")
    assert rows(out.select("pad_name", "time", "OD600"), "pad_name", "time") == [("A1", 0.0, 0.1), ("A1", 900.0, -0.2), ("B2", 0.0, 0.3), ("B2", 900.0, 0.4)]


def test_stored_results(spark, tmp_path):
    df = spark.createDataFrame([("a", 1), ("b", 2)], "label string, v int")
    assert tables.load(spark, str(tmp_path / "none")) is None
    tables.store(df, str(tmp_path / "t"))
    assert rows(tables.pending(spark.createDataFrame([("a",), ("c",)], "label string"), tables.load(spark, str(tmp_path / "t")))) == [("c",)]


class _Set(frameset.FrameSet):
    def frame_count(self):
        return 3

    def frame(self, i):
        return np.full((2, 3), i, dtype=np.uint8)

    def time(self, i):
        return 60.0 * i


def make_sets(_):
    return [_Set("a"), _Set("b")]


def test_frame_sets():
    s = _Set("a")
    assert len(s[0:2]) == 2 and s[-1][0, 0] == 2
    with pytest.raises(TypeError):
        s["x"]


def test_names_and_species():
    assert schema.normal_name("ss_area_25%") == "ss_area_p25" and schema.species_parameters(None)[0] == 1.5
    with pytest.raises(ValueError):
        schema.species_parameters("unknown")


def test_condition_labels():
    label = scalar.condition_label
    assert label(["Drug", "Strain"], ["1.0", "MG1655"], "Ampicillin concentration (uM)") == "ampicillin, Drug, Strain=MG1655"
    assert label(["dose", "note"], ["0.1234", "nan"]) == "dose=0.12"
    assert label(["Note", "Kind"], ["nan", "nan"], None) == "note=nan, kind=nan"
    assert label([], [], "Kanamycin concentration") == "kanamycin" and label([], []) == ""


def test_band_of_a_ring():
    b = morph.band(6, 2)
    assert [(int(i), int(j)) for i, j in zip(*b.nonzero(), strict=True)] == [(0, 2), (0, 3), (1, 3), (1, 4), (2, 4), (2, 5), (3, 5)]


def test_times_of_a_plate_reader_are_kept(spark):
    t = spark.createDataFrame([("p", "head\nt 0.5 910.25 1800.0 C 37.0 37.0 B2 0.1 0.2 0.3;\n")], "path string, content string")
    got = tables.plate_reader(t, "e", limit=2).orderBy("time").collect()
    assert [(r.time, r.round_time, r.pad_name, r.labelid, r.OD600) for r in got] == [(0.5, 0.5, "B2", "e_B2", 0.1), (910.25, 910.25, "B2", "e_B2", 0.2)]


def test_species_of_rows(spark):
    rows = spark.createDataFrame([("e. COLI",), (None,), ("Staphylococcus aureus",)], "species string")
    assert sorted(r.sigma for r in schema.with_species(rows, "species").collect()) == [1.5, 1.5, 2.5]
    with pytest.raises(Exception, match="no parameters for species"):
        schema.with_species(spark.createDataFrame([("unknown",)], "species string"), "species").collect()


def test_positions_with_ties_and_none(spark):
    d = spark.createDataFrame([(v,) for v in [5, 1, 1, 1, 9, 2] * 40], "v long")
    got = sorted((r.position, r.v) for r in series.positioned(d, "v").collect())
    assert [p for p, _ in got] == list(range(240)) and [v for _, v in got] == sorted([5, 1, 1, 1, 9, 2] * 40)
    assert series.positioned(d.where("v > 100"), "v").count() == 0
