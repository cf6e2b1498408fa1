"""Queries take all rows of their tables."""

import hashlib
import zlib
from datetime import datetime

import numpy as np

from trackfold.functions.kernels import gp, segment
from trackfold.operators import growth, segmentation
from trackfold.plans.catalog import QUERIES, synthetic_frames


def stored(spark, place, **tables):
    for name, (rows, schema) in tables.items():
        spark.createDataFrame(rows, schema).write.parquet(f"{place}/{name}.parquet")
    return str(place)


def test_owners_and_outlines_take_all_quantities(spark, tmp_path):
    day = datetime(2024, 3, 5)
    place = stored(
        spark, tmp_path,
        orders=([(1, 10, day), (2, 20, datetime(2024, 4, 1))], "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz"),
        lineitem=([(1, 7, 50.0, day), (1, 8, 1.0, day), (2, 9, 45.0, datetime(2024, 4, 1)), (3, 9, 50.0, day)], "l_orderkey long, l_suppkey long, l_quantity double, l_shipdate timestamp_ntz"),
    )
    assert {tuple(r) for r in QUERIES["outlines_touching"](spark, place).collect()} == {(7, 10), (8, 10), (9, 20)}
    assert {tuple(r) for r in QUERIES["containment"](spark, place).collect()} == {(1, 9), (2, 9)}


def test_growth_rates_take_the_best_of_five_starts(spark):
    """Each series' rates come from a fit as likely as the operator's default, which one start does not reach in all of them."""
    got = {}
    for r in QUERIES["growth_rates"](spark, "/root/testdata/sf0.001").collect():
        got.setdefault(r.series_key, []).append(r)
    one_is_worse = 0
    for key, rows in got.items():
        rows.sort(key=lambda r: r.hours)
        t, y = np.array([r.hours for r in rows]), np.array([r.area for r in rows])
        if len(rows) < growth.LEAST_GROWTH:
            continue
        seed = zlib.crc32(repr((str(key),)).encode())
        best, one = (gp.derivatives(t, y, runs=n, seed=seed)["df"] for n in (5, 1))
        assert np.allclose([r.area_growth_rate for r in rows], best, rtol=1e-6, atol=1e-9), key
        one_is_worse += not np.allclose(one, best, rtol=1e-3, atol=1e-6)
    assert one_is_worse


def test_focused_frames_depend_on_the_focus(spark):
    stacks = {}
    for r in synthetic_frames(spark, 2, 3).orderBy("label", "time_index").collect():
        stacks.setdefault(r.label, []).append(segmentation.array_of(r.image.asDict()))
    got = {r.label: r for r in QUERIES["focused_frames"](spark, "").collect()}
    assert set(got) == set(stacks)
    digest = lambda a: hashlib.sha256(bytes(segmentation.image_of(a)["px"])).hexdigest()
    for label, a in stacks.items():
        assert [got[label].digest, got[label].digest_large_backlash] == [digest(segment.flatten(np.stack(a), x)) for x in (False, True)]
        assert got[label].digest != digest(segment.flatten(np.stack(a[:1])))
    best = {r.label: (r.z_index, r.score) for r in QUERIES["sharpest_planes"](spark, "").collect()}
    for label, a in stacks.items():
        score = [segment.sharpness(x.astype(float)) for x in a]
        assert best[label][0] == int(np.argmax(score)) and np.isclose(best[label][1], max(score))
