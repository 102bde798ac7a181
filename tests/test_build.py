"""Builds that resume, isolate bad tiles and commit twice without harm."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ridgeline import schemas as S
from ridgeline.operators import registry as RG
from ridgeline.plans import build as B

WAYS = [(1, {"highway": "path"}, [(-5.0, 20.5), (45.0, 20.5)]), (2, {"highway": "path", "trail_visibility": "bad"}, [(10.25, -5.0), (10.25, 60.0)]),
        (3, {"abandoned:highway": "track"}, [(1000.0, 0.0), (1040.0, 0.0)])]


def cloud(tile, n, width=40.0, x0=0.0, ground=True, seed=0):
    rng = np.random.default_rng(seed)
    x, y = x0 + rng.uniform(0, width, n), rng.uniform(0, width, n)
    z = 100 + x / 10 + rng.normal(0, 0.02, n)
    cls = np.where(rng.uniform(size=n) < 0.7, 2, 1) if ground else np.ones(n, int)
    return [(tile, float(a), float(b), float(c + (0 if k == 2 else 2)), int(k), None) for a, b, c, k in zip(x, y, z, cls, strict=True)]


@pytest.fixture(scope="module")
def inputs(spark):
    points = cloud("good", 4000) + cloud("wet", 4000, x0=1000.0, seed=1) + cloud("hole", 300, ground=False) + cloud("small", 900, width=3.0)
    aois = [(k, k, 37.0, -118.5 + i, "train", 40, "", ["water"] if k == "wet" else [], "") for i, k in enumerate(("good", "wet", "hole", "small", "none"))]
    ways = spark.createDataFrame(WAYS, "id bigint, tags map<string,string>, geometry array<struct<x: double, y: double>>")
    return spark.createDataFrame(aois, S.AOI), spark.createDataFrame(points, S.POINT), ways


def build(inputs, aois, root, **kw):
    return B.build_tiles(aois, *inputs[1:], root, 1.0, 4.0, 4.0, 16, **kw)


def rounded(v):
    """Sums over cells come in any order, so their last digits differ."""
    return {k: rounded(x) for k, x in v.items()} if isinstance(v, dict) else round(v, 6) if isinstance(v, float) else v


def state(spark, root):
    cells = {n: spark.read.parquet(f"{root}/{n}").groupBy("tile").agg(F.count("*").alias("n"), F.round(F.sum(c), 6).alias("s")).collect()
             for n, c in (("dtm", "z"), ("features", "slope"), ("labels", "target"))}
    docs = {r.aoi.key: rounded(r.asDict(True)) for r in B.built_manifests(spark, root).collect()}
    return {n: sorted(map(tuple, v)) for n, v in cells.items()}, docs


@pytest.fixture(scope="module")
def whole(spark, inputs, tmp_path_factory):
    """All areas built in one batch: the folder and the manifests."""
    root = str(tmp_path_factory.mktemp("whole"))
    return root, {r.aoi.key: r for r in build(inputs, inputs[0], root).collect()}


def test_what_fails_is_a_row(whole):
    first = whole[1]
    assert {k: r.error for k, r in first.items()} == {
        "good": None, "wet": None, "hole": "only 0 ground points", "small": "raster is too small to mirror up to one window", "none": "no points"}
    good = first["good"]
    assert good.epsg == "EPSG:32611" and good.labels.trail_km == pytest.approx(0.08, abs=0.005) and good.raster.valid_frac > 0.9
    assert good.labels.trail_km_by_class["active"] == pytest.approx(0.04, abs=0.002) == good.labels.trail_km_by_class["faint"]
    assert first["wet"].labels.trail_km_by_class["lifecycle"] == pytest.approx(0.04, abs=0.002)
    assert first["small"].raster is None and first["hole"].labels is None and first["hole"].points.points == 300


def test_two_batches_are_one(spark, inputs, whole, tmp_path, monkeypatch):
    """The first batch is lost before its manifests, built again, and then followed by the rest."""
    aois, root = inputs[0], str(tmp_path)
    some = aois.where("key in ('good', 'hole')")
    with monkeypatch.context() as m:
        m.setattr(B, "write_documents", lambda *a, **k: (_ for _ in ()).throw(RuntimeError("lost")))
        with pytest.raises(RuntimeError, match="lost"):
            build(inputs, some, root)
    assert B.built_manifests(spark, root).isEmpty() and spark.read.parquet(f"{root}/dtm").count() > 0
    assert sorted(r.aoi.key for r in build(inputs, some, root).collect()) == ["good", "hole"]
    again = build(inputs, aois, root)  # the good tile is done; the hole is tried again
    assert sorted(r.aoi.key for r in again.collect()) == ["hole", "none", "small", "wet"]
    assert state(spark, whole[0]) == state(spark, root)
    assert build(inputs, aois.where("key = 'good'"), root).isEmpty()


def test_manifests_feed_vetting_and_totals(spark, inputs, whole):
    from pathlib import Path

    late = spark.createDataFrame([("later", "later", 37.0, -118.0, "train", 40, "", [], "")], S.AOI)
    rows = RG.manifest_rows(inputs[0].unionByName(late), B.built_manifests(spark, whole[0]))
    got = {r.key: (r.accepted, list(r.reasons)) for r in RG.vet(rows, min_density=0.5, min_km=0.05).collect()}
    assert got["good"] == (True, []) and got["wet"] == (False, ["only 0.04 km of trail in tile"]) and got["later"] == (False, ["not built"])
    assert got["hole"] == (False, ["build error: only 0 ground points"]) and not got["small"][0]
    t = RG.corpus_totals(rows.where("built")).first()
    assert (t.built, t.failed) == (2, 3) and t.active_km == pytest.approx(0.04, abs=0.002) and t.lifecycle_km == pytest.approx(0.04, abs=0.002)
    doc = [json.loads(line) for f in (Path(whole[0]) / "manifests" / "key=good").glob("*.json") for line in open(f)][0]
    assert doc["aoi"]["key"] == "good" and doc["points"]["points"] == 4000


def test_folders_of_documents_are_made_by_several_tasks(spark, tmp_path):
    """Small rows all the same: one task made the folder of every area."""
    from ridgeline.sources.readers import write_documents

    d = spark.range(400).groupBy((F.col("id") % 200).cast("string").alias("key")).agg(F.count("*").alias("n"))
    write_documents(d, str(tmp_path / "docs"), by="key")
    files = [f.name for f in (tmp_path / "docs").glob("key=*/*.json")]
    assert len(files) == 200 and len({n.split("-")[1] for n in files}) > 1


def test_ways_far_from_all_tiles_leave_the_labels_alone(spark):
    """Only segments in reach go on, each as often as it came; planes and their summary stay."""
    from ridgeline.operators import labels as L

    ways = spark.createDataFrame(WAYS + WAYS[:1] + [(9, {"highway": "path"}, [(5000.0, 0.0), (5040.0, 0.0)])],
                                 "id bigint, tags map<string,string>, geometry array<struct<x: double, y: double>>")
    grid = spark.createDataFrame([("good", 0.0, 40.0, 40, 40, 1.0)], "tile string, x0 double, y1 double, height int, width int, res double")
    every = L.classified_segments(ways)
    near = L.segments_near(every, grid)
    assert sorted(r.id for r in near.collect()) == [1, 1, 2] and near.columns == every.columns
    rows = lambda d: sorted(map(str, d.collect()))
    assert rows(L.label_planes(near, grid)) == rows(L.label_planes(every, grid))
    assert rows(L.label_stats(L.label_planes(near, grid), near, grid)) == rows(L.label_stats(L.label_planes(every, grid), every, grid))
