"""Point-in-polygon joins and what is decided from footprints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.operators.lineage import cut


def rect_ring(x0: Column, y0: Column, x1: Column, y1: Column) -> Column:
    """A four-vertex ring."""
    return F.array(*[F.struct(a.alias("x"), b.alias("y")) for a, b in ((x0, y0), (x1, y0), (x1, y1), (x0, y1))])


def ring_edges(rings: Column) -> Column:
    """Edges of all rings, formed once per polygon: box, one end point, run per rise."""
    def edges(ring: Column) -> Column:
        n = F.size(ring)
        prev = F.concat(F.slice(ring, n, F.lit(1)), F.slice(ring, F.lit(1), n - 1))
        return F.zip_with(ring, prev, lambda i, j: F.struct(
            F.least(i["y"], j["y"]).alias("lo"), F.greatest(i["y"], j["y"]).alias("hi"),
            F.least(i["x"], j["x"]).alias("left"), F.greatest(i["x"], j["x"]).alias("right"),
            i["x"].alias("x"), i["y"].alias("y"),
            F.try_divide(j["x"] - i["x"], j["y"] - i["y"]).alias("run")))

    usable = F.filter(rings, lambda r: F.size(r) >= 3)
    return F.flatten(F.transform(usable, edges))


def _bbox(rings: Column) -> dict[str, Column]:
    xs = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["x"])))
    ys = F.flatten(F.transform(rings, lambda r: F.transform(r, lambda p: p["y"])))
    return {"_bx0": F.array_min(xs), "_bx1": F.array_max(xs), "_by0": F.array_min(ys), "_by1": F.array_max(ys)}


def _slices(edges: DataFrame, cell: float) -> DataFrame:
    """Edges once per bucket they meet, in the row band they meet it in."""
    band = F.sequence(F.floor(F.col("e.lo") / cell), F.floor(F.col("e.hi") / cell))
    d = edges.withColumn("_gy", F.explode(band))
    y0, run = F.col("_gy") * cell, F.col("e.run")
    at = lambda y: F.col("e.x") + (y - F.col("e.y")) * run
    a, b = at(F.greatest(F.col("e.lo"), y0)), at(F.least(F.col("e.hi"), y0 + cell))
    # A horizontal edge has no run and lies in its band at full length. The slack only adds buckets.
    slack = cell * 1e-9
    low = F.coalesce(F.least(a, b), F.col("e.left")) - slack
    high = F.coalesce(F.greatest(a, b), F.col("e.right")) + slack
    return d.withColumn("_gx", F.explode(F.sequence(F.ceil(low / cell) - 1, F.floor(high / cell))))


def _poly_buckets(polys: DataFrame, cell: float) -> DataFrame:
    """Polygons once per bucket that is not wholly outside.

    ``_edges`` are those that meet the bucket (NULL where it is wholly inside)
    and ``_odd`` is the side on which the bucket's lower right corner lies: how
    many edges cross its row line to the right of it.
    """
    d = cut(polys.withColumn("_pid", F.monotonically_increasing_id()))
    edges = d.select("_pid", F.explode(ring_edges(F.col("rings"))).alias("e"))
    touched = _slices(edges, cell).groupBy("_pid", "_gy", "_gx").agg(F.collect_list("e").alias("_edges"))
    lines = edges.withColumn("_gy", F.explode(F.sequence(F.ceil(F.col("e.lo") / cell), F.ceil(F.col("e.hi") / cell))))
    line = F.col("_gy") * cell
    crossed = lines.where((F.col("e.lo") <= line) & (line < F.col("e.hi"))).select(
        "_pid", "_gy", (F.col("e.x") + (line - F.col("e.y")) * F.col("e.run")).alias("_at"), F.lit(1).alias("_n"),
        F.lit(None).cast("bigint").alias("_gx"), F.lit(None).cast(touched.schema["_edges"].dataType).alias("_edges"))
    corners = touched.select("_pid", "_gy", ((F.col("_gx") + 1) * cell).alias("_at"), F.lit(0).alias("_n"), "_gx", "_edges")
    along = Window.partitionBy("_pid", "_gy").orderBy(F.desc("_at"), "_n").rowsBetween(Window.unboundedPreceding, 0)
    corners = corners.unionByName(crossed).withColumn("_odd", F.sum("_n").over(along) % 2 == 1).where("_n = 0")
    following = F.lead("_gx").over(Window.partitionBy("_pid", "_gy").orderBy("_gx"))
    corners = corners.withColumn("_next", following)
    # Between two touched buckets of a row all are on the side of the first one's corner.
    inner = corners.where(F.col("_odd") & (F.col("_next") > F.col("_gx") + 1)).select(
        "_pid", "_gy", F.explode(F.sequence(F.col("_gx") + 1, F.col("_next") - 1)).alias("_gx"),
        F.lit(None).cast(touched.schema["_edges"].dataType).alias("_edges"), F.lit(True).alias("_odd"))
    return corners.select("_pid", "_gy", "_gx", "_edges", "_odd").unionByName(inner).join(d.drop("rings"), "_pid")


def contains(edges: Column, odd: Column, x: Column, y: Column, right: Column, bottom: Column) -> Column:
    """Even-odd test of a point in a bucket over the edges that meet the bucket.

    From the point the way leads right to the bucket's side and down that side
    to the corner, whose side is known; every edge on the way changes sides. Both
    legs run a hair past their coordinates, the hair along x being by far the
    longer, so no vertex lies on them; where an edge meets the end of a leg
    exactly, whether it rises tells on which side of the end it passes.
    """
    across = F.filter(edges, lambda e: (y >= e["lo"]) & (y < e["hi"]) & (x < e["x"] + (y - e["y"]) * e["run"]) & (e["x"] + (y - e["y"]) * e["run"] <= right))
    height = lambda e: F.when(e["lo"] == e["hi"], e["lo"]).otherwise(e["y"] + F.try_divide(right - e["x"], e["run"]))

    def passes(e: Column) -> Column:
        at, rises = height(e), F.coalesce(e["run"] > 0, F.lit(False))
        return ((at > bottom) | ((at == bottom) & rises)) & ((at < y) | ((at == y) & ~rises))

    down = F.filter(edges, lambda e: (e["left"] <= right) & (right < e["right"]) & passes(e))
    return ((F.size(across) + F.size(down)) % 2 == 1) != odd


def point_in_polygon_join(points: DataFrame, polys: DataFrame, cell: float, how: str = "inner") -> DataFrame:
    """Points with the polygons that contain them (``inner`` or ``left_semi``).

    Both sides meet by equality on a bucket key, and only then is the exact
    test made, over the few edges that meet the bucket. A polygon makes rows in
    proportion to its edges and to the buckets inside it.
    """
    p = points.withColumns({"_gx": F.floor(F.col("x") / cell), "_gy": F.floor(F.col("y") / cell)})
    q = _poly_buckets(polys, cell)
    inside = (F.col("p._gx") == F.col("q._gx")) & (F.col("p._gy") == F.col("q._gy")) & (F.col("q._edges").isNull() | contains(
        F.col("q._edges"), F.col("q._odd"), F.col("p.x"), F.col("p.y"), (F.col("q._gx") + 1) * cell, F.col("q._gy") * cell))
    j = p.alias("p").join(q.alias("q"), inside, how)
    cols = [F.col(f"p.{c}") for c in points.columns]
    if how != "left_semi":
        cols += [F.col(f"q.{c}") for c in polys.columns if c != "rings"]
    return j.select(*cols)


def find_project(aois: DataFrame, coverage: DataFrame, prefer: str | None = None, cell: float = 1.0) -> DataFrame:
    """Covering survey per area: the preferred one if it covers, else the one
    with most points (then by name); uncovered areas say so in ``reason``."""
    pts = aois.select("key", F.col("lon").alias("x"), F.col("lat").alias("y"))
    hits = point_in_polygon_join(pts, coverage, cell)
    rank = F.struct((F.col("name") == prefer) if prefer else F.lit(False), F.col("count"), F.col("name"))
    best = hits.groupBy("key").agg(F.max_by("name", rank).alias("project"), F.count("*").alias("candidates"))
    d = aois.join(best, "key", "left")
    return d.withColumns({
        "candidates": F.coalesce("candidates", F.lit(0).cast("bigint")),
        "reason": F.when(F.col("project").isNull(), F.lit("no coverage")),
    })


def _axis(lo: str, hi: str, fewest: int, most: int) -> Column:
    """Inclusive samples along one side of a view, 50 m apart, ``fewest`` to ``most``."""
    span = F.col(hi) - F.col(lo)
    n = F.least(F.greatest(F.ceil(span / K.COVERAGE_STEP_M), F.lit(fewest)), F.lit(most))
    return F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.col(lo) + span * i / (n - 1.0))


def view_samples(views: DataFrame, fewest: int = K.COVERAGE_MIN_SAMPLES, most: int = K.COVERAGE_MAX_SAMPLES) -> DataFrame:
    """Inclusive sample grid of each view, 50 m apart, ``fewest`` to ``most`` per axis."""
    d = views.select("view_id", _axis("x0", "x1", fewest, most).alias("_xs"), _axis("y0", "y1", fewest, most).alias("_ys"))
    d = d.withColumn("_total", (F.size("_xs") * F.size("_ys")).cast("bigint"))
    return d.withColumn("x", F.explode("_xs")).select("view_id", "x", F.explode("_ys").alias("y"), "_total")


def _sample_buckets(views: DataFrame, cell: float, fewest: int, most: int) -> DataFrame:
    """A view's samples once per bucket they lie in: those columns ``_xs`` and rows ``_ys`` of its grid."""
    of = lambda v: F.floor(v / cell)

    def parts(values: Column) -> Column:
        # the array of one array binds the samples to a name, so they are formed once
        return F.flatten(F.transform(F.array(values), lambda vs: F.transform(
            F.array_distinct(F.transform(vs, of)), lambda g: F.struct(g.alias("g"), F.filter(vs, lambda v: of(v) == g).alias("v")))))

    # The number of partitions is stated: views take few bytes, and one split of them makes very many samples.
    d = views.repartition(int(views.sparkSession.conf.get("spark.sql.shuffle.partitions")), "view_id")
    px, py = (parts(_axis(*ends, fewest, most)) for ends in (("x0", "x1"), ("y0", "y1")))
    # outer, as the filter that Spark derives from a plain explode would form all samples a second time, before they are spread
    d = d.select("view_id", px.alias("_px"), py.alias("_py"))
    many = lambda c: F.aggregate(c, F.lit(0), lambda n, p: n + F.size(p["v"]))
    d = d.withColumn("_total", many("_px") * many("_py"))
    d = d.select("view_id", "_total", "_py", F.explode_outer("_px").alias("_px"))
    d = d.select("view_id", "_total", "_px", F.explode_outer("_py").alias("_py"))
    d = d.select("view_id", "_total", F.col("_px.g").alias("_gx"), F.col("_py.g").alias("_gy"), F.col("_px.v").alias("_xs"), F.col("_py.v").alias("_ys"))
    ends = {f"_{axis}{i}": of(f"_{axis}s") for axis in "xy" for i, of in enumerate((F.array_min, F.array_max))}
    return d.withColumns(ends).withColumn("_n", F.size("_xs") * F.size("_ys"))


def covered_fraction(views: DataFrame, footprints: DataFrame, cell: float = 1000.0,
                     fewest: int = K.COVERAGE_MIN_SAMPLES, most: int = K.COVERAGE_MAX_SAMPLES) -> DataFrame:
    """Share of each view's samples inside any fine footprint.

    ``most`` samples along an axis make the grid coarser than 50 m on a large
    view, as the published rule has it. Copies of a footprint are one, a bucket
    that lies in some footprint answers for all samples in it, and so does one
    sample where no edge comes near the others. Only the rest are tested one by one.
    """
    fine = footprints.where(F.col("low_ps") <= K.MAX_SOURCE_PIXEL_M).select("rings").distinct()
    buckets = cut(_poly_buckets(fine, cell).select("_gx", "_gy", "_edges", "_odd"))
    whole = buckets.where(F.col("_edges").isNull()).dropDuplicates(["_gx", "_gy"])
    crossed = buckets.where(F.col("_edges").isNotNull()).join(whole.select("_gx", "_gy"), ["_gx", "_gy"], "left_anti")
    d = _sample_buckets(views, cell, fewest, most).join(whole.unionByName(crossed), ["_gx", "_gy"])

    def inside(x: Column, y: Column) -> Column:
        return contains(F.col("_edges"), F.col("_odd"), x, y, (F.col("_gx") + 1) * cell, F.col("_gy") * cell)

    slack = cell * 1e-9
    near = F.exists("_edges", lambda e: (e["right"] >= F.col("_x0") - slack) & (e["left"] <= F.col("_x1") + slack)
                    & (e["hi"] >= F.col("_y0") - slack) & (e["lo"] <= F.col("_y1") + slack))
    samples = F.flatten(F.transform("_xs", lambda x, i: F.transform("_ys", lambda y, j: F.struct(
        x.alias("x"), y.alias("y"), (i * F.size("_ys") + j).alias("no")))))
    tested = F.transform(F.filter(samples, lambda s: inside(s["x"], s["y"])), lambda s: s["no"])
    every = F.array(F.lit(-1))  # stands for all samples of the bucket
    found = F.when(F.col("_edges").isNull(), every).when(near, tested).when(inside(F.col("_x0"), F.col("_y0")), every)
    d = d.select("view_id", "_gx", "_gy", "_total", "_n", F.explode_outer(found).alias("_no")).where(F.col("_no").isNotNull())
    hit = d.groupBy("view_id", "_gx", "_gy").agg(F.max("_total").alias("_total"), F.when(F.min("_no") < 0, F.max("_n")).otherwise(F.count_distinct("_no")).alias("_hit"))
    share = hit.groupBy("view_id").agg((F.sum("_hit") / F.max("_total")).alias("covered"))
    return views.select("view_id").join(share, "view_id", "left").withColumn(
        "covered", F.coalesce("covered", F.lit(0.0)))


def boxes_meeting(a: DataFrame, b: DataFrame, a_box: tuple[str, str, str, str], b_box: tuple[str, str, str, str],
                  cell: float) -> DataFrame:
    """Pairs of rows whose boxes (x0, y0, x1, y1) meet, each pair once.

    Both boxes are spread over buckets; a pair is kept only in the bucket that
    holds the south-west corner of the overlap.
    """
    def spread(d: DataFrame, box: tuple[str, str, str, str]) -> DataFrame:
        x0, y0, x1, y1 = box
        d = d.withColumn("_gx", F.explode(F.sequence(F.floor(F.col(x0) / cell), F.floor(F.col(x1) / cell))))
        return d.withColumn("_gy", F.explode(F.sequence(F.floor(F.col(y0) / cell), F.floor(F.col(y1) / cell))))

    j = spread(a, a_box).join(spread(b, b_box), ["_gx", "_gy"])
    return j.where(
        (F.col(a_box[0]) <= F.col(b_box[2])) & (F.col(a_box[2]) >= F.col(b_box[0]))
        & (F.col(a_box[1]) <= F.col(b_box[3])) & (F.col(a_box[3]) >= F.col(b_box[1]))
        & (F.floor(F.greatest(a_box[0], b_box[0]) / cell) == F.col("_gx"))
        & (F.floor(F.greatest(a_box[1], b_box[1]) / cell) == F.col("_gy"))).drop("_gx", "_gy")


def views_meeting(views: DataFrame, footprints: DataFrame, cell: float = 10000.0) -> DataFrame:
    """(view, footprint) pairs whose boxes meet."""
    f = footprints.withColumns(_bbox(F.col("rings"))).drop("rings").where(F.col("_bx0").isNotNull())
    j = boxes_meeting(views, f, ("x0", "y0", "x1", "y1"), ("_bx0", "_by0", "_bx1", "_by1"), cell)
    return j.drop("_bx0", "_bx1", "_by0", "_by1")


def met_sources(views: DataFrame, catalog: DataFrame, cell: float = 10000.0) -> DataFrame:
    """What is known of the sources whose boxes meet each view; views that none meets have no row.

    Sources of one box are summed up first, so a view meets each box once
    however many sources share it.
    """
    acquired = F.when(F.col("low_ps") <= K.MAX_SOURCE_PIXEL_M, F.col("acquired"))
    first = F.struct("low_ps", "object_id")
    f = catalog.withColumns(_bbox(F.col("rings"))).where(F.col("_bx0").isNotNull())
    box = ("_bx0", "_by0", "_bx1", "_by1")
    f = f.groupBy(*box).agg(
        F.min("low_ps").alias("best_m"), F.min(first).alias("_first"), F.min_by("title", first).alias("title"), F.count("*").alias("sources"),
        F.min(acquired).alias("first"), F.max(acquired).alias("last"))
    j = boxes_meeting(views.select("view_id", "x0", "y0", "x1", "y1"), f, ("x0", "y0", "x1", "y1"), box, cell)
    return j.groupBy("view_id").agg(
        F.min("best_m").alias("best_m"), F.min_by("title", "_first").alias("title"), F.sum("sources").alias("sources"),
        F.min("first").alias("first"), F.max("last").alias("last"))


def coverage_summary(views: DataFrame, catalog: DataFrame, cell: float = 10000.0) -> DataFrame:
    """What elevation each view would be served: best pixel size, share, dates, verdict."""
    d = views.select("view_id").join(met_sources(views, catalog, cell), "view_id", "left").join(covered_fraction(views, catalog), "view_id")
    good = F.coalesce(F.col("best_m") <= K.MAX_SOURCE_PIXEL_M, F.lit(False))
    complete = F.col("covered") >= 1.0
    return d.withColumns({
        "sources": F.coalesce("sources", F.lit(0).cast("bigint")), "fine": good, "complete": complete,
        "usable": good & complete,
        "reason": F.when(F.col("best_m").isNull(), "no source")
        .when(~good, F.concat(F.lit("source is resampled: "), F.coalesce("title", F.lit("unknown source"))))
        .when(~complete, F.concat(F.lit("only "), F.floor(F.col("covered") * 100 + 0.5).cast("bigint").cast("string"),
                                  F.lit("% of this view is fine enough"))),
    })


def plan_requests(views: DataFrame, res: float, input_px: int) -> DataFrame:
    """Grow each view to whole pixels and at least one window, about its centre."""
    def px(span: Column) -> Column:
        return F.greatest(F.ceil(span / res), F.lit(input_px))

    d = views.withColumns({"width": px(F.col("x1") - F.col("x0")), "height": px(F.col("y1") - F.col("y0"))})
    cx, cy = (F.col("x0") + F.col("x1")) / 2, (F.col("y0") + F.col("y1")) / 2
    hw, hh = F.col("width") * res / 2, F.col("height") * res / 2
    return d.select(
        "view_id", "width", "height", (cx - hw).alias("px0"), (cy - hh).alias("py0"), (cx + hw).alias("px1"),
        (cy + hh).alias("py1"),
        F.when(F.greatest("width", "height") > K.MAX_IMAGE_PX, "too large").alias("reason"))


def true_scale_check(spans: DataFrame) -> DataFrame:
    """Flag projections whose metre is more than one percent off a ground metre."""
    bad_span = (F.col("projected_m") <= 0) | (F.col("ground_m") <= 0)
    d = spans.withColumn("scale", F.when(~bad_span, F.try_divide("ground_m", "projected_m")))
    return d.withColumn("reason", F.when(bad_span, "degenerate span").when(
        F.abs(F.col("scale") - 1.0) > K.MAX_SCALE_ERROR, "projected metres are not ground metres"))
