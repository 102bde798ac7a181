"""Tolerance-relaxed, class-stratified scoring.

One halo pass serves every threshold: the maximum of ``prob >= t`` over a
neighbourhood is ``max(prob) >= t``, so the prediction is dilated once as a
number and compared afterwards.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ridgeline import constants as K
from ridgeline.operators import grid as G
from ridgeline.operators.lineage import cut
from ridgeline.operators.ranks import SPAN_ROWS, exact_quantiles, measured_edges, running_totals, span_of

EPS = K.EPS


def dilated(cells: DataFrame, meta: DataFrame, radius: int, keep: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Cells with ``y_near`` and ``p_near``.

    The label is dilated before masking and the prediction after: a label just
    outside the valid area still excuses a prediction, but a prediction on an
    ignored cell never finds anything.
    """
    d = cells.withColumn("_p", F.when(F.col("w") > 0, F.col("prob")))
    base = sorted({"prob", "y", "w", *keep})
    d = G.dilate(d, meta, {"y_near": "y", "p_near": "_p"}, radius, keep=base, dense=dense)
    return d.where(F.col("w").isNotNull())


def near_planes(cells: DataFrame, meta: DataFrame, radius: int, keep: Sequence[str] = (),
                dense: bool = False) -> DataFrame:
    """The valid cells of :func:`dilated`."""
    return dilated(cells, meta, radius, keep, dense).where(F.col("w") > 0)


def _flag(c: Column) -> Column:
    return F.when(c, F.lit(1)).otherwise(F.lit(0))


def _tag(t: float) -> str:
    return str(t).replace(".", "_")


def _threshold_sums(near: DataFrame, keys: Sequence[str], thresholds: Sequence[float]) -> DataFrame:
    """Per key and threshold: predicted, excused, found; and labelled."""
    aggs = [F.sum("y").cast("bigint").alias("y_sum"), F.count("*").alias("cells")]
    for t in thresholds:
        on = F.col("prob") >= t
        aggs += [
            F.sum(_flag(on)).alias(f"pred{_tag(t)}"),
            F.sum(F.when(on, F.coalesce("y_near", F.lit(0))).otherwise(0)).cast("bigint").alias(f"tpp{_tag(t)}"),
            F.sum(F.when(F.col("p_near") >= t, F.col("y")).otherwise(0)).cast("bigint").alias(f"tpr{_tag(t)}"),
        ]
    wide = near.groupBy(*keys).agg(*aggs)
    rows = F.array(*[
        F.struct(F.lit(float(t)).alias("t"), F.col(f"pred{_tag(t)}").alias("pred"),
                 F.col(f"tpp{_tag(t)}").alias("tp_p"), F.col(f"tpr{_tag(t)}").alias("tp_r"))
        for t in thresholds])
    return wide.select(*keys, "y_sum", "cells", F.explode(rows).alias("_r")).select(*keys, "y_sum", "cells", "_r.*")


def _prf(tp_p: Column, pred: Column, tp_r: Column, y: Column) -> dict[str, Column]:
    p, r = tp_p / (pred + EPS), tp_r / (y + EPS)
    return {"p": p, "r": r, "f1": p * r * 2 / (p + r + EPS)}


def relaxed_pr(cells: DataFrame, meta: DataFrame, t: float, radius: int, keys: Sequence[str] = ("tile",)) -> DataFrame:
    """Relaxed precision and recall at one threshold."""
    s = _threshold_sums(near_planes(cells, meta, radius, keys[1:]), keys, [t])
    m = _prf(F.col("tp_p"), F.col("pred"), F.col("tp_r"), F.col("y_sum"))
    return s.select(*keys, m["p"].alias("precision"), m["r"].alias("recall"))


def threshold_sweep(cells: DataFrame, meta: DataFrame, res: float,
                    thresholds: Sequence[float] = K.SWEEP_THRESHOLDS, near: DataFrame | None = None) -> DataFrame:
    """Relaxed precision, recall and F1 per tile and threshold, one pass for all."""
    near = near_planes(cells, meta, K.tolerance_px(res)) if near is None else near
    s = _threshold_sums(near, ["tile"], thresholds)
    m = _prf(F.col("tp_p"), F.col("pred"), F.col("tp_r"), F.col("y_sum"))
    return s.select("tile", "t", *[F.round(m[k], 4).alias(k) for k in ("p", "r", "f1")])


def stratified_counts(cells: DataFrame, meta: DataFrame, res: float, keys: Sequence[str] = ("tile",),
                      thresholds: Sequence[float] = K.SELECTION_THRESHOLDS,
                      near: DataFrame | None = None) -> DataFrame:
    """Counts per key, threshold and class.

    Recall counts are split by class; predicted and excused counts are pooled
    over classes and repeated, since a predicted cell has no class. Code 0 is
    the background row: it keeps the predictions of a tile without labels.
    """
    keys = list(keys)
    extra = [k for k in keys if k != "tile"]
    near = near_planes(cells, meta, K.tolerance_px(res), ["code", *extra]) if near is None else near
    strat = near.withColumn("code", F.when(F.col("y") > 0, F.col("code")).otherwise(F.lit(0)))
    by = _threshold_sums(strat, [*keys, "code"], thresholds).drop("cells")
    return pool_counts(by, keys)


def pool_counts(by_code: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Repeat the pooled prediction counts on every class row."""
    keys = list(keys)
    every = Window.partitionBy(*keys, "t")
    return by_code.withColumns({"pred": F.sum("pred").over(every), "tp_p": F.sum("tp_p").over(every)})


def sum_counts(counts: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Add counts over batches or tiles before anything is divided."""
    keys = list(keys)
    pooled = counts.select(*keys, "tile", "t", "pred", "tp_p").distinct().groupBy(*keys, "t").agg(
        F.sum("pred").alias("pred"), F.sum("tp_p").alias("tp_p"))
    split = counts.groupBy(*keys, "t", "code").agg(F.sum("y_sum").alias("y_sum"), F.sum("tp_r").alias("tp_r"))
    return split.join(pooled, [*keys, "t"])


def stratified_result(counts: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Best F1 over thresholds per class; the first threshold wins ties."""
    keys = list(keys)
    m = _prf(F.col("tp_p"), F.col("pred"), F.col("tp_r"), F.col("y_sum"))
    d = counts.where(F.col("y_sum") > 0).withColumns({k: v for k, v in m.items()})
    best = F.max_by(F.struct("p", "r", "f1", "t", "y_sum"), F.struct(F.col("f1"), -F.col("t"))).alias("b")
    return d.groupBy(*keys, "code").agg(best).select(
        *keys, "code", F.round("b.f1", 4).alias("f1"), F.round("b.p", 4).alias("p"),
        F.round("b.r", 4).alias("r"), "b.t", F.col("b.y_sum").alias("px"))


def stratified_score(result: DataFrame, keys: Sequence[str] = ()) -> DataFrame:
    """Mean of the rounded class scores; classes without labels have no vote."""
    return result.groupBy(*keys).agg(F.round(F.avg("f1"), 4).alias("score"), F.count("*").alias("classes"))


def average_precision(cells: DataFrame, keys: Sequence[str] = ("tile",), rows_each: int = SPAN_ROWS) -> DataFrame:
    """Exact pixel AP over unignored cells, NULL where only one class is present.

    Equal probabilities are collapsed first; running counts then go span by span
    of measured quantiles, so no ranking holds all cells of a tile, even where
    nearly all its probabilities lie close together.
    """
    keys = list(keys)
    ties = cut(cells.where(F.col("w") > 0).groupBy(*keys, F.col("prob").cast("double").alias("prob")).agg(
        F.count("*").alias("_n"), F.sum(_flag(F.col("y") > 0.5)).alias("_pos")))
    ties = ties.withColumn("_bucket", -span_of(F.col("prob"), measured_edges(ties, "prob", rows_each)))
    run = running_totals(ties, keys, "_bucket", [F.desc("prob")], {"_cn": "_n", "_cp": "_pos"})
    out = run.groupBy(*keys).agg(
        F.sum(F.col("_pos") * F.col("_cp") / F.col("_cn")).alias("_s"), F.sum("_pos").alias("_t"), F.sum("_n").alias("_all"))
    return out.select(*keys, F.when((F.col("_t") > 0) & (F.col("_t") < F.col("_all")), F.col("_s") / F.col("_t")).alias("ap"))


def false_positive_rate(cells: DataFrame, t: float = 0.5, keys: Sequence[str] = ("tile",)) -> DataFrame:
    return cells.where(F.col("w") > 0).groupBy(*keys).agg(F.avg((F.col("prob") >= t).cast("double")).alias("fp_rate"))


def held_out_spread(scores: DataFrame, min_px: int = K.MIN_CLASS_PX) -> DataFrame:
    """Spread of per-tile F1 by variant and class, advisory tiles left out.

    Tiles with too few labelled cells are counted, not averaged; an unknown
    cell count passes.
    """
    d = scores.where(F.coalesce("advisory", F.lit("")) == "")
    thin = F.coalesce("px", F.lit(min_px)) < min_px
    kept = d.where(~thin)
    spread = kept.groupBy("variant", "class").agg(
        F.count("*").alias("n"), F.min("f1").alias("min"), F.max("f1").alias("max"))
    med = exact_quantiles(kept, ["variant", "class"], "f1", {"median": 0.5})
    few = d.where(thin).groupBy("variant", "class").agg(F.count("*").alias("too_thin"))
    out = spread.join(med, ["variant", "class"]).join(few, ["variant", "class"], "left")
    return out.select("variant", "class", "n", F.round("median", 4).alias("median"), F.round("min", 4).alias("min"),
                      F.round("max", 4).alias("max"), F.coalesce("too_thin", F.lit(0).cast("bigint")).alias("too_thin"))


def held_out_tiles(scores: DataFrame, min_px: int = K.MIN_CLASS_PX) -> DataFrame:
    """The tiles behind :func:`held_out_spread`, one row each, thin ones flagged."""
    d = scores.where(F.coalesce("advisory", F.lit("")) == "")
    return d.select("variant", "class", "tile", "f1", (F.coalesce("px", F.lit(min_px)) < min_px).alias("thin"))


def validation_means(batches: DataFrame, keys: Sequence[str], stats: Sequence[str]) -> DataFrame:
    """Mean per statistic over batches, NaN and NULL batches ignored."""
    return batches.groupBy(*keys).agg(
        *[F.round(F.avg(F.when(~F.isnan(s), F.col(s))), 4).alias(s) for s in stats])


def selection_score(val: DataFrame, keys: Sequence[str] = ("epoch",)) -> DataFrame:
    """Mean score of the variants that can be deployed, else of all of them."""
    return val.groupBy(*keys).agg(
        F.avg(F.when(~F.col("canopy"), F.col("score"))).alias("_dep"), F.avg("score").alias("score_all")
    ).select(*keys, F.coalesce("_dep", "score_all").alias("score"), "score_all",
             F.col("_dep").isNotNull().alias("deployable"))


def best_epoch(history: DataFrame) -> DataFrame:
    """First epoch that reached the highest score."""
    return history.agg(F.max_by("epoch", F.struct(F.col("score"), -F.col("epoch"))).alias("epoch"),
                       F.max("score").alias("score"))


def label_prior(cells: DataFrame, keys: Sequence[str] = (), pos_weight: float = 8.0) -> DataFrame:
    """Positive share of trainable cells and the output bias it implies."""
    d = cells.where(F.col("w") > 0).groupBy(*keys).agg(
        F.sum(_flag(F.col("y") > 0)).alias("positive"), F.count("*").alias("total"))
    d = d.withColumn("prior", F.col("positive") / F.greatest(F.col("total"), F.lit(1)))
    pi = F.least(F.greatest(F.col("prior"), F.lit(1e-6)), F.lit(1 - 1e-6))
    p = pi * pos_weight / (pi * pos_weight + 1 - pi)
    return d.withColumns({
        "bias": F.log(p / (1 - p)),
        "neg_pos_ratio": (1 - pi) / (pi * pos_weight),
    })


def weighted_bce(cells: DataFrame, meta: DataFrame | None, pos_weight: float = 8.0, radius: int = 0,
                 keys: Sequence[str] = ("tile",)) -> DataFrame:
    """Weighted cross entropy of ``logit``; with a radius both sides are relaxed."""
    d = cells
    if radius <= 0:
        x, y = F.col("logit"), F.col("y")
        raw = y * pos_weight * F.log1p(F.exp(-x)) + (1 - y) * F.log1p(F.exp(x))
    else:
        d = d.withColumn("prob", G.sigmoid(F.col("logit")))
        d = G.dilate(d, meta, {"_pn": "prob", "_yn": "y"}, radius, keep=["prob", "w", "y"]).where(F.col("w").isNotNull())
        raw = (-F.col("y") * pos_weight * F.log(F.greatest("_pn", F.lit(EPS)))
               - (1 - F.col("_yn")) * F.log(F.greatest(1 - F.col("prob"), F.lit(EPS))))
    return d.groupBy(*keys).agg((F.sum(raw * F.col("w")) / (F.sum("w") + EPS)).alias("bce"))


def tversky(cells: DataFrame, meta: DataFrame | None, alpha: float = 0.3, beta: float = 0.7,
            radius: int = 0) -> DataFrame:
    """Soft Tversky loss per tile; average over tiles for the batch value."""
    d = cells
    if radius > 0:
        d = G.dilate(d, meta, {"_ph": "prob", "_yh": "y"}, radius, keep=["prob", "w", "y"]).where(F.col("w").isNotNull())
    else:
        d = d.withColumns({"_ph": F.col("prob"), "_yh": F.col("y")})
    w, y = F.col("w"), F.col("y")
    s = d.groupBy("tile").agg(
        F.sum(w * F.col("_ph") * y).alias("tp"), F.sum(w * F.col("prob") * (1 - F.col("_yh"))).alias("fp"),
        F.sum(w * (1 - F.col("_ph")) * y).alias("fn"))
    loss = 1 - (F.col("tp") + EPS) / (F.col("tp") + F.col("fp") * alpha + F.col("fn") * beta + EPS)
    return s.select("tile", loss.alias("tversky"))


def cldice(cells: DataFrame, meta: DataFrame, iters: int = 8) -> DataFrame:
    """Centreline Dice loss per tile; ignored cells take the target as prediction."""
    from ridgeline.operators.skeleton import soft_skeleton

    d = cells.select("tile", "row", "col", F.col("y").cast("double").alias("y"),
                     F.when(F.col("w") > 0, F.col("prob")).otherwise(F.col("y").cast("double")).alias("prob"))
    s = soft_skeleton(d, meta, {"skel_p": "prob", "skel_y": "y"}, iters, keep=("prob", "y"))
    s = s.groupBy("tile").agg(
        F.sum(F.col("skel_p") * F.coalesce("y", F.lit(0.0))).alias("a"), F.sum("skel_p").alias("b"),
        F.sum(F.col("skel_y") * F.coalesce("prob", F.lit(0.0))).alias("c"), F.sum("skel_y").alias("d"))
    tp = (F.col("a") + EPS) / (F.col("b") + EPS)
    ts = (F.col("c") + EPS) / (F.col("d") + EPS)
    return s.select("tile", (1 - tp * ts * 2 / (tp + ts + EPS)).alias("cldice"))


def ramp(epoch: Column, warmup: int, span: int = 3) -> Column:
    """Weight of the topology term: off during warm-up, then linear."""
    return F.when(epoch < warmup, F.lit(0.0)).otherwise(
        F.least((epoch - warmup + 1) / float(span), F.lit(1.0)))


def combined_score(parts: DataFrame, ramp_col: Column, bce_w: float = 1.0, tversky_w: float = 1.0,
                   cldice_w: float = 0.5) -> DataFrame:
    """Weighted sum of the loss terms; at ramp 0 the topology term is withheld, not zero."""
    scale = ramp_col * cldice_w
    term = F.when(scale > 0, F.col("cldice"))
    return parts.withColumns({
        "cldice": term,
        "total": F.col("bce") * bce_w + F.col("tversky") * tversky_w + F.coalesce(term * scale, F.lit(0.0)),
    })


def overlay_summary(prob: DataFrame, keys: Sequence[str] = ("tile",)) -> DataFrame:
    return prob.groupBy(*keys).agg(
        F.avg("prob").alias("mean"), F.avg((F.col("prob") > 0.5).cast("double")).alias("above_half"))


def parity(expected: DataFrame, actual: DataFrame, value: str = "prob") -> DataFrame:
    """Largest difference, one-sided nodata and value range of two rasters."""
    j = expected.select("tile", "row", "col", F.col(value).alias("_a")).join(
        actual.select("tile", "row", "col", F.col(value).alias("_b")), ["tile", "row", "col"], "full")
    return j.groupBy("tile").agg(
        F.max(F.abs(F.col("_a") - F.col("_b"))).alias("max_abs_diff"),
        F.count_if(F.col("_a").isNull() != F.col("_b").isNull()).alias("nodata_mismatches"),
        ((F.max("_b") - F.min("_b")) > 0.05).alias("has_range"))


def evaluate_tiles(cells: DataFrame, meta: DataFrame, res: float, advisories: DataFrame | None = None) -> DataFrame:
    """One record per tile: sweep, stratified score, AP, false positives, advisory.

    The dilated planes feed both the sweep and the stratified counts.
    """
    near = dilated(cells, meta, K.tolerance_px(res), ["code"])
    both = sorted({*K.SWEEP_THRESHOLDS, *K.SELECTION_THRESHOLDS, 0.5})
    # ignored cells are a code of their own, so one aggregation also gives the label share
    code = F.when(F.col("w") <= 0, -1).when(F.col("y") > 0, F.col("code")).otherwise(0)
    by = _threshold_sums(near.withColumn("code", code), ["tile", "code"], both)
    valid = F.col("code") >= 0
    pooled = by.groupBy("tile", "t").agg(
        *[F.sum(F.when(valid, F.col(c))).alias(c) for c in ("y_sum", "cells", "pred", "tp_p", "tp_r")],
        F.sum("y_sum").alias("_pos"), F.sum("cells").alias("_all"))
    m = _prf(F.col("tp_p"), F.col("pred"), F.col("tp_r"), F.col("y_sum"))
    half = F.col("t") == 0.5
    sweep = pooled.groupBy("tile").agg(
        *[F.max(F.when(F.col("t") == t, F.round(m["f1"], 4))).alias(f"f1_{int(t * 100)}") for t in K.SWEEP_THRESHOLDS],
        F.round(F.max(F.when(half, F.try_divide("pred", "cells"))), 5).alias("fp_rate"),
        F.round(F.max(F.when(half, F.col("_pos") / F.col("_all"))), 5).alias("positive_frac"))
    scored = pool_counts(by.where(valid).drop("cells"), ["tile"])
    result = stratified_result(scored.where(F.col("t").isin(*K.SELECTION_THRESHOLDS)), ["tile"])
    strat_score = stratified_score(result, ["tile"])
    ap = average_precision(cells).withColumn("ap", F.round("ap", 4))
    out = sweep.join(strat_score, "tile", "left").join(ap, "tile", "left")
    if advisories is not None:
        out = out.join(advisories.select("tile", "advisory"), "tile", "left")
        out = out.withColumn("advisory", F.coalesce("advisory", F.lit("")))
    return out


def run_report(history: DataFrame, spread: DataFrame) -> DataFrame:
    """Last-epoch class scores beside the held-out spread, ordered for reading."""
    last = history.join(history.agg(F.max("epoch").alias("epoch")), "epoch")
    return last.select("epoch", "variant", "class", F.col("f1").alias("val_f1")).join(
        spread, ["variant", "class"], "left").orderBy("variant", "class")
