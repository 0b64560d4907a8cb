"""The accept / review / reject gate as Column expressions over a row of fit metrics.

A row has iou, hausdorff_m, area_ratio, margin, rectilinearity, aniso, overlap, mirrored, multipart, match_quality,
disambiguated_by, height_source and exif_silhouette_disagree.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ACCEPT, REVIEW, REJECT = "auto_accept", "review", "reject"

# Metric, column, rule text.
RULES = (
    ("footprint_iou", "iou", "accept >= 0.75, review 0.50-0.75, reject < 0.50"),
    ("hausdorff_m", "hausdorff_m", "accept <= 2.0 m, review 2-5 m, reject > 5 m"),
    ("area_ratio", "area_ratio", "accept 0.85-1.15, review 0.7-1.3, reject outside"),
    ("rotation_margin_footprint", "margin", "accept >= 0.05, review < 0.05"),
    ("rectilinearity", "rectilinearity", "accept >= 0.75, review < 0.75"),
    ("anisotropy_log_ratio", "aniso", "accept <= 0.05, review 0.05-0.15, reject >= 0.15 (|log(sx/sy)|)"),
    ("max_neighbor_overlap", "overlap", "accept <= 0.02, review 0.02-0.10, reject > 0.10"),
)
GUESSED = ("road_normal", "facade_detail", "arbitrary_symmetric")
AUTHORITATIVE = ("osm_height", "osm_levels")
FEATURES = ("footprint_iou", "hausdorff_m", "abs_area_ratio_log", "rotation_margin_footprint", "rectilinearity", "abs_anisotropy_log_ratio", "max_neighbor_overlap", "height_source_authoritative")


def _level(accept: Column, review: Column) -> Column:
    return F.when(accept, 0).when(review, 1).otherwise(2)


def ranks() -> dict[str, Column]:
    """Metric -> 0 accept, 1 review, 2 reject."""
    v = {name: F.col(c) for name, c, _ in RULES}
    ar, an = v["area_ratio"], F.abs(v["anisotropy_log_ratio"])
    return {
        "footprint_iou": _level(v["footprint_iou"] >= 0.75, v["footprint_iou"] >= 0.5),
        "hausdorff_m": _level(v["hausdorff_m"] <= 2.0, v["hausdorff_m"] <= 5.0),
        "area_ratio": _level((ar >= 0.85) & (ar <= 1.15), (ar >= 0.7) & (ar <= 1.3)),
        "rotation_margin_footprint": F.when(v["rotation_margin_footprint"] >= 0.05, 0).otherwise(1),
        "rectilinearity": F.when(v["rectilinearity"] >= 0.75, 0).otherwise(1),
        "anisotropy_log_ratio": F.when(an <= 0.05, 0).when(an >= 0.15, 2).otherwise(1),
        "max_neighbor_overlap": _level(v["max_neighbor_overlap"] <= 0.02, v["max_neighbor_overlap"] <= 0.10),
    }


def decision(rank: Column) -> Column:
    return F.when(rank == 0, ACCEPT).when(rank == 1, REVIEW).otherwise(REJECT)


def valid() -> Column:
    """Every metric finite and the area ratio not negative; others go to quarantine, not to a decision."""
    ok = F.col("area_ratio") >= 0
    for _, c, _ in RULES:
        ok = ok & F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf"))
    return F.coalesce(ok, F.lit(False))


def checks() -> Column:
    """ARRAY<STRUCT<name, value, band, rule>> in the table's order."""
    level = ranks()
    return F.array(*[F.struct(F.lit(n).alias("name"), F.col(c).cast("double").alias("value"), decision(level[n]).alias("band"), F.lit(rule).alias("rule")) for n, c, rule in RULES])


def table_rank() -> Column:
    return F.greatest(*ranks().values())


def orientation_guessed() -> Column:
    """NaN margins count as guesses, so NaN is asked for first: in Spark it is the largest value."""
    by, margin = F.col("disambiguated_by"), F.col("margin")
    return by.isin(*GUESSED) | ((by == "aspect_ratio") & (F.isnan(margin) | ~(margin >= 0.05)))


def floors() -> list[tuple[str, Column, int]]:
    """(name, fires, rank) of the hard rules, in order."""
    quality = F.coalesce(F.col("match_quality"), F.lit(""))
    return [
        ("mirrored", F.coalesce(F.col("mirrored"), F.lit(False)), 2),
        ("guessed", F.coalesce(orientation_guessed(), F.lit(False)), 1),
        ("ill_posed", F.col("rectilinearity") < 0.6, 1),
        ("weak_match", quality == "unnamed_sole_candidate", 1),
        ("unrecorded_match", quality == "", 1),
        ("multipart", F.coalesce(F.col("multipart"), F.lit(False)), 1),
        ("evidence_conflict", F.col("exif_silhouette_disagree").eqNullSafe(F.lit(True)), 1),
        ("height", ~F.coalesce(F.col("height_source").isin(*AUTHORITATIVE), F.lit(False)), 1),
    ]


def forced() -> Column:
    """Names of the hard rules that fire."""
    return F.array_compact(F.array(*[F.when(fires, F.lit(name)) for name, fires, _ in floors()]))


def floor_rank() -> Column:
    return F.greatest(*[F.when(fires, rank).otherwise(0) for _, fires, rank in floors()])


def pseudo_score() -> Column:
    """Mean of five clipped terms; comparable, not calibrated."""
    clip = lambda x: F.least(F.greatest(x, F.lit(0.0)), F.lit(1.0))
    terms = (
        clip(F.col("iou") / 0.85),
        clip(1.0 - F.col("hausdorff_m") / 6.0),
        clip(1.0 - F.abs(F.log(F.greatest(F.col("area_ratio"), F.lit(1e-6)))) / 0.35),
        clip(F.col("margin") / 0.20),
        clip(F.col("rectilinearity")),
    )
    return sum(terms[1:], terms[0]) / 5.0


def features() -> dict[str, Column]:
    return {
        "footprint_iou": F.col("iou"),
        "hausdorff_m": F.col("hausdorff_m"),
        "abs_area_ratio_log": F.abs(F.log("area_ratio")),
        "rotation_margin_footprint": F.col("margin"),
        "rectilinearity": F.col("rectilinearity"),
        "abs_anisotropy_log_ratio": F.abs(F.col("aniso")),
        "max_neighbor_overlap": F.col("overlap"),
        "height_source_authoritative": F.col("height_source").isin(*AUTHORITATIVE).cast("double"),
    }


def probability(model: dict) -> Column:
    """Sigmoid of the standardised dot product; ``model`` has feature_names, scaler_mean, scaler_scale, coef_standardised, intercept."""
    own = features()
    z = F.lit(float(model["intercept"]))
    for name, mean, scale, coef in zip(model["feature_names"], model["scaler_mean"], model["scaler_scale"], model["coef_standardised"], strict=True):
        z = z + coef * (own[name] - mean) / scale
    return F.when(z >= 0, 1.0 / (1.0 + F.exp(-z))).otherwise(F.exp(z) / (1.0 + F.exp(z)))


def learned_rank(p: Column, p_accept: float | None, p_reject: float | None) -> Column:
    """Thresholds that are None never fire."""
    out = F.lit(1)
    if p_reject is not None:
        out = F.when(p <= p_reject, 2).otherwise(out)
    if p_accept is not None:
        out = F.when(p >= p_accept, 0).otherwise(out)
    return out


def evaluate(fits: DataFrame, model: dict | None = None) -> DataFrame:
    """``fits`` with status, decision, probability, score, method, checks and forced.

    The table decides, or with a model its thresholds; hard rules only lower the result. Rows with a metric that
    isn't finite, or a negative area ratio, get status ``quarantined`` and no decision.
    """
    p = probability(model) if model else F.lit(None).cast("double")
    rank = learned_rank(p, model["thresholds"].get("p_accept"), model["thresholds"].get("p_reject")) if model else table_rank()
    ok = valid()
    return fits.select(
        "*",
        F.when(ok, "ok").otherwise("quarantined").alias("status"),
        F.when(ok, decision(F.greatest(rank, floor_rank()))).alias("decision"),
        F.when(ok, p).alias("probability"),
        F.when(ok, pseudo_score()).alias("score"),
        F.lit("learned" if model else "table").alias("method"),
        F.when(ok, checks()).alias("checks"),
        F.when(ok, forced()).alias("forced"),
    )


def threshold_decision() -> Column:
    """The table's decision a second time, from two conditions instead of ranks, with the match, parts and mirror rules.

    Kept apart from ``table_rank`` on purpose: the two are held against each other.
    """
    iou, distance, ratio, aniso, common = (F.col(c) for c in ("iou", "hausdorff_m", "area_ratio", "aniso", "overlap"))
    quality = F.coalesce(F.col("match_quality"), F.lit(""))
    bad = (iou < 0.5) | (distance > 5.0) | ~ratio.between(0.7, 1.3) | (aniso >= 0.15) | (common > 0.10) | F.coalesce(F.col("mirrored"), F.lit(False))
    doubt = (iou < 0.75) | (distance > 2.0) | ~ratio.between(0.85, 1.15) | (F.col("margin") < 0.05) | (F.col("rectilinearity") < 0.75) | (aniso > 0.05) | (common > 0.02)
    return F.when(bad, REJECT).when(doubt | quality.isin("", "unnamed_sole_candidate") | F.coalesce(F.col("multipart"), F.lit(False)), REVIEW).otherwise(ACCEPT)


def resolve_method(asked: str | None = None, flag: str | None = None, model: dict | None = None) -> tuple[str, str | None]:
    """(method, reason): what was asked for, else the flag, else the table.

    The learned gate without a model falls back to the table with a reason; one trained on synthetic rows is an error,
    as are unknown names and flags.
    """
    flag = (flag or "").strip().lower()
    if flag not in ("", "1", "true", "yes", "on", "0", "false", "no", "off"):
        raise ValueError(f"flag {flag!r} is not recognised; use 1 or 0")
    method = asked or ("learned" if flag in ("1", "true", "yes", "on") else "table")
    if method not in ("table", "learned"):
        raise ValueError(f"unknown method {method!r}")
    if method == "learned" and model is None:
        return "table", "no learned model"
    if method == "learned" and model.get("trained_on_synthetic"):
        raise ValueError("the model was trained on synthetic rows and must not gate placements")
    return method, None
