"""Queries over the gate, heights and their evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from plotwise.derive import ctes, fit_rows, l_rings, r6
from plotwise.functions import rings as g
from plotwise.operators import evaluate, gate, height
from plotwise.plans.geodesy import length_tag
from plotwise.session import table

QUERIES, ORACLES = {}, {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql:
            ORACLES[name] = sql
        return fn

    return register


_RANKS = {
    "footprint_iou": "CASE WHEN iou>=0.75 THEN 0 WHEN iou>=0.5 THEN 1 ELSE 2 END",
    "hausdorff_m": "CASE WHEN hausdorff_m<=2 THEN 0 WHEN hausdorff_m<=5 THEN 1 ELSE 2 END",
    "area_ratio": "CASE WHEN area_ratio>=0.85::DOUBLE AND area_ratio<=1.15::DOUBLE THEN 0 WHEN area_ratio>=0.7::DOUBLE AND area_ratio<=1.3::DOUBLE THEN 1 ELSE 2 END",
    "rotation_margin_footprint": "CASE WHEN margin>=0.05::DOUBLE THEN 0 ELSE 1 END",
    "rectilinearity": "CASE WHEN rectilinearity>=0.75 THEN 0 ELSE 1 END",
    "anisotropy_log_ratio": "CASE WHEN abs(aniso)<=0.05::DOUBLE THEN 0 WHEN abs(aniso)>=0.15::DOUBLE THEN 2 ELSE 1 END",
    "max_neighbor_overlap": "CASE WHEN overlap<=0.02::DOUBLE THEN 0 WHEN overlap<=0.1::DOUBLE THEN 1 ELSE 2 END",
}
_FLOORS = {
    "mirrored": ("mirrored", 2),
    "guessed": ("(disambiguated_by IN ('road_normal','facade_detail','arbitrary_symmetric') OR (disambiguated_by='aspect_ratio' AND NOT margin>=0.05::DOUBLE))", 1),
    "ill_posed": ("rectilinearity<0.6::DOUBLE", 1),
    "weak_match": ("coalesce(match_quality,'')='unnamed_sole_candidate'", 1),
    "unrecorded_match": ("coalesce(match_quality,'')=''", 1),
    "multipart": ("multipart", 1),
    "evidence_conflict": ("coalesce(exif_silhouette_disagree,false)", 1),
    "height": ("height_source NOT IN ('osm_height','osm_levels')", 1),
}
_RANK = f"greatest({','.join(_RANKS.values())})"
_FLOOR = "greatest(" + ",".join(f"CASE WHEN {c} THEN {r} ELSE 0 END" for c, r in _FLOORS.values()) + ")"
_NAME = "(CASE {0} WHEN 0 THEN 'auto_accept' WHEN 1 THEN 'review' ELSE 'reject' END)"
_DECIDED = ctes("fit") + f", d AS (SELECT *, {_NAME.format('greatest(' + _RANK + ',' + _FLOOR + ')')} AS decision, {_NAME.format(_RANK)} AS table_decision FROM fit)"


@query("gate_bands", ctes("fit") + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS name, {_NAME.format(r)} AS band, count(*)::BIGINT AS n FROM fit GROUP BY ALL" for n, r in _RANKS.items()) + ")")
def gate_bands(spark, d):
    return fit_rows(spark, d).select(F.explode(gate.checks()).alias("c")).groupBy(F.col("c.name").alias("name"), F.col("c.band").alias("band")).agg(F.count("*").alias("n"))


@query("gate_decision", _DECIDED + " SELECT config, corruption, decision, table_decision, count(*)::BIGINT AS n FROM d GROUP BY ALL")
def gate_decision(spark, d):
    e = gate.evaluate(fit_rows(spark, d)).withColumn("table_decision", gate.decision(gate.table_rank()))
    return e.groupBy("config", "corruption", "decision", "table_decision").agg(F.count("*").alias("n"))


@query("gate_hard_rules", ctes("fit") + " SELECT * FROM (" + " UNION ALL ".join(f"SELECT '{n}' AS rule, count(*)::BIGINT AS n FROM fit WHERE {c}" for n, (c, _) in _FLOORS.items()) + ") WHERE n>0")
def gate_hard_rules(spark, d):
    return fit_rows(spark, d).select(F.explode(gate.forced()).alias("rule")).groupBy("rule").agg(F.count("*").alias("n"))


_SCORE = "(least(greatest(iou/0.85::DOUBLE,0),1)+least(greatest(1-hausdorff_m/6,0),1)+least(greatest(1-abs(ln(greatest(area_ratio,1e-6)))/0.35::DOUBLE,0),1)+least(greatest(margin/0.2::DOUBLE,0),1)+least(greatest(rectilinearity,0),1))/5"


@query("gate_pseudo_score", ctes("fit") + f" SELECT building_id, round(min({_SCORE}),6) AS least, round(max({_SCORE}),6) AS most FROM fit GROUP BY building_id")
def gate_pseudo_score(spark, d):
    return fit_rows(spark, d).withColumn("s", gate.pseudo_score()).groupBy("building_id").agg(r6(F.min("s")).alias("least"), r6(F.max("s")).alias("most"))


@query("gate_features", ctes("fit") + """ SELECT building_id, round(max(abs(ln(area_ratio))),6) AS abs_area_ratio_log, round(max(abs(aniso)),6) AS abs_anisotropy_log_ratio, sum(CASE WHEN height_source IN ('osm_height','osm_levels') THEN 1 ELSE 0 END)::DOUBLE AS authoritative FROM fit GROUP BY building_id""")
def gate_features(spark, d):
    own = gate.features()
    return fit_rows(spark, d).select("building_id", *[c.alias(n) for n, c in own.items()]).groupBy("building_id").agg(
        r6(F.max("abs_area_ratio_log")).alias("abs_area_ratio_log"), r6(F.max("abs_anisotropy_log_ratio")).alias("abs_anisotropy_log_ratio"), F.sum("height_source_authoritative").alias("authoritative")
    )


MODEL = {"feature_names": ["footprint_iou", "hausdorff_m", "rectilinearity", "rotation_margin_footprint"], "scaler_mean": [0.6, 3.5, 0.75, 0.05], "scaler_scale": [0.2, 2.0, 0.17, 0.03], "coef_standardised": [1.2, -0.9, 0.4, 0.3], "intercept": -0.2, "thresholds": {"p_accept": 0.7, "p_reject": 0.3}, "trained_on_synthetic": False}
_Z = "(-0.2::DOUBLE+1.2::DOUBLE*(iou-0.6::DOUBLE)/0.2::DOUBLE-0.9::DOUBLE*(hausdorff_m-3.5)/2.0+0.4::DOUBLE*(rectilinearity-0.75)/0.17::DOUBLE+0.3::DOUBLE*(margin-0.05::DOUBLE)/0.03::DOUBLE)"


@query("gate_learned", ctes("fit") + f""", p AS (SELECT *, 1/(1+exp(-{_Z})) AS pr FROM fit), r AS (SELECT *, {_NAME.format('greatest(CASE WHEN pr>=0.7::DOUBLE THEN 0 WHEN pr<=0.3::DOUBLE THEN 2 ELSE 1 END,' + _FLOOR + ')')} AS decision FROM p)
SELECT config, decision, count(*)::BIGINT AS n, round(avg(pr),6) AS mean_p FROM r GROUP BY ALL""")
def gate_learned(spark, d):
    e = gate.evaluate(fit_rows(spark, d), MODEL)
    return e.groupBy("config", "decision").agg(F.count("*").alias("n"), r6(F.avg("probability")).alias("mean_p"))


# Every edge of the bands.
GRID = {
    "iou": (0.4, 0.5, 0.6, 0.75, 0.9), "hausdorff_m": (1.0, 2.0, 3.0, 5.0, 6.0), "area_ratio": (0.6, 0.7, 0.8, 0.85, 1.0, 1.15, 1.2, 1.3, 1.4), "margin": (0.0, 0.049, 0.05, 0.3),
    "aniso": (0.0, 0.05, 0.1, 0.15, 0.3), "overlap": (0.0, 0.02, 0.05, 0.1, 0.2), "rectilinearity": (0.5, 0.74, 0.75, 0.95),
}


@query("gate_parity_grid", "WITH grid AS (SELECT * FROM " + ", ".join(f"(SELECT unnest([{','.join(f'{x}::DOUBLE' for x in v)}]) AS {n})" for n, v in GRID.items()) + f") SELECT {_NAME.format(_RANK)} AS decision, iou, hausdorff_m, count(*)::BIGINT AS n FROM grid GROUP BY ALL")
def gate_parity_grid(spark, d):
    """All 90,000 combinations of the bands' edges, exploded from one row."""
    grid = spark.range(1)
    for name, values in GRID.items():
        grid = grid.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    return grid.groupBy(gate.decision(gate.table_rank()).alias("decision"), "iou", "hausdorff_m").agg(F.count("*").alias("n"))


def decided(spark, d):
    """Rows with the table's decision, which accepts some."""
    return fit_rows(spark, d).withColumn("decision", gate.decision(gate.table_rank()))


_SUM = """count(*)::BIGINT AS n, round(quantile_cont(iou,0.5),6) AS iou_med, round(quantile_cont(iou,0.1),6) AS iou_p10, round(quantile_cont(hausdorff_m,0.9),6) AS haus_p90, round(avg(label),6) AS good,
round(count(*) FILTER (decision='auto_accept')::DOUBLE/count(*),6) AS accept, round(coalesce(avg(1-label) FILTER (decision='auto_accept'),0),6)+0.0::DOUBLE AS false_accept, round(quantile_cont(ms,0.5),3) AS ms_med"""
_TABLE = ctes("fit") + f", d AS (SELECT *, {_NAME.format(_RANK)} AS decision FROM fit)"


@query("summary_by_config", _TABLE + f" SELECT config, {_SUM} FROM d GROUP BY config")
def summary_by_config(spark, d):
    return evaluate.summarise(decided(spark, d), "config")


@query("summary_by_corruption", _TABLE + f" SELECT corruption, {_SUM} FROM d GROUP BY corruption")
def summary_by_corruption(spark, d):
    return evaluate.summarise(decided(spark, d), "corruption")


@query("summary_grouping_sets", _TABLE + f" SELECT config, corruption, height_source, {_SUM} FROM d GROUP BY GROUPING SETS ((config),(corruption),(height_source))")
def summary_grouping_sets(spark, d):
    return evaluate.summarise_all(decided(spark, d), ["config", "corruption", "height_source"])


@query("false_accepts", _TABLE + " SELECT building_id, config, corruption, round(iou,4) AS iou, ms FROM d WHERE decision='auto_accept' AND label=0")
def false_accepts(spark, d):
    return decided(spark, d).where("decision = 'auto_accept' and label = 0").select("building_id", "config", "corruption", F.round("iou", 4).alias("iou"), "ms")


@query("decision_tally", _TABLE + """ SELECT corruption, count(*)::BIGINT AS n, count(*) FILTER (decision='auto_accept')::BIGINT AS accepts, count(*) FILTER (decision='auto_accept' AND label=0)::BIGINT AS wrong_accepts,
count(*) FILTER (decision='reject')::BIGINT AS rejects, count(*) FILTER (decision='reject' AND label=1)::BIGINT AS wrong_rejects FROM d GROUP BY corruption""")
def decision_tally(spark, d):
    return evaluate.tally(decided(spark, d), "corruption")


_LEVELS = ctes("fit") + """, lv AS (SELECT round(p,6) AS t, count(*) AS n, sum(label) AS k FROM fit GROUP BY 1), cum AS (SELECT t, n, k, sum(n) OVER (ORDER BY t DESC) AS n_ge, sum(k) OVER (ORDER BY t DESC) AS k_ge, sum(n) OVER (ORDER BY t) AS n_le, sum(k) OVER (ORDER BY t) AS k_le FROM lv)"""


@query("choose_thresholds", _LEVELS + """, a AS (SELECT min(t) AS p_accept FROM cum WHERE n_ge>=5 AND k_ge::DOUBLE/n_ge>=0.95)
SELECT p_accept, (SELECT max(t) FROM cum WHERE n_le>=5 AND (n_le-k_le)::DOUBLE/n_le>=0.9 AND (p_accept IS NULL OR t<p_accept)) AS p_reject FROM a""")
def choose_thresholds(spark, d):
    return evaluate.choose_thresholds(fit_rows(spark, d))


@query("equal_coverage", _LEVELS + " SELECT (max(struct_pack(t:=t,n:=n_ge,k:=k_ge))).t AS threshold, (max(struct_pack(t:=t,n:=n_ge,k:=k_ge))).n::BIGINT AS accepts, ((max(struct_pack(t:=t,n:=n_ge,k:=k_ge))).n-(max(struct_pack(t:=t,n:=n_ge,k:=k_ge))).k)::BIGINT AS wrong FROM cum WHERE n_ge>=5000")
def equal_coverage(spark, d):
    return evaluate.at_coverage(fit_rows(spark, d), 5000)


@query("zero_wrong_threshold", _LEVELS + " SELECT min(t) AS threshold, coalesce(max(n_ge),0)::BIGINT AS accepts FROM cum WHERE n_ge=k_ge")
def zero_wrong(spark, d):
    return evaluate.zero_wrong_threshold(fit_rows(spark, d))


_W = "1.96::DOUBLE"


@query("reliability_bins", ctes("fit") + f""", b AS (SELECT least(floor(p*4),3)::BIGINT AS bin, count(*) AS n, sum(label) AS k, avg(p) AS mp FROM fit GROUP BY 1), w AS (SELECT r.bin, coalesce(n,0)::BIGINT AS n, k, mp, k::DOUBLE/n AS s, n::DOUBLE AS m FROM range(4) r(bin) LEFT JOIN b ON b.bin=r.bin)
SELECT bin, n, round(mp,6) AS mean_predicted, round(s,6) AS observed, round(greatest(0,(s+{_W}*{_W}/(2*m)-{_W}*sqrt(s*(1-s)/m+{_W}*{_W}/(4*m*m)))/(1+{_W}*{_W}/m)),6)+0.0::DOUBLE AS wilson_lo,
round(least(1,(s+{_W}*{_W}/(2*m)+{_W}*sqrt(s*(1-s)/m+{_W}*{_W}/(4*m*m)))/(1+{_W}*{_W}/m)),6) AS wilson_hi FROM w""")
def reliability_bins(spark, d):
    return evaluate.reliability(fit_rows(spark, d))


@query("calibration_error", ctes("fit") + ", b AS (SELECT least(floor(p*4),3) AS bin, count(*) AS n, sum(label) AS k, sum(p) AS s FROM fit GROUP BY 1) SELECT round(sum(abs(k-s))/sum(n),6) AS ece FROM b")
def calibration_error(spark, d):
    return evaluate.calibration_error(fit_rows(spark, d))


@query("auc_rank", _LEVELS + """, r AS (SELECT sum(k*(n_le-n+(n+1)/2.0::DOUBLE)) AS r, sum(k)::DOUBLE AS a, sum(n-k)::DOUBLE AS b FROM cum),
m AS (SELECT round(avg(CASE WHEN (p>=0.5)::INT=label THEN 1.0::DOUBLE ELSE 0 END),6) AS accuracy, round(avg(-(label*ln(q)+(1-label)*ln(1-q))),5) AS log_loss, round(avg((p-label)*(p-label)),6) AS brier, round(avg(label),6) AS base_rate, round(greatest(avg(label),1-avg(label)),6) AS majority
FROM (SELECT *, greatest(least(p,1-1e-12::DOUBLE),1e-12::DOUBLE) AS q FROM fit)) SELECT m.*, round((r-a*(a+1)/2)/(a*b),6) AS auc FROM m, r""")
def auc_rank(spark, d):
    return evaluate.metrics(fit_rows(spark, d))


_H = """hh AS (SELECT p_partkey AS id, CASE p_partkey%7 WHEN 0 THEN p_size::DOUBLE WHEN 1 THEN p_size WHEN 2 THEN p_size*0.3048::DOUBLE WHEN 3 THEN (p_size+0.5::DOUBLE)*0.3048::DOUBLE WHEN 4 THEN p_size*0.3048::DOUBLE WHEN 5 THEN p_size+0.5::DOUBLE END AS tag,
CASE WHEN p_partkey%3=0 THEN (p_partkey%9)*3.0::DOUBLE END AS lev, CASE WHEN p_partkey%4=0 THEN -1.0::DOUBLE ELSE 2.0::DOUBLE+p_partkey%30 END AS ms, CASE WHEN p_partkey%2=0 THEN (p_partkey%50)::DOUBLE END AS depth, 100.0::DOUBLE+p_size*20 AS area, CASE WHEN p_partkey%3<>1 THEN 1 ELSE 0 END AS keep FROM part),
h1 AS (SELECT *, CASE WHEN keep=1 AND tag BETWEEN 2.5 AND 300 THEN tag WHEN lev BETWEEN 2.5 AND 300 THEN lev END AS osm, CASE WHEN keep=1 AND tag BETWEEN 2.5 AND 300 THEN 'osm_height' WHEN lev BETWEEN 2.5 AND 300 THEN 'osm_levels' END AS src,
coalesce(depth BETWEEN 2.5 AND 300 AND depth/sqrt(area) BETWEEN 0.1 AND 8, false) AS dok, CASE WHEN ms BETWEEN 2.5 AND 300 THEN ms END AS m FROM hh),
h2 AS (SELECT id, area, coalesce(osm, CASE WHEN dok THEN depth END, m, greatest(0.1::DOUBLE*sqrt(area), least(greatest(2.5::DOUBLE, least(area/50,300)), 8*sqrt(area)))) AS height_m, coalesce(src, CASE WHEN dok THEN 'monocular_depth' END, CASE WHEN m IS NOT NULL THEN 'microsoft' END, 'proportional_fallback') AS source,
(CASE WHEN osm IS NOT NULL AND depth>0 AND abs(depth-osm)/osm>0.3::DOUBLE THEN 1 ELSE 0 END)+(CASE WHEN osm IS NOT NULL AND ms>0 AND abs(ms-osm)/osm>0.3::DOUBLE THEN 1 ELSE 0 END)+(CASE WHEN osm IS NULL AND dok AND m IS NOT NULL THEN 1 ELSE 0 END)+(CASE WHEN osm IS NULL AND depth IS NOT NULL AND NOT dok THEN 1 ELSE 0 END)+(CASE WHEN osm IS NULL AND NOT dok THEN 1 ELSE 0 END) AS notes FROM h1)"""


def heights(spark, d):
    k = F.col("p_partkey")
    tag, levels = F.when(k % 3 != 1, length_tag()), F.when(k % 3 == 0, (k % 9).cast("string"))
    ms = F.when(k % 4 == 0, -1.0).otherwise(2.0 + k % 30)
    area = 100.0 + F.col("p_size") * 20
    osm, source = height.from_osm(tag, levels)
    read = table(spark, d, "part").select(k.alias("id"), osm.alias("osm"), source.alias("osm_source"), ms.alias("ms"), F.when(k % 2 == 0, (k % 50).cast("double")).alias("depth"), area.alias("area"))
    a = F.col("area")
    return read.select("id", height.resolve_from(F.col("osm"), F.col("osm_source"), F.col("ms"), F.col("depth"), a, F.lit(0.02), a).alias("h"))


@query("height_chain", "WITH " + _H + " SELECT id, round(height_m,6) AS height_m, source, notes::INTEGER AS notes FROM h2")
def height_chain(spark, d):
    return heights(spark, d).select("id", F.round("h.height_m", 6).alias("height_m"), F.col("h.source").alias("source"), F.size("h.notes").alias("notes"))


@query("height_coverage", "WITH " + _H + " SELECT count(*)::BIGINT AS total, count(*) FILTER (source LIKE 'osm%')::BIGINT AS hits, round(count(*) FILTER (source LIKE 'osm%')::DOUBLE/count(*),6) AS coverage, count(*) FILTER (source LIKE 'osm%')::DOUBLE/count(*)>=0.8 AS enough FROM h2")
def height_coverage(spark, d):
    hit = F.col("h.source").startswith("osm")
    return heights(spark, d).agg(F.count("*").alias("total"), F.count_if(hit).alias("hits"), F.round(F.count_if(hit) / F.count("*"), 6).alias("coverage"), (F.count_if(hit) / F.count("*") >= 0.8).alias("enough"))


@query("ground_percentile", """SELECT user_id, round(quantile_cont(value,0.25),6) AS ground, round(max(value)-min(value),6) AS spread, max(value)-min(value)>1.5 AS sloped, round(quantile_cont(value,0.01),6) AS base FROM events GROUP BY user_id""")
def ground_percentile(spark, d):
    """Ground height of terrain samples, and the robust base of a mesh's vertices."""
    return table(spark, d, "events").groupBy("user_id").agg(
        r6(F.percentile("value", F.lit(0.25))).alias("ground"), r6(F.max("value") - F.min("value")).alias("spread"), (F.max("value") - F.min("value") > 1.5).alias("sloped"), r6(F.percentile("value", F.lit(0.01))).alias("base")
    )


@query("review_queue", _DECIDED + " SELECT building_id, decision, count(*)::BIGINT AS n FROM d WHERE decision<>'auto_accept' GROUP BY ALL")
def review_queue(spark, d):
    return gate.evaluate(fit_rows(spark, d)).where("decision <> 'auto_accept'").groupBy("building_id", "decision").agg(F.count("*").alias("n"))


@query("latest_record", "SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn=1")
def latest_record(spark, d):
    """The newest record of each address, by an aggregate that combines map-side."""
    return table(spark, d, "events").groupBy("user_id").agg(F.max(F.struct("ts", "event_id", "event_type")).alias("m")).select("user_id", "m.event_id", "m.event_type")


@query("flagship", ctes("l_base") + ", hs AS (WITH " + _H + """ SELECT * FROM h2) SELECT source, CASE WHEN l.h/l.w*2<1 THEN 'flat' ELSE 'tall' END AS shape, count(*)::BIGINT AS n, round(sum(w*h*(1-f*f)),3) AS area, round(avg(height_m),6) AS height_m FROM l_base l JOIN hs USING (id) GROUP BY ALL""")
def flagship(spark, d):
    """Placement in one plan: rings measured, heights resolved, tallied by height source and shape."""
    r = l_rings(spark, d).select("id", g.signed_area(F.col("ring")).alias("area"), F.when(F.col("h") / F.col("w") * 2 < 1, "flat").otherwise("tall").alias("shape"))
    joined = r.join(heights(spark, d), "id")
    return joined.groupBy(F.col("h.source").alias("source"), "shape").agg(F.count("*").alias("n"), F.round(F.sum("area"), 3).alias("area"), r6(F.avg("h.height_m")).alias("height_m"))
