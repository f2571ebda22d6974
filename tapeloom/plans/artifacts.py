"""Per-symbol records as JSON, lookups of fixed parameter tables, model tiers and probability gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions import windows as w
from tapeloom.plans.registry import query
from tapeloom.sources.bars import BARS, bars_orders, table


def _r(x, n=6):
    return F.round(x, n)


@query(f"""WITH {BARS}, k AS (SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date DESC) AS rn FROM bars) SELECT symbol, date, round(close, 2) AS close FROM k WHERE rn <= 10""")
def artifact_json_roundtrip(spark, sf_dir):
    """The last ten bars of each symbol as one JSON record, read back and exploded."""
    x = bars_orders(spark, sf_dir).withColumn("rn", F.row_number().over(w.BY.orderBy(F.desc("date")))).where("rn <= 10")
    rec = x.groupBy("symbol").agg(F.to_json(F.struct(F.sort_array(F.collect_list(F.struct("date", _r("close", 2).alias("close")))).alias("history"))).alias("json"))
    back = rec.select("symbol", F.explode(F.from_json("json", "history array<struct<date:date,close:double>>")["history"]).alias("h"))
    return back.select("symbol", "h.date", "h.close")


# Stop multiple, regime window, entry threshold, exposure floor, weight cap of an asset class.
TRADING = [("MEGA_INDEX", 4.5, 260, 0.52, 0.40, 1.0), ("EM_INDEX", 3.0, 200, 0.58, 0.0, 1.0), ("LIQUID_STOCK", 2.0, 130, 0.62, 0.0, 0.30), ("THIN_STOCK", 4.0, 240, 0.68, 0.0, 0.10)]
DEFAULT_CLASS = "LIQUID_STOCK"
# Entry threshold and exposure floor by kind of asset and regime.
REGIMES = [("index", "bull", 0.52, 0.80), ("index", "neutral", 0.55, 0.50), ("index", "bear", 0.60, 0.20), ("emerging_stock", "bull", 0.56, 0.50), ("emerging_stock", "neutral", 0.60, 0.20), ("emerging_stock", "bear", 0.65, 0.0)]
# Profit multiples (normal, trend, choppy) and stop multiple of a sector; the default follows.
BARRIERS = [
    ("Commercial Banks", 0.85, 1.0, 0.75, 2.5), ("Life Insurance", 0.85, 1.05, 0.70, 2.5), ("Development Banks", 1.15, 1.40, 0.90, 2.5), ("Finance", 1.15, 1.40, 0.90, 2.5),
    ("Hydropower", 1.60, 2.20, 1.25, 3.0), ("Non-Life Insurance", 1.40, 1.80, 1.20, 2.7), ("Microfinance", 2.10, 3.00, 1.50, 3.2), ("Hotels & Tourism", 1.35, 1.60, 1.00, 2.7),
    ("Manufacturing & Processing", 1.35, 1.60, 1.00, 2.7), ("Investment", 1.35, 1.60, 1.00, 2.7), ("Trading", 1.35, 1.60, 1.00, 2.7), ("Others", 1.35, 1.60, 1.00, 2.7),
]
DEFAULT_BARRIER = (1.25, 1.5, 1.0, 2.5)
# Label horizon of a sector in bars; others take 21.
HORIZONS = [("Commercial Banks", 45), ("Development Banks", 40), ("Finance", 25), ("Hydropower", 30), ("Microfinance", 40), ("Investment", 75)]
DEFAULT_HORIZON = 21

_SECTORS = [*[b[0] for b in BARRIERS], "Unknown"]


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(repr(v).replace('"', "'") for v in r) + ")" for r in rows)


def barriers(x, sector="sector", regime="regime"):
    """x with profit and stop multiples and the horizon of its sector and regime. The tables have a dozen rows each."""
    spark = x.sparkSession
    rules = spark.createDataFrame([(s, r, p, sl) for s, *ps, sl in BARRIERS for r, p in zip(("normal", "trend", "choppy"), ps)], "sector string, regime string, pt double, sl double")
    base = F.when(F.col(regime) == "trend", DEFAULT_BARRIER[1]).when(F.col(regime) == "choppy", DEFAULT_BARRIER[2]).otherwise(DEFAULT_BARRIER[0])
    out = x.join(F.broadcast(rules), [sector, regime], "left").join(F.broadcast(spark.createDataFrame(HORIZONS, "sector string, horizon int")), "sector", "left")
    return out.withColumns({"pt": F.coalesce("pt", base), "sl": F.coalesce("sl", F.lit(DEFAULT_BARRIER[3])), "horizon": F.coalesce("horizon", F.lit(DEFAULT_HORIZON))})


def _pick(options: list[str], key: str) -> str:
    return "CASE " + " ".join(f"WHEN {key} % {len(options)} = {k} THEN '{s}'" for k, s in enumerate(options)) + " END"


@query(f"""WITH g AS (SELECT p_partkey, {_pick(_SECTORS, 'p_partkey')} AS sector, {_pick(['normal', 'trend', 'choppy'], '(p_partkey // 13)')} AS regime, {_pick([*[t[0] for t in TRADING], 'OTHER'], 'p_partkey')} AS cls FROM part),
b(sector, n, t, c, sl) AS (VALUES {_values(BARRIERS)}), h(sector, hz) AS (VALUES {_values(HORIZONS)}), t(cls, sl_mult, ma, thr, floor_, cap) AS (VALUES {_values(TRADING)})
SELECT p_partkey, g.sector, regime, coalesce(CASE regime WHEN 'normal' THEN n WHEN 'trend' THEN b.t ELSE c END, CASE regime WHEN 'normal' THEN 1.25 WHEN 'trend' THEN 1.5 ELSE 1.0 END)::DOUBLE AS pt, coalesce(b.sl, 2.5)::DOUBLE AS sl, coalesce(hz, 21)::INT AS horizon,
    coalesce(t.sl_mult, 2.0)::DOUBLE AS stop_mult, coalesce(t.thr, 0.62)::DOUBLE AS prob_thresh FROM g LEFT JOIN b USING (sector) LEFT JOIN h USING (sector) LEFT JOIN t ON t.cls = g.cls""")
def parameter_lookup(spark, sf_dir):
    """Barrier, horizon and trading parameters by sector, regime and asset class; unknown keys take the defaults."""
    x = table(spark, sf_dir, "part").select("p_partkey", F.expr(_pick(_SECTORS, "p_partkey")).alias("sector"), F.expr(_pick(["normal", "trend", "choppy"], "(p_partkey div 13)")).alias("regime"), F.expr(_pick([*[t[0] for t in TRADING], "OTHER"], "p_partkey")).alias("cls"))
    t = spark.createDataFrame([(c, a, b) for c, a, _, b, *_ in TRADING], "cls string, stop_mult double, prob_thresh double")
    default = next(t for t in TRADING if t[0] == DEFAULT_CLASS)
    x = barriers(x).join(F.broadcast(t), "cls", "left")
    return x.select("p_partkey", "sector", "regime", "pt", "sl", "horizon", F.coalesce("stop_mult", F.lit(default[1])).alias("stop_mult"), F.coalesce("prob_thresh", F.lit(default[3])).alias("prob_thresh"))


# Lower bound of the score, tier and trust of each band.
TIERS = [(0.57, "Gold", 0.85), (0.53, "Gold", 0.75), (0.515, "Silver", 0.55), (0.50, "Marginal", 0.35), (0.47, "Paper", 0.25)]
#: Scores below every band that are not quarantined count as the top band, as originally defined.
BELOW = ("Gold", 0.85)


def model_quality(x, score="cv_score", std="cv_std", sector="sector", edge="prob_edge", warnings="warnings"):
    """Tier, trust within [0, 1] and notes of each model."""
    s, v = F.col(score), F.coalesce(std, F.lit(0.20))
    e = F.greatest(F.lit(0.0), s - 0.5, F.coalesce(edge, F.lit(0.0)))
    name = F.lower(F.coalesce(sector, F.lit("")))
    bad = s.isNull() | ((s < 0.47) & (e < 0.01)) | ((v > 0.45) & (s < 0.50))
    tier, trust = F.lit(None).cast("string"), F.lit(None).cast("double")
    for low, t, q in TIERS:
        tier, trust = F.coalesce(tier, F.when(s >= low, F.lit(t))), F.coalesce(trust, F.when(s >= low, F.lit(q)))
    tier, trust = F.coalesce(tier, F.lit(BELOW[0])), F.coalesce(trust, F.lit(BELOW[1]))
    trust = trust + F.when(v < 0.08, 0.05).when(v > 0.25, -0.10).otherwise(0.0) + F.when(v > 0.32, -0.10).otherwise(0.0)
    trust = F.when(e < 0.005, F.least(trust, F.lit(0.40))).when(e > 0.03, trust + 0.05).otherwise(trust)
    bank = name.contains("bank")
    cap = lambda c: F.least(trust, F.lit(c))
    trust = F.when(name.contains("hydro"), cap(0.65)).when(bank, trust + 0.05).when(name.contains("micro"), cap(0.60)).when(name.contains("investment") | name.contains("holding"), cap(0.55)).otherwise(trust)
    calibration = F.exists(F.coalesce(warnings, F.array().cast("array<string>")), lambda t: t.contains("Calibr")) & (tier == "Gold")
    trust, tier = F.when(calibration, F.least(trust, F.lit(0.85))).otherwise(trust), F.when(calibration, "Silver").otherwise(tier)
    random = e < 0.002
    notes = F.array_compact(F.array(F.when(bad, "quarantined"), F.when(~bad & random, "effectively random"), F.when(~bad & ~random & (v < 0.08), "stable across folds"), F.when(~bad & ~random & (v > 0.25), "volatile across folds"), F.when(~bad & ~random & calibration, "calibration issues")))
    return x.withColumns({
        "tier": F.when(bad, "Quarantine").when(random, "Paper").otherwise(tier),
        "trust": F.when(bad, 0.0).when(random, 0.10).otherwise(F.least(F.greatest(trust, F.lit(0.0)), F.lit(1.0))),
        "notes": notes,
    })


@query(f"""WITH g AS (SELECT p_partkey, {_pick(_SECTORS, 'p_partkey')} AS sector, 0.44 + (p_partkey % 150) / 1000.0 AS s, CASE WHEN p_partkey % 17 <> 0 THEN (p_partkey % 49) / 100.0 END AS sd, CASE WHEN p_partkey % 5 = 0 THEN 0.004 ELSE 0.0 END AS pe, p_partkey % 7 = 0 AS cal FROM part),
a AS (SELECT *, coalesce(sd, 0.2) AS v, greatest(0.0, s - 0.5, pe) AS e FROM g), b AS (SELECT *, (s < 0.47 AND e < 0.01) OR (v > 0.45 AND s < 0.5) AS bad,
    CASE WHEN s >= 0.57 THEN 'Gold' WHEN s >= 0.53 THEN 'Gold' WHEN s >= 0.515 THEN 'Silver' WHEN s >= 0.5 THEN 'Marginal' WHEN s >= 0.47 THEN 'Paper' ELSE 'Gold' END AS t0,
    (CASE WHEN s >= 0.57 THEN 0.85 WHEN s >= 0.53 THEN 0.75 WHEN s >= 0.515 THEN 0.55 WHEN s >= 0.5 THEN 0.35 WHEN s >= 0.47 THEN 0.25 ELSE 0.85 END) + (CASE WHEN v < 0.08 THEN 0.05 WHEN v > 0.25 THEN -0.1 ELSE 0 END) + (CASE WHEN v > 0.32 THEN -0.1 ELSE 0 END) AS q0 FROM a),
c AS (SELECT *, CASE WHEN e < 0.005 THEN least(q0, 0.4) WHEN e > 0.03 THEN q0 + 0.05 ELSE q0 END AS q1 FROM b),
f AS (SELECT *, CASE WHEN lower(sector) LIKE '%hydro%' THEN least(q1, 0.65) WHEN lower(sector) LIKE '%bank%' THEN q1 + 0.05 WHEN lower(sector) LIKE '%micro%' THEN least(q1, 0.6) WHEN lower(sector) LIKE '%investment%' THEN least(q1, 0.55) ELSE q1 END AS q2, cal AND t0 = 'Gold' AS down FROM c)
SELECT p_partkey, CASE WHEN bad THEN 'Quarantine' WHEN e < 0.002 THEN 'Paper' WHEN down THEN 'Silver' ELSE t0 END AS tier, round(CASE WHEN bad THEN 0.0 WHEN e < 0.002 THEN 0.1 ELSE least(greatest(CASE WHEN down THEN least(q2, 0.85) ELSE q2 END, 0.0), 1.0) END, 6)::DOUBLE AS trust FROM f""")
def model_tier(spark, sf_dir):
    """Tiers over a grid of scores, deviations, sectors and warnings."""
    k = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select("p_partkey", F.expr(_pick(_SECTORS, "p_partkey")).alias("sector"), (0.44 + (k % 150) / F.lit(1000.0)).alias("cv_score"), F.when(k % 17 != 0, (k % 49) / F.lit(100.0)).alias("cv_std"), F.when(k % 5 == 0, 0.004).otherwise(0.0).alias("prob_edge"), F.when(k % 7 == 0, F.array(F.lit("Calibration failed"))).alias("warnings"))
    return model_quality(x).select("p_partkey", "tier", _r("trust").alias("trust"))


def gated(p: str, sd: str, edge: str, trust: str):
    """A probability damped without an edge, capped near one half where scores are unstable, and neutral without trust."""
    damped = 0.5 + (F.col(p) - 0.5) * F.when(F.col(edge).isNull(), 0.5).otherwise(1.0)
    capped = F.when((F.col(sd) > 0.07) | F.col(edge).isNull() | (F.col(edge) < 0.01), F.least(F.greatest(damped, F.lit(0.48)), F.lit(0.52))).otherwise(damped)
    return F.when(F.col(trust) == 0, 0.5).otherwise(capped)


@query("""WITH g AS (SELECT p_partkey, 0.3 + (p_partkey % 400) / 1000.0 AS p, (p_partkey % 13) / 100.0 AS sd, CASE WHEN p_partkey % 3 <> 0 THEN (p_partkey % 40) / 1000.0 - 0.01 END AS e, (p_partkey % 11) / 10.0 AS trust FROM part),
a AS (SELECT *, 0.5 + (p - 0.5) * CASE WHEN e IS NULL THEN 0.5 ELSE 1.0 END AS d FROM g), b AS (SELECT *, CASE WHEN sd > 0.07 OR e IS NULL OR e < 0.01 THEN least(greatest(d, 0.48), 0.52) ELSE d END AS c FROM a)
SELECT p_partkey, round(CASE WHEN trust = 0 THEN 0.5 ELSE c END, 6)::DOUBLE AS probability FROM b""")
def prob_gating(spark, sf_dir):
    """Probabilities damped without an edge, capped near one half where scores are unstable, and neutral without trust."""
    k = F.col("p_partkey")
    x = table(spark, sf_dir, "part").select("p_partkey", (0.3 + (k % 400) / F.lit(1000.0)).alias("p"), ((k % 13) / F.lit(100.0)).alias("sd"), F.when(k % 3 != 0, (k % 40) / F.lit(1000.0) - 0.01).alias("e"), ((k % 11) / F.lit(10.0)).alias("trust"))
    return x.select("p_partkey", _r(gated("p", "sd", "e", "trust")).alias("probability"))
