"""Features of a macro series at bar dates; which blocks a series gets follows from its label."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, functions as F

from tapeloom.functions import scans, windows as w
from tapeloom.sources.bars import by_symbol

# Words in a label that ask for a block.
FX = ("fx", "usd", "forex", "currency", "exchange")
REMITTANCE = ("remit", "inflow", "foreign", "remittance")
RAIN = ("rain", "rainfall", "precip", "hydro", "monsoon")
INFLATION = ("inflation", "cpi")
BANK = ("remit", "liquidity", "rate")
BANK_SECTORS = ("Commercial Banks", "Development Banks")
HYDRO_SECTORS = ("Hydropower",)


def _zero(x):
    return F.coalesce(x, F.lit(0.0))


def at_dates(bars: DataFrame, series: DataFrame) -> DataFrame:
    """bars with m: the value of exactly the bar's date, gaps filled forward by symbol. Values of other dates are not seen."""
    joined = bars.join(series.select("date", F.col("value").alias("raw")), "date", "left")
    return by_symbol(joined).withColumn("m", w.ffill("raw")).drop("raw")


def block(x: DataFrame, label: str, sector: str | None = None, beta: str | None = None, by: str | None = None) -> tuple[DataFrame, list[str]]:
    """x (symbol, date, close, m) with the label's feature columns, and their names; what is missing counts 0.

    `beta` names a column of the symbol's beta to its sector. `sector` asks for what banks and hydropower get besides; `by` names
    a column of sectors instead, and rows of other sectors have NULL there.
    """
    has = lambda keys: any(k in label.lower() for k in keys)

    def of(sectors: tuple[str, ...], value):
        return value if by is None else F.when(F.col(by).isin(*sectors), value)

    x = x.withColumns({"ar": _zero(w.change("close")), "mr": _zero(w.change("m"))})
    x = scans.slide(x, 126, pairs=(("ar", "mr"),))
    x = x.withColumns({"beta": _zero(scans.beta_of("ar_mr_126", 126)), "corr": _zero(scans.corr_of("ar_mr_126", 126)), "link": F.col("ar") * F.col("mr"), "gap": F.col("ar") - F.col("mr")}).drop("ar_mr_126")
    z = {"z": ("m", 252), "beta_z": ("beta", 126), "corr_z": ("corr", 126), "spread_z": ("gap", 126)}
    x = scans.slide(x, 60, ("mr", "ar"))
    sharpe = lambda v: _zero(scans.mean_of(f"{v}_60", 60) / F.nullif(scans.std_of(f"{v}_60", 60), F.lit(0.0)) * math.sqrt(252))
    made = {"return_5d": _zero(w.change("m", 5)), "return_20d": _zero(w.change("m", 20)), "asset_interaction": F.col("link"), "momentum": sharpe("mr")}
    if beta:
        x = x.withColumn("pull", _zero(F.col(beta)) * F.col("mr"))
        made["sector_beta_interaction"] = F.col("pull")
        if has(INFLATION):
            z["inflation_sensitivity_z"] = ("pull", 126)
    if has(INFLATION):
        x = scans.slide(x, 126, ("link",)).withColumn("carry", scans.mean_of("link_126", 126)).drop("link_126")
        z["inflation_carry_z"] = ("carry", 126)
    if has(FX):
        x = x.withColumn("slow", _zero(w.mean("mr", 30) - w.mean("mr", 5)))
        z |= {"fx_shock": ("mr", 60), "fx_carry": ("slow", 126)}
    if has(REMITTANCE):
        x = x.withColumn("m90", w.mean("m", 90)).withColumn("trend", _zero(w.change("m90")))
        x = scans.slide(x, 60, pairs=(("ar", "trend"),)).withColumn("tie", scans.corr_of("ar_trend_60", 60)).drop("ar_trend_60")
        z |= {"remit_trend_z": ("trend", 126), "asset_link": ("tie", 126)}
    if has(RAIN):
        x = scans.slide(x, 252, ("m",), extremes=True).withColumn("dev", _zero(F.col("m") - scans.mean_of("m_252", 252)))
        z["hydro_stress_z"] = ("dev", 252)
        if by or sector in HYDRO_SECTORS:
            full = F.col("m_252.n") >= 252
            low, high = F.when(full, F.col("m_252.l_x")), F.when(full, F.col("m_252.g_x"))
            made["hydro_interaction"] = of(HYDRO_SECTORS, sharpe("ar") * F.coalesce((F.col("m") - low) / (high - low + 1e-6), F.lit(0.5)))
    x = x.withColumns({f"macro_{k}": v for k, v in made.items()}).drop("mr_60", "ar_60", "m_252")
    if has(BANK) and (by or sector in BANK_SECTORS):
        x = scans.zscores(x, {"_bank": ("m", 126)})
        risk = w.clamp(w.ratio(w.std("ar", 20), w.std("ar", 120)), 0.5, 2.0)
        x = x.withColumn("macro_bank_interaction", of(BANK_SECTORS, _zero(F.col("_bank") / risk))).drop("_bank")
        made["bank_interaction"] = None
    x = scans.zscores(x, {f"macro_{k}": v for k, v in z.items()})
    return x, [f"macro_{k}" for k in (*made, *z)]
