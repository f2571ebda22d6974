"""Price-path simulation: a seeded kernel for each path model, and a deterministic block bootstrap in SQL terms.

Random numbers come from a counter-based generator keyed by (seed, symbol, chunk), so results depend neither on the number
of partitions nor on lost executors. Only what is asked for leaves the kernel: terminal returns, never all path points.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window, functions as F

CHUNK = 2_000
#: Paths and days of the risk job.
SIMS, DAYS = 100_000, 240
#: Days of a bootstrap block.
BLOCK = 30


def kernel(model: str, mu: float, sigma: float, days: int, sims: int, rng: np.random.Generator, *, df: float = 0.0, rho: float = 0.0, kappa: float = 0.05, jump_rate: float = 0.02, jump_mean: float = -0.03, jump_std: float = 0.05, vols: np.ndarray | None = None) -> np.ndarray:
    """Terminal log price of `sims` paths of `days` steps from 0. Models: gbm, ou, jump; df > 2: scaled t shocks; rho: AR(1) shocks."""
    x, last = np.zeros(sims), np.zeros(sims)
    for day in range(days):
        z = rng.standard_t(df, sims) * np.sqrt((df - 2) / df) if df > 2 else rng.standard_normal(sims)
        z = rho * last + np.sqrt(1 - rho * rho) * z if rho else z
        last, s = z, sigma if vols is None else vols[min(day, len(vols) - 1)]
        if model == "ou":
            x += kappa * (mu * days - x) + s * z
        else:
            x += mu - s * s / 2 + s * z
        if model == "jump":
            n = rng.poisson(jump_rate, sims)
            x += n * (jump_mean + jump_std * rng.standard_normal(sims))
    return x


def simulate(params: DataFrame, model: str = "gbm", days: int = DAYS, sims: int = SIMS, seed: int = 7, **options) -> DataFrame:
    """symbol, sim, terminal simple return, for (symbol, mu, sigma) rows. An unknown model name is a gbm."""
    kind = model if model in ("gbm", "ou", "jump") else "gbm"
    chunks = params.select("symbol", "mu", "sigma", F.explode(F.sequence(F.lit(0), F.lit((sims - 1) // CHUNK))).alias("chunk"))

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                n = min(CHUNK, sims - r.chunk * CHUNK)
                end = kernel(kind, r.mu, r.sigma, days, n, _generator(seed, r.symbol, r.chunk), **options)
                yield pd.DataFrame({"symbol": r.symbol, "sim": r.chunk * CHUNK + np.arange(n), "ret": np.expm1(end)})

    return _dealt(chunks).mapInPandas(run, "symbol string, sim long, ret double")


def growth_by_day(r: np.ndarray, days: int, sims: int, rng: np.random.Generator, block: int = BLOCK):
    """The growth of `sims` paths after each day: blocks of the history r, each from a random start."""
    block = min(block, days, len(r))
    growth, at = np.ones(sims), np.zeros(sims, int)
    for day in range(days):
        if day % block == 0:
            at = rng.integers(0, max(len(r) - block, 1), sims)
        growth = growth * (1 + r[at + day % block])
        yield growth


def _chunk_sizes(sims: int) -> list[int]:
    return [min(CHUNK, sims - at) for at in range(0, sims, CHUNK)]


def _generator(seed: int, symbol: str, chunk: int) -> np.random.Generator:
    return np.random.Generator(np.random.Philox(key=[seed, zlib.crc32(f"{symbol}/{chunk}".encode())]))


def _dealt(chunks: DataFrame) -> DataFrame:
    """Chunks over the session's shuffle partitions: adaptive execution would merge them, since their work exceeds their bytes."""
    return chunks.repartition(int(chunks.sparkSession.conf.get("spark.sql.shuffle.partitions")), "symbol", "chunk")


def _histories(returns: DataFrame) -> DataFrame:
    """symbol, hist: each symbol's returns by date. Symbols without a return are left out."""
    rows = F.array_sort(F.collect_list(F.struct("date", "r")))
    return returns.where("r IS NOT NULL").groupBy("symbol").agg(F.transform(rows, lambda x: x["r"]).alias("hist"))


def bootstrap(returns: DataFrame, days: int = DAYS, sims: int = SIMS, seed: int = 7) -> DataFrame:
    """symbol, sim, terminal return, deepest drawdown and share of days under water of block-bootstrap paths of (symbol, date, r).

    Block starts are random; a task simulates a chunk of a symbol's paths, so no path point leaves it.
    """
    last = len(_chunk_sizes(sims)) - 1
    chunks = _histories(returns).select("symbol", "hist", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("chunk"))

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                n = _chunk_sizes(sims)[r.chunk]
                top, deepest, under, growth = np.ones(n), np.zeros(n), np.zeros(n), np.ones(n)
                for growth in growth_by_day(np.asarray(r.hist, float), days, n, _generator(seed, r.symbol, r.chunk)):
                    top = np.maximum(top, growth)
                    down = growth / top - 1
                    deepest, under = np.minimum(deepest, down), under + (down < 0)
                sim = r.chunk * CHUNK + np.arange(n)
                yield pd.DataFrame({"symbol": r.symbol, "sim": sim, "ret": growth - 1, "mdd": deepest, "under": under / days})

    schema = "symbol string, sim long, ret double, mdd double, under double"
    return _dealt(chunks).mapInPandas(run, schema)


def bootstrap_fan(returns: DataFrame, percentiles: tuple[int, ...], days: int = DAYS, sims: int = SIMS, seed: int = 7) -> DataFrame:
    """symbol, day from 0 and percentiles of the growth of the paths of `bootstrap`; a symbol's task holds one day of its paths."""

    def run(batches):
        for batch in batches:
            for r in batch.itertuples():
                hist = np.asarray(r.hist, float)
                chunks = [growth_by_day(hist, days, n, _generator(seed, r.symbol, k)) for k, n in enumerate(_chunk_sizes(sims))]
                found = [np.ones(len(percentiles))]
                found += [np.percentile(np.concatenate(day), percentiles) for day in zip(*chunks)]
                names = [f"p{p}" for p in percentiles]
                out = pd.DataFrame(found, columns=names)
                yield out.assign(symbol=r.symbol, day=np.arange(len(out)))[["symbol", "day", *names]]

    schema = "symbol string, day long, " + ", ".join(f"p{p} double" for p in percentiles)
    return _histories(returns).repartition("symbol").mapInPandas(run, schema)


def bootstrap_paths(returns: DataFrame, sims: int, blocks: int, block: int = 30) -> DataFrame:
    """symbol, sim, day, growth along block-bootstrap paths of (symbol, date, r); block starts follow a fixed rule."""
    w = Window.partitionBy("symbol").orderBy("date")
    hist = returns.select("symbol", (F.row_number().over(w) - 1).alias("idx"), "r")
    size = hist.groupBy("symbol").agg(F.count("*").alias("n")).where(F.col("n") >= block)
    draw = size.select("symbol", "n", F.explode(F.sequence(F.lit(0), F.lit(sims - 1))).alias("sim")).select("*", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("b"))
    draw = draw.withColumn("start", (F.col("sim") * 7919 + F.col("b") * 104729) % (F.col("n") - block + 1))
    steps = draw.select("symbol", "sim", "b", "start", F.explode(F.sequence(F.lit(0), F.lit(block - 1))).alias("j"))
    steps = steps.select("symbol", "sim", (F.col("b") * block + F.col("j") + 1).alias("day"), (F.col("start") + F.col("j")).cast("int").alias("idx"))
    path = Window.partitionBy("symbol", "sim").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    return steps.join(hist, ["symbol", "idx"]).select("symbol", "sim", "day", F.exp(F.sum(F.log1p("r")).over(path)).alias("growth"))
