"""Statistics of values, of codes, and of a reconstruction against its original."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def extrema(df: DataFrame, value: str) -> DataFrame:
    """min, max, avg, range and population deviation in one pass."""
    c = F.col(value)
    return df.agg(F.min(c).alias("min"), F.max(c).alias("max"), F.avg(c).alias("avg"), (F.max(c) - F.min(c)).alias("rng"), F.stddev_pop(c).alias("std"))


def assess(df: DataFrame, original: str, restored: str, idx: str) -> DataFrame:
    """Quality of a reconstruction: one row, one pass.

    psnr is 20 log10(range) - 10 log10(mse); nrmse is the root of mse over the
    range; the place of the largest error is the first one.
    """
    o, r = F.col(original), F.col(restored)
    err = F.abs(o - r)
    mse, rng = F.avg((o - r) * (o - r)), F.max(o) - F.min(o)
    return df.agg(
        F.count("*").alias("n"),
        F.min(o).alias("min_original"),
        F.max(o).alias("max_original"),
        F.max(r).alias("max_restored"),
        F.stddev_pop(o).alias("std_original"),
        F.stddev_pop(r).alias("std_restored"),
        mse.alias("mse"),
        F.when(mse > 0, 20 * F.log10(rng) - 10 * F.log10(mse)).alias("psnr"),
        F.when(rng > 0, F.sqrt(mse) / rng).alias("nrmse"),
        F.corr(o, r).alias("coeff"),
        F.max(err).alias("max_abs_err"),
        F.when(rng > 0, F.max(err) / rng).alias("max_rel_err"),
        F.max(F.when(o != 0, err / F.abs(o))).alias("max_pw_rel_err"),
        (-F.max(F.struct(err.alias("e"), (-F.col(idx)).alias("i")))["i"]).alias("max_err_idx"),
    )


def max_error(df: DataFrame, a: str, b: str, idx: str) -> DataFrame:
    """The largest absolute difference and the first index that has it."""
    m = F.max(F.struct(F.abs(F.col(a) - F.col(b)).alias("e"), (-F.col(idx)).alias("i")))
    return df.agg(m.alias("m")).select(F.col("m.e").alias("max_err"), (-F.col("m.i")).alias("idx"))


def error_bounded(df: DataFrame, a: str, b: str, eb: float, idx: str) -> DataFrame:
    """Whether all differences are within 1.001 * eb, and the first index where one is not."""
    bad = F.abs(F.col(a) - F.col(b)) > 1.001 * eb
    return df.agg((~F.max(bad)).alias("bounded"), F.min(F.when(bad, F.col(idx))).alias("first_bad"))


def identical(df: DataFrame, a: str, b: str) -> DataFrame:
    same = F.col(a).eqNullSafe(F.col(b))
    return df.agg(F.min(same).alias("identical"), F.count_if(~same).alias("n_different"))


def autocorrelation(df: DataFrame, key: str, value: str, lags: tuple[int, ...] = (1, 2), block: int = 1 << 16) -> DataFrame:
    """Correlation of a column, numbered from 0 by key, with itself shifted.

    The shift is a window inside blocks of keys; rows that the block before needs are in both.
    """
    rows = df.select(F.col(key).alias("k"), F.col(value).alias("v"))
    # block windows see the next rows through rows repeated at the block's end
    edge = F.floor(F.col("k") / block)
    both = rows.withColumn("b", F.explode(F.array_distinct(F.array(edge, F.floor((F.col("k") - max(lags)) / block)))))
    w = Window.partitionBy("b").orderBy("k")
    seen = both.withColumns({f"v{n}": F.lead("v", n).over(w) for n in lags}).where(F.floor(F.col("k") / block) == F.col("b"))
    return seen.agg(*[F.corr(F.when(F.col(f"v{n}").isNotNull(), F.col("v")), F.col(f"v{n}")).alias(f"lag{n}") for n in lags])


def entropy(counts: DataFrame, n: str = "n") -> DataFrame:
    """Bits per symbol of grouped counts: log2(N) - sum(n log2 n) / N, in one pass."""
    c = F.col(n).cast("double")
    return counts.where(c > 0).agg((F.log2(F.sum(c)) - F.sum(c * F.log2(c)) / F.sum(c)).alias("entropy"))


def equal_width(df: DataFrame, value: str, bins: int, lo: float, hi: float, log2: bool = False, drop_zeros: bool = False) -> DataFrame:
    """(bin, n): counts by equal-width bins of [lo, hi], which may be a part of the values' range; the upper end belongs to the last bin.

    log2 adds the whole part of the binary logarithm of each count; drop_zeros leaves zero values out.
    """
    step = (hi - lo) / bins
    at = F.least(F.floor((F.col(value) - lo) / step), F.lit(bins - 1))
    keep = F.col(value).between(lo, hi)
    out = df.where(keep & (F.col(value) != 0) if drop_zeros else keep).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))
    return out.withColumn("log2_n", F.floor(F.log2("n"))) if log2 else out


def huffman_estimate(hist: DataFrame, book: DataFrame, width: int = 32) -> DataFrame:
    """Entropy, coded bits and the ratio to `width`-bit symbols."""
    rows = hist.where("n > 0").join(F.broadcast(book.select("symbol", "length")), "symbol")  # a book is small
    n, bits = F.sum("n"), F.sum(F.col("n") * F.col("length"))
    return rows.agg(n.alias("n"), bits.alias("bits"), (width * n / bits).alias("ratio"))


def code_check(df: DataFrame, code: str, bins: int) -> DataFrame:
    """Data-quality counts: codes out of range, zero codes, and whether there are any codes."""
    c = F.col(code)
    return df.agg(F.count_if((c < 0) | (c >= bins)).alias("out_of_range"), F.count_if(c == 0).alias("zeros"), (F.count(c) > 0).alias("any"))


def ratios(original: Column, compressed: Column, seconds: Column | None = None) -> dict[str, Column]:
    """Compression ratio, bits per 32-bit value, and GiB per second."""
    ratio = original / compressed
    out = {"ratio": ratio, "bitrate": 32 / ratio}
    if seconds is not None:
        out["gib_per_s"] = original / F.lit(float(1 << 30)) / seconds
    return out
