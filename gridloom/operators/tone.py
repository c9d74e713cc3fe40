"""Tone enhancement of images held as pixels (image_id, y, x, r, g, b and, if any, extra bands)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from ..errors import EnhancementFailed
from ..functions import tone
from ..params import Enhance, EnhanceRegions
from .quantile import quantile

BANDS = ("r", "g", "b")


def _with_range(df: DataFrame, dtype: str) -> DataFrame:
    """With lo and hi of the image, over all its bands, for types without a fixed depth; a row for each image is joined."""
    if dtype in tone.DEPTHS:
        return df
    low, high = F.least(*map(F.min, BANDS)), F.greatest(*map(F.max, BANDS))
    if "extra" in df.columns:
        low, high = F.least(low, F.min(F.array_min("extra"))), F.greatest(high, F.max(F.array_max("extra")))
    return df.join(df.groupBy("image_id").agg(low.alias("lo"), high.alias("hi")), "image_id")


def _bands(df: DataFrame) -> None:
    if missing := [b for b in BANDS if b not in df.columns]:
        raise EnhancementFailed(f"tone operators need three bands; missing: {', '.join(missing)}")


def normalised(df: DataFrame, dtype: str = "uint8") -> DataFrame:
    _bands(df)
    to_unit = lambda c: tone.normalise(c, dtype, F.col("lo"), F.col("hi"))
    return _with_range(df, dtype).withColumns({b: to_unit(F.col(b)) for b in BANDS} | _extra(df, dtype, to_unit))


def denormalised(df: DataFrame, dtype: str = "uint8", rescale: bool = False) -> DataFrame:
    span = (F.col("lo"), F.col("hi")) if rescale and "lo" in df.columns else None
    back = lambda c: tone.denormalise(c, dtype, span)
    return df.withColumns({b: back(F.col(b)) for b in BANDS} | _extra(df, dtype, back)).drop("lo", "hi")


def _extra(df: DataFrame, dtype: str, f) -> dict:
    """The bands after the third go there and back with the others; for types with a fixed depth that changes nothing."""
    return {"extra": F.transform("extra", f)} if "extra" in df.columns and dtype not in tone.DEPTHS else {}


def enhance(df: DataFrame, p: Enhance = Enhance(), dtype: str = "uint8", rescale: bool = False) -> DataFrame:  # noqa: B008
    """Linear brightness, contrast and saturation of r, g and b; extra bands pass through."""
    rgb = tone.chain(tuple(F.col(b) for b in BANDS), p.brightness, p.contrast, p.saturation)
    return denormalised(normalised(df, dtype).withColumns(dict(zip(BANDS, rgb, strict=True))), dtype, rescale)


#: The side of a chunk that is blurred at once.
CHUNK = 128


def blurred(df: DataFrame, *cols: str) -> DataFrame:
    """A 3 x 3 binomial blur of all cols in one pass, rows first; at an edge, or by a pixel that is missing, the neighbour inside stands for that outside.

    Pixels go to the chunk that they lie in, and those on its border to its neighbours too, so there is one exchange,
    whatever the number of cols; a chunk is one array for each of them. Pixels must be unique; a null counts as missing
    and stays null.
    """
    cell = lambda c, step: F.floor((F.col(c) + step) / CHUNK).cast("int")
    near = lambda c: F.explode(F.sequence(cell(c, -1), cell(c, 1)))
    laid = df.select("*", near("y").alias("_cy")).select("*", near("x").alias("_cx"))
    side, names = CHUNK + 2, df.columns

    def along(v: np.ndarray, there: np.ndarray, axis: int) -> np.ndarray:
        """(1, 2, 1) / 4 of three places along an axis; what is missing counts as its opposite, or as the middle."""
        before, after = np.roll(v, 1, axis), np.roll(v, -1, axis)
        b, a = np.roll(there, 1, axis), np.roll(there, -1, axis)
        return (np.where(b, before, np.where(a, after, v)) + 2 * v + np.where(a, after, np.where(b, before, v))) / 4

    def run(rows: pa.Table) -> pa.Table:
        get = lambda c: rows.column(c).to_numpy(zero_copy_only=False)
        y, x = (get(c).astype(np.int64) - int(rows.column(k)[0].as_py()) * CHUNK + 1 for c, k in (("y", "_cy"), ("x", "_cx")))
        own = (y > 0) & (y <= CHUNK) & (x > 0) & (x <= CHUNK)
        out = rows.select(names)
        for c in cols:
            values = get(c).astype(float)
            plane, there = np.zeros((side, side)), np.zeros((side, side), bool)
            plane[y, x], there[y, x] = np.nan_to_num(values), ~np.isnan(values)
            soft = along(along(plane, there, 1), there, 0)[y, x]
            out = out.set_column(out.schema.get_field_index(c), c, pa.array(soft, mask=np.isnan(values)))
        return out.filter(pa.array(own))

    kinds = ", ".join(f"`{f.name}` {'double' if f.name in cols else f.dataType.simpleString()}" for f in df.schema)
    return laid.groupBy("image_id", "_cy", "_cx").applyInArrow(run, kinds)


def otsu(df: DataFrame) -> DataFrame:
    """(image_id, bin): the bin of 256 over the green leaf index that best parts the classes; of equals the least.

    df: pixels in [0, 1]. The histogram has at most 256 rows an image.
    """
    index = ((tone.gli(*map(F.col, BANDS)) + tone.lit(1)) / tone.lit(2) * tone.lit(255)).cast("int")
    hist = df.groupBy("image_id", index.alias("bin")).agg(F.count("*").cast("double").alias("n"))
    upto, all_ = Window.partitionBy("image_id").orderBy("bin"), Window.partitionBy("image_id")
    sums = hist.select("image_id", "bin", F.sum("n").over(upto).alias("n0"), F.sum(F.col("n") * F.col("bin")).over(upto).alias("s0"), F.sum("n").over(all_).alias("n"), F.sum(F.col("n") * F.col("bin")).over(all_).alias("s"))
    n1 = F.col("n") - F.col("n0")
    gap = F.col("s0") / F.col("n0") - F.when(n1 > 0, (F.col("s") - F.col("s0")) / n1).otherwise(F.col("s0") / F.col("n0"))
    return sums.select("image_id", "bin", (F.col("n0") * n1 * gap * gap).alias("between")).groupBy("image_id").agg(F.max(F.struct("between", (-F.col("bin")).alias("k"))).alias("m")).select("image_id", (-F.col("m.k")).alias("bin"))


#: Fixed values of the vegetation mask: the least index, the most coverage, the percentile beyond it.
FLOOR, COVER, PERCENTILE = 0.04, 0.45, 0.55


def vegetation(df: DataFrame) -> DataFrame:
    """(image_id, otsu, coverage, p55, threshold): what the mask of an image in [0, 1] is cut at."""
    index = df.select("image_id", tone.gli(*map(F.col, BANDS)).alias("gli"))
    cut = otsu(df).select("image_id", (F.col("bin") / tone.lit(255) * tone.lit(2) - tone.lit(1)).alias("otsu"))
    first = index.join(cut, "image_id").withColumn("t", F.greatest("otsu", tone.lit(FLOOR)))
    stats = first.groupBy("image_id", "otsu", "t").agg(F.avg((F.col("gli") > F.col("t")).cast("double")).alias("coverage")).join(quantile(index, "image_id", "gli", PERCENTILE).withColumnRenamed("q", "p55"), "image_id")
    return stats.select("image_id", "otsu", "coverage", "p55", F.when(F.col("coverage") > COVER, F.greatest("p55", tone.lit(FLOOR))).otherwise(F.col("t")).alias("threshold"))


def masks(df: DataFrame) -> DataFrame:
    """df in [0, 1] with h, s, v and the soft masks water and vegetation."""
    h, s, v = tone.to_hsv(*map(F.col, BANDS))
    hsv = df.withColumns({"h": h, "s": s, "v": v})
    cut = vegetation(df).select("image_id", "threshold")
    hard = hsv.join(cut, "image_id").withColumns({"water": tone.is_water(*map(F.col, ("r", "g", "b", "s", "v"))).cast("double"), "vegetation": (tone.gli(*map(F.col, BANDS)) > F.col("threshold")).cast("double")})
    return blurred(hard.drop("threshold"), "water", "vegetation")


def tone_v1(df: DataFrame, brightness: float, contrast: float, saturation: float) -> DataFrame:
    """Gamma and S-curve on the value, saturation on the saturation; the hue stays."""
    h, s, v = tone.to_hsv(*map(F.col, BANDS))
    hsv = df.withColumns({"h": h, "s": tone.more_saturated(s, saturation), "v": tone.s_curve(tone.gamma(v, brightness), contrast)})
    return hsv.withColumns(dict(zip(BANDS, tone.from_hsv(*map(F.col, "hsv")), strict=True))).drop(*"hsv")


def enhance_regions(df: DataFrame, p: EnhanceRegions = EnhanceRegions(), dtype: str = "uint8") -> DataFrame:  # noqa: B008
    """Water bluer, then vegetation greener, both on masks of the original, then the tone chain in hue, saturation and value."""
    out = masks(normalised(df, dtype))
    if p.water > 0:
        b, r = tone.region(F.col("b"), F.col("r"), F.col("water"), p.water, 0.5, 0.3)
        out = out.withColumns({"b": b, "r": r})
    if p.vegetation > 0:
        g, r = tone.region(F.col("g"), F.col("r"), F.col("vegetation"), p.vegetation, 0.5, 0.2)
        out = out.withColumns({"g": g, "r": r})
    out = out.drop("h", "s", "v", "water", "vegetation")
    return denormalised(tone_v1(out, p.brightness, p.contrast, p.saturation), dtype)
