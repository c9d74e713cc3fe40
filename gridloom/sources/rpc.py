"""Camera models from text files and from tags."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..errors import OrthoFailed
from . import shared

#: The fields of a model.
SCALARS = ("HEIGHT_OFF", "HEIGHT_SCALE", "LAT_OFF", "LAT_SCALE", "LONG_OFF", "LONG_SCALE", "LINE_OFF", "LINE_SCALE", "SAMP_OFF", "SAMP_SCALE")
VECTORS = ("LINE_NUM_COEFF", "LINE_DEN_COEFF", "SAMP_NUM_COEFF", "SAMP_DEN_COEFF")


def pairs(lines: DataFrame) -> DataFrame:
    """(image_id, key, value) from lines (image_id, n, line): KEY: value or KEY = value; the last of a key counts."""
    text = F.trim("line")
    cut = F.when(F.contains(text, F.lit(":")), ":").when(F.contains(text, F.lit("=")), "=")
    at = F.when(cut == ":", F.instr(text, ":")).otherwise(F.instr(text, "="))
    rows = lines.where((text != "") & ~text.startswith("#") & ~text.startswith(";")).select("image_id", "n", text.alias("t"), at.alias("at")).where("at > 0")
    split = rows.select("image_id", "n", F.upper(F.trim(F.expr("substring(t, 1, at - 1)"))).alias("key"), F.trim(F.expr("substring(t, at + 1)")).alias("value"))
    return split.groupBy("image_id", "key").agg(F.max_by("value", "n").alias("value"))


def models(found: DataFrame) -> DataFrame:
    """A row for each image from pairs(): ten doubles, four arrays of twenty. A missing or odd value is null here."""
    keys = [*SCALARS, *(f"{v}_{i}" for v in VECTORS for i in range(1, 21))]
    # Keys are numbered, and an image's numbers are one array in that order, which is worked out once.
    number = F.array_position(F.array(*map(F.lit, keys)), F.col("key"))
    numbers = found.where(F.col("key").isin(keys)).select("image_id", number.cast("int").alias("k"), F.expr("try_cast(value as double)").alias("v"))
    wide = numbers.groupBy("image_id").agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias("m"))
    all_ = wide.select("image_id", F.transform(F.sequence(F.lit(1), F.lit(len(keys))), lambda k: F.try_element_at("m", k)).alias("all"))
    vector = [F.slice("all", len(SCALARS) + 20 * j + 1, 20).alias(v.lower()) for j, v in enumerate(VECTORS)]
    return all_.select("image_id", *(F.col("all")[k].alias(s.lower()) for k, s in enumerate(SCALARS)), *vector)


def checked(rows: DataFrame) -> DataFrame:
    """The models, worked out once, or an error that names a field that one lacks."""
    rows = shared.saved(rows, "models")
    gaps = F.array_compact(F.array(*(F.when(F.col(k.lower()).isNull(), k) for k in SCALARS), *(F.when(F.exists(v.lower(), lambda x: x.isNull()) | (F.size(v.lower()) != 20), v) for v in VECTORS)))
    if bad := rows.select("image_id", gaps.alias("gaps")).where("size(gaps) > 0").first():
        raise OrthoFailed(f"{bad.image_id}: the camera model lacks {', '.join(bad.gaps)}")
    return rows


def read(spark: SparkSession, paths: list[str]) -> DataFrame:
    files = spark.read.option("wholetext", "true").text(paths).select(F.input_file_name().alias("image_id"), F.posexplode(F.split("value", "\r?\n")).alias("n", "line"))
    return checked(models(pairs(files)))


def vector(text: Column) -> Column:
    """The numbers of a tag, between white space."""
    return F.transform(F.split(F.trim(text), r"\s+"), lambda x: x.cast("double"))


def from_array(scenes: DataFrame) -> DataFrame:
    """scenes (image_id, rpc), rpc as GeoTIFF's tag for it holds 92 numbers: two errors, five offsets, five scales, four vectors."""
    order = ("LINE", "SAMP", "LAT", "LONG", "HEIGHT")
    at = {f"{k}_{what}": 2 + 5 * j + i for j, what in enumerate(("OFF", "SCALE")) for i, k in enumerate(order)}
    rows = scenes.where(F.size("rpc") >= 92)
    return checked(rows.select("image_id", *(F.col("rpc")[at[k]].alias(k.lower()) for k in SCALARS), *(F.slice("rpc", 13 + 20 * j, 20).alias(v.lower()) for j, v in enumerate(VECTORS))))


def from_tags(tags: DataFrame) -> DataFrame:
    """tags (image_id, tags map<string, string>), keys as in text files, each vector in one."""
    scalar = [F.element_at("tags", k).cast("double").alias(k.lower()) for k in SCALARS]
    return checked(tags.select("image_id", *scalar, *(vector(F.element_at("tags", v)).alias(v.lower()) for v in VECTORS)))
