"""GeoTIFF files in and out, by many tasks each.

Files are read by the data source of sources.scan, whose partitions are parts of files, and headers by ranges. What is
written is tiled: tiles are packed where they are, find their places by the sizes before them, and are written there by
whichever task has them. The no-data value and the geographic keys go from image to image.
"""

from __future__ import annotations

import os
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from ..errors import InvalidImage
from ..params import LEAST_SIDE, OVERLAP, TILE
from . import shared
from .scan import AREA, SCHEMA as CHUNKS, Grid, Ranges, Span, listed, load
from .tiff import RPC_TAG, Tiff, geokeys_of, tile as packed_tile, tiled_layout

SCENES = "image_id string, width int, height int, band_count int, dtype string, crs string, transform array<double>, rpc array<double>, nodata string, geokeys array<int>"


def scenes(spark: SparkSession, paths: list[str] | str) -> DataFrame:
    """A row for each file: size, bands, type, reference system, transform, embedded camera model, no-data value, geographic keys as key and value by turns. Only headers are read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.string(), *(pa.int32(),) * 3, pa.string(), pa.string(), *(pa.list_(pa.float64()),) * 2, pa.string(), pa.list_(pa.int32())]
        for batch in batches:
            rows = []
            for path in batch.column("path").to_pylist():
                t = Tiff(Ranges(path))
                rows.append((path, t.width, t.height, t.bands, t.dtype.name, t.crs(), list(t.transform()), list(t.tags[RPC_TAG]) if RPC_TAG in t.tags else None, t.nodata(), [v for pair in t.geokeys() for v in pair] or None))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split(" ")[0] for f in SCENES.split(", ")])

    return listed(spark, paths).select("path").mapInArrow(run, SCENES)


def chunks(spark: SparkSession, paths: list[str] | str, size: int = 512, bands: list[int] | None = None, area: int = AREA, rows: Span = (None, None), columns: Span = (None, None)) -> DataFrame:
    """Windows of size x size, band-major; only the bands asked for, and the windows that begin within rows and columns, are read."""
    return load(spark, paths, Grid(size, size), bands, area=area, rows=rows, columns=columns)


def pixels(parts: DataFrame, names: tuple[str, ...] = ("r", "g", "b")) -> DataFrame:
    """(image_id, y, x, names) and, of images with more bands, extra, from chunks."""
    schema = "image_id string, y int, x int, " + ", ".join(f"{n} double" for n in names) + ", extra array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                a = np.frombuffer(r["data"], r["dtype"]).reshape(r["bands"], r["height"], r["width"]).astype(float)
                if len(a) < len(names):
                    raise InvalidImage(f"{r['image_id']} has {len(a)} bands, not {len(names)}")
                y, x = np.indices(a.shape[1:], np.int32)
                more = len(a) - len(names)
                extra = pa.ListArray.from_arrays(pa.array(np.arange(y.size + 1) * more, pa.int32()), pa.array(a[len(names) :].reshape(more, y.size).T.ravel()))
                cols = [pa.array([r["image_id"]] * y.size), pa.array(y.ravel() + r["row_off"], pa.int32()), pa.array(x.ravel() + r["col_off"], pa.int32()), *(pa.array(a[k].ravel()) for k in range(len(names))), extra]
                yield pa.RecordBatch.from_arrays(cols, names=["image_id", "y", "x", *names, "extra"])

    return parts.mapInArrow(run, schema)


def windows(spark: SparkSession, paths: list[str] | str, tile: int = TILE, overlap: float = OVERLAP, cover_edges: bool = False, area: int = AREA) -> DataFrame:
    """(image_id, tile_id, row_off, col_off, tile_width, tile_height, data): the windows of operators.tiles.windows(), as detectors take them.

    data is 3 x tile_height x tile_width of uint8.
    """
    from ..operators.tiles import stride

    step = stride(tile, overlap)
    read = load(spark, paths, Grid(tile, step, 0 if cover_edges else LEAST_SIDE * tile), as_shown=True, area=area)
    across = scenes(spark, paths).select("image_id", F.ceil(F.col("width") / step).alias("_n"))
    return read.join(F.broadcast(across), "image_id").select("image_id", (F.col("chunk_row") * F.col("_n") + F.col("chunk_col")).cast("int").alias("tile_id"), "row_off", "col_off", F.col("width").alias("tile_width"), F.col("height").alias("tile_height"), "data")


def assembled(px: DataFrame, info: DataFrame, names: tuple[str, ...] = ("r", "g", "b"), size: int = 512) -> DataFrame:
    """chunks() again from pixels (image_id, y, x, names and, if any, extra); info: width, height and dtype of each image.

    A group is a window, so of size x size rows at most; places without a pixel are 0.
    """
    extra = "extra" in px.columns
    cell = lambda c: F.floor(F.col(c) / size).cast("int")
    placed = px.select("image_id", cell("y").alias("chunk_row"), cell("x").alias("chunk_col"), "y", "x", *names, *(["extra"] if extra else []))
    placed = placed.join(info.select("image_id", F.col("width").alias("_w"), F.col("height").alias("_h"), F.col("dtype").alias("_t")), "image_id")

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        i, j = int(first["chunk_row"]) * size, int(first["chunk_col"]) * size
        h, w = min(size, int(first["_h"]) - i), min(size, int(first["_w"]) - j)
        more = np.stack(pdf["extra"].to_numpy()) if extra else np.empty((len(pdf), 0))
        out = np.zeros((len(names) + more.shape[1], h, w), first["_t"])
        y, x = pdf["y"].to_numpy() - i, pdf["x"].to_numpy() - j
        for k, n in enumerate(names):
            out[k, y, x] = pdf[n].to_numpy()
        for k in range(more.shape[1]):
            out[len(names) + k, y, x] = more[:, k]
        row = (first["image_id"], int(first["chunk_row"]), int(first["chunk_col"]), i, j, w, h, first["_t"], len(out), out.tobytes())
        return pd.DataFrame([row], columns=[f.split(" ")[0] for f in CHUNKS.split(", ")])

    return placed.groupBy("image_id", "chunk_row", "chunk_col").applyInPandas(run, CHUNKS)


# Tiled files. A table of tiles has (image_id, k, n, data): the number of the tile in its image, its packed bytes.

#: Tiles whose sizes are added up at a time.
RUN = 1024


def packed(parts: DataFrame, info: DataFrame, side: int, compress: str | None = "lzw") -> DataFrame:
    """The tiles of chunks that lie on a grid of side x side, packed where the chunks are."""
    placed = parts.join(info.select("image_id", F.ceil(F.col("width") / side).cast("long").alias("_n")), "image_id")
    placed = placed.withColumn("k", F.floor(F.col("row_off") / side) * F.col("_n") + F.floor(F.col("col_off") / side))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):  # a tile at a time: they may be large
                r = batch.slice(i, 1).to_pylist()[0]
                out = packed_tile(np.frombuffer(r["data"], r["dtype"]).reshape(r["bands"], r["height"], r["width"]), side, compress)
                yield _tile(r["image_id"], r["k"], out)

    return placed.select("image_id", "k", "height", "width", "dtype", "bands", "data").mapInArrow(run, TILES)


def missing(tiles: DataFrame, info: DataFrame, side: int, compress: str | None = "lzw") -> DataFrame:
    """Tiles of zeros where an image has none; only numbers of tiles are exchanged to find them."""
    count = F.ceil(F.col("width") / side) * F.ceil(F.col("height") / side)
    every = info.select("image_id", "dtype", "band_count", F.explode(F.sequence(F.lit(0).cast("long"), count - 1)).alias("k"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                yield _tile(r["image_id"], r["k"], packed_tile(np.zeros((r["band_count"], side, side), r["dtype"]), side, compress))

    return every.join(tiles.select("image_id", "k"), ["image_id", "k"], "left_anti").mapInArrow(run, TILES)


TILES = "image_id string, k bigint, n bigint, data binary"


def _tile(image_id: str, k: int, data: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([image_id]), pa.array([k], pa.int64()), pa.array([len(data)], pa.int64()), pa.array([data], pa.binary())], names=["image_id", "k", "n", "data"])


def ahead(tiles: DataFrame, run: int = RUN) -> DataFrame:
    """(image_id, k, n, at): the bytes before each tile. Runs of tiles are added up first, and runs of their sums, so that no window holds more than a run."""
    level = [tiles.select("image_id", "k", "n")]
    top = level[0].agg(F.max("k")).first()[0] or 0
    while top > 0:  # a thousand runs of a thousand tiles each are an image of a million tiles
        level.append(level[-1].groupBy("image_id", F.floor(F.col("k") / run).alias("k")).agg(F.sum("n").alias("n")))
        top //= run
    placed = level[-1].withColumn("at", F.lit(0).cast("long"))
    before = Window.partitionBy("image_id", "_run").orderBy("k").rowsBetween(Window.unboundedPreceding, -1)
    for rows in reversed(level[:-1]):
        base = placed.select("image_id", F.col("k").alias("_run"), F.col("at").alias("_base"))
        own = rows.withColumn("_run", F.floor(F.col("k") / run)).join(base, ["image_id", "_run"])
        placed = own.select("image_id", "k", "n", (F.col("_base") + F.coalesce(F.sum("n").over(before), F.lit(0))).alias("at"))
    return placed


JOBS = "image_id string, target string, part string, here boolean, start bigint, offsets bigint, counts bigint, big boolean, opening binary, directory binary, dir_at bigint"


def layouts(info: DataFrame, places: DataFrame, folder: str, side: int, compress: str | None, big: bool | None, append: bool = False) -> DataFrame:
    """A row for each file: its name, the one it has until it is whole, where its parts lie, and the bytes around the tiles."""
    name = F.col("name") if "name" in info.columns else F.substring_index("image_id", "/", -1)
    keys = F.col("geokeys") if "geokeys" in info.columns else F.lit(None).cast("array<int>")
    sizes = places.groupBy("image_id").agg(F.sum("n").alias("total"))
    rows = info.join(sizes, "image_id").select("image_id", F.concat(F.lit(folder.rstrip("/") + "/"), name).alias("target"), "width", "height", "dtype", "band_count", "crs", "transform", "nodata", keys.alias("geokeys"), "total")
    token = uuid.uuid4().hex

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                own = r["geokeys"]
                geo = list(zip(own[::2], own[1::2], strict=True)) if own else geokeys_of(r["crs"])
                opening, start, offsets, counts, directory, is_big = tiled_layout(r["band_count"], r["height"], r["width"], np.dtype(r["dtype"]), side, r["total"], tuple(r["transform"]), compress, r["nodata"], geo, big)
                here = not append and isinstance(pa.fs.FileSystem.from_uri(r["target"])[0], pa.fs.LocalFileSystem)
                out.append((r["image_id"], r["target"], f"{r['target']}.{token}.part", here, start, offsets, counts, is_big, opening, directory, struct.unpack("<Q" if is_big else "<I", opening[-8:] if is_big else opening[-4:])[0]))
            kinds = (*(pa.string(),) * 3, pa.bool_(), *(pa.int64(),) * 3, pa.bool_(), pa.binary(), pa.binary(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], kind) for k, kind in enumerate(kinds)], names=[f.split(" ")[0] for f in JOBS.split(", ")])

    return rows.mapInArrow(run, JOBS)


def _put(path: str, *pieces: tuple[int, bytes]) -> None:
    """Bytes at their places in a file that others write to as well."""
    fd = os.open(path, os.O_WRONLY | os.O_CREAT, 0o644)
    try:
        for at, data in pieces:
            while data:
                n = os.pwrite(fd, data, at)
                at, data = at + n, data[n:]
    finally:
        os.close(fd)


def _local(uri: str) -> str:
    return pa.fs.FileSystem.from_uri(uri)[1]


def _begun(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in batch.to_pylist():
            path = _local(r["part"])
            os.makedirs(os.path.dirname(path), exist_ok=True)
            _put(path, (0, r["opening"]), (r["dir_at"], r["directory"]))
        yield pa.RecordBatch.from_arrays([batch.column("target")], names=["target"])


def _placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            word = "<Q" if r["big"] else "<I"
            size, at = struct.calcsize(word), r["start"] + r["at"]
            _put(_local(r["part"]), (at, r["data"]), (r["offsets"] + size * r["k"], struct.pack(word, at)), (r["counts"] + size * r["k"], struct.pack(word, r["n"])))
        yield pa.RecordBatch.from_arrays([batch.column("n")], names=["n"])


def _streamed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Files whose tiles come in order, one after the other, for stores that only append."""
    job, f, at, sizes = None, None, 0, []

    def close() -> None:
        word = "Q" if job["big"] else "I"
        starts = np.concatenate([[0], np.cumsum(sizes)[:-1]]) + job["start"]
        lists = struct.pack(f"<{len(sizes)}{word}", *starts.astype(int).tolist()) + struct.pack(f"<{len(sizes)}{word}", *sizes)
        f.write(b"\0" * (job["offsets"] - at) + lists)
        f.write(b"\0" * (job["dir_at"] - job["offsets"] - len(lists)) + job["directory"])
        f.close()

    for batch in batches:
        for i in range(batch.num_rows):
            r = batch.slice(i, 1).to_pylist()[0]
            if job is None or r["image_id"] != job["image_id"]:
                if f:
                    close()
                store, path = pa.fs.FileSystem.from_uri(r["part"])
                store.create_dir(path.rsplit("/", 1)[0], recursive=True)
                job, f, at, sizes = r, store.open_output_stream(path), r["start"], []
                f.write(r["opening"])
            f.write(r["data"])
            at += r["n"]
            sizes.append(r["n"])
        yield pa.RecordBatch.from_arrays([batch.column("n")], names=["n"])
    if f:
        close()


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Whole files get their names; one that a lost task has named already is left."""
    for batch in batches:
        for r in batch.to_pylist():
            store, part = pa.fs.FileSystem.from_uri(r["part"])
            if store.get_file_info(part).type != pa.fs.FileType.NotFound:
                store.move(part, pa.fs.FileSystem.from_uri(r["target"])[1])
        yield pa.RecordBatch.from_arrays([batch.column("target")], names=["target"])


def written(parts: DataFrame, info: DataFrame, folder: str, side: int = 512, compress: str | None = "lzw", big: bool | None = None, append: bool = False) -> list[str]:
    """Write each image as a tiled GeoTIFF; the paths. parts: its chunks of side x side, a multiple of 16; info: scenes, with a name for the file if it isn't the image's.

    Packed tiles are written to the shared folder once, so a lost task packs its own again only; sums of their sizes
    give every tile its place. On a file system with random access each task writes its tiles, and their entries in the
    two lists of tiles, at their places in a file that has no name yet: what is run again writes the same bytes. On
    other stores a task streams each file's tiles in order. compress: lzw, deflate or None; big: places of 64 bits, by
    size if not said; append: take any store for one that only appends.
    """
    if side % 16:
        raise InvalidImage(f"sides of tiles are multiples of 16, not {side}")
    own = shared.saved(packed(parts, info, side, compress), "tiles")
    rest = shared.saved(missing(own, info, side, compress), "tiles-of-zeros")
    tiles = own.unionByName(rest)
    places = shared.saved(ahead(tiles), "places")
    jobs = shared.saved(layouts(info, places, folder, side, compress, big, append), "files")
    here, there = jobs.where("here"), jobs.where("not here")
    placed = tiles.join(places.select("image_id", "k", "at"), ["image_id", "k"])
    here.mapInArrow(_begun, "target string").count()
    placed.join(here.drop("opening", "directory"), "image_id").mapInArrow(_placed, "n bigint").count()
    if not there.isEmpty():
        placed.join(there, "image_id").repartition("image_id").sortWithinPartitions("image_id", "k").mapInArrow(_streamed, "n bigint").count()
    out = sorted(r.target for r in jobs.mapInArrow(_named, "target string").collect())  # a name for each file
    for table in (own, rest, places, jobs):
        shared.drop(table)
    return out
