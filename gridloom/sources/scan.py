"""A data source of GeoTIFF windows: many tasks to a file, and no more of it read than they show.

A partition is one or more areas of whole windows, of about AREA unpacked bytes together. Planning reads headers by
ranges, many files at a time; a task reads the header and the strips or tiles of its own areas, each once, as parts that
windows share are kept. Which bands, and which rows and columns windows may begin at, are options, so nothing else is read. They
are no pushed conditions, as Spark 4.1 keeps what was pushed into a Python source for every other scan of the same frame:
the frame and a part of it in one union lose rows. A strip or tile is the least that can be unpacked, so a file of one
compressed strip stays one task's.

Files are opened through pyarrow, so they lie where it can read: local and shared file systems, HDFS, S3, GCS.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .tiff import Tiff

SCHEMA = "image_id string, chunk_row int, chunk_col int, row_off int, col_off int, width int, height int, dtype string, bands int, data binary"
#: Unpacked bytes of a partition, about; bytes fetched with a header; headers read at a time.
AREA, HEADER, AT_ONCE = 64 << 20, 1 << 16, 32
#: From and to, the latter excluded; None is the image's own.
Span = tuple[int | None, int | None]


class Ranges:
    """Slices of a file, read as they are asked for; the first HEADER bytes at once."""

    def __init__(self, uri: str):
        store, path = pa.fs.FileSystem.from_uri(uri)
        self.file = store.open_input_file(path)
        self.size, self.read = self.file.size(), 0
        self.head = self._fetched(0, min(HEADER, self.size))

    def _fetched(self, at: int, n: int) -> bytes:
        self.read += n
        return self.file.read_at(n, at)

    def __len__(self) -> int:
        return self.size

    def __getitem__(self, part: slice) -> bytes:
        start, stop, _ = part.indices(self.size)
        return self.head[start:stop] if stop <= len(self.head) else self._fetched(start, max(0, stop - start))


@lru_cache(maxsize=4)
def opened(uri: str, size: int, changed: int) -> Tiff:
    """A file, kept open in a worker while it goes from area to area; one that was written anew is another."""
    return Tiff(Ranges(uri))


@dataclass(frozen=True)
class Grid:
    """Windows of size x size at every step, cut at the image's edges; those with a side under least are left out."""

    size: int
    step: int
    least: float = 0.0

    def along(self, n: int) -> list[tuple[int, int]]:
        return [(at, min(self.size, n - at)) for at in range(0, n, self.step)]


@dataclass(frozen=True)
class Header:
    path: str
    length: int
    changed: int
    width: int
    height: int
    pixel: int
    block_height: int
    tiled: bool


@dataclass
class Areas(InputPartition):
    """(path, length, changed, windows' rows from and to, columns from and to), of one or more files."""

    areas: list[tuple] = field(default_factory=list)


class Windows(DataSourceReader):
    def __init__(self, options: dict):
        self.files = json.loads(options["files"])
        self.grid = Grid(int(options["size"]), int(options["step"]), float(options.get("least", 0)))
        self.bands = json.loads(options["bands"]) if "bands" in options else None
        self.shown = options.get("shown") == "true"
        self.area = int(options.get("area", AREA))
        self.rows, self.columns = json.loads(options["rows"]), json.loads(options["columns"])

    def _spans(self, n: int, span: Span) -> list[int]:
        """Numbers of the wanted windows along an axis."""
        low, high = span[0] or 0, n if span[1] is None else span[1]
        return [k for k, (at, m) in enumerate(self.grid.along(n)) if m >= self.grid.least and low <= at < high]

    def _header(self, file: list) -> Header:
        path, length, changed = file
        t = Tiff(Ranges(path))
        return Header(path, length, changed, t.width, t.height, t.dtype.itemsize * (t.bands if self.bands is None else len(self.bands)), t.block[0], t.tiled)

    def partitions(self) -> list[Areas]:
        out, held = [], 0
        with ThreadPoolExecutor(AT_ONCE) as pool:
            for h in pool.map(self._header, self.files):
                for area, weight in self._areas(h):
                    if not out or held + weight > self.area:
                        out.append(Areas([]))
                        held = 0
                    out[-1].areas.append(area)
                    held += weight
        return out or [Areas([])]

    def _areas(self, h: Header) -> Iterator[tuple[tuple, int]]:
        """The areas of a file, and what each weighs: rows of windows, and of tiled files that are wide parts of them."""
        down, across = self._spans(h.height, self.rows), self._spans(h.width, self.columns)
        if not down or not across:
            return
        step = self.grid.step
        weigh = lambda columns: (min((columns[-1] + 1) * step, h.width) - columns[0] * step) * step * h.pixel  # noqa: E731  of a row of windows
        wide = max(1, self.area // (step * step * h.pixel)) if h.tiled and weigh(across) > self.area else len(across)
        for c in range(0, len(across), wide):
            columns = across[c : c + wide]
            row = weigh(columns)
            high = max(1, self.area // max(1, row), -(-h.block_height // step))
            for r in range(0, len(down), high):
                rows = down[r : r + high]
                yield (h.path, h.length, h.changed, rows, columns), row * len(rows)

    def read(self, partition: Areas) -> Iterator[pa.RecordBatch]:
        for path, length, changed, rows, columns in partition.areas:
            t = opened(path, length, changed)
            bands = self.bands if self.bands is not None else list(range(min(3, t.bands) if self.shown else t.bands))
            down, across = self.grid.along(t.height), self.grid.along(t.width)
            for r in rows:
                for c in columns:
                    (i, h), (j, w) = down[r], across[c]
                    a = t.read(i, j, h, w, bands)
                    a = shown(a) if self.shown else a
                    yield batch([(path, r, c, i, j, w, h, a.dtype.name, len(a), a.tobytes())])


def batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.string(), *(pa.int32(),) * 6, pa.string(), pa.int32(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=[f.split(" ")[0] for f in SCHEMA.split(", ")])


def shown(a: np.ndarray) -> np.ndarray:
    """Three bands of 8 bits from one, two or three: one stands for all, a third is empty; other types are stretched."""
    if len(a) < 3:
        a = np.concatenate([a, np.zeros_like(a[:1])]) if len(a) == 2 else np.repeat(a, 3, axis=0)
    if a.dtype == np.uint8:
        return a
    if a.dtype == np.uint16:
        return (a >> 8).astype(np.uint8)
    low, high = float(a.min()), float(a.max())
    return ((a.astype(float) - low) / (high - low) * 255).astype(np.uint8) if high > low else np.zeros(a.shape, np.uint8)


class GeoTiff(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gridloom-geotiff"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> Windows:
        return Windows(dict(self.options))


def listed(spark: SparkSession, paths: list[str] | str):
    """(path, length, modificationTime) of the files; contents are not read."""
    return spark.read.format("binaryFile").load(paths).select("path", "length", "modificationTime")


def load(spark: SparkSession, paths: list[str] | str, grid: Grid, bands: list[int] | None = None, as_shown: bool = False, area: int = AREA, rows: Span = (None, None), columns: Span = (None, None)):
    """The windows of files that begin within rows and columns. The driver holds the list of files and of areas, not their contents."""
    spark.dataSource.register(GeoTiff)
    files = [[r.path, r.length, int(r.modificationTime.timestamp())] for r in listed(spark, paths).collect()]
    options = {"files": json.dumps(sorted(files)), "size": str(grid.size), "step": str(grid.step), "least": str(grid.least), "shown": str(as_shown).lower(), "area": str(area), "rows": json.dumps(rows), "columns": json.dumps(columns)}
    if bands is not None:
        options["bands"] = json.dumps(bands)
    return spark.read.format(GeoTiff.name()).options(**options).load()
