"""Rasters: discovery of files by name, TIFF reading by windows, writing by strips, cubes of pixels and days.

``GeoTiffSource`` is a data source: ``spark.read.format("terra_tiff").load(path)`` gives (path, pixel_id, value), one
partition for some hundred rows of a file. Files are opened by the tasks, on any file system that pyarrow reads.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual

UNITS, SIGNS = {"mm": 1.0, "cm": 10.0, "m": 1000.0}, {"uplift": 1.0, "subsidence": -1.0}
#: The sample format tag of each kind of sample that is written.
TYPES_OF = {"u1": 1, "u2": 1, "f4": 3}


def unit_factor(unit: str, positive: str = "uplift") -> float:
    """What turns a value into millimetres, positive up."""
    if unit not in UNITS or positive not in SIGNS:
        raise ValueError(f"unknown unit or sign: {unit}, {positive}")
    return UNITS[unit] * SIGNS[positive]


def discover(spark: SparkSession, path: str, pattern: str = "*.tif", name: str = r"(\d{8})_(\d{8})\.tif$") -> DataFrame:
    """path, reference_date and date of the files whose name matches, by date; an error without any."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path")
    dated = files.select("path", F.to_date(F.regexp_extract("path", name, 1), "yyyyMMdd").alias("reference_date"), F.to_date(F.regexp_extract("path", name, 2), "yyyyMMdd").alias("date")) if name else files
    found = dated.where(F.regexp_extract("path", name, 1) != "").orderBy("date")
    if found.isEmpty():
        raise FileNotFoundError(f"no file in {path} matches {name}")
    return found


def check_epochs(files: DataFrame) -> None:
    """One reference date and no date twice."""
    row = files.agg(F.count_distinct("reference_date").alias("r"), F.count("date").alias("n"), F.count_distinct("date").alias("d")).first()
    if row["r"] != 1 or row["n"] != row["d"]:
        raise ValueError("files must share one reference date and differ in their observation dates")


@dataclass(frozen=True)
class Grid:
    height: int
    width: int
    affine: tuple[float, float, float, float, float, float]
    crs: str = "EPSG:4326"
    nodata: float | None = None

    @property
    def geographic(self) -> bool:
        return self.crs == "EPSG:4326"


#: Bytes and struct codes of the field types of tags.
FIELDS = {1: ("B", 1), 2: ("s", 1), 3: ("H", 2), 4: ("I", 4), 5: ("II", 8), 6: ("b", 1), 8: ("h", 2), 9: ("i", 4), 11: ("f", 4), 12: ("d", 8), 13: ("I", 4), 16: ("Q", 8), 17: ("q", 8), 18: ("Q", 8)}


def unpack_lzw(data: bytes) -> bytes:
    """A strip of TIFF's LZW: codes of 9 to 12 bits, high bits first, that widen one code early."""
    out, bits, held, wide = [], 0, 0, 9
    table: list[bytes] = []
    last = b""
    for byte in data:
        held, bits = (held << 8 | byte) & 0xFFFFFF, bits + 8
        if bits < wide:
            continue
        bits -= wide
        code = held >> bits & (1 << wide) - 1
        if code == 257:
            break
        if code == 256:
            table, wide, last = [bytes([k]) for k in range(256)] + [b"", b""], 9, b""
            continue
        if not table or code > len(table) or code == len(table) and not last:
            raise ValueError("a broken LZW strip")
        text = table[code] if code < len(table) else last + last[:1]
        out.append(text)
        if last and len(table) < 4096:
            table.append(last + text[:1])
        last = text
        wide = 9 if len(table) < 511 else 10 if len(table) < 1023 else 11 if len(table) < 2047 else 12
    return b"".join(out)


def unpack_bits(data: bytes) -> bytes:
    """A strip of PackBits: runs and literals."""
    out, at = [], 0
    while at < len(data):
        n = data[at]
        if n < 128:
            out.append(data[at + 1 : at + 2 + n])
            at += 2 + n
        else:
            if n > 128:
                out.append(data[at + 1 : at + 2] * (257 - n))
            at += 2 if n > 128 else 1
    return b"".join(out)


UNPACK: dict[int, Callable[[bytes], bytes]] = {1: bytes, 5: unpack_lzw, 8: zlib.decompress, 32773: unpack_bits, 32946: zlib.decompress}


class Tiff:
    """A TIFF or BigTIFF with strips or tiles, read through ``read(offset, size)``: only the parts that a window needs."""

    def __init__(self, read: Callable[[int, int], bytes]):
        self.read = read
        head = read(0, 16)
        if head[:2] not in (b"II", b"MM"):
            raise ValueError("not a TIFF")
        self.order = order = "<" if head[:2] == b"II" else ">"
        big = struct.unpack(order + "H", head[2:4])[0] == 43
        at = struct.unpack(order + "Q", head[8:16])[0] if big else struct.unpack(order + "I", head[4:8])[0]
        word, entry, inline = ("Q", 20, 8) if big else ("I", 12, 4)
        n = struct.unpack(order + ("Q" if big else "H"), read(at, 8 if big else 2))[0]
        raw = read(at + (8 if big else 2), entry * n)
        self.tags: dict[int, tuple] = {}
        for i in range(n):
            one = raw[i * entry : (i + 1) * entry]
            tag, kind, count = struct.unpack(order + "HH" + word, one[: 4 + inline])
            code, wide = FIELDS.get(kind, ("B", 1))
            field = one[4 + inline :][: wide * count] if wide * count <= inline else read(struct.unpack(order + word, one[4 + inline :])[0], wide * count)
            self.tags[tag] = (field.rstrip(b"\0").decode("latin-1"),) if kind == 2 else struct.unpack(order + code * count, field)
        get = lambda tag, default: self.tags.get(tag, (default,))[0]
        self.width, self.height, self.bands = self.tags[256][0], self.tags[257][0], get(277, 1)
        bits, form, self.packed, self.predictor = set(self.tags.get(258, (8,))), get(339, 1), get(259, 1), get(317, 1)
        if len(bits) != 1 or (depth := bits.pop()) not in (8, 16, 32, 64) or form not in (1, 2, 3) or self.packed not in UNPACK or self.predictor not in (1, 2, 3):
            raise ValueError(f"a TIFF of {self.tags.get(258)} bits, sample format {form}, compression {self.packed} and predictor {self.predictor} is not read")
        self.dtype = np.dtype(order + {1: "u", 2: "i", 3: "f"}[form] + str(depth // 8))
        self.apart = get(284, 1) == 2 and self.bands > 1  # bands one after the other
        self.tiled = 322 in self.tags
        self.block = (self.tags[323][0], self.tags[322][0]) if self.tiled else (min(get(278, self.height), self.height), self.width)
        self.across, self.down = -(-self.width // self.block[1]), -(-self.height // self.block[0])

    @property
    def grid(self) -> Grid:
        scale, tie = self.tags.get(33550, (1.0, 1.0, 0.0)), self.tags.get(33922, (0.0,) * 6)
        affine = (scale[0], 0.0, tie[3] - tie[0] * scale[0], 0.0, -scale[1], tie[4] + tie[1] * scale[1])
        if 34264 in self.tags:
            m = self.tags[34264]
            affine = (m[0], m[1], m[3], m[4], m[5], m[7])
        keys = self.tags.get(34735, ())
        codes = {keys[k]: keys[k + 3] for k in range(4, len(keys) - 3, 4)}
        text = self.tags.get(42113, ("",))[0].strip()
        return Grid(self.height, self.width, affine, f"EPSG:{codes.get(3072) or codes.get(2048) or 4326}", float(text) if text else None)

    def part(self, row: int, col: int, band: int) -> np.ndarray:
        """The samples of a strip or tile."""
        place = row * self.across + col + (band * self.across * self.down if self.apart else 0)
        offset, size = (self.tags[t][place] for t in ((324, 325) if self.tiled else (273, 279)))
        rows = self.block[0] if self.tiled else min(self.block[0], self.height - row * self.block[0])
        deep = 1 if self.apart else self.bands
        raw = UNPACK[self.packed](self.read(offset, size))
        if self.predictor == 3:  # bytes of a row by significance, each the difference to the one before of its band
            flat = np.frombuffer(raw, np.uint8, rows * self.block[1] * deep * self.dtype.itemsize).reshape(rows, -1, deep)
            planes = np.cumsum(flat, axis=1, dtype=np.uint8).reshape(rows, self.dtype.itemsize, -1)
            whole = np.ascontiguousarray(planes.transpose(0, 2, 1)).view(self.dtype.newbyteorder(">"))
            return whole.reshape(rows, self.block[1], deep)[..., 0 if self.apart else band]
        out = np.frombuffer(raw, self.dtype, rows * self.block[1] * deep).reshape(rows, self.block[1], deep)
        if self.predictor == 2:
            out = np.cumsum(out, axis=1, dtype=self.dtype.newbyteorder("="))
        return out[..., 0 if self.apart else band]

    def window(self, top: int = 0, bottom: int | None = None, left: int = 0, right: int | None = None, band: int = 0) -> np.ndarray:
        """Rows top to bottom and columns left to right, ends excluded, of a band."""
        if not 0 <= band < self.bands:
            raise ValueError(f"there are {self.bands} bands")
        bottom, right = min(self.height, self.height if bottom is None else bottom), min(self.width, self.width if right is None else right)
        (th, tw), out = self.block, np.zeros((max(0, bottom - top), max(0, right - left)), self.dtype.newbyteorder("="))
        for i in range(top // th, -(-bottom // th)):
            for j in range(left // tw, -(-right // tw)):
                part = self.part(i, j, band)
                y0, y1, x0, x1 = max(top, i * th), min(bottom, (i + 1) * th), max(left, j * tw), min(right, (j + 1) * tw)
                if y0 < y1 and x0 < x1:
                    out[y0 - top : y1 - top, x0 - left : x1 - left] = part[y0 - i * th : y1 - i * th, x0 - j * tw : x1 - j * tw]
        return out


def decode_tiff(data: bytes, band: int | None = None) -> tuple[np.ndarray, Grid]:
    """A band and the grid of a TIFF: uncompressed, deflated, LZW or PackBits, any predictor. Of several bands one must be named."""
    file = Tiff(lambda offset, size: data[offset : offset + size])
    if band is None and file.bands > 1:
        raise ValueError(f"{file.bands} bands: name one")
    return file.window(band=band or 0), file.grid


@contextmanager
def opened(path: str) -> Iterator[Tiff]:
    """A TIFF on a file system that pyarrow reads (local, or by its scheme), of which only what is asked for is read."""
    from pyarrow import fs

    place = re.sub(r"^file:/+", "/", path)
    system, name = (fs.LocalFileSystem(), place) if "://" not in place else fs.FileSystem.from_uri(place)
    with system.open_input_file(name) as file:
        yield Tiff(lambda offset, size: file.read_at(size, offset))


def frame(sizes: list[int], grid: Grid, dtype: str, strip: int, big: bool | None = None) -> tuple[bytes, bytes]:
    """What comes before and after the deflated strips of a single-band TIFF of these sizes; offsets have 64 bits (BigTIFF) where 32 can't hold them."""
    big = sum(sizes) + 16 * len(sizes) + 4096 > 0xFFFFFFFF if big is None else big
    word, wide, long, start = ("Q", 8, 16, 16) if big else ("I", 4, 4, 8)
    kind, offsets, at = TYPES_OF[dtype], [], start
    for n in sizes:
        offsets.append(at)
        at += n
    a, _, c, _, e, f = grid.affine
    code = int(grid.crs.split(":")[1])
    geo = (1, 1, 0, 3, 1024, 0, 1, 2 if grid.geographic else 1, 1025, 0, 1, 1, 2048 if grid.geographic else 3072, 0, 1, code)
    nodata = (repr(grid.nodata if grid.nodata is not None else "nan").strip("'") + "\0").encode()
    at += at % 2
    pad, entries, extra = b"\0" * (at - start - sum(sizes)), [], b""

    def add(tag: int, form: int, count: int, raw: bytes) -> None:
        nonlocal extra
        if len(raw) <= wide:
            entries.append(struct.pack(f"<HH{word}", tag, form, count) + raw.ljust(wide, b"\0"))
        else:
            entries.append(struct.pack(f"<HH{word}{word}", tag, form, count, at + len(extra)))
            extra += raw + b"\0" * (len(raw) % 2)

    for tag, form, v in ((256, 4, (grid.width,)), (257, 4, (grid.height,)), (258, 3, (np.dtype(dtype).itemsize * 8,)), (259, 3, (8,)), (262, 3, (1,)), (273, long, offsets), (277, 3, (1,)), (278, 4, (strip,)), (279, long, sizes), (339, 3, (kind,)), (33550, 12, (a, -e, 0.0)), (33922, 12, (0.0, 0.0, 0.0, c, f, 0.0)), (34735, 3, geo)):
        add(tag, form, len(v), struct.pack("<" + {3: "H", 4: "I", 12: "d", 16: "Q"}[form] * len(v), *v))
    add(42113, 2, len(nodata), nodata)
    directory = struct.pack("<Q" if big else "<H", len(entries)) + b"".join(entries) + b"\0" * wide
    head = struct.pack("<2sHHHQ", b"II", 43, 8, 0, at + len(extra)) if big else struct.pack("<2sHI", b"II", 42, at + len(extra))
    return head, pad + extra + directory


def encode_tiff(values: np.ndarray, grid: Grid, strip: int = 64, big: bool | None = None) -> bytes:
    """A deflated single-band TIFF, one strip a row block, with the grid's tags."""
    dtype = values.dtype.str[1:]
    strips = [zlib.compress(values[i : i + strip].astype("<" + dtype).tobytes(), 6) for i in range(0, len(values), strip)]
    head, tail = frame([len(x) for x in strips], grid, dtype, strip, big)
    return head + b"".join(strips) + tail


def known(values: np.ndarray, nodata: float | None) -> np.ndarray:
    flat = values.astype(float).ravel()
    flat[~np.isfinite(flat)] = np.nan
    if nodata is not None:
        flat[flat == nodata] = np.nan
    return flat


def read_rasters(files: DataFrame, grid: Grid | None = None, factor: float = 1.0, *, window: tuple[int, int, int, int] | None = None, band: int | None = None, rows: int = 512) -> DataFrame:
    """path, pixel_id, value (nodata null, times factor) of the TIFFs in ``files`` (path).

    A task reads ``rows`` rows of a file at a time, and only the strips or tiles that hold them and the ``window``
    (top, bottom, left, right; ends excluded). With a grid, a file of another shape or place is an error. Of files of
    several bands one must be named.
    """
    schema = pa.schema([("path", pa.string()), ("pixel_id", pa.int64()), ("value", pa.float64())])

    def bounds(file: Tiff) -> tuple[int, int, int, int]:
        top, bottom, left, right = window or (0, file.height, 0, file.width)
        return max(0, top), min(bottom, file.height), max(0, left), min(right, file.width)

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                with opened(path) as file:
                    own = file.grid
                    if grid and ((own.height, own.width) != (grid.height, grid.width) or not np.allclose(own.affine, grid.affine, atol=1e-9)):
                        raise ValueError(f"{path} has another geometry")
                    if band is None and file.bands > 1:
                        raise ValueError(f"{path} has {file.bands} bands: name one")
                    top, bottom, _, _ = bounds(file)
                starts = list(range(top, bottom, rows))
                yield pa.RecordBatch.from_arrays([pa.array([path] * len(starts), pa.string()), pa.array(starts, pa.int32())], names=["path", "top"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, start in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                with opened(path) as file:
                    _, bottom, left, right = bounds(file)
                    values = file.window(start, min(bottom, start + rows), left, right, band or 0)
                    ids = (start + np.arange(values.shape[0], dtype=np.int64))[:, None] * file.width + np.arange(left, right)
                    v = known(values, file.grid.nodata) * factor
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(v), pa.string()), pa.array(ids.ravel()), pa.array(v, from_pandas=True)], schema=schema)

    parts = max(1, int(files.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    asked = files.select("path").repartition(parts, "path").mapInArrow(pieces, "path string, top int")
    return asked.repartition(parts, "path", "top").mapInArrow(run, "path string, pixel_id long, value double")


def cube(spark: SparkSession, path: str, *, unit: str = "mm", positive: str = "uplift", grid: Grid | None = None, domain: Column | None = None, **names: str) -> DataFrame:
    """pixel_id, day, value in mm of a folder of dated TIFFs with one reference date."""
    files = discover(spark, path, **names)
    check_epochs(files)
    out = read_rasters(files, grid, unit_factor(unit, positive)).join(files.select("path", F.unix_date("date").alias("day")), "path").select("pixel_id", "day", "value")
    return out if domain is None else out.withColumn("value", F.when(domain, F.col("value")))


def write_cube(df: DataFrame, path: str, width: int, block: int = 256) -> None:
    """A cube as Parquet, partitioned by tiles and sorted by day, so that reads prune both."""
    from terrachron.operators.spatial import pixel_grid

    tiled = pixel_grid(df, width, block=block).drop("row", "col")
    tiled.repartition("block_id").sortWithinPartitions("block_id", "day", "pixel_id").write.mode("overwrite").partitionBy("block_id").option("compression", "zstd").parquet(path)


def read_cube(spark: SparkSession, path: str, *, days: list[int] | None = None, blocks: list[int] | None = None) -> DataFrame:
    df = spark.read.parquet(path)
    df = df if blocks is None else df.where(F.col("block_id").isin(blocks))
    return df if days is None else df.where(F.col("day").isin(days))


def write_raster(df: DataFrame, path: str, grid: Grid, value: str = "value", dtype: str = "f4", strip: int = 64) -> None:
    """One product (pixel_id, value) as a deflated TIFF on any file system that Spark writes to.

    Tasks fill and pack strips of ``strip`` rows; the driver learns their sizes, then streams them one by one.
    """
    gap = grid.nodata if grid.nodata is not None else (np.nan if dtype == "f4" else 0)
    per, strips = strip * grid.width, -(-grid.height // strip)

    def pack(group: pd.DataFrame) -> pd.DataFrame:
        at = int(group["strip"].iloc[0])
        out = np.full(min(strip, grid.height - at * strip) * grid.width, gap, dtype)
        own = group[group["v"].notna()]
        out[own["pixel_id"].to_numpy(np.int64) - at * per] = own["v"].to_numpy()
        return pd.DataFrame({"strip": [at], "data": [zlib.compress(out.astype("<" + dtype).tobytes(), 6)]})

    spark = df.sparkSession
    every = spark.range(strips).select(F.col("id").alias("strip"), F.lit(None).cast("long").alias("pixel_id"), F.lit(None).cast("double").alias("v"))
    rows = df.where(F.col("pixel_id").between(0, grid.height * grid.width - 1)).select(F.floor(F.col("pixel_id") / per).alias("strip"), F.col("pixel_id").cast("long").alias("pixel_id"), F.col(value).cast("double").alias("v"))
    aside = f"{path}.strips"
    rows.unionByName(every).groupBy("strip").applyInPandas(pack, "strip long, data binary").write.mode("overwrite").parquet(aside)
    packed = spark.read.parquet(aside).orderBy("strip")
    sizes = [r["n"] for r in packed.select("strip", F.octet_length("data").alias("n")).orderBy("strip").collect()]
    head, tail = frame(sizes, grid, dtype, strip)
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = system.create(place, True)
    try:
        out.write(bytearray(head))
        for r in packed.toLocalIterator():
            out.write(bytearray(r["data"]))
        out.write(bytearray(tail))
    finally:
        out.close()
    system.delete(spark._jvm.org.apache.hadoop.fs.Path(aside), True)


def files_of(path: str) -> list[str]:
    """The TIFFs of a folder, or the one file, on any file system that pyarrow reads."""
    from pyarrow import fs

    place = re.sub(r"^file:/+", "/", path)
    system, name = (fs.LocalFileSystem(), place) if "://" not in place else fs.FileSystem.from_uri(place)
    if system.get_file_info(name).type != fs.FileType.Directory:
        return [path]
    names = (i.base_name for i in system.get_file_info(fs.FileSelector(name)) if i.type == fs.FileType.File)
    return sorted(f"{place.rstrip('/')}/{n}" for n in names if n.lower().endswith((".tif", ".tiff")))


class TiffReader(DataSourceReader):
    """Reads files by ``ROWS`` rows; all of them, or those that ``names``, ``low`` and ``high`` leave."""

    ROWS = 512

    def __init__(self, path: str):
        self.path, self.low, self.high = path, 0, None
        self.names: set[str] | None = None

    def partitions(self) -> list[InputPartition]:
        out = []
        for name in files_of(self.path):
            if self.names is not None and name not in self.names:
                continue
            with opened(name) as file:
                last = file.height - 1 if self.high is None else min(file.height - 1, self.high // file.width)
                out += [InputPartition((name, top, min(top + self.ROWS, last + 1))) for top in range(self.low // file.width, last + 1, self.ROWS)]
        return out or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        if partition.value is None:
            return
        name, top, bottom = partition.value
        with opened(name) as file:
            if file.bands > 1:
                raise ValueError(f"{name} has {file.bands} bands")
            v = known(file.window(top, bottom), file.grid.nodata)
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(v)), pa.array(top * file.width + np.arange(len(v), dtype=np.int64)), pa.array(v, from_pandas=True)], names=["path", "pixel_id", "value"])


class PushedTiffReader(TiffReader):
    """A reader to which conditions on path and pixel_id come, so that only their files and strips are read."""

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:  # noqa: N802 (the interface's name)
        """Conditions narrow what is read; Spark tests all of them again on the rows."""
        for f in filters:
            name, values = getattr(f, "attribute", None), [v for v in f.value if v is not None] if isinstance(f, In) else [getattr(f, "value", None)]
            if name == ("path",) and isinstance(f, (EqualTo, In)):
                self.names = set(values) if self.names is None else self.names & set(values)
            elif name == ("pixel_id",) and values and None not in values:
                if isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, min(values))
                if isinstance(f, (EqualTo, In, LessThan, LessThanOrEqual)):
                    self.high = max(values) if self.high is None else min(self.high, max(values))
        return filters


class GeoTiffSource(DataSource):
    """Register with ``spark.dataSource.register(GeoTiffSource)``; a folder or one file.

    With the option ``pushdown`` conditions choose what is read; Spark then wants ``spark.sql.python.filterPushdown.enabled``.
    """

    @classmethod
    def name(cls) -> str:
        return "terra_tiff"

    def schema(self) -> str:
        return "path string, pixel_id long, value double"

    def reader(self, schema: object) -> DataSourceReader:
        kind = PushedTiffReader if self.options.get("pushdown", "false").lower() == "true" else TiffReader
        return kind(self.options["path"])


def grid_of(spark: SparkSession, path: str) -> Grid:
    """The grid of a TIFF, from its head alone."""
    with opened(path) as file:
        return file.grid
