"""Reading images, headers, lists and archives, and writing tiles. Files are found and opened by Spark on the executors."""

from __future__ import annotations

import ast
import os
import re
import tarfile
import tempfile
import uuid
import zipfile
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Usual extensions by kind of image.
EXTENSIONS = {"tiff": ".tiff", "worldview": ".zip", "landsat": ".zip", "npy": ".npy", "sentinel1": ".zip"}
#: Fixed value: the extension of files with shapes.
SHAPES = ".wkt.csv"
#: Fixed values of elevation grids: side, nodata, pixels a degree.
HGT_SIDE, HGT_NODATA, HGT_STEP = 3601, -32768, 3600
#: Stores whose folders tasks list by themselves; those of others are listed by Spark's own readers.
STORES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
#: Small files that one task makes, lists or reads at most; rows of a batch of names; bytes of a batch of contents.
TASK_FILES, BATCH_ROWS, BATCH_BYTES = 5_000, 5_000, 8 << 20


def shared_folder(spark: SparkSession) -> str:
    """The session's ``spark.checkpoint.dir``; a temporary folder only where that is unset and all run on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return folder or tempfile.mkdtemp(prefix="spark-scratch-")


def qualified(spark: SparkSession, folder: str) -> str:
    """``folder`` as a full address; one without a scheme belongs to the cluster's default file system."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(folder)
    return path.getFileSystem(context._jsc.hadoopConfiguration()).makeQualified(path).toString()


def store_of(address: str):
    """(Arrow file system, path in it) of a full address, inside a task."""
    from pyarrow import fs

    local = re.match(r"file:/*(/.*)", address)
    return (fs.LocalFileSystem(), local[1]) if local else fs.FileSystem.from_uri(address)


def stored(df: DataFrame) -> DataFrame:
    """``df`` written to the shared folder and read back, for what is read several times and costs more than its rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(rows: DataFrame, n: int | None = None, size: int = 0) -> DataFrame:
    """``rows`` dealt evenly over tasks where each is a file to make or read: a table of few bytes is one task's otherwise.

    ``n`` is their number, if known, ``size`` the bytes that they stand for.
    """
    n = rows.count() if n is None else n
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-n // TASK_FILES), -(-size // TASK_BYTES)))


def _frames(rows: Iterable[tuple], schema: str, size=None) -> Iterator[pd.DataFrame]:
    """Rows as frames of a batch each, as a frame of its own costs more than a small file; ``size`` gives a row's bytes."""
    names, held, total = [x.split()[0] for x in schema.split(", ")], [], 0
    for row in rows:
        held.append(row)
        total += 0 if size is None else size(row)
        if len(held) >= BATCH_ROWS or total > BATCH_BYTES:
            yield pd.DataFrame(held, columns=names).astype(object)
            held, total = [], 0
    if held:
        yield pd.DataFrame(held, columns=names).astype(object)


def _hidden(name: str) -> bool:
    """What Spark's listings leave out."""
    return name.startswith(".") or name.endswith("._COPYING_") or name.startswith("_") and "=" not in name and not name.startswith(("_metadata", "_common_metadata"))


def _entries(address: str, ending: str) -> Iterator[tuple[str, int, bool]]:
    """(path, length, whether it is a folder) of what a folder holds; of a file, itself. A local folder is read a name at a time."""
    from pyarrow import fs

    store, at = store_of(address)
    top = store.get_file_info(at)
    if top.type == fs.FileType.File:
        yield address, top.size, False
    elif isinstance(store, fs.LocalFileSystem):
        with os.scandir(at) as found:
            for e in found:
                try:
                    if not _hidden(e.name) and (e.is_dir() or e.name.endswith(ending)):
                        yield f"{address}/{e.name}", 0 if e.is_dir() else e.stat().st_size, e.is_dir()
                except FileNotFoundError:  # gone since, or a link to nothing
                    continue
    else:
        for e in store.get_file_info(fs.FileSelector(at)):
            folder = e.type == fs.FileType.Directory
            if not _hidden(e.base_name) and (folder or e.base_name.endswith(ending)):
                yield f"{address}/{e.base_name}", 0 if folder else e.size, folder


def _own(spark: SparkSession, directory: str) -> bool:
    """Whether tasks can list the folder: it is there, in a store of STORES."""
    context = spark.sparkContext
    path = context._jvm.org.apache.hadoop.fs.Path(directory)
    return qualified(spark, directory).split(":")[0] in STORES and path.getFileSystem(context._jsc.hadoopConfiguration()).exists(path)


def listed(spark: SparkSession, directory: str, ending: str = "") -> DataFrame:
    """(path, length) of all files below the folder whose name ends so, a stored table; hidden and empty files are left out as by Spark.

    Tasks list folders, level by level, so that neither the driver nor a scan's plan holds the names of the files. Patterns, and folders of
    stores that tasks cannot list, go by Spark's own listing.
    """
    address = qualified(spark, directory).rstrip("/")
    if not _own(spark, directory):
        found = spark.read.format("binaryFile").option("recursiveFileLookup", "true")
        return (found.option("pathGlobFilter", "*" + ending) if ending else found).load(directory).select("path", "length")
    schema = "path string, length long, folder boolean"

    def look(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((e for f in frames for folder in f["path"] for e in _entries(folder, ending)), schema)

    level, out = spark.createDataFrame([(address,)], "path string"), None
    while True:
        seen = stored(level.mapInPandas(look, schema))
        found = seen.filter("NOT folder AND length > 0").select("path", "length")
        out = found if out is None else out.unionByName(found)
        folders = seen.filter("folder").select("path")
        n = folders.count()
        if n == 0:
            return out
        level = spread(folders, n)


def discover(spark: SparkSession, directory: str, image_type: str = "tiff", extension: str | None = None) -> DataFrame:
    """(path, length) of all files below the folder whose name ends with the extension; contents are not read."""
    return listed(spark, directory, extension or EXTENSIONS[image_type])


def read_list(spark: SparkSession, path: str) -> DataFrame:
    """One path per line, trimmed, blank lines dropped."""
    return spark.read.text(path).select(F.trim("value").alias("path")).filter("path <> ''")


def image_paths(spark: SparkSession, files: list[str] | None = None, file_list: str | None = None, directory: str | None = None, **more) -> DataFrame:
    """Paths from exactly one of a list, a list file or a folder, whose listing also tells the files' ``length``."""
    if sum(x is not None for x in (files, file_list, directory)) != 1:
        raise ValueError("give one of files, file_list, directory")
    if files is not None:
        return spark.createDataFrame([(f,) for f in files], "path string")
    return read_list(spark, file_list) if file_list is not None else discover(spark, directory, **more)


def label_ids(lines: DataFrame, value: str = "value") -> DataFrame:
    """The second field of rows whose first is a whole number; headers fall out."""
    p = F.split(value, ",")
    return lines.filter(F.trim(p[0]).try_cast("int").isNotNull()).select(F.trim(F.get(p, F.lit(1))).alias("label_id"))


def read_headers(spark: SparkSession, path: str, level: int = 0) -> DataFrame:
    """(scene_id, text): whole text files below the folder; the scene is the file's stem, or the name of a folder ``level`` above it."""
    def read(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def text(address: str) -> bytes:
            store, at = store_of(address)
            with store.open_input_stream(at) as file:
                return file.read()

        return _frames(((address, text(address)) for f in frames for address in f["_path"]), "_path string, value binary", lambda row: len(row[1]))

    if _own(spark, path):
        found = listed(spark, path)
        n, size = found.agg(F.count(F.lit(1)), F.sum("length")).first()
        rows = spread(found.select(F.col("path").alias("_path")), n, size or 0).mapInPandas(read, "_path string, value binary").withColumn("value", F.col("value").cast("string"))
    else:
        rows = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("_path", F.input_file_name())
    parts = F.split("_path", "/")
    name = F.regexp_extract("_path", r"([^/]+?)(?:\.[^./]*)?$", 1) if level == 0 else F.element_at(parts, -1 - level)
    return rows.select(name.alias("scene_id"), F.col("value").alias("text"))


def write_files(files: DataFrame, folder: str) -> DataFrame:
    """Writes each row's ``content`` to ``folder``/``path`` from the task that holds it; gives (path, length) when acted on.

    A task that runs again writes the same bytes under the same names. Any store that Arrow knows by its address will do;
    a folder without a scheme is one of the cluster's default file system, as for Spark's own readers.
    """
    address = qualified(files.sparkSession, folder)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, base = store_of(address)
        made = set()
        for f in frames:
            for path, content in zip(f["path"], f["content"]):
                parent = f"{base}/{path}".rsplit("/", 1)[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(f"{base}/{path}") as out:
                    out.write(content)
            yield pd.DataFrame({"path": f["path"], "length": [len(c) for c in f["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, length long")


def shapes_path(image: Column, folder: str | None = None) -> Column:
    """Where the shapes of an image are: beside it, or in ``folder``, under its own name with another extension."""
    place = image if folder is None else F.concat(F.lit(folder.rstrip("/") + "/"), F.substring_index(image, "/", -1))
    return F.concat(F.regexp_replace(place, r"\.[^./]*$", ""), F.lit(SHAPES))


def read_shapes(spark: SparkSession, path: str) -> DataFrame:
    """(scene_id, shape_id, tags, rings) of files with a quoted WKT and tags per line; other lines are skipped.

    The scene is the file's name without its extension, as ``shapes_path`` has it; ``shape_id`` is the line's number, the order in
    which shapes are painted. ``path`` may be a file or a folder.
    """
    from ..operators.regions import parse_tags, parse_wkt

    whole = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True).withColumn("_path", F.col("_metadata.file_path"))
    scene = F.regexp_replace(F.substring_index("_path", "/", -1), r"(\.wkt\.csv|\.[^.]*)$", "")
    lines = whole.select(scene.alias("scene_id"), F.posexplode(F.split("value", "\r?\n")).alias("shape_id", "line"))
    row = F.from_csv("line", "wkt string, tag_text string, rest string", {"quote": '"', "ignoreLeadingWhiteSpace": "true"})
    rows = lines.select("scene_id", F.col("shape_id").cast("long").alias("shape_id"), row.alias("_r")).filter(F.upper("_r.wkt").contains("POLYGON") & F.col("_r.rest").isNull())
    return rows.select("scene_id", "shape_id", parse_tags(F.col("_r.tag_text")).alias("tags"), parse_wkt(F.col("_r.wkt")).alias("rings"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    """All pages of a catalog (one JSON document each) as one table."""
    return spark.read.json(path, multiLine=True)


TILES = "scene_id string, tile_row int, tile_col int, min_x int, min_y int, max_x int, max_y int, n_bands int, data array<float>, error string"
SPLITS = "path string, scene_id string, dtype string, offset long, columns_first boolean, height int, width int, n_bands int, tile_row int, min_y int, max_y int, bytes long, error string"
#: Bytes of tiles that one task of a reader aims at; tiles of a row in one file; tasks of a write at most.
TASK_BYTES, TASK_TILES, TASKS = 64 << 20, 10_000, 10_000


def npy_layout(head: bytes) -> tuple[str, bool, tuple[int, ...], int]:
    """(type, columns first, shape, where the data begins) of the head of a NumPy file."""
    if head[:6] != b"\x93NUMPY" or len(head) < 12:
        raise ValueError("not a NumPy file")
    wide = head[6] > 1
    n = int.from_bytes(head[8 : 12 if wide else 10], "little")
    begin = (12 if wide else 10) + n
    if len(head) < begin:
        raise ValueError("a header of a NumPy file that is cut short")
    said = ast.literal_eval(head[12 if wide else 10 : begin].decode("latin1"))
    if np.dtype(said["descr"]).hasobject:
        raise ValueError("arrays of objects are not read")
    return np.dtype(said["descr"]).str, bool(said["fortran_order"]), tuple(said["shape"]), begin


def _splits(spark: SparkSession, directory: str, extension: str, layout, rows_per_tile: int) -> DataFrame:
    """The tiles of whole rows of each file and where their bytes are; ``layout(file, size)`` is what ``npy_layout`` gives."""
    found = discover(spark, directory, extension=extension)

    def planned(path: str, size: int) -> list[tuple]:
        scene = path.rsplit("/", 1)[-1][: -len(extension)]
        try:
            store, at = store_of(path)
            with store.open_input_file(at) as file:
                kind, turned, shape, begin = layout(file, size)
            if len(shape) not in (2, 3):
                raise ValueError(f"{len(shape)} dimensions")
            h, w, bands = (*shape, 1)[:3]
            if h * w * bands == 0:
                return [(path, scene, None, None, None, None, None, None, 0, None, None, None, "no pixels")]
            line = w * bands * np.dtype(kind).itemsize
            if begin + h * line > size:
                raise ValueError("the file is cut short")
            # an array with its columns first has no rows in one piece: one split of all of it
            step = h if turned else rows_per_tile
            return [(path, scene, kind, begin + y * line, turned, h, w, bands, y // rows_per_tile, y, min(h, y + step), (min(h, y + step) - y) * line, None) for y in range(0, h, step)]
        except Exception as e:  # a bad file is a row of the report, not the end of the job
            return [(path, scene, None, None, None, None, None, None, 0, None, None, None, f"{type(e).__name__}: {e}")]

    def plan(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((row for f in frames for path, size in zip(f["path"], f["length"]) for row in planned(path, size)), SPLITS)

    return spread(found).mapInPandas(plan, SPLITS)


def npy_splits(spark: SparkSession, directory: str, rows_per_tile: int = 256) -> DataFrame:
    """Where the tiles of NumPy arrays are: their headers only are read. One row for each tile, or with ``error`` for a bad file."""

    def layout(file, size: int) -> tuple:
        return npy_layout(file.read_at(min(size, 1 << 16), 0))

    return _splits(spark, directory, ".npy", layout, rows_per_tile)


def elevation_splits(spark: SparkSession, directory: str, side: int = HGT_SIDE, rows_per_tile: int = 256) -> DataFrame:
    """The same of elevation grids, whose size tells that they are whole."""

    def layout(file, size: int) -> tuple:
        if size != side * side * 2:
            raise ValueError(f"{size} bytes are no grid of {side} x {side}")
        return ">i2", False, (side, side), 0

    return _splits(spark, directory, ".hgt", layout, rows_per_tile)


def read_splits(splits: DataFrame, rows_per_tile: int = 256, missing: float | None = None) -> DataFrame:
    """The tiles of ``splits`` (a filter on these reads less), each read by its range of bytes; ``missing`` becomes NaN.

    Splits are dealt over tasks by their bytes and number, so that many tasks read one large file, and a task holds one split at a
    time, or a batch of small ones.
    """
    names = [x.split()[0] for x in TILES.split(", ")]

    def tiles(s) -> list[tuple]:
        try:
            store, at = store_of(s.path)
            with store.open_input_file(at) as file:
                data = file.read_at(s.bytes, s.offset)
            flat = np.frombuffer(data, np.dtype(s.dtype))
            image = flat.reshape((s.n_bands, s.width, s.height)).T if s.columns_first else flat.reshape(s.max_y - s.min_y, s.width, s.n_bands)
            image = image.astype("float32")
            image = image if missing is None else np.where(image == missing, np.float32("nan"), image)
            return [(s.scene_id, (s.min_y + y) // rows_per_tile, 0, 0, s.min_y + y, s.width, s.min_y + y + len(part), s.n_bands, part.reshape(-1), None)
                    for y in range(0, len(image), rows_per_tile) for part in [image[y : y + rows_per_tile]]]
        except Exception as e:  # as above
            return [(s.scene_id, s.tile_row, 0, 0, 0, 0, 0, 0, None, f"{type(e).__name__}: {e}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((row for f in frames for s in f.itertuples(index=False) for row in tiles(s)), TILES, lambda row: 0 if row[8] is None else row[8].nbytes)

    splits = stored(splits)
    good = splits.filter("error IS NULL")
    n, total = good.agg(F.count(F.lit(1)), F.sum("bytes")).first()
    bad = splits.filter("error IS NOT NULL").select("scene_id", *[F.lit(0).alias(n) for n in names[1:7]], F.lit(0).alias("n_bands"), F.lit(None).cast("array<float>").alias("data"), "error")
    return spread(good, n, total or 0).mapInPandas(run, TILES).unionByName(bad)


def read_npy(spark: SparkSession, directory: str, rows_per_tile: int = 256) -> DataFrame:
    """NumPy arrays as tiles of whole rows; two dimensions mean one band. Unreadable files give a row with ``error``."""
    return read_splits(npy_splits(spark, directory, rows_per_tile), rows_per_tile)


def read_elevation(spark: SparkSession, directory: str, side: int = HGT_SIDE, rows_per_tile: int = 256) -> DataFrame:
    """Big-endian 16-bit elevation grids as tiles of whole rows; nodata becomes NaN. See ``elevation_bounds`` for their place."""
    return read_splits(elevation_splits(spark, directory, side, rows_per_tile), rows_per_tile, HGT_NODATA)


def elevation_bounds(tiles: DataFrame, side: int = HGT_SIDE) -> DataFrame:
    """``tiles`` of ``read_elevation`` with the geo box of their degree, by the file's name, and the size of a pixel in degrees."""
    from ..operators.catalog import elevation_tile_bounds

    return tiles.withColumns({"bounds": elevation_tile_bounds(F.col("scene_id")), "pixel_size": F.lit(1.0 / (side - 1))})


MEMBERS = "archive string, member string, kind string, start long, packed long, size long, error string"
#: Bytes of a member that are read, unpacked and written at a time.
BLOCK = 4 << 20


def archive_members(spark: SparkSession, directory: str, limit: int | None = None) -> DataFrame:
    """(archive, member, kind, start, packed, size, error): the files in zip and tar archives, and where their bytes are.

    Of a zip file the central directory is read, of a tar file the headers, by ranges. A compressed tar file has no index: it is
    one row of kind ``stream``, whose members are known when it is read. A bad archive is a row with its error.
    """
    found = listed(spark, directory).select("path")
    found = found if limit is None else found.orderBy("path").limit(limit)

    def inside(path: str) -> Iterator[tuple]:
        store, at = store_of(path)
        with store.open_input_file(at) as file:
            if zipfile.is_zipfile(file):
                with zipfile.ZipFile(file) as z:
                    for i in z.infolist():
                        if i.is_dir():
                            continue
                        if i.flag_bits & 1 or i.compress_type not in (0, 8):
                            yield path, i.filename, None, None, None, None, "encrypted, or packed in a way that is not read"
                            continue
                        head = file.read_at(30, i.header_offset)
                        begin = i.header_offset + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little")
                        yield path, i.filename, "deflated" if i.compress_type else "stored", begin, i.compress_size, i.file_size, None
                return
            file.seek(0)
            if file.read(2) in (b"\x1f\x8b", b"BZ", b"\xfd7"):
                yield path, None, "stream", 0, file.size(), None, None
                return
            file.seek(0)
            with tarfile.open(fileobj=file, mode="r:") as t:
                for m in t:
                    if m.isfile():
                        yield path, m.name, "stored", m.offset_data, m.size, m.size, None

    def rows(path: str) -> list[tuple]:
        try:
            return list(inside(path))
        except Exception as e:  # as above
            return [(path, None, None, None, None, None, f"{type(e).__name__}: {e}")]

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((row for f in frames for path in f["path"] for row in rows(path)), MEMBERS)

    return spread(found).mapInPandas(run, MEMBERS)


def _blocks(file, kind: str, start: int, packed: int) -> Iterator[bytes]:
    """A member's bytes, a block at a time."""
    squeeze = zlib.decompressobj(-15) if kind == "deflated" else None
    for at in range(start, start + packed, BLOCK):
        data = file.read_at(min(BLOCK, start + packed - at), at)
        if squeeze is None:
            yield data
            continue
        while data:
            yield squeeze.decompress(data, BLOCK)
            data = squeeze.unconsumed_tail
    if squeeze is not None:
        yield squeeze.flush()
        if not squeeze.eof:
            raise EOFError("the member is cut short")


def _contents(path: str, member: str, kind: str, start: int, packed: int) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(member, blocks) of one row of ``archive_members``; a stream has many members."""
    store, at = store_of(path)
    with store.open_input_file(at) as file:
        if kind != "stream":
            yield member, _blocks(file, kind, start, packed)
            return
        with tarfile.open(fileobj=file, mode="r|*") as t:
            for m in t:
                if m.isfile():
                    body = t.extractfile(m)
                    yield m.name, iter(lambda: body.read(BLOCK), b"")


def _dealt(members: DataFrame) -> DataFrame:
    good = members.filter("error IS NULL")
    n, total = good.agg(F.count(F.lit(1)), F.sum("packed")).first()
    return spread(good, n, total or 0)


def unpack(spark: SparkSession, directory: str, limit: int | None = None) -> DataFrame:
    """(archive, member, content, error) of zip and tar files; a bad archive or member is a row with its error.

    Members are dealt over tasks and read by their ranges, so that a task holds one member, or a batch of small ones, and no
    archive. What is too large for a row goes by ``unpack_to``.
    """
    members = stored(archive_members(spark, directory, limit))
    schema = "archive string, member string, content binary, error string"

    def rows(m) -> Iterator[tuple]:
        try:
            for name, blocks in _contents(m.archive, m.member, m.kind, m.start, m.packed):
                yield m.archive, name, b"".join(blocks), None
        except Exception as e:  # as above
            yield m.archive, m.member, None, f"{type(e).__name__}: {e}"

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        return _frames((row for f in frames for m in f.itertuples(index=False) for row in rows(m)), schema, lambda row: len(row[2] or b""))

    good = _dealt(members).mapInPandas(run, schema)
    return good.unionByName(members.filter("error IS NOT NULL").select("archive", "member", F.lit(None).cast("binary").alias("content"), "error"))


def mirrored(base: str, archive: str, member: str | None) -> str:
    """A member's place in a tree that mirrors the one below ``base``: the archive's folders, one of its own stem, its own name."""
    inner = archive.removeprefix(base.rstrip("/") + "/")
    stem = re.sub(r"(\.tar)?\.[^./]*$", "", inner)
    return stem if member is None else f"{stem}/{member}"


def unpacked_paths(members: DataFrame, directory: str) -> DataFrame:
    """``members`` of ``unpack`` with ``path``: the archive's folders below ``directory``, one of its own stem, and the member's name."""
    base = qualified(members.sparkSession, directory).rstrip("/") + "/"
    inner = F.when(F.startswith("archive", F.lit(base)), F.substring("archive", F.lit(len(base) + 1), F.length("archive"))).otherwise(F.col("archive"))
    return members.withColumn("path", F.concat_ws("/", F.regexp_replace(inner, r"(\.tar)?\.[^./]*$", ""), "member"))


def unpack_to(spark: SparkSession, directory: str, folder: str, limit: int | None = None) -> DataFrame:
    """Writes all members below ``folder`` in a tree that mirrors the input's; gives (archive, member, path, length, error) when acted on.

    Members go over in blocks from range to file, so that neither an archive nor a member is held whole. A task that runs again
    writes the same files. Names that would leave their archive's folder are errors.
    """
    base, target = qualified(spark, directory), qualified(spark, folder).rstrip("/")
    members = stored(archive_members(spark, directory, limit))

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = store_of(target)
        for f in frames:
            out = []
            for m in f.itertuples(index=False):
                try:
                    for name, blocks in _contents(m.archive, m.member, m.kind, m.start, m.packed):
                        if name.startswith("/") or ".." in name.split("/"):
                            raise ValueError("the name leaves its folder")
                        path, length = mirrored(base, m.archive, name), 0
                        store.create_dir(f"{root}/{path}".rsplit("/", 1)[0], recursive=True)
                        with store.open_output_stream(f"{root}/{path}") as to:
                            for data in blocks:
                                to.write(data)
                                length += len(data)
                        out.append((m.archive, name, path, length, None))
                except Exception as e:  # as above
                    out.append((m.archive, m.member, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["archive", "member", "path", "length", "error"]).astype(object)

    good = _dealt(members).mapInPandas(run, "archive string, member string, path string, length long, error string")
    nothing = [F.lit(None).cast("string").alias("path"), F.lit(None).cast("long").alias("length")]
    return good.unionByName(members.filter("error IS NOT NULL").select("archive", "member", *nothing, "error"))


def invalid_inputs(files: DataFrame, tiles: DataFrame, expected: DataFrame | None = None) -> DataFrame:
    """(scene_id, reason): empty files, unreadable ones, images without rows or columns, and those of ``expected`` (scene_id) that are not there.

    Spark's listings leave files of 0 bytes out, so with these they are missing; lists from elsewhere may give their length.
    """
    scene = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]*)?$", 1).alias("scene_id")
    # read once: arrays are decoded for it
    tiles = stored(tiles.select("scene_id", "max_x", "max_y", "error"))
    empty = files.filter("length = 0").select(scene, F.lit("empty").alias("reason"))
    bad = tiles.filter("error IS NOT NULL").select("scene_id", F.col("error").alias("reason"))
    flat = tiles.filter("error IS NULL").groupBy("scene_id").agg(F.max("max_x").alias("w"), F.max("max_y").alias("h")).filter("w <= 0 OR h <= 0").select("scene_id", F.lit("no pixels").alias("reason"))
    out = empty.unionByName(bad.join(empty, "scene_id", "left_anti")).unionByName(flat)
    if expected is not None:
        out = out.unionByName(expected.select("scene_id").distinct().join(files.select(scene), "scene_id", "left_anti").select("scene_id", F.lit("missing").alias("reason")))
    return out


def block_side(side: int, other: int) -> int:
    """The output block: a multiple of 16, at most 1024, for rasters with a side above 100; small ones stay whole."""
    return side if max(side, other) <= 100 else min(max(1, side // 16) * 16, 1024)


def write_tiles(pixels: DataFrame, path: str, tile: int = 256, mode: str = "overwrite", nodata: float | None = None, headers: DataFrame | None = None, by_row: bool = False) -> None:
    """Parquet tiles, a folder for each scene, or ``by_row`` for each row of tiles of all scenes; rows are dealt by scene and tile row, so a giant scene takes many tasks.

    A raster with a side above 100 is cut into blocks of a multiple of 16 (``block_side`` of ``tile``); edge blocks may be
    short. Every tile carries the nodata value and, of ``headers`` (scene_id, gt, projection, tags), its scene's metadata,
    the geotransform moved to the tile's corner.
    """
    from ..operators.grid import pixels_to_tiles

    tiles = pixels_to_tiles(pixels, block_side(tile, tile), block_side(tile, tile)).withColumn("nodata", F.lit(nodata).cast("double"))
    if headers is not None:
        g = F.col("gt")
        moved = F.array(g[0] + F.col("min_x") * g[1], g[1], g[2], g[3] + F.col("min_y") * g[5], g[4], g[5])
        tiles = tiles.join(headers.select("scene_id", "gt", "projection", "tags"), "scene_id", "left").withColumn("gt", F.when(F.size(g) == 6, moved))
    if not by_row:
        tiles.repartition("scene_id", "tile_row").write.mode(mode).partitionBy("scene_id").parquet(path)
        return
    # folders are as many as rows of tiles, files as rows and parts of scenes, of which each has TASK_TILES tiles of a row or so
    tiles = stored(tiles)
    rows, most = tiles.groupBy("tile_row").count().agg(F.count(F.lit(1)), F.max("count")).first()
    parts = -(-(most or 0) // TASK_TILES) or 1
    dealt = tiles.repartition(max(1, min((rows or 1) * parts, TASKS)), "tile_row", F.pmod(F.xxhash64("scene_id"), F.lit(parts)))
    dealt.sortWithinPartitions("tile_row", "scene_id").write.mode(mode).partitionBy("tile_row").parquet(path)
