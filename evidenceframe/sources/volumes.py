"""Volumes, image and mask [D, H, W], as rows of slices: a data source that reads and writes .npz and NIfTI files.

A task opens a file, checks it and yields a slice at a time, so it holds one of them whatever the volume's size; files are dealt to
tasks by their bytes. A writer takes the slices of a volume in order and streams them into compressed files; a data
set is whole once its ``dataset.json`` is there (``staging``).
"""

from __future__ import annotations

import gzip
import io
import json
import struct
import zipfile
import zlib
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from .staging import Staged, StagedWriter, listed, store

SLICES = "path string, case_id string, split string, z int, depth int, height int, width int, image array<float>, mask array<byte>, error string"
NIFTI_TYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


@dataclass
class Stream:
    """An array of slices, read in turn."""

    shape: tuple[int, ...]
    read: Callable[[], np.ndarray] = lambda: np.zeros((0, 0))  # the next slice


def _exactly(f, size: int) -> bytes:
    data = f.read(size)
    if len(data) < size:
        raise ValueError("the file ends early")
    return data


def npy_stream(f) -> Stream:
    """An array of an .npy file; one in Fortran's order is read whole."""
    version = np.lib.format.read_magic(f)
    header = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, fortran, kind = header(f)
    if kind.hasobject:
        raise ValueError("an array of objects")
    size = int(np.prod(shape[1:])) * kind.itemsize
    if fortran and len(shape) > 1:
        planes = iter(np.frombuffer(_exactly(f, size * shape[0]), kind).reshape(shape, order="F"))
        return Stream(shape, lambda: next(planes))
    return Stream(shape, lambda: np.frombuffer(_exactly(f, size), kind).reshape(shape[1:]))


def nifti_header(raw: bytes) -> tuple[tuple[int, ...], np.dtype, int, float, float]:
    """Shape [X, Y, Z] without closing ones beyond the third, type, place of the data, slope and shift. A slope of 0 or none is 1."""
    order = "<" if struct.unpack_from("<i", raw)[0] == 348 else ">"
    if struct.unpack_from(order + "i", raw)[0] != 348:
        raise ValueError("not a NIfTI-1 file")
    n, *shape = struct.unpack_from(order + "8h", raw, 40)
    shape = shape[:n]
    while len(shape) > 3 and shape[-1] == 1:
        shape.pop()
    code = struct.unpack_from(order + "h", raw, 70)[0]
    if code not in NIFTI_TYPES:
        raise ValueError(f"voxels of type {code}")
    offset, slope, shift = struct.unpack_from(order + "3f", raw, 108)
    scaled = np.isfinite(slope) and slope != 0
    return tuple(shape), np.dtype(order + NIFTI_TYPES[code]), int(offset), float(slope) if scaled else 1.0, float(shift) if scaled and np.isfinite(shift) else 0.0


def nifti_stream(f) -> Stream:
    """The slices [Y, X] of a NIfTI-1 file, gzip or plain, scaled as its header says."""
    head = f.read(2)
    f.seek(0)
    f = gzip.GzipFile(fileobj=f) if head == b"\x1f\x8b" else f
    shape, kind, offset, slope, shift = nifti_header(raw := _exactly(f, 348))
    _exactly(f, max(0, offset - len(raw)))
    plane = shape[1::-1]

    def read() -> np.ndarray:
        v = np.frombuffer(_exactly(f, int(np.prod(plane)) * kind.itemsize), kind).reshape(plane)
        return v if slope == 1 and not shift else v * slope + shift

    return Stream(shape[::-1], read)


def nearest(plane: np.ndarray, height: int, width: int) -> np.ndarray:
    """The plane at another size: each new pixel takes the one its centre falls in."""
    rows = ((np.arange(height) + 0.5) * plane.shape[0] / height).astype(int)
    columns = ((np.arange(width) + 0.5) * plane.shape[1] / width).astype(int)
    return plane[rows][:, columns]


def checked(image: Stream | None, mask: Stream | None) -> tuple[int, int, int]:
    """Depth, height and width of a volume; ValueError says why it can't be used."""
    for name, s in (("image", image), ("mask", mask)):
        if s and len(s.shape) != 3:
            raise ValueError(f"{name} has {len(s.shape)} dimensions")
    if image and mask and image.shape[0] != mask.shape[0]:
        raise ValueError(f"depths {image.shape[0]} and {mask.shape[0]}")
    return (image or mask).shape


@dataclass
class Volume:
    case_id: str
    split: str | None
    image: str | None
    mask: str | None


@dataclass
class Volumes(InputPartition):
    volumes: list[Volume]


class VolumeReader(DataSourceReader):
    """form: npz (image and mask in a file), nifti (a data set's images and labels folders) or mask (single NIfTI masks)."""

    def __init__(self, options):
        self.path, self.form = options["path"], options.get("form", "npz")
        self.keys = options.get("imageKey", "image"), options.get("maskKey", "mask")
        self.bytes = int(options.get("taskBytes", 64 << 20))
        self.pixels = options.get("pixels", "true").lower() != "false"

    def found(self) -> list[tuple[Volume, int]]:
        if self.form == "npz":
            return [(Volume(p.rsplit("/", 1)[-1].removesuffix(".npz"), None, p, p), n) for p, n in listed(self.path, ".npz")]
        files = listed(self.path, ".nii.gz") + listed(self.path, ".nii")
        stem = lambda p: p.rsplit("/", 1)[-1].removesuffix(".gz").removesuffix(".nii")
        if self.form == "mask":
            return sorted(((Volume(stem(p), None, None, p), n) for p, n in files), key=lambda x: x[0].mask)
        sides: dict[tuple[str, str], dict] = {}
        for p, n in files:
            folder = p.rsplit("/", 2)[-2]
            for side in ("images", "labels"):
                if folder.startswith(side):
                    case = stem(p).removesuffix("_0000") if side == "images" else stem(p)
                    own = sides.setdefault((folder.removeprefix(side), case), {"bytes": 0})
                    own[side], own["bytes"] = p, own["bytes"] + n
        splits = {"Tr": "train", "Ts": "test"}
        return [(Volume(case, splits.get(end, end.lower()), own.get("images"), own.get("labels")), own["bytes"]) for (end, case), own in sorted(sides.items())]

    def partitions(self) -> list[Volumes]:
        out, size = [], 0
        for volume, n in self.found():
            if not out or size + n > self.bytes:
                out, size = [*out, Volumes([])], 0
            out[-1].volumes.append(volume)
            size += n
        return out or [Volumes([])]

    def streams(self, v: Volume, opened: list) -> tuple[Stream | None, Stream | None]:
        def open_(path: str):
            fs, _ = store(self.path)
            opened.append(f := fs.open_input_file(path))
            return io.BytesIO(f.read()) if f.size() < 1 << 16 else f

        if self.form == "npz":
            archive = zipfile.ZipFile(open_(v.image))
            there = {n.removesuffix(".npy") for n in archive.namelist()}
            if missing := [k for k in self.keys if k not in there]:
                raise ValueError(f"no array {' or '.join(missing)} among {', '.join(sorted(there))}")
            return tuple(npy_stream(archive.open(f"{k}.npy")) for k in self.keys)
        if self.form == "nifti" and not (v.image and v.mask):
            raise ValueError(f"no {'mask' if v.image else 'image'} of this name")
        return tuple(p and nifti_stream(open_(p)) for p in (v.image, v.mask))

    def read(self, partition: Volumes) -> Iterator[pa.RecordBatch]:
        for v in partition.volumes if partition else []:
            row = {"path": v.image or v.mask, "case_id": v.case_id, "split": v.split}
            opened: list = []
            try:
                image, mask = self.streams(v, opened)
                depth, height, width = checked(image, mask)
                for z in range(depth):
                    a, m = image and image.read(), mask and mask.read()
                    if m is not None and m.shape != (height, width):
                        m = nearest(m, height, width)
                    yield _batch(row | {"z": z, "depth": depth, "height": height, "width": width}, a if self.pixels else None, m)
            except (ValueError, KeyError, OSError, EOFError, zipfile.BadZipFile, struct.error, zlib.error) as e:
                yield _batch(row | {"error": (str(e) or type(e).__name__)[:200]}, None, None)
            finally:
                for f in opened:
                    f.close()


ARROW = {
    "path": pa.string(), "case_id": pa.string(), "split": pa.string(), "z": pa.int32(), "depth": pa.int32(), "height": pa.int32(), "width": pa.int32(),
    "image": pa.list_(pa.float32()), "mask": pa.list_(pa.int8()), "error": pa.string(),
}


def _batch(row: dict, image: np.ndarray | None, mask: np.ndarray | None) -> pa.RecordBatch:
    whole = lambda v, kind: None if v is None else pa.ListArray.from_arrays(pa.array([0, v.size], pa.int32()), pa.array(np.ascontiguousarray(v).ravel(), kind))
    planes = {"image": whole(image if image is None else image.astype(np.float32), pa.float32()), "mask": whole(mask if mask is None else (mask > 0).astype(np.int8), pa.int8())}
    cells = [planes[k] if planes.get(k) is not None else pa.array([row.get(k)], kind) for k, kind in ARROW.items()]
    return pa.RecordBatch.from_arrays(cells, list(ARROW))


def nifti_head(shape: tuple[int, int, int], kind: str) -> bytes:
    """Header and empty extension of a NIfTI-1 file [X, Y, Z] with voxels of one unit."""
    code, bits = {"f4": (16, 32), "u1": (2, 8)}[kind]
    head = bytearray(352)
    struct.pack_into("<i", head, 0, 348)
    struct.pack_into("<8h", head, 40, 3, *shape, 1, 1, 1, 1)
    struct.pack_into("<2h", head, 70, code, bits)
    struct.pack_into("<8f", head, 76, *[1.0] * 8)
    struct.pack_into("<3f", head, 108, 352.0, 1.0, 0.0)
    struct.pack_into("<2h", head, 252, 0, 2)
    struct.pack_into("<12f", head, 280, 1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 1, 0)
    head[344:348] = b"n+1\0"
    return bytes(head)


class _Nifti:
    """Image and mask files of a case."""

    def __init__(self, writer: VolumeWriter, case: str, train: bool, depth: int, image: tuple[int, int], mask: tuple[int, int], done: Staged):
        end = "Tr" if train else "Ts"
        self.files = []
        for name, (height, width), kind in ((f"images{end}/{case}_0000.nii.gz", image, "f4"), (f"labels{end}/{case}.nii.gz", mask, "u1")):
            out = writer.stage(name, done)
            zipped = gzip.GzipFile(filename="", fileobj=out, mode="wb", compresslevel=6, mtime=0)
            zipped.write(nifti_head((width, height, depth), kind))
            self.files.append((zipped, out, "<" + kind))

    def add(self, *planes: np.ndarray) -> None:
        for (zipped, _, kind), v in zip(self.files, planes):
            zipped.write(v.astype(kind).tobytes())

    def close(self) -> None:
        for zipped, out, _ in self.files:
            zipped.close()
            out.close()


class _Npz:
    """The .npz file of a case: the image streams into it, the mask (a byte a voxel) follows at the end."""

    def __init__(self, writer: VolumeWriter, case: str, train: bool, depth: int, image: tuple[int, int], mask: tuple[int, int], done: Staged):
        self.out = writer.stage(f"{case}.npz", done)
        self.archive = zipfile.ZipFile(self.out, "w", zipfile.ZIP_DEFLATED)
        self.image, self.held, self.shape = self.archive.open("image.npy", "w", force_zip64=True), io.BytesIO(), (depth, *mask)
        np.lib.format.write_array_header_1_0(self.image, {"descr": "<f4", "fortran_order": False, "shape": (depth, *image)})

    def add(self, image: np.ndarray, mask: np.ndarray) -> None:
        self.image.write(image.astype("<f4").tobytes())
        self.held.write(mask.astype("u1").tobytes())

    def close(self) -> None:
        self.image.close()
        with self.archive.open("mask.npy", "w", force_zip64=True) as f:
            np.lib.format.write_array_header_1_0(f, {"descr": "|u1", "fortran_order": False, "shape": self.shape})
            f.write(self.held.getbuffer())
        self.archive.close()
        self.out.close()


class VolumeWriter(StagedWriter):
    def __init__(self, options, overwrite: bool):
        super().__init__(options["path"], overwrite)
        self.form, self.name, self.number = options.get("form", "nifti"), options.get("datasetName", "volumes"), int(options.get("datasetId", 1))
        if self.form == "nifti" and not overwrite and listed(self.path, "dataset.json"):
            raise FileExistsError(f"{self.path} holds a data set")

    def write(self, batches) -> Staged:
        done, case, volume, z = self.begin(), None, None, 0

        def close():
            if volume:
                if z != depth:
                    raise ValueError(f"{case}: {z} of {depth} slices")
                volume.close()

        for batch in batches:
            image, mask = batch.column("image"), batch.column("mask")
            for i, r in enumerate(batch.drop_columns(["image", "mask"]).to_pylist()):
                if r["case_id"] != case:
                    close()
                    case, z, depth, train = r["case_id"], 0, r["depth"], r["split"] in (None, "train")
                    if not case or "/" in case:
                        raise ValueError(f"a case can't be named {case!r}")
                    volume = (_Npz if self.form == "npz" else _Nifti)(self, case, train, depth, (r["height"], r["width"]), (r["mask_height"], r["mask_width"]), done)
                    done.counts["train" if train else "test"] = done.counts.get("train" if train else "test", 0) + 1
                a, m = image[i].values, mask[i].values
                if r["z"] != z or a is None or m is None or len(a) != r["height"] * r["width"] or len(m) != r["mask_height"] * r["mask_width"]:
                    raise ValueError(f"{case}: slice {r['z']} in place of {z}, or not of its size")
                volume.add(a.to_numpy(zero_copy_only=False), m.to_numpy(zero_copy_only=False) > 0)
                z += 1
        close()
        return self.end(done)

    def finish(self, fs, root: str, counts: dict[str, int]) -> None:
        if self.form != "nifti":
            return
        document = {
            "channel_names": {"0": "MRI"}, "labels": {"background": 0, "lesion": 1}, "numTraining": counts.get("train", 0), "numTest": counts.get("test", 0), "file_ending": ".nii.gz",
            "dataset_name": f"Dataset{self.number:03d}_{self.name}", "dataset_id": self.number,
        }
        with fs.open_output_stream(f"{root}/dataset.json") as f:
            f.write(json.dumps(document, ensure_ascii=False, indent=2).encode())


class VolumeSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "volumes"

    def schema(self) -> str:
        return SLICES

    def reader(self, schema) -> VolumeReader:
        return VolumeReader(self.options)

    def writer(self, schema, overwrite: bool) -> VolumeWriter:
        return VolumeWriter(self.options, overwrite)


def read_volumes(spark: SparkSession, path: str, form: str = "npz", **options) -> DataFrame:
    """Rows of slices (``SLICES``) of the volumes below a path; one that can't be used is a row with an error, after such slices as could be read.

    Masks are 0 or 1, and brought to the image's height and width by nearest neighbour. ``pixels="false"`` leaves images out.
    """
    spark.dataSource.register(VolumeSource)
    return spark.read.format("volumes").options(form=form, **options).load(path)


def accepted(slices: DataFrame) -> DataFrame:
    """Slices of volumes without an error."""
    wrong = slices.where("error is not null").select("path").distinct()
    return slices.where("error is null").join(wrong, "path", "left_anti").drop("error")


def rejected(slices: DataFrame) -> DataFrame:
    """path, case_id and error of volumes that can't be used."""
    return slices.where("error is not null").select("path", "case_id", "error")


def slices_of_pixels(pixels: DataFrame, height: int, width: int, image: str = "v", mask: str = "mask") -> DataFrame:
    """Rows of slices from a pixel table that holds each pixel once."""
    planes = F.array_sort(F.collect_list(F.struct("y", "x", F.col(image).cast("float").alias("v"), F.col(mask).cast("byte").alias("m"))))
    found = pixels.groupBy("case_id", "z").agg(planes.alias("p"))
    return found.select("case_id", F.col("z").cast("int").alias("z"), F.lit(height).alias("height"), F.lit(width).alias("width"), F.col("p.v").alias("image"), F.col("p.m").alias("mask"))


def pixels_of_slices(slices: DataFrame) -> DataFrame:
    """A pixel table (case_id, z, y, x, v, mask) from rows of slices; without images v is null."""
    both = F.arrays_zip(F.coalesce("image", F.transform("mask", lambda m: F.lit(None).cast("float"))).alias("v"), F.col("mask").alias("mask"))
    p = slices.where("z is not null").select("case_id", "z", "width", F.posexplode(both).alias("pos", "c"))
    return p.select("case_id", "z", F.floor(F.col("pos") / F.col("width")).cast("int").alias("y"), (F.col("pos") % F.col("width")).alias("x"), F.col("c.v").alias("v"), F.col("c.mask").cast("int").alias("mask"))


def write_volumes(slices: DataFrame, path: str, form: str = "nifti", overwrite: bool = False, **options) -> None:
    """Volumes from rows of slices (case_id, z, height, width, image, mask and, where they are given, split, mask_height, mask_width).

    A case is written by one task, slice by slice; z counts from 0 without gaps. NIfTI goes to the folders of a data set by split (train, or no split, and others),
    with its document at the end.
    """
    slices.sparkSession.dataSource.register(VolumeSource)
    depth = slices.groupBy("case_id").agg(F.count(F.lit(1)).cast("int").alias("depth"))
    have = set(slices.columns)
    optional = {"split": F.lit(None).cast("string"), "mask_height": F.col("height"), "mask_width": F.col("width")}
    rows = slices.drop("depth").withColumns({c: v for c, v in optional.items() if c not in have}).join(depth, "case_id")
    names = ["case_id", "split", "z", "depth", "height", "width", "mask_height", "mask_width", "image", "mask"]
    rows = rows.select(*names).repartition("case_id").sortWithinPartitions("case_id", "z")
    rows.write.format("volumes").options(form=form, **options).mode("overwrite" if overwrite else "append").save(path)
