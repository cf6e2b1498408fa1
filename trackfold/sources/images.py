"""Image files: PNG and TIFF read and written without an image library, 8 and 16 bits."""

from __future__ import annotations

import struct
import zlib

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trackfold import schema

_SIGN = b"\x89PNG\r\n\x1a\n"


def read_png(raw: bytes) -> np.ndarray:
    """Grey or colour (made grey by its mean), not interlaced; depth unchanged."""
    if raw[:8] != _SIGN:
        raise ValueError("not a PNG file")
    at, head, data = 8, None, []
    while at + 8 <= len(raw):
        size, kind = struct.unpack(">I4s", raw[at : at + 8])
        body = raw[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", body)
        elif kind == b"IDAT":
            data.append(body)
        at += 12 + size
    if head is None:
        raise ValueError("no header")
    w, h, depth, colour, _, _, interlace = head
    if interlace or depth not in (8, 16) or colour not in (0, 2, 4, 6):
        raise ValueError("unsupported kind of PNG")
    channels = {0: 1, 2: 3, 4: 2, 6: 4}[colour]
    bpp = channels * depth // 8
    lines = np.frombuffer(zlib.decompress(b"".join(data)), dtype=np.uint8).reshape(h, 1 + w * bpp)
    out = np.zeros((h, w * bpp), dtype=np.uint8)
    above = np.zeros(w * bpp, dtype=np.uint8)
    for y in range(h):
        how, line = lines[y, 0], lines[y, 1:].copy()
        if how == 1:
            line = np.cumsum(line.reshape(-1, bpp), axis=0, dtype=np.uint8).ravel()
        elif how == 2:
            line = line + above
        elif how in (3, 4):
            for i in range(len(line)):
                a, b = int(line[i - bpp]) if i >= bpp else 0, int(above[i])
                if how == 3:
                    guess = (a + b) // 2
                else:
                    c = int(above[i - bpp]) if i >= bpp else 0
                    guess = min((a, b, c), key=lambda v, p=a + b - c: abs(p - v))
                line[i] = (int(line[i]) + guess) & 255
        elif how:
            raise ValueError("unknown filter")
        out[y] = above = line
    a = out.reshape(h, w, channels, depth // 8)
    a = a[..., 0] if depth == 8 else (a[..., 0].astype(np.uint16) << 8) | a[..., 1]
    colours = a[..., : 3 if channels >= 3 else 1]
    return colours[..., 0] if colours.shape[2] == 1 else colours.mean(axis=2).astype(a.dtype)


def write_png(a: np.ndarray) -> bytes:
    depth = {1: 8, 2: 16}[a.dtype.itemsize]
    lines = np.ascontiguousarray(a.astype(a.dtype.newbyteorder(">"))).view(np.uint8).reshape(a.shape[0], -1)
    body = np.concatenate([np.zeros((len(lines), 1), np.uint8), lines], axis=1).tobytes()
    chunk = lambda k, b: struct.pack(">I", len(b)) + k + b + struct.pack(">I", zlib.crc32(k + b))
    return _SIGN + chunk(b"IHDR", struct.pack(">IIBBBBB", a.shape[1], a.shape[0], depth, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(body)) + chunk(b"IEND", b"")


def read_tiff(raw: bytes) -> np.ndarray:
    """The first image: grey, in strips, plain or deflated, of any integer or floating type."""
    e = {b"II": "<", b"MM": ">"}.get(raw[:2])
    if e is None or struct.unpack(e + "H", raw[2:4])[0] != 42:
        raise ValueError("not a TIFF file")
    at = struct.unpack(e + "I", raw[4:8])[0]
    tags = {}
    for i in range(struct.unpack(e + "H", raw[at : at + 2])[0]):
        tag, kind, n = struct.unpack(e + "HHI", raw[at + 2 + 12 * i : at + 10 + 12 * i])
        item = {1: "B", 3: "H", 4: "I"}.get(kind)
        if item:
            size = struct.calcsize(item) * n
            place = at + 10 + 12 * i if size <= 4 else struct.unpack(e + "I", raw[at + 10 + 12 * i : at + 14 + 12 * i])[0]
            tags[tag] = struct.unpack(e + item * n, raw[place : place + size])
    w, h = tags[256][0], tags[257][0]
    bits, how, kind = tags.get(258, (1,))[0], tags.get(259, (1,))[0], tags.get(339, (1,))[0]
    if how not in (1, 8, 32946) or bits not in (8, 16, 32, 64):
        raise ValueError("unsupported kind of TIFF")
    strips = [raw[o : o + n] for o, n in zip(tags[273], tags[279], strict=True)]
    data = b"".join(zlib.decompress(s) if how != 1 else s for s in strips)
    kind = {1: "u", 2: "i", 3: "f"}[kind]
    samples = tags.get(277, (1,))[0]
    a = np.frombuffer(data, dtype=np.dtype(f"{e}{kind}{bits // 8}"), count=w * h * samples).reshape(h, w, samples)
    return a[..., 0].astype(f"{kind}{bits // 8}") if samples == 1 else a.mean(axis=2).astype(f"{kind}{bits // 8}")


def write_tiff(a: np.ndarray) -> bytes:
    kind = {"u": 1, "i": 2, "f": 3}[a.dtype.kind]
    data = np.ascontiguousarray(a.astype(a.dtype.newbyteorder("<"))).tobytes()
    tags = [(256, a.shape[1]), (257, a.shape[0]), (258, a.dtype.itemsize * 8), (259, 1), (262, 1), (273, 8), (277, 1), (278, a.shape[0]), (279, len(data)), (339, kind)]
    return b"II*\0" + struct.pack("<I", 8 + len(data)) + data + struct.pack("<H", len(tags)) + b"".join(struct.pack("<HHII", t, 4, 1, v) for t, v in tags) + struct.pack("<I", 0)


def decode(raw: bytes) -> np.ndarray:
    return read_png(raw) if raw[:8] == _SIGN else read_tiff(raw)


def frames(spark: SparkSession, manifest: DataFrame, folder: str) -> DataFrame:
    """A manifest (label, time_index, z_index, time_s, frame_label, path) with the files under a folder, decoded. A file that cannot be read stays as a row with a null image and its fault in `corrupt`; files are never deleted. A missing frame_label is the index."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select(F.regexp_extract("path", r"[^/]+$", 0).alias("_name"), "content")
    out = T.StructType([*schema.FRAMES.fields, T.StructField("corrupt", T.StringType())])

    def run(batches):
        for b in batches:
            rows = []
            for r in b.itertuples():
                image = fault = None
                try:
                    if r.content is None:
                        raise ValueError("no such file")
                    a = decode(bytes(r.content))
                    image = {"h": a.shape[0], "w": a.shape[1], "dtype": a.dtype.name, "px": a.astype(a.dtype.newbyteorder("<")).tobytes()}
                except (ValueError, KeyError, IndexError, struct.error, zlib.error) as e:
                    fault = str(e)
                rows.append((r.label, r.time_index, r.z_index, r.time_s, r.frame_label, image, fault))
            yield pd.DataFrame(rows, columns=out.names)

    m = manifest.select("label", F.col("time_index").cast("int"), F.col("z_index").cast("int").alias("z_index"), F.col("time_s").cast("double"), F.coalesce("frame_label", F.col("time_index").cast("string")).alias("frame_label"), F.regexp_extract("path", r"[^/]+$", 0).alias("_name"))
    return m.join(files, "_name", "left").select("label", "time_index", "z_index", "time_s", "frame_label", "content").mapInPandas(run, out)


def checked(manifest: DataFrame) -> DataFrame:
    """Labels whose numbers of files and of times differ."""
    return manifest.groupBy("label").agg(F.count("path").alias("files"), F.count("time_s").alias("times")).where("files <> times")


def encoded(images: DataFrame) -> DataFrame:
    """Rows with an `image` to rows with a `png` and a name that holds the label, so that names of different labels do not meet."""

    def run(batches):
        for b in batches:
            png = [write_png(np.frombuffer(x["px"], dtype=np.dtype(x["dtype"]).newbyteorder("<")).reshape(x["h"], x["w"]).astype(x["dtype"])) for x in (i if isinstance(i, dict) else i.asDict() for i in b["image"])]
            yield pd.DataFrame({"label": b["label"], "time_index": b["time_index"], "png": png})

    return images.select("label", "time_index", "image").mapInPandas(run, "label string, time_index int, png binary").withColumn("name", F.format_string("%s/%d.png", "label", "time_index"))
