"""Readers and writers: uncompressed LAS, GeoJSON areas, xyz text, PLY meshes, CityJSON."""

from __future__ import annotations

import json
import struct
from pathlib import PurePosixPath

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LAS_SCHEMA = "tile_id string, point_id long, x_mm long, y_mm long, z_mm long, return_number int, number_of_returns int, classification int"


def parse_las(raw: bytes) -> pd.DataFrame:
    """Points of an uncompressed LAS 1.2 to 1.4 file (point formats 0 to 8), coordinates in millimetres."""
    if raw[:4] != b"LASF":
        raise ValueError("not a LAS file")
    offset, kind, length = struct.unpack_from("<I", raw, 96)[0], raw[104], struct.unpack_from("<H", raw, 105)[0]
    if kind & 0x80 or kind > 8:
        raise ValueError(f"point format {kind & 0x7F} is compressed or unknown")
    count = struct.unpack_from("<Q", raw, 247)[0] if raw[25] >= 4 else struct.unpack_from("<I", raw, 107)[0]
    scale, shift = np.array(struct.unpack_from("<3d", raw, 131)), np.array(struct.unpack_from("<3d", raw, 155))
    rows = np.frombuffer(raw, np.uint8, count * length, offset).reshape(count, length)
    xyz = np.ascontiguousarray(rows[:, :12]).view("<i4").astype(np.float64) * scale + shift
    new = kind >= 6
    flags = rows[:, 14]
    mm = np.rint(xyz * 1000).astype(np.int64)
    return pd.DataFrame({
        "x_mm": mm[:, 0], "y_mm": mm[:, 1], "z_mm": mm[:, 2], "return_number": (flags & (15 if new else 7)).astype(np.int32),
        "number_of_returns": ((flags >> 4) if new else (flags >> 3) & 7).astype(np.int32), "classification": (rows[:, 16] if new else rows[:, 15] & 31).astype(np.int32)})


def write_las_bytes(points: pd.DataFrame, scale: float = 0.001) -> bytes:
    """A LAS 1.4 file of point format 6."""
    n = len(points)
    rows = np.zeros((n, 30), np.uint8)
    rows[:, :12] = np.ascontiguousarray(np.rint(points[["x_mm", "y_mm", "z_mm"]].to_numpy() / 1000 / scale).astype("<i4")).view(np.uint8).reshape(n, 12)
    rows[:, 14] = points.return_number.to_numpy() | points.number_of_returns.to_numpy() << 4
    rows[:, 16] = points.classification.to_numpy()
    head = bytearray(375)
    head[:4], head[24], head[25], head[104] = b"LASF", 1, 4, 6
    struct.pack_into("<HII", head, 94, 375, 375, 0)
    struct.pack_into("<HI", head, 105, 30, 0)
    struct.pack_into("<3d", head, 131, scale, scale, scale)
    struct.pack_into("<Q", head, 247, n)
    return bytes(head) + rows.tobytes()


def read_las(spark: SparkSession, path: str) -> DataFrame:
    """One row per point of all LAS files under path; tile_id is the file's name, point_id its place in the file."""

    def run(batches):
        for b in batches:
            for path, raw in zip(b.path, b.content, strict=True):
                p = parse_las(raw)
                yield p.assign(tile_id=PurePosixPath(path).stem, point_id=np.arange(len(p)))[[c.split()[0] for c in LAS_SCHEMA.split(", ")]]

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInPandas(run, LAS_SCHEMA)


def read_area(spark: SparkSession, path: str, first_only: bool = False) -> DataFrame:
    """Edges (part, ring, seq, x1, y1, x2, y2 in mm) of the polygons of a GeoJSON file; first_only: of the first feature."""
    text = "".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    rows, part = [], 0
    for feature in json.loads(text)["features"][: 1 if first_only else None]:
        g = feature["geometry"]
        if g["type"] not in ("Polygon", "MultiPolygon"):
            raise ValueError(f"{g['type']} is not an area")
        for polygon in g["coordinates"] if g["type"] == "MultiPolygon" else [g["coordinates"]]:
            for r, ring in enumerate(polygon):
                mm = [(round(p[0] * 1000), round(p[1] * 1000)) for p in ring]
                rows += [(part, r, i, *a, *b) for i, (a, b) in enumerate(zip(mm, mm[1:], strict=False))]
            part += 1
    return spark.createDataFrame(rows, "part int, ring int, seq int, x1 long, y1 long, x2 long, y2 long")


def xyz_lines(points: DataFrame, *before: str) -> DataFrame:
    """Lines of the columns named and x y z in metres with six decimals."""
    parts = [F.col(c).cast("string") for c in before] + [F.format_string("%.6f", F.col(f"{a}_mm") / 1000.0) for a in "xyz"]
    return points.select(F.concat_ws(" ", *parts).alias("value"))


def read_xyz(spark: SparkSession, path: str) -> DataFrame:
    """x y z text in metres -> millimetres; lines that are not three numbers are left out."""
    cells = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(cells) >= 3).select(*(F.expr(f"try_cast(get(split(trim(value), '[ \t]+'), {i}) as double)").alias(a) for i, a in enumerate("xyz")))
    return rows.dropna().select(*(F.bround(F.col(a) * 1000).cast("long").alias(f"{a}_mm") for a in "xyz"))


def ply_lines(vertices: np.ndarray, faces: np.ndarray) -> str:
    """An ASCII PLY mesh."""
    head = ["ply", "format ascii 1.0", f"element vertex {len(vertices)}", *(f"property double {a}" for a in "xyz"), f"element face {len(faces)}", "property list uchar int vertex_indices", "end_header"]
    return "\n".join([*head, *(" ".join(f"{v:.6f}" for v in row) for row in vertices), *("3 " + " ".join(map(str, f)) for f in faces)]) + "\n"
