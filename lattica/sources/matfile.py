"""Snapshots in MAT files (level 5): a parser of the public format, and a scan that gives a row for each file."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .snapshots import frame_of_path

#: Fixed values of the format: element types to number types, and the classes that aren't plain numbers.
NUMBERS = {1: "i1", 2: "u1", 3: "i2", 4: "u2", 5: "i4", 6: "u4", 7: "f4", 9: "f8", 12: "i8", 13: "u8", 16: "u1", 17: "u2", 18: "u4"}
MATRIX, COMPRESSED = 14, 15
CELL, STRUCT, CHAR, SPARSE = 1, 2, 4, 5
COMPLEX = 0x0800

#: Variables of a snapshot, and the columns of read_mat that hold them.
FLAT = {"hypos": ("hypos", "int"), "hyposCard": ("hypos_card", "int"), "clusters": ("clusters", "int"), "clustersCard": ("clusters_card", "int"), "probLogHypos": ("log_probs", "double")}
NESTED = {"predX": "pred_x", "predZ": "pred_z", "predP": "pred_p", "predS": "pred_s"}
SCHEMA = (
    "path string, n_tracks int, n_meas int, matrix array<array<double>>, assoc array<array<int>>, "
    + ", ".join(f"{c} array<{t}>" for c, t in FLAT.values())
    + ", pred_x array<array<double>>, pred_z array<array<double>>, pred_p array<array<array<double>>>, pred_s array<array<array<double>>>"
)


def _elements(data: bytes, order: str) -> Iterator[tuple[int, bytes]]:
    """(type, content) of elements in a row; compressed ones are opened."""
    at = 0
    while at + 8 <= len(data):
        kind, size = struct.unpack_from(order + "II", data, at)
        if kind >> 16:  # a small element: its size and content share the tag
            yield kind & 0xFFFF, data[at + 4 : at + 4 + (kind >> 16)]
            at += 8
            continue
        content = data[at + 8 : at + 8 + size]
        if len(content) < size:
            raise ValueError("the file ends inside an element")
        if kind == COMPRESSED:
            yield from _elements(zlib.decompress(content), order)
            at += 8 + size
        else:
            yield kind, content
            at += 8 + size + -size % 8


def _number(element: tuple[int, bytes], order: str) -> np.ndarray:
    return np.frombuffer(element[1], order + NUMBERS[element[0]])


def _matrix(content: bytes, order: str, names: set[str] | None = None) -> tuple[str, object]:
    """Name and value of an array; the value is None if names are given and it isn't among them."""
    if not content:
        return "", np.zeros((0, 0))
    parts = list(_elements(content, order))
    flags, shape, name = int(_number(parts[0], order)[0]), tuple(_number(parts[1], order).tolist()), parts[2][1].decode()
    kind, rest = flags & 0xFF, parts[3:]
    if names is not None and name not in names:
        return name, None
    if kind == CELL:
        cells = np.empty(len(rest), object)
        cells[:] = [_matrix(c, order)[1] for _, c in rest]
        return name, cells.reshape(shape, order="F")
    if kind == STRUCT:
        width = int(_number(rest[0], order)[0])
        fields = [rest[1][1][i : i + width].split(b"\0")[0].decode() for i in range(0, len(rest[1][1]), width)]
        items = np.empty(int(np.prod(shape)), object)
        values = [_matrix(c, order)[1] for _, c in rest[2:]]
        items[:] = [dict(zip(fields, values[i * len(fields) : (i + 1) * len(fields)], strict=True)) for i in range(len(items))]
        return name, items.reshape(shape, order="F")
    if kind == SPARSE:
        rows, ends, data = (_number(r, order) for r in rest[:3])
        out = np.zeros(shape, data.dtype)
        n = int(ends[-1])
        out[rows[:n], np.repeat(np.arange(shape[1]), np.diff(ends))] = data[:n]
        return name, out
    if kind == CHAR:
        codes = _number(rest[0], order) if rest else np.zeros(0, "u1")
        return name, "".join(map(chr, codes.tolist()))
    data = _number(rest[0], order) if rest else np.zeros(0)
    if flags & COMPLEX:
        data = data + 1j * _number(rest[1], order)
    return name, data.reshape(shape, order="F")


def parse(data: bytes, names: Iterable[str] | None = None) -> dict[str, object]:
    """The variables of a file: numbers as arrays, cells and structs (dictionaries) as object arrays, characters as a string.
    With names, others are passed over."""
    mark = data[126:128]
    if mark not in (b"IM", b"MI"):
        raise ValueError("not a MAT file of level 5")
    order, wanted = "<" if mark == b"IM" else ">", None if names is None else set(names)
    found = (_matrix(c, order, wanted) for kind, c in _elements(data[128:], order) if kind == MATRIX)
    return {name: value for name, value in found if value is not None}


def _row(path: str, ws: dict[str, object]) -> dict[str, object]:
    n, m = ws["trackFile"].shape[1], ws["measurements"].shape[1]
    out = {"path": path, "n_tracks": n, "n_meas": m, "matrix": ws["gainMatPostC"][:n, : n + m].astype(float).tolist()}
    out["assoc"] = ws["assocLocal"].astype(int).tolist() if "assocLocal" in ws else None
    for name, (column, kind) in FLAT.items():
        out[column] = ws[name].ravel(order="F").astype(int if kind == "int" else float).tolist()
    for name, column in NESTED.items():  # one entry for each track, which is the last axis
        out[column] = np.moveaxis(ws[name].astype(float), -1, 0).tolist() if name in ws else None
    return out


def read_mat(spark: SparkSession, path: str) -> DataFrame:
    """A row for each *.mat file below a path: frame (the number in its name) and SCHEMA. `matrix` suits to_reward(), the flat
    columns decode_hypotheses(). Variables that aren't used are passed over; a file that isn't level 5 is an error that names it.

    A file is a row, so it's held in memory by one task; files are spread over tasks by size, as any scan's."""
    names = {"trackFile", "measurements", "gainMatPostC", "assocLocal", *FLAT, *NESTED}

    def run(batches):
        for batch in batches:
            for p, content in zip(batch["path"], batch["content"], strict=True):
                try:
                    row = _row(p, parse(bytes(content), names))
                except (ValueError, KeyError, struct.error, zlib.error) as e:
                    raise ValueError(f"{p}: {e}") from e
                yield pd.DataFrame([row])

    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.mat").option("recursiveFileLookup", "true").load(path)
    return files.select("path", "content").mapInPandas(run, SCHEMA).withColumn("frame", frame_of_path(F.col("path")))


def cluster_map(snapshots: DataFrame) -> DataFrame:
    """CLUSTER_MAP rows of `assoc`: its first row has each cluster's master, from 1; its second, whether it is one."""
    cells = snapshots.select("frame", F.posexplode(F.arrays_zip(F.col("assoc")[0].alias("master"), F.col("assoc")[1].alias("is"))).alias("cluster", "x"))
    return cells.select("frame", F.col("cluster").cast("int"), (F.col("x.master") - 1).cast("int").alias("master"), (F.col("x.is") > 0).alias("is_master"))
