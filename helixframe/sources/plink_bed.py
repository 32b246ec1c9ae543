"""PLINK binary genotypes as a Spark data source: partitions of marker ranges, two bits a genotype, marker-major.

``spark.dataSource.register(PlinkBed)`` then
``spark.read.format("plink_bed").option("individuals", n).option("markers", m).load(path)`` gives (marker, dosages: array<double>).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

MAGIC = bytes((108, 27, 1))
#: Dosage of allele 1 by two-bit code 00, 01, 10, 11.
DOSAGE = (2.0, None, 1.0, 0.0)
MARKERS_A_PARTITION = 4096


class Range(InputPartition):
    def __init__(self, start: int, end: int) -> None:
        self.start, self.end = start, end


def decode(data: bytes, individuals: int) -> list[list[float | None]]:
    """Dosages of whole marker blocks."""
    size = -(-individuals // 4)
    codes = np.frombuffer(data, np.uint8).reshape(-1, size)
    bits = np.stack([(codes >> s) & 3 for s in (0, 2, 4, 6)], axis=2).reshape(len(codes), -1)[:, :individuals]
    return [[DOSAGE[c] for c in row] for row in bits]


def encode(rows: list[list[float | None]]) -> bytes:
    """The inverse, with the header; dosages are rounded to the nearest genotype."""
    code = {2: 0, None: 1, 1: 2, 0: 3}
    out = bytearray(MAGIC)
    for row in rows:
        codes = [code[None if d is None else int(d + 0.5)] for d in row]
        codes += [0] * (-len(codes) % 4)
        out += bytes(a | b << 2 | c << 4 | d << 6 for a, b, c, d in zip(codes[::4], codes[1::4], codes[2::4], codes[3::4]))
    return bytes(out)


class Reader(DataSourceReader):
    def __init__(self, options) -> None:
        self.path, self.individuals, self.markers = options["path"], int(options["individuals"]), int(options["markers"])

    def partitions(self):
        return [Range(i, min(i + MARKERS_A_PARTITION, self.markers)) for i in range(0, self.markers, MARKERS_A_PARTITION)]

    def read(self, partition: Range):
        size = -(-self.individuals // 4)
        with open(self.path.removeprefix("file://"), "rb") as f:
            if f.read(3) != MAGIC:
                raise ValueError(f"{self.path} is no marker-major bed file")
            f.seek(3 + partition.start * size)
            data = f.read((partition.end - partition.start) * size)
        for i, row in enumerate(decode(data, self.individuals)):
            yield partition.start + i, row


class PlinkBed(DataSource):
    @classmethod
    def name(cls) -> str:
        return "plink_bed"

    def schema(self) -> str:
        return "marker long, dosages array<double>"

    def reader(self, schema) -> Reader:
        return Reader(self.options)
