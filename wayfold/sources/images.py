"""Folders of image files: reading, size and checksum by expressions, and a writer."""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed values of the PNG format: the first eight bytes of a file, and the hex form of them with the header chunk's length and name.
SIGNATURE = b"\x89PNG\r\n\x1a\n"
_START = (SIGNATURE + b"\0\0\0\x0dIHDR").hex().upper()


def scan_images(spark: SparkSession, folder: str, pattern: str = "*.png") -> DataFrame:
    """(file_name, n_bytes, payload): every matching file, payload as one-line base64."""
    return _files(spark, folder, pattern).select("file_name", "n_bytes", _one_line(F.col("content")).alias("payload"))


def scan_image_parts(spark: SparkSession, folder: str, pattern: str = "*.png", part_bytes: int = 3 << 20) -> DataFrame:
    """(file_name, n_bytes, width, height, intact, part, payload): matching files with payloads of bounded size.

    A payload holds at most ``part_bytes`` bytes of its file, so the payloads of a file joined in order are its
    base64 text, as long as ``part_bytes`` is a multiple of three. Width, height and ``intact`` come from the header
    chunk: ``intact`` is false where its checksum is wrong, and all three are NULL where a file is no PNG.
    Files without a byte give no row, because Spark's file scan leaves them out.
    """
    if part_bytes < 3 or part_bytes % 3:
        raise ValueError("part_bytes must be a multiple of three")
    files = _files(spark, folder, pattern)
    is_png = F.hex(F.substring("content", 1, 16)) == _START
    facts = {
        "width": F.when(is_png, _number(17)),
        "height": F.when(is_png, _number(21)),
        "intact": F.when(is_png, F.crc32(F.substring("content", 13, 17)) == _number(30)),
    }
    last = F.ceil(F.col("n_bytes") / part_bytes) - 1
    parts = files.withColumns(facts).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), last)))
    piece = F.substring(F.col("content"), (F.col("part") * part_bytes + 1).cast("int"), F.lit(part_bytes))
    return parts.select("file_name", "n_bytes", *facts, "part", _one_line(piece).alias("payload"))


def _files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    found = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
    return found.select(F.element_at(F.split("path", "/"), -1).alias("file_name"), F.col("length").alias("n_bytes"), "content")


def _one_line(content: Column) -> Column:
    return F.regexp_replace(F.base64(content), "\\s", "")


def _number(at: int) -> Column:
    """The four bytes of the content from a place, the first being 1, as a whole number."""
    return F.conv(F.hex(F.substring("content", at, 4)), 16, 10).cast("long")


def gray_png(pixels: bytes, width: int) -> bytes:
    """A PNG of 8-bit grey pixels in rows of ``width``; the last row must be full."""
    rows = [b"\0" + pixels[k : k + width] for k in range(0, len(pixels), width)]
    header = struct.pack(">IIBBBBB", width, len(rows), 8, 0, 0, 0, 0)
    chunks = ((b"IHDR", header), (b"IDAT", zlib.compress(b"".join(rows), 0)), (b"IEND", b""))
    told = [struct.pack(">I", len(d)) + n + d + struct.pack(">I", zlib.crc32(n + d)) for n, d in chunks]
    return SIGNATURE + b"".join(told)


def write_images(df: DataFrame, folder: str) -> DataFrame:
    """Write each (file_name, pixels) as a one-row grey PNG into a shared folder; gives (file_name, n_bytes) lazily.

    Every task writes its own rows, and a task that runs again writes the same files again. Rows need unique names.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        place, root = fs.FileSystem.from_uri(folder if "://" in folder else f"file://{folder.removeprefix('file:')}")
        place.create_dir(root, recursive=True)
        for batch in batches:
            sizes = []
            for name, pixels in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                image = gray_png(pixels, len(pixels))
                with place.open_output_stream(f"{root}/{name}") as out:
                    out.write(image)
                sizes.append(len(image))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["file_name", "n_bytes"])

    return df.select("file_name", "pixels").mapInArrow(write, "file_name string, n_bytes long")
