"""Image files: a sink that checks what it has written, and the way back."""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator

import pandas as pd
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evidentia.functions.extract import path_stem
from evidentia.functions.images import _images, decoded_png, in_image_batches, png_bytes, png_image

WRITTEN = "name string, length bigint, crc32 bigint, error string"


def write_images(df: DataFrame, name: str, image: str, folder: str, *, overwrite: bool = False) -> DataFrame:
    """Writes each image as <name>.png below `folder`; a row per image with its length, checksum and error.

    A file is written under a name of its task's attempt, read back and compared with the image, and only then gets its
    own name, so readers and repeated attempts see whole files alone. Without `overwrite` a file that is there and can
    be read stays. An image that can't be written leaves its error in its row and no file. The work is done when the
    result is read; names must be unique."""

    def write(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = fs.FileSystem.from_uri(folder)
        store.create_dir(root, recursive=True)
        for frame in frames:
            rows = []
            for n, pixels in zip(frame["name"], _images(frame), strict=True):
                target, part = f"{root}/{n}.png", f"{root}/_{uuid.uuid4().hex}.part"
                try:
                    if pixels is None or n is None:
                        raise ValueError("no image")
                    there = store.get_file_info(target).type == fs.FileType.File
                    if there and not overwrite and png_image(held := store.open_input_stream(target).read()) is not None:
                        rows.append((n, len(held), zlib.crc32(held), None))
                        continue
                    data = png_bytes(pixels)
                    with store.open_output_stream(part) as out:
                        out.write(data)
                    with store.open_input_stream(part) as file:
                        again = png_image(file.read())
                    if again is None or again.tobytes() != pixels.tobytes():
                        raise OSError("what was written is not the image")
                    store.move(part, target)
                    rows.append((n, len(data), zlib.crc32(data), None))
                except (OSError, ValueError) as e:
                    rows.append((n, None, None, str(e)))
            yield pd.DataFrame(rows, columns=["name", "length", "crc32", "error"]).astype({"length": "Int64", "crc32": "Int64"})

    pixels = F.col(image)
    flat = in_image_batches(df).select(F.col(name).cast("string").alias("name"), pixels["height"].alias("height"), pixels["width"].alias("width"), pixels["data"].alias("data"))
    return flat.mapInPandas(write, WRITTEN)


def read_images(spark: SparkSession, folder: str) -> DataFrame:
    """name (of the file, without its ending) and image (NULL where it can't be read) of the PNG files below a folder."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.png").load(folder)
    read = in_image_batches(files).select(path_stem(F.col("path")).alias("name"), decoded_png()("content").alias("image"))
    return read.withColumn("image", F.when(F.col("image.data").isNotNull(), F.col("image")))
