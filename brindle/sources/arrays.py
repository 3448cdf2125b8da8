"""Rasters in .npy files: written in bands of rows as a data source, read by Spark's reader of binary files.

A file holds the rows of one image from the number after ``@`` in its name on, or from 0 on without one; image
ids are quoted as in addresses. A task holds one band at a time. Bands are written to a temporary folder beside the
others and renamed once all tasks are done, so a lost executor or a failed job leaves no half of an image; a band
that is written again replaces the old one.
"""

from __future__ import annotations

import io
import os
import re
import shutil
import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import quote, unquote

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

BAND = 256


def shared_path(path: str) -> str:
    """The folder's path for Python's files; it must be mounted on the driver and all executors."""
    if re.match(r"file:", path):
        return re.sub(r"^file:/*", "/", path)
    if re.match(r"[a-z][a-z0-9+.-]*:", path):
        raise ValueError(f"arrays are written to a mounted folder, not to {path}")
    return path


@dataclass
class Written(WriterCommitMessage):
    names: list[str]


class BandWriter(DataSourceArrowWriter):
    def __init__(self, path: str):
        self.path, self.aside = path, f"{path}/_bands-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        names, key, parts = [], None, []
        os.makedirs(self.aside, exist_ok=True)
        for batch in iterator:
            rows = batch.to_pandas()
            new = np.flatnonzero((rows.image_id != rows.image_id.shift()) | (rows.band != rows.band.shift()))
            for a, b in zip(new, [*new[1:], len(rows)], strict=True):
                here = (rows.image_id.iloc[a], rows.band.iloc[a])
                if parts and here != key:
                    names.append(self.save(parts))
                    parts = []
                key = here
                parts.append(rows.iloc[a:b])
        if parts:
            names.append(self.save(parts))
        return Written(names)

    def save(self, parts: list[pd.DataFrame]) -> str:
        rows = pd.concat(parts, ignore_index=True)
        height, width = rows.y.iloc[-1] - rows.y.iloc[0] + 1, rows.x.iloc[-1] + 1
        if len(rows) != height * width or not (rows.x.to_numpy() == np.tile(np.arange(width), height)).all():
            raise ValueError(f"image {rows.image_id.iloc[0]} has gaps or repeated pixels from row {rows.y.iloc[0]} on")
        name = f"{quote(rows.image_id.iloc[0], safe='')}@{rows.y.iloc[0]}.npy"
        once = f"{self.aside}/{uuid.uuid4().hex}"  # an attempt that is repeated has its own file
        with open(once, "wb") as f:
            np.save(f, rows.value.to_numpy().reshape(height, width), allow_pickle=False)
        return f"{os.path.basename(once)} {name}"

    def commit(self, messages: list[Written | None]) -> None:
        for message in filter(None, messages):
            for pair in message.names:
                once, name = pair.split(" ", 1)
                os.replace(f"{self.aside}/{once}", f"{self.path}/{name}")
        shutil.rmtree(self.aside, ignore_errors=True)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.aside, ignore_errors=True)


class ArrayBands(DataSource):
    @classmethod
    def name(cls) -> str:
        return "array_bands"

    def writer(self, schema, overwrite: bool) -> BandWriter:
        return BandWriter(shared_path(self.options["path"]))


def write_arrays(pixels: DataFrame, path: str, value: str, band: int = BAND) -> None:
    """Writes pixels (image_id, y, x, value) as files of ``band`` rows; images are rectangles from row and column 0 on, without gaps or nulls."""
    pixels.sparkSession.dataSource.register(ArrayBands)
    rows = pixels.select(F.col("image_id").cast("string").alias("image_id"), F.floor(F.col("y") / band).alias("band"), F.col("y").cast("long").alias("y"), F.col("x").cast("long").alias("x"), F.col(value).alias("value"))
    rows = rows.repartition("image_id", "band").sortWithinPartitions("image_id", "band", "y", "x")
    rows.write.format("array_bands").mode("append").option("path", path).save()


def _rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for batch in batches:
        for path, content in zip(batch.path, batch.content, strict=True):
            stem = unquote(path.rsplit("/", 1)[1])[: -len(".npy")]  # Spark quotes a path once more
            image, _, first = stem.rpartition("@") if re.search(r"@\d+$", stem) else (stem, "", "0")
            array = np.load(io.BytesIO(content), allow_pickle=False)
            if array.ndim != 2:
                raise ValueError(f"{path} has {array.ndim} dimensions instead of 2")
            for at in range(0, len(array), 64):
                part = array[at : at + 64]
                yield pd.DataFrame({"image_id": unquote(image), "y": np.arange(len(part)) + at + int(first), "values": list(part)})


def read_arrays(spark: SparkSession, path: str, kind: str = "long") -> DataFrame:
    """(image_id, y, x, value) of all .npy files of a folder, of two dimensions each; ``kind`` is the value's type. The folder may be at any path that Spark reads."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.npy").load(path).select("path", "content")
    rows = files.mapInPandas(_rows_of, f"image_id string, y long, values array<{kind}>")
    return rows.select("image_id", "y", F.posexplode("values").alias("x", "value")).withColumn("x", F.col("x").cast("long"))
