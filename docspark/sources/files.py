"""Files as documents: listing, hashing, decoding, routing; and writing documents as JSON."""

from __future__ import annotations

import io
import json
import os
import zipfile
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docspark.functions import text as T
from docspark.plans.local import with_local
from docspark.types import ELEMENT

#: Extensions that a folder is searched for.
IN_FOLDERS = ("pdf", "docx", "md")


def binary_files(spark: SparkSession, path: str, streaming: bool = False) -> DataFrame:
    """(path, length, content) of a folder (searched through), a glob or one file. Only the columns that are used are read."""
    reader = (spark.readStream if streaming else spark.read).format("binaryFile").option("recursiveFileLookup", True)
    reader = reader.option("ignoreCorruptFiles", True).option("ignoreMissingFiles", True)  # `unread` tells them
    if streaming:
        reader = reader.schema("path string, modificationTime timestamp, length long, content binary")
    if os.path.isdir(path.removeprefix("file://")) and not streaming:
        reader = reader.option("pathGlobFilter", f"*.{{{','.join(IN_FOLDERS)}}}")
    return reader.load(path).select("path", "length", "content")


def identified(files: DataFrame) -> DataFrame:
    """`files` with source_hash, document_id, source_type and text (decoded; for formats that are text)."""
    out = files.withColumn("source_hash", T.source_hash("content")).withColumn("document_id", T.document_id("source_hash")).withColumn("source_type", T.source_type("path"))
    return out.withColumn("text", F.when(F.col("source_type").isin("markdown", "html", "text", "ipynb"), T.decode("content")))


def unread(listed: DataFrame, read: DataFrame) -> DataFrame:
    """(path, error_code) of files that a listing names and that could not be read: hash_io_error."""
    return listed.select("path").join(read.select("path"), "path", "left_anti").withColumn("error_code", F.lit("hash_io_error"))


def collisions(files: DataFrame, path: str = "path", order: str | None = None) -> DataFrame:
    """`files` with stem_collision: whether an earlier file has the same name without extension; earlier by the column `order`, as the
    inputs were given, then by path.

    Ranked within the stem; equal stems are files that one output name can't serve, so groups are small.
    """
    stem = F.regexp_replace(F.regexp_extract(F.regexp_replace(path, r"\\", "/"), r"([^/]*)$", 1), r"(?<=.)\.[^.]*$", "")
    rank = F.row_number().over(Window.partitionBy("stem").orderBy(*([order] if order else []), path))
    return files.withColumn("stem", stem).withColumn("stem_collision", rank > 1)


def image_name(document_id: str, ordinal: int, part: str) -> str:
    """The file name of a document's n-th image."""
    return f"image_{document_id.removeprefix('doc-')}_docx_{ordinal:02d}{os.path.splitext(part)[1] or '.bin'}"


def with_images(documents: DataFrame, content: str, folder: str) -> DataFrame:
    """`documents` whose image elements (DOCX) name the files that their images are written to, under `folder`, which all workers share.

    An image without a part in the package, and one that can't be written, keeps its resource_path. Files are written under a
    temporary name first, so a repeated task does no harm.
    """

    def save(elements: list[dict] | None, data: bytes | None, document: str, kind: str | None) -> list[dict] | None:
        images = [e for e in elements or [] if e["type"] == "image" and (e["source_locator"] or {}).get("target_partname")]
        if kind != "docx" or not images:
            return elements
        try:
            os.makedirs(folder, exist_ok=True)
            with zipfile.ZipFile(io.BytesIO(bytes(data))) as package:
                for n, e in enumerate(images):
                    part = e["source_locator"]["target_partname"]
                    target = os.path.join(folder, image_name(document, n, part))
                    try:
                        image = package.read(part.lstrip("/"))
                        with open(f"{target}.{os.getpid()}.part", "wb") as f:
                            f.write(image)
                        os.replace(f"{target}.{os.getpid()}.part", target)
                        e["resource_path"] = target
                    except (KeyError, OSError):
                        continue
        except (zipfile.BadZipFile, TypeError, OSError):
            pass
        return [{**e, "source_locator": e["source_locator"] and {**e["source_locator"], "extra": dict(e["source_locator"].get("extra") or []) or None}} for e in elements]

    return with_local(documents, "elements", f"array<{ELEMENT}>", save, "elements", content, "document_id", "source_type")


def as_json(document: DataFrame, columns: list[str]) -> DataFrame:
    """(value) of each row as a JSON object that keeps null fields."""
    return document.select(F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}).alias("value"))


def write_documents(documents: DataFrame, folder: str, name: str, body: str, path: str) -> DataFrame:
    """(path, error_code) after writing one UTF-8 file `<name>.json` for each row: null, or write_failed.

    A file is written under a temporary name first, so that no half file is left and a repeated task does no harm. `folder` must be
    on storage that all workers share. Written as the result is read: read it once.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = []
            for stem, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                target = os.path.join(folder, f"{stem}.json")
                part = f"{target}.{os.getpid()}.part"
                try:
                    with open(part, "w", encoding="utf-8") as f:
                        f.write(json.dumps(json.loads(text), ensure_ascii=False, indent=2))
                    os.replace(part, target)
                    codes.append(None)
                except OSError:
                    codes.append("write_failed")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(codes, pa.string())], ["path", "error_code"])

    os.makedirs(folder, exist_ok=True)
    return documents.select(path, name, body).mapInArrow(write, "path string, error_code string")


def summary(status: DataFrame, seconds: float, workers: int) -> dict:
    """The batch summary of (path, error_code): counts and one entry for each failed file."""
    n = status.agg(F.count("*").alias("total"), F.count_if(F.col("error_code").isNull()).alias("success")).first()
    failed = status.where("error_code is not null").select("path", "error_code").toLocalIterator()
    return {"total": n.total, "success": n.success, "failed": n.total - n.success, "workers": workers, "wall_time_seconds": round(seconds, 3), "errors": [{"file": r.path, "code": r.error_code} for r in failed]}
