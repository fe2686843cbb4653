"""Images: duplicates, references, alternative text, size, names, dimensions, licences."""

from __future__ import annotations

import struct

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillscan.functions.regex import java
from quillscan.functions.text import casefold
from quillscan.functions.udf import vectorized
from quillscan.operators._findings import exploded, findings, union
from quillscan.tables import Tables

# Fixed values.
SUFFIXES = [".png", ".jpg", ".jpeg", ".gif", ".webp", ".svg", ".avif"]
GENERIC_NAME = java(r"^(?:image|img|photo|picture|scan|untitled|dsc)[_ -]?\d*$")
LICENCE_KEYS = ["license", "licence", "rights", "copyright"]
FRAME_MARKERS = [0xC0, 0xC1, 0xC2, 0xC3, 0xC5, 0xC6, 0xC7, 0xC9, 0xCA, 0xCB, 0xCD, 0xCE, 0xCF]
ACTION = "Review this image resource and its EPUB manifest or HTML references."
INVENTORY_ACTION = "Confirm the resource inventory and intended image coverage."


def dimensions_of(data: bytes | None) -> tuple[int, int] | None:
    """Width and height from the header of a PNG, GIF or JPEG file; None for others and for broken ones."""
    data = data or b""
    if data[:8] == b"\x89PNG\r\n\x1a\n":
        return struct.unpack(">II", data[16:24]) if len(data) >= 24 else None
    if data[:6] in (b"GIF87a", b"GIF89a"):
        return struct.unpack("<HH", data[6:10]) if len(data) >= 10 else None
    if data[:2] != b"\xff\xd8":
        return None
    at = 2
    while at + 4 <= len(data):
        at = data.find(b"\xff", at)
        if at < 0 or at + 4 > len(data):
            return None
        if data[at + 1] in FRAME_MARKERS:
            if at + 9 > len(data):
                return None
            height, width = struct.unpack(">HH", data[at + 5 : at + 9])
            return width, height
        at += 2 + struct.unpack(">H", data[at + 2 : at + 4])[0]
    return None


@vectorized("width int, height int")
def dimensions(content: pd.Series) -> pd.DataFrame:
    return pd.DataFrame([dimensions_of(c) or (None, None) for c in content], columns=["width", "height"])


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def suffix(path: Column) -> Column:
    """Last suffix of the file name with its dot; none for a name that only begins with one."""
    return F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(file_name(path), r"(?<=.)\.[^.]+$", "")


def inventory(tables: Tables) -> DataFrame:
    path = F.col("path")
    return tables.resources.where(F.col("media_type").startswith("image/") | F.lower(suffix(path)).isin(SUFFIXES))


def detect(tables: Tables, rules=None) -> DataFrame:
    images = inventory(tables)
    hashed = F.trim("sha256")
    shared = images.where(hashed != "").groupBy("book_id", hashed.alias("h")).agg(F.count(F.lit(1)).alias("copies")).where("copies > 1").drop("copies")
    rows = images.withColumn("h", hashed).join(shared.withColumn("duplicate", F.lit(True)), ["book_id", "h"], "left")
    name = F.when(F.trim("path") == "", "<unnamed resource>").otherwise(F.trim("path"))
    rows = rows.withColumn("text", F.concat(F.lit("Image resource: "), name))
    at = {"par": 0, "sent": 0, "file": "path", "chapter": F.lit("")}
    size = F.concat(F.lit("Locally readable dimensions are "), F.col("width").cast("string"), F.lit("×"), F.col("height").cast("string"), F.lit("; review whether that size is intentional."))
    per_image = exploded(rows, "images", [
        (F.col("duplicate"), "duplicate_image", "low", "Another inventoried image has the same nonempty content hash; review whether both resources are intentionally retained.", 0.5),
        (~F.coalesce("referenced", F.lit(False)), "unused_image", "medium", "No local HTML image reference was recorded for this image; review whether it is intentionally retained.", 0.5),
        (F.trim(F.coalesce("alt_text", F.lit(""))) == "", "missing_alt_text", "medium", "No alternative text is available for this image; review accessibility context.", 0.5),
        (F.col("size") <= 0, "missing_size", "medium", "This image has no recorded positive size; review manifest extraction or resource availability.", 0.5),
        (F.col("sha256") == "", "missing_hash", "low", "This image has no recorded content hash; review resource inventory completeness.", 0.5),
        (stem(F.col("path")).rlike(GENERIC_NAME), "generic_filename_weak", "low", "The filename is generic. This is a weak organizational signal only, not evidence of a content problem.", 0.5),
        ((F.col("width") < 32) | (F.col("height") < 32), "small_dimensions", "low", size, 0.5),
    ], ACTION, **at)
    first = images.groupBy("book_id").agg(F.min(F.struct("res_seq", "path")).alias("f")).select("book_id", "f.path")
    licensed = tables.metadata.where(casefold(F.col("key")).isin(LICENCE_KEYS) & (F.trim("value") != "")).select("book_id").distinct()
    unlicensed = first.join(licensed, "book_id", "left_anti").withColumn("text", F.concat(F.lit("Image resource: "), F.when(F.trim("path") == "", "<unnamed resource>").otherwise(F.trim("path"))))
    chapter = tables.chapters.groupBy("book_id").agg(F.min(F.struct("chapter_seq", "file", "title")).alias("c")).select("book_id", "c.file", "c.title")
    bare = chapter.join(first, "book_id", "left_anti")
    bare = bare.withColumn("text", F.concat(F.lit("Image inventory: no image resources recorded for source file "), F.when(F.col("file") == "", "<unnamed chapter>").otherwise(F.col("file")), F.lit(".")))
    return union([
        per_image,
        findings(unlicensed, "images", "missing_image_license_context", "low", "No book-level rights or license metadata is available for the inventoried images; review licensing documentation.", ACTION, 0.5, **at),
        findings(bare, "images", "no_images_inventory", "low", "No image resources were inventoried; review whether the publication intentionally contains no images.", INVENTORY_ACTION, 0.2, par=0, sent=0, chapter="title"),
    ])

