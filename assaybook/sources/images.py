"""Upload manifests and image files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import or_null, safe_ext
from ..operators.numbering import with_new_ids


def image_manifest(files: DataFrame, max_bytes: int | None = None) -> DataFrame:
    """files(original_name, mime, bytes, ...) -> + accepted, reject_reason, safe_ext. Files of more
    than max_bytes are refused, if given."""
    image = F.coalesce(F.col("mime"), F.lit("")).rlike(r"(?i)^image/(jpeg|jpg|png|gif|webp)\z")
    reason = F.when(~image, "not_an_image")
    if max_bytes is not None:
        reason = reason.when(F.col("bytes") > max_bytes, "too_large")
    return files.select(
        "*",
        reason.isNull().alias("accepted"),
        reason.alias("reject_reason"),
        safe_ext(F.col("original_name")).alias("safe_ext"),
    )


def register_uploads(images: DataFrame, uploads: DataFrame, as_of: str) -> DataFrame:
    """uploads(seq, stored_name, original_name, user_id), the accepted manifest rows, become unattached
    image rows: new ids in arrival order, place 0, the stored name where there is no original one."""
    new = with_new_ids(uploads, images, ["seq"]).select(
        "id", F.lit(None).cast("bigint").alias("report_id"), "stored_name",
        F.coalesce(or_null(F.col("original_name")), F.col("stored_name")).alias("original_name"),
        F.col("user_id").cast("bigint").alias("created_by"), F.lit(0).alias("display_order"),
        F.lit(as_of).cast("timestamp_ntz").alias("created_at"),
    )
    return images.unionByName(new)


def missing_files(images: DataFrame, file_listing: DataFrame) -> DataFrame:
    """Image rows whose stored name is a plain base name but has no file.
    file_listing has a column stored_name."""
    plain = (F.col("stored_name") != "") & ~F.col("stored_name").rlike("/")
    return images.filter(plain).join(
        file_listing.select("stored_name"), "stored_name", "left_anti"
    )


def unattached_images(images: DataFrame) -> DataFrame:
    return images.filter(F.col("report_id").isNull())
