"""Declared table and payload schemas (DDL strings), limits, and the empty-table helper."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Column names, types and order of the lab tables.
TABLES: dict[str, str] = {
    "lab_users": (
        "id BIGINT, name STRING, email STRING, password_hash STRING, role STRING, "
        "is_active INT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "lab_settings": (
        "id BIGINT, lab_name STRING, address STRING, phone STRING, email STRING, "
        "footer_note STRING, updated_at TIMESTAMP_NTZ"
    ),
    "lab_test_panels": (
        "id BIGINT, code STRING, name STRING, description STRING, display_order INT, "
        "is_active INT, created_at TIMESTAMP_NTZ"
    ),
    "lab_test_parameters": (
        "id BIGINT, panel_id BIGINT, code STRING, name STRING, unit STRING, "
        "reference_range_dog STRING, reference_range_cat STRING, reference_range STRING, "
        "display_order INT, is_active INT"
    ),
    "lab_reports": (
        "id BIGINT, report_no STRING, patient_name STRING, owner_phone STRING, pet_name STRING, "
        "species STRING, breed STRING, age STRING, sex STRING, referring_vet STRING, "
        "sample_date DATE, report_date DATE, clinical_notes STRING, remarks STRING, status STRING, "
        "created_by BIGINT, created_at TIMESTAMP_NTZ, updated_at TIMESTAMP_NTZ"
    ),
    "lab_report_panels": "id BIGINT, report_id BIGINT, panel_id BIGINT",
    "lab_report_results": (
        "id BIGINT, report_id BIGINT, parameter_id BIGINT, value STRING, flag STRING, remarks STRING"
    ),
    "lab_report_images": (
        "id BIGINT, report_id BIGINT, stored_name STRING, original_name STRING, created_by BIGINT, "
        "display_order INT, created_at TIMESTAMP_NTZ"
    ),
    "lab_report_forms": (
        "id BIGINT, report_id BIGINT, form_code STRING, form_json STRING, updated_at TIMESTAMP_NTZ"
    ),
}

# Readers treat these as empty when the files are missing.
OPTIONAL_TABLES = ("lab_report_images", "lab_report_forms")

HEADER_TEXT = (
    "patient_name", "owner_phone", "pet_name", "species", "breed", "age", "sex",
    "referring_vet", "clinical_notes", "remarks", "status",
)

PAYLOAD = (
    "patient_name STRING, owner_phone STRING, pet_name STRING, species STRING, breed STRING, "
    "age STRING, sex STRING, referring_vet STRING, sample_date STRING, report_date STRING, "
    "clinical_notes STRING, remarks STRING, status STRING, panel_ids ARRAY<STRING>, "
    "results ARRAY<STRUCT<parameter_id: STRING, value: STRING, flag: STRING, remarks: STRING>>, "
    "image_ids ARRAY<STRING>, forms MAP<STRING, STRING>"
)

DRAFT = (
    "editId STRING, patient_name STRING, owner_phone STRING, pet_name STRING, species STRING, "
    "breed STRING, age STRING, sex STRING, referring_vet STRING, sample_date STRING, "
    "report_date STRING, clinical_notes STRING, remarks STRING, status STRING, "
    "panel_ids ARRAY<STRING>, included_parameter_ids ARRAY<STRING>, "
    "parameter_ids_snapshot ARRAY<STRING>, results MAP<STRING, STRING>, "
    "images ARRAY<STRUCT<id: STRING, stored_name: STRING, original_name: STRING>>, "
    "forms MAP<STRING, STRING>"
)

# Declared column lengths in characters; over-long values are refused.
TEXT_LIMITS = {
    "patient_name": 150, "owner_phone": 40, "pet_name": 120, "breed": 100, "age": 40,
    "sex": 20, "referring_vet": 150,
}
RESULT_TEXT_LIMITS = {"flag": 10, "remarks": 255}
PANEL_TEXT_LIMITS = {"code": 30, "name": 120, "description": 255}
PARAMETER_TEXT_LIMITS = {
    "code": 40, "name": 150, "unit": 40, "reference_range_dog": 120, "reference_range_cat": 120,
}

# Request sizes of the web form, for callers that want to keep them, and a column width.
MAX_BODY_BYTES = 1048576
MAX_UPLOAD_BYTES = 8 * 1024 * 1024
MAX_FORM_CODE = 40
REPORT_PREFIX = "PZ"


def empty_table(spark: SparkSession, name: str) -> DataFrame:
    return spark.createDataFrame([], TABLES[name])


def columns_of(ddl: str) -> list[tuple[str, str]]:
    """(name, type) pairs of a flat DDL string."""
    return [tuple(part.strip().split(" ", 1)) for part in ddl.split(", ")]


def conform(df: DataFrame, name: str) -> DataFrame:
    """Declared columns in declared order and type; missing ones become typed nulls."""
    have = set(df.columns)
    return df.select(
        *[
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c)
            for c, t in columns_of(TABLES[name])
        ]
    )
