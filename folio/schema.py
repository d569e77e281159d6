"""Table schemas and validation at the boundary."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, IntegerType, LongType, MapType, StringType, StructType, TimestampType

_KINDS: dict[str, DataType] = {
    "BIGINT": LongType(),
    "INT": IntegerType(),
    "DOUBLE": DoubleType(),
    "STRING": StringType(),
    "TIMESTAMP": TimestampType(),
    "ARRAY<STRING>": ArrayType(StringType()),
    "ARRAY<FLOAT>": ArrayType(FloatType()),
    "MAP<STRING,STRING>": MapType(StringType(), StringType()),
}


def _schema(text: str) -> StructType:
    """Fields as ``name KIND``; needs no session."""
    out = StructType()
    for name, kind in (f.split() for f in text.split(", ")):
        out.add(name, _KINDS[kind])
    return out


DOCUMENTS = _schema(
    "id BIGINT, checksum STRING, title STRING, registre STRING, date STRING, category STRING, subcategory STRING, summary STRING, "
    "tags ARRAY<STRING>, total_amount STRING, vat_amount STRING, siren STRING, iban STRING, expiry_date STRING, contact_name STRING, "
    "contact_email STRING, contact_phone STRING, contact_address STRING, contact_website STRING, raw_text STRING, markdown_content STRING, "
    "original_filename STRING, original_path STRING, new_path STRING, file_type STRING, source_image_path STRING, embedding ARRAY<FLOAT>, "
    "status STRING, created_at TIMESTAMP, updated_at TIMESTAMP"
)
BLOCKED = _schema(
    "original_path STRING, filename STRING, reason STRING, message STRING, mtime_ms DOUBLE, size BIGINT, blocked_at TIMESTAMP"
)
DECISIONS = _schema(
    "id BIGINT, document_id BIGINT, checksum STRING, old_category STRING, old_subcategory STRING, new_category STRING, "
    "new_subcategory STRING, reason STRING, raw_text_snippet STRING, rule_keywords ARRAY<STRING>, enabled INT, created_at TIMESTAMP"
)
TAXONOMY = _schema("category STRING, sub_path STRING, ordinal INT, name STRING, aliases ARRAY<STRING>")
ENTITIES = _schema("domain STRING, category STRING, slug STRING, surface STRING, ordinal INT")
METADATA = _schema(
    "titre STRING, registre STRING, date STRING, categorie STRING, subcategorie STRING, summary STRING, tags ARRAY<STRING>, "
    "markdown_content STRING, other MAP<STRING,STRING>"
)

BLOCKED_REASONS = ("NO_TEXT", "GENERAL_SUBCATEGORY", "QUALITY_GATE", "typesafe_disagreement")


def conform(df: DataFrame, schema: StructType) -> DataFrame:
    """The columns of ``schema``; those that ``df`` lacks are null. Older tables read on after columns were added."""
    have = set(df.columns)
    return df.select(
        *((df[f.name] if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema.fields)
    )


def validate(df: DataFrame, required: list[str]) -> tuple[DataFrame, DataFrame]:
    """``(valid, rejected)``: a required string column must hold something; rejected rows carry ``missing``."""
    empty = [F.when(F.coalesce(F.trim(df[c].cast("string")), F.lit("")) == "", F.lit(c)) for c in required]
    marked = df.withColumn("missing", F.array_compact(F.array(*empty)))
    return marked.where(F.size("missing") == 0).drop("missing"), marked.where(F.size("missing") > 0)


def metadata_defaults(df: DataFrame) -> DataFrame:
    """Model output as records: nulls become the field's empty value."""
    out = []
    for f in METADATA.fields:
        kind = f.dataType.simpleString()
        default = F.array().cast(kind) if kind.startswith("array") else F.create_map().cast(kind) if kind.startswith("map") else F.lit("")
        out.append((F.coalesce(df[f.name].cast(kind), default) if f.name in df.columns else default).alias(f.name))
    return df.select(*out)
