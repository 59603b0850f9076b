"""Class keys, source keys, feature paths and display names as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Key formats of the data.
CLASS_SEP = "::"
SOURCE_SEP = ":"
NO_FORM = ""


def _col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def class_key(attribute: str | Column, form: str | Column) -> Column:
    """``attribute::form``; without a form ``attribute::``. A NULL form gives an invalid key."""
    return F.concat_ws(CLASS_SEP, _col(attribute), _col(form))


def class_parts(key: str | Column) -> Column:
    """Struct (attribute, form) of a class key; a malformed key fails the job."""
    key = _col(key)
    parts = F.split(key, CLASS_SEP, -1)
    valid = (F.size(parts) == 2) & (F.try_element_at(parts, F.lit(1)) != "")
    problem = F.raise_error(
        F.concat(
            F.lit("not a valid class key (one '::' after a non-empty attribute): "),
            F.coalesce(key, F.lit("NULL")),
        )
    ).cast("struct<attribute:string,form:string>")
    good = F.struct(
        F.try_element_at(parts, F.lit(1)).alias("attribute"),
        F.try_element_at(parts, F.lit(2)).alias("form"),
    )
    return F.when(key.isNull(), F.lit(None)).when(valid, good).otherwise(problem)


def source_key(site: str | Column, project: str | Column) -> Column:
    return F.concat_ws(SOURCE_SEP, _col(site), _col(project))


def source_parts(key: str | Column) -> Column:
    parts = F.split(_col(key), SOURCE_SEP, 2)
    return F.struct(parts[0].alias("site"), parts[1].alias("source_id"))


def display_name(attribute_name: Column, form: Column, form_name: Column) -> Column:
    """Attribute name alone without a form, otherwise ``attribute::form`` by name."""
    return F.when(form == NO_FORM, attribute_name).otherwise(
        F.concat_ws(CLASS_SEP, attribute_name, form_name)
    )


def provider_feature_path(source_id: Column, image_id: Column) -> Column:
    return F.concat(
        F.lit("s"),
        source_id.cast("string"),
        F.lit("/features/i"),
        image_id.cast("string"),
        F.lit(".featurevector"),
    )


def native_feature_path(prefix: str, image_id: Column) -> Column:
    return F.concat(F.lit(f"{prefix}/"), image_id, F.lit("_featurevector"))


def full_path(bucket: str | Column = "bucket", path: str | Column = "feature_vector") -> Column:
    # NULL in either part gives NULL, as a path with a part missing matches nothing.
    return F.concat(_col(bucket), F.lit("/"), _col(path))


def image_of_feature_path(path: str | Column) -> Column:
    """Image id of ``.../i<id>.featurevector``; NULL for other paths."""
    found = F.regexp_extract(_col(path), r".*/i([^/]+)\.featurevector$", 1)
    return F.nullif(found, F.lit(""))
