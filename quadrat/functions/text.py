"""Text clean-up expressions for file names, ids and form names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Status suffixes of image lists, image page format, forms that keep their own class.
STATUS_SUFFIX = r"\s+-\s+(?:Confirmed|Unconfirmed|Unclassified)\s*$"
IMAGE_PAGE = r"/image/(\d+)/"
KEPT_FORMS = ("Branching", "Massive")

_DECIMAL = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def strip_status(name: Column) -> Column:
    return F.trim(F.regexp_replace(name, STATUS_SUFFIX, ""))


def image_of_page(page: Column) -> Column:
    """Digits of ``/image/<id>/``; NULL when the page has none."""
    return F.nullif(F.regexp_extract(page, IMAGE_PAGE, 1), F.lit(""))


def normal_id(raw: Column) -> Column:
    """Trim; blank and ``nan`` become NULL; ``123.0`` becomes ``123``; other text stays."""
    text = F.trim(raw)
    # Spark's cast to double also takes a trailing d or f, which belongs to an id.
    decimal = F.when(text.rlike(_DECIMAL), text.try_cast("double").try_cast("bigint"))
    number = F.when(text.rlike(r"^[+-]?\d+$"), text.try_cast("bigint")).otherwise(decimal).cast("string")
    return F.when((text == "") | (F.lower(text) == "nan"), F.lit(None)).otherwise(
        F.coalesce(number, text)
    )


def kept_form(name: Column, kept: Sequence[str] = KEPT_FORMS) -> Column:
    """Canonical name of a form that stays separate, ``''`` for every other form."""
    canonical = F.initcap(F.trim(F.coalesce(name, F.lit(""))))
    return F.when(canonical.isin(*kept), canonical).otherwise(F.lit(""))


def inherent_form(listed: Column, kept: Sequence[str] = KEPT_FORMS) -> Column:
    """Kept form of a single-valued cell; NULL for a blank cell or a list of choices."""
    blank = listed.isNull() | (F.trim(listed) == "")
    return F.when(blank | F.contains(listed, F.lit(",")), F.lit(None)).otherwise(
        kept_form(listed, kept)
    )
