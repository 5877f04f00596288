"""Identity and size of file contents."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def content_id(text: Column) -> Column:
    """SHA-1 of the bytes of a text."""
    return F.sha1(text)


def blob_id(content: Column) -> Column:
    """The id Git gives a blob of these bytes in a SHA-1 repository."""
    return F.sha1(_framed(content))


def blob_id_sha256(content: Column) -> Column:
    """The id Git gives a blob of these bytes in a SHA-256 repository."""
    return F.sha2(_framed(content), 256)


def _framed(content: Column) -> Column:
    return F.concat(F.encode(F.concat(F.lit("blob "), F.octet_length(content).cast("string")), "UTF-8"), F.unhex(F.lit("00")), content)


def source_text(content: Column) -> Column:
    """Bytes as text; null where they are not UTF-8."""
    return F.when(F.is_valid_utf8(content.cast("string")), content.cast("string"))
