"""Helpers that the operators share."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..sources.tables import shared_path, table, written

__all__ = ["SPACE", "WORD", "remainder", "shared_path", "table", "written"]

#: Characters that separate words: space and \t \n \v \f \r, as a Java and RE2 class body.
SPACE = r"\x20\x09-\x0D"
WORD = rf"[^{SPACE}]+"


def remainder(doc_id: Column, n: int) -> Column:
    """crc32 of doc_id as text, modulo n; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % n
