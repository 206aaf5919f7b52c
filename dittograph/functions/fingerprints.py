"""Content fingerprints of byte columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

QUICK_BYTES = 65_536


def sha256_hex(content: Column) -> Column:
    """SHA-256 in upper-case hex; null for null."""
    return F.upper(F.sha2(content, 256))


def quick_hash(content: Column) -> Column:
    """SHA-256 of the first 64 KB."""
    return F.upper(F.sha2(F.substring(content, 1, QUICK_BYTES), 256))
