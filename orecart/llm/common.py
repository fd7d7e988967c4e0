"""What the corpus operators share: scratch tables, folds, word splitting and connected components."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from orecart.operators.graph import connected_components, streamed  # noqa: F401
from orecart.sources.scratch import Scratch, shared_dir  # noqa: F401

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def per_worker(key: tuple, make):
    """make(), kept while the same Python worker runs task after task of the same kind; only the latest kind is kept.

    The holder hangs on a module that every worker has installed: this package travels by value, so each task's functions come with
    modules of their own, whose variables the next task does not see.
    """
    import pyspark

    kept = pyspark.__dict__.setdefault("_orecart_kept", {})
    if key not in kept:
        kept.clear()
        kept[key] = make()
    return kept[key]


def fold(column: str, folds: int) -> Column:
    """crc32 of the id as text, modulo the number of folds; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % folds, F.lit(0).cast("long"))


def ascii_lower(column: Column) -> Column:
    return F.translate(column, ASCII_UPPER, ASCII_LOWER)


def lowered_words(data: bytes | None) -> list[bytes]:
    """Maximal runs of bytes other than 0x20 and 0x09-0x0D, with A-Z in lower case.

    bytes.lower touches ASCII letters only and bytes.split cuts at exactly those six bytes, so this is the contract's
    rule on UTF-8 without decoding.
    """
    return data.lower().split() if data else []
