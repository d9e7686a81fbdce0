"""Deterministic ids: hashes of content, never random."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def short_id(c: Column, length: int = 32) -> Column:
    """The first ``length`` hex digits of SHA-256."""
    return F.substring(F.sha2(c, 256), 1, length)


def item_hash(url: Column) -> Column:
    return short_id(url, 16)


def vault_id(relative_path: Column) -> Column:
    return F.concat(F.lit("obsidian::"), F.sha2(relative_path, 256))


def participant_set(addresses: Column) -> Column:
    """Sorted distinct addresses, lower case and trimmed, without blanks."""
    clean = F.filter(F.transform(addresses, lambda a: F.lower(F.trim(a))), lambda a: a.isNotNull() & (a != ""))
    return F.array_sort(F.array_distinct(clean))


def participant_hash(addresses: Column) -> Column:
    return F.sha2(F.array_join(participant_set(addresses), ","), 256)
