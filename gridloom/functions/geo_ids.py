"""Ids of cells and zones: parsing, synthetic parents, id sets."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

UNSIGNED = "decimal(20,0)"


def cell_id(text: Column, bare_hex: bool = True) -> Column:
    """An unsigned 64-bit id from decimal digits, ``0x`` hex or (with ``bare_hex``) plain hex; null if it is none of them."""
    t = F.lower(F.trim(text))
    out = F.when(t.rlike(r"^[0-9]{1,20}$"), t.cast(UNSIGNED)).when(t.rlike(r"^0x[0-9a-f]{1,16}$"), F.conv(F.substring(t, 3, 16), 16, 10).cast(UNSIGNED))
    return out.when(t.rlike(r"^[0-9a-f]{1,16}$"), F.conv(t, 16, 10).cast(UNSIGNED)) if bare_hex else out


def synthetic_parent(cell: Column, level: int, parent_level: int) -> Column:
    """A stand-in parent id: top bit, parent level in the bits from 56, and the cell shifted by three bits a level.

    It groups cells without real geometry. The top bit makes the bigint negative; read it as unsigned.
    """
    if not 0 <= parent_level < level <= 15:
        raise ValueError("the parent must be coarser, and both levels between 0 and 15")
    head = -(1 << 63) | (parent_level << 56)
    return F.shiftrightunsigned(cell.cast("bigint"), 3 * (level - parent_level)).bitwiseOR(F.lit(head).cast("bigint"))


def sorted_ids(ids: Column) -> Column:
    return F.array_sort(F.array_distinct(ids))


def cell_set(cell: Column, parents: Sequence[Column]) -> Column:
    """A row's id set: the cell and its parents, sorted and distinct."""
    return sorted_ids(F.array(cell, *parents))


def grid_cell(x: Column, y: Column, size: float, levels: int = 20) -> Column:
    """Id of the square cell of a side length; both halves are offset so that negative indices sort too."""
    half = 1 << 30
    return F.shiftleft((F.floor(x / size) + half).cast("bigint"), 31).bitwiseOR((F.floor(y / size) + half).cast("bigint"))


def zone_number(value: Column, strict: bool = False) -> Column:
    """A non-negative whole id from text or a number (``00501``, ``12345-6789``, ``7.0``); null otherwise, or an error if strict."""
    t = F.trim(value.cast("string"))
    digits = F.regexp_extract(t, r"^([0-9]{1,18})(?:\.0+|-[0-9]{4})?$", 1)
    out = F.when(digits != "", digits.cast("bigint"))
    return F.when(value.isNotNull() & out.isNull(), F.raise_error(F.concat(F.lit("not a zone id: "), t)).cast("bigint")).otherwise(out) if strict else out
