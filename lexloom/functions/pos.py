"""Parts of speech."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.fixed import FAMILY_POS, LABEL_POS, POS_NAMES, VALID_POS
from lexloom.functions.text import display


def literal_map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) if not isinstance(x, list) else F.array(*map(F.lit, x)) for x in chain(*values.items())])


def normal_pos(raw: Column) -> Column:
    """Key of a label: exact, else the longest name in it as whole words; compound labels give keys joined by +; null if none."""
    by_length = sorted(POS_NAMES, key=len, reverse=True)

    def one(part: Column) -> Column:
        found = F.element_at(literal_map(POS_NAMES), part)
        for name in by_length:
            found = F.coalesce(found, F.when(part.rlike(rf"\b{name}\b"), F.lit(POS_NAMES[name])))
        return found

    parts = F.filter(F.split(F.lower(display(raw)), r"(?U)\s*,\s*|\s*/\s*|\s+and\s+"), lambda p: F.trim(p) != "")
    return F.nullif(F.array_join(F.transform(parts, lambda p: one(F.trim(p))), "+"), F.lit(""))


def valid_pos(key: Column) -> Column:
    parts = F.filter(F.split(key, r"\+"), lambda p: p != "")
    return F.coalesce((key != "") & F.forall(parts, lambda p: p.isin(*VALID_POS)), F.lit(False))


def pos_label(key: Column) -> Column:
    """n+v -> n. / v."""
    return F.array_join(F.transform(F.filter(F.split(key, r"\+"), lambda p: p != ""), lambda p: F.concat(p, F.lit("."))), " / ")


def pos_keys(summary: Column) -> Column:
    """n:50/v:50 -> [n, v]."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(summary, F.lit("")), "/"), lambda x: F.substring_index(x, ":", 1)), lambda x: x != ""))


def pos_scope(label: Column) -> Column:
    """Parts of speech a label may stand for, in display order; null for other labels."""
    return F.element_at(literal_map(LABEL_POS), label)


def allowed_pos(labels: Column) -> Column:
    """Union over the comma-joined labels; empty if none is known."""
    return F.array_distinct(F.flatten(F.transform(F.split(labels, ","), lambda x: F.coalesce(pos_scope(F.trim(x)), F.array().cast("array<string>")))))


def family_pos(raw: Column) -> Column:
    plain = F.replace(F.lower(F.trim(raw)), F.lit("."), F.lit(""))
    return F.coalesce(F.element_at(literal_map(FAMILY_POS), plain), plain)


def has_pos(summary: Column, *keys: str) -> Column:
    return F.arrays_overlap(pos_keys(summary), F.array(*map(F.lit, keys)))
