"""Exchange strings (slot:form/slot:form) and English inflection rules."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.fixed import IRREGULAR_COMPARATIVES, IRREGULAR_PLURALS, IRREGULAR_SUPERLATIVES, PLURAL, SLOT_LABELS, SLOTS, THIRD
from lexloom.functions.pos import has_pos, literal_map
from lexloom.functions.text import display, let


def slot_forms(exchange: Column) -> Column:
    """Array of (slot, form) in source order, distinct; leading balanced bracket notes go and alternatives are split at commas."""
    items = F.filter(F.split(F.coalesce(exchange, F.lit("")), "/"), lambda x: x.rlike("^[^:]+:.+"))

    def one(item: Column) -> Column:
        slot, value = F.substring_index(item, ":", 1), F.regexp_replace(item, "^[^:]*:", "")
        plain = F.regexp_replace(F.trim(value), r"^(?:[（(][^）)]*[）)]\s*)+", "")
        forms = F.filter(F.transform(F.split(plain, ","), display), lambda f: f != "")
        return F.transform(forms, lambda f: F.struct(slot.alias("slot"), f.alias("form")))

    return F.array_distinct(F.flatten(F.transform(items, one)))


def forms_of(pairs: Column, slot: str | Column) -> Column:
    return F.transform(F.filter(pairs, lambda p: p["slot"] == slot), lambda p: p["form"])


def _in_slot(slot: str):
    return lambda p: p["slot"] == slot


def serialise(pairs: Column) -> Column:
    """Back to a string, slots in display order."""
    ordered = let(pairs, lambda x: F.flatten(F.array(*[F.filter(x, _in_slot(s)) for s in SLOTS])))
    return F.array_join(F.transform(ordered, lambda p: F.concat(p["slot"], F.lit(":"), p["form"])), "/")


def _doubled(base: Column, form: Column, end: str) -> Column:
    """Final consonant doubled after a single vowel, as in bigger."""
    return base.rlike(r"[^aeiouy][aeiou][^aeiou]$") & (form == F.concat(base, F.right(base, F.lit(1)), F.lit(end)))


def _cut(word: Column, n: int) -> Column:
    return F.substring(word, F.lit(1), F.length(word) - n)


def _swap(base: Column, form: Column, tail: str, end: str) -> Column:
    return base.endswith(tail) & (form == F.concat(_cut(base, len(tail)), F.lit(end)))


def _either(*tests: Column) -> Column:
    return reduce(lambda a, b: a | b, tests)


def _plus(base: Column, *ends: str) -> Column:
    return [F.concat(base, F.lit(e)) for e in ends]


def is_regular(base_word: Column, form_word: Column, slot: Column) -> Column:
    """The form follows from the base by the slot's rules (or equals it)."""
    b, f = F.lower(base_word), F.lower(form_word)
    grade = lambda end: _either(f == F.concat(b, F.lit(end)), _swap(b, f, "e", "e" + end[1:]), _doubled(b, f, end), _swap(b, f, "y", "i" + end))
    rules = (
        F.when(slot == "s", f.isin(*_plus(b, "s", "es")) | _swap(b, f, "f", "ves") | _swap(b, f, "fe", "ves") | _swap(b, f, "y", "ies"))
        .when(slot == "3", f.isin(*_plus(b, "s", "es")))
        .when(slot == "i", _either(f == F.concat(b, F.lit("ing")), _swap(b, f, "e", "ing"), _doubled(b, f, "ing")))
        .when(slot == "c", grade("er"))
        .when(slot == "sup", grade("est"))
        .when(slot.isin("p", "d"), grade("ed"))
        .otherwise(F.lit(False))
    )
    return (f == b) | rules


def looks_graded(base_word: Column, form_word: Column, end: str) -> Column:
    """Comparative (er) or superlative (est) of the base by rule."""
    b, f = F.lower(base_word), F.lower(form_word)
    return _either(f == F.concat(b, F.lit(end)), _swap(b, f, "e", "e" + end[1:]), _swap(b, f, "y", "i" + end), _doubled(b, f, end))


def moved_grades(pairs: Column, pos_summary: Column, word: Column) -> Column:
    """Comparatives and superlatives in slot s go to c and sup; checked against the word unless it is empty."""
    graded = has_pos(pos_summary, "adj", "adv")
    trusted = F.coalesce(word, F.lit("")) == ""

    def slot(p: Column) -> Column:
        low = F.lower(p["form"])
        new = (
            F.when(low.isin(*IRREGULAR_COMPARATIVES), "c")
            .when(low.isin(*IRREGULAR_SUPERLATIVES), "sup")
            .when(p["form"].contains(" "), "s")
            .when(graded & low.endswith("er") & (trusted | looks_graded(word, p["form"], "er")), "c")
            .when(graded & low.endswith("est") & (trusted | looks_graded(word, p["form"], "est")), "sup")
            .otherwise("s")
        )
        return F.when(p["slot"] == "s", new).otherwise(p["slot"])

    placed = F.transform(pairs, lambda p: F.struct(p["slot"].alias("old"), slot(p).alias("slot"), p["form"].alias("form")))
    ordered = let(placed, lambda x: F.concat(F.filter(x, lambda p: p["slot"] == p["old"]), F.filter(x, lambda p: p["slot"] != p["old"])))
    return F.array_distinct(F.transform(ordered, lambda p: F.struct(p["slot"].alias("slot"), p["form"].alias("form"))))


def plural_of(word: Column) -> Column:
    """The plural by table or rule; null for blank words."""
    w = F.lower(F.regexp_replace(word, r"(?U)^\s+|\s+$", ""))
    rule = (
        F.when(w.rlike("(s|x|z|ch|sh)$"), F.concat(w, F.lit("es")))
        .when(w.rlike("[^aeiou]y$"), F.concat(_cut(w, 1), F.lit("ies")))
        .when(w.rlike(".f$"), F.concat(_cut(w, 1), F.lit("ves")))
        .when(w.rlike(".fe$"), F.concat(_cut(w, 2), F.lit("ves")))
        .when(w.rlike("[^aeiou]o$"), F.concat(w, F.lit("es")))
        .otherwise(F.concat(w, F.lit("s")))
    )
    return F.when(w != "", F.coalesce(F.element_at(literal_map(IRREGULAR_PLURALS), w), rule))


def slot_label(pos_summary: Column, slot: Column) -> Column:
    """Label of a slot for an entry with these parts of speech; null if it has none of those the slot is for."""
    named = F.element_at(literal_map(SLOT_LABELS), slot)
    return (
        F.when(slot == "s", F.when(has_pos(pos_summary, "n"), PLURAL).when(has_pos(pos_summary, "v"), THIRD))
        .when(slot.isin("3", "p", "d", "i"), F.when(has_pos(pos_summary, "v"), named))
        .when(slot.isin("c", "sup"), F.when(has_pos(pos_summary, "adj", "adv"), named))
    )


def surface_plurals(pairs: Column, pos_summary: Column) -> Column:
    """(allowed, blocked): whether slot s gives plurals at all, and its lower-case forms that are none."""
    s, third = forms_of(pairs, "s"), forms_of(pairs, "3")
    noun, graded = has_pos(pos_summary, "n"), has_pos(pos_summary, "adj", "adv")
    grade = lambda f: ~F.array_contains(third, f) & ((f.rlike("(er|est)$") & graded) | F.lower(f).isin(*IRREGULAR_COMPARATIVES))
    blocked = F.array_distinct(F.transform(F.when(noun, F.filter(s, grade)).otherwise(s), F.lower))
    allowed = noun & F.exists(s, lambda f: ~F.array_contains(blocked, F.lower(f)))
    return F.struct(allowed.alias("allowed"), blocked.alias("blocked"))


def plural_stems(word: Column) -> Column:
    """Words whose plural the word may be, in order of trial."""
    none = F.array().cast("array<string>")
    y = F.when(word.endswith("ies"), F.array(F.concat(_cut(word, 3), F.lit("y")))).otherwise(none)
    es = F.when(word.endswith("es"), F.concat(F.array(_cut(word, 2)), y)).otherwise(none)
    stems = F.concat(F.array(_cut(word, 1)), es)
    return F.when(word.endswith("s") & ~word.endswith("ss"), F.array_distinct(F.filter(stems, lambda x: x != ""))).otherwise(none)


def moved_grades_at_lookup(pairs: Column, pos_summary: Column) -> Column:
    """The lookup's safety net: forms of slot s in -er and -est go to c and sup on their looks, for adjectives and adverbs."""
    graded = F.coalesce(pos_summary, F.lit("")).rlike("adj:|adv:")
    slot = lambda p: F.when((p["slot"] == "s") & graded, F.when(F.lower(p["form"]).endswith("est"), "sup").when(F.lower(p["form"]).endswith("er"), "c").otherwise("s")).otherwise(p["slot"])
    placed = F.transform(pairs, lambda p: F.struct(p["slot"].alias("old"), slot(p).alias("slot"), p["form"].alias("form")))
    ordered = let(placed, lambda x: F.concat(F.filter(x, lambda p: p["slot"] == p["old"]), F.filter(x, lambda p: p["slot"] != p["old"])))
    return F.array_distinct(F.transform(ordered, lambda p: F.struct(p["slot"].alias("slot"), p["form"].alias("form"))))
