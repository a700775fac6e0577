"""Display text, meanings and fragments as Column expressions.  White space is Unicode white space throughout."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexloom.functions.fixed import NARROW, WIDE

HAN = "[一-鿿]"


def squeeze(text: Column) -> Column:
    """Runs of white space become one space; ends are trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U) \s+|[\s&&[^ ]]\s*", " "))  # a single space is no match: most texts stay as they are


def display(text: Column) -> Column:
    """Full-width brackets and comma become ASCII, a semicolon full-width; white space squeezed."""
    return squeeze(F.translate(text, WIDE, NARROW))


def without_brackets(text: Column) -> Column:
    return F.regexp_replace(text, r"[（(].*?[）)]", "")


def bracket_han(text: Column) -> Column:
    """Han characters in each bracket block."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"[（(](.*?)[）)]"), 1), lambda b: F.length(F.regexp_replace(b, r"[^一-鿿]", "")))


def without_long_brackets(text: Column, most: int = 7) -> Column:
    """Blocks with more than `most` Han characters go."""
    return squeeze(F.regexp_replace(text, rf"[（(](?=(?:[^）)]*?[一-鿿]){{{most + 1}}})[^）)]*[）)]", ""))


def meaning_key(text: Column) -> Column:
    return shown_key(F.translate(without_brackets(text), WIDE, NARROW))


def shown_key(text: Column) -> Column:
    """meaning_key of a text without brackets that has been displayed: white space goes, so it needs no squeezing before."""
    return F.regexp_replace(F.replace(text, F.lit(" "), F.lit("")), r"(?U)[，,；;、\s]+", "")


def qualified(text: Column, qualifier: Column) -> Column:
    shown = display(text)
    return F.when((F.coalesce(qualifier, F.lit("")) == "") | shown.startswith("(") | shown.startswith("（"), shown).otherwise(F.concat(F.lit("("), qualifier, F.lit(")"), shown))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once: a column that a lambda takes from outside would be evaluated again for each element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _bracketed(text: Column, delimiters: str) -> Column:
    """Pieces between the delimiters at bracket depth 0.  An unmatched closing bracket counts for nothing.

    Walks over brackets, delimiters and the stretches between them, not over single characters.
    """
    first = F.struct(F.lit(0).alias("depth"), F.lit("").alias("open"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, t: Column) -> Column:
        depth = F.when(t.isin("(", "（"), s["depth"] + 1).when(t.isin(")", "）"), F.greatest(s["depth"] - 1, F.lit(0))).otherwise(s["depth"])
        cut = t.isin(*delimiters) & (s["depth"] == 0)
        ended = F.struct(depth.alias("depth"), F.lit("").alias("open"), F.concat(s["done"], F.array(s["open"])).alias("done"))
        return F.when(cut, ended).otherwise(F.struct(depth.alias("depth"), F.concat(s["open"], t).alias("open"), s["done"].alias("done")))

    marks = "()（）" + delimiters
    stretches = F.split(text, f"(?<=[{marks}])|(?=[{marks}])")  # cut at the marks: a class of all other characters takes three times as long
    return F.aggregate(stretches, first, step, lambda s: F.concat(s["done"], F.array(s["open"])))


def split_outside_brackets(text: Column, delimiters: str = ",;，；") -> Column:
    """Pieces between delimiters at bracket depth 0, trimmed, empty ones dropped."""
    return F.filter(F.transform(_cut_outside_brackets(text, delimiters), _ends), lambda p: p != "")


def displayed_pieces(text: Column, delimiters: str = ",;，；") -> Column:
    """The pieces of split_outside_brackets as `display` shows them, which trims them too."""
    return F.filter(F.transform(_cut_outside_brackets(text, delimiters), display), lambda p: p != "")


def _cut_outside_brackets(text: Column, delimiters: str) -> Column:
    """Only a text with brackets is walked through."""
    cut = lambda t: F.when(t.rlike("[()（）]"), _bracketed(t, delimiters)).otherwise(F.split(t, f"[{delimiters}]"))
    return let(F.coalesce(text, F.lit("")), cut)


def _ends(text: Column) -> Column:
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def _all(text: Column, *steps: tuple[str, str]) -> Column:
    for pattern, put in steps:
        text = F.regexp_replace(text, pattern, put)
    return text


def repair_lines(text: Column) -> Column:
    """Scanned text as one paragraph: words broken by a hyphen joined, lines joined by a space, spacing around punctuation put right."""
    joined = F.regexp_replace(text, r"(?U)([A-Za-z])-\s*\n\s*([A-Za-z])", "$1$2")
    lines = F.filter(F.transform(F.split(joined, "\n"), _ends), lambda x: x != "")
    return _ends(_all(F.array_join(lines, " "), (r"(?U)\s+([,.;:!?])", "$1"), (r"(?U)([(\[\"])\s+", "$1"), (r"(?U)\s{2,}", " ")))


def han_punctuation(text: Column) -> Column:
    """ASCII punctuation becomes full-width, with its spacing; a double quote is doubled, and doubled again behind a word character."""
    quoted = F.replace(F.regexp_replace(F.replace(text, F.lit("'"), F.lit("’")), r'(\w)"', '$1""'), F.lit('"'), F.lit('""'))
    return _ends(_all(F.translate(quoted, "!?,.;:()", "！？，。；：（）"), (r"(?U)\s+([，。！？；：）])", "$1"), (r"(?U)（\s+", "（"), (r"(?U)\s{2,}", " ")))


def segments(text: Column, most: int = 900) -> Column:
    """Pieces of at most `most` characters: up to the last sentence end in reach (a mark and a space, a full-width mark or a line break), else cut hard."""
    wide = r"[。？！；\n]"
    ends = rf".{{1,{most}}}\z|.{{{most - 1}}}{wide}|.{{2,{most - 1}}}(?:(?<=[.?!;])(?= )|(?<={wide}))|.{{{most}}}"
    return F.filter(F.transform(F.regexp_extract_all(_ends(text), F.lit(rf"(?sU)\s*({ends})"), F.lit(1)), _ends), lambda s: s != "")
