"""Benchmark decontamination by template canonicalisation; DataFrame functions only.

Numbers, names and units become typed placeholders (`<num>`, `<name>`, `<unit>`), the rest is lower-cased and loses its
punctuation; a run of one placeholder is one word, so a name of two words stands for a name of one.  Windows of `width`
canonical words of every text are hash-joined with the windows of the benchmark items (an item with fewer words is one
window of its own).  A hit is then checked word by word, and the values in its slots
must agree over all hits of an item on one alignment: one benchmark value stands for one value of the text and the other
way round, as in a question whose numbers or names were changed throughout.  A text is contaminated by an item if the
consistent hits cover at least `share` of the item's windows: on one alignment or, where words were put in or left out, on
alignments at most the item's length apart whose hits are in the item's order and whose slots agree (from each alignment
the largest others are added first).

Windows with more placeholders than words (of the given text) say too little for that: they are compared by their exact
values, and count beside the others.  An item is also found by its other windows alone, so a copy with new values is too.

A number is a word that starts with a digit (after one of $ € £ # ( + -); a unit is a word of UNITS after a number; a
name is a capitalised word after a space and a word that ends no sentence, so a name that opens a sentence or the text is
an ordinary word and has to agree.  Null or blank texts and items match nothing.  Very long texts are worked on whole, as
one row each; only those with a hit are written with their words.
Rows with one id share their hits; a null id has none.  n_windows are those of the best alignment or, if no single one is
enough, of the best chain.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.shared import join_small, pick, settle, small_enough

WIDTH, SHARE = 8, 0.5
#: Benchmark windows that may be broadcast (some 300 bytes each).
WINDOW_ROWS = 100_000
#: Words that count as units after a number, in English, French and Spanish.  German ones are capitalised, so they become names.
UNITS = """km kg cm mm mg ml km/h mph lb lbs oz mi ft yd in m g l s min h hr hrs
hour hours minute minutes second seconds day days week weeks month months year years percent dollar dollars euro euros cent cents degree degrees
meter meters metre metres kilometer kilometers kilometre kilometres centimeter centimeters centimetre centimetres mile miles liter liters litre litres gram grams kilogram kilograms kilo kilos
heure heures seconde secondes jour jours semaine semaines mois an ans année années degré degrés mètre mètres kilomètre kilomètres centimètre centimètres mille milles gramme grammes kilogramme kilogrammes
hora horas minuto minutos segundo segundos día días semana semanas mes meses año años dólar dólares centavo centavos grado grados metro metros kilómetro kilómetros centímetro centímetros milla millas litro litros gramo gramos kilogramo kilogramos""".split()
PUNCTUATION = ".,;:!?\"'()[]{}*#%&$"
SPACES = r"[\x20\x09-\x0D]+"
NAME = r"(?<=[^.!?:\s] )\p{Lu}[^\s.!?:,;\"()]*"
NUMBER = r"(^|[\x20\x09-\x0D])[$€£#(+-]?[0-9][^\x20\x09-\x0D]*"
UNIT = r"(<num>[\x20\x09-\x0D]+)(?:" + "|".join(UNITS) + r")([\x20\x09-\x0D.,;:!?)]|$)"


def _words(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"^[\x20\x09-\x0D]+|[\x20\x09-\x0D]+$", ""), SPACES)


def canonical(text: Column) -> Column:
    """One canonical word for each word of the text."""
    marked = F.regexp_replace(F.regexp_replace(F.regexp_replace(text, NAME, "<name>"), NUMBER, "$1<num>"), UNIT, "$1<unit>$2")
    return F.transform(_words(F.lower(marked)), lambda w: F.translate(w, PUNCTUATION, ""))


def _goes_on(words: Column, i: Column) -> Column:
    """Whether the word at i (from 0) is the same placeholder as the one before it."""
    return F.get(words, i).startswith("<") & (i > 0) & (F.get(words, i) == F.get(words, i - 1))


def _tokens(df: DataFrame) -> DataFrame:
    """canon with runs of one placeholder as one word, vals (what each stands for, without punctuation), low (in lower case), sizes (given words).

    canon and raw have to be columns of a table: what a lambda takes from outside is evaluated again for each element otherwise.
    """
    df = df.withColumn("starts", F.filter(F.sequence(F.lit(1), F.size("canon")), lambda i: ~_goes_on(F.col("canon"), i - 1)))
    ends = F.concat(F.slice("starts", F.lit(2), F.size("starts")), F.array(F.size("canon") + 1))
    df = df.withColumn("sizes", F.zip_with("starts", ends, lambda i, j: j - i))
    df = df.withColumn("vals", F.zip_with("starts", "sizes", lambda i, n: F.array_join(F.transform(F.slice("raw", i, n), lambda x: F.translate(x, PUNCTUATION, "")), " ")))
    df = df.withColumn("low", F.transform("vals", lambda x: F.lower(x)))
    return df.withColumn("canon", F.transform("starts", lambda i: F.get("canon", i - 1))).drop("starts", "raw")


def _agree(pairs: Column) -> Column:
    values = lambda field: F.size(F.array_distinct(F.transform(pairs, lambda z: z[field])))
    return (values("b") == F.size(pairs)) & (values("d") == F.size(pairs))


def _chains(lines: DataFrame, most: int) -> DataFrame:
    """doc_id, item_id, hits of each alignment together with those near it that are in order and agree with it."""
    near = Window.partitionBy("doc_id", "item_id").orderBy("line").rangeBetween(-most, most)
    df = lines.withColumn("near", F.collect_list(F.struct((-F.col("n")).alias("least"), "line", "length", "hits", "pairs")).over(near))
    df = df.withColumn("near", F.sort_array(F.filter("near", lambda m: (m["line"] != F.col("line")) & (F.abs(m["line"] - F.col("line")) <= F.col("length")))))
    placed = lambda hits, line: F.transform(hits, lambda h: F.struct(h["bpos"].alias("bpos"), h["exact"].alias("exact"), (h["bpos"] + line).alias("pos")))

    def add(state: Column, m: Column) -> Column:
        in_order = lambda h: F.forall(state["hits"], lambda a: F.signum(a["bpos"] - h["bpos"]) == F.signum(a["pos"] - h["pos"]))
        new = F.struct(F.concat(state["hits"], F.filter(placed(m["hits"], m["line"]), in_order)).alias("hits"), F.array_distinct(F.concat(state["pairs"], m["pairs"])).alias("pairs"))
        return F.when(_agree(new["pairs"]) & (F.size(new["hits"]) > F.size(state["hits"])), new).otherwise(state)

    start = F.struct(placed(F.col("hits"), F.col("line")).alias("hits"), F.col("pairs").alias("pairs"))
    return df.select("doc_id", "item_id", F.aggregate("near", start, add, lambda state: state["hits"]).alias("hits"))


def _hashes(words: Column, width: Column) -> Column:
    """Hashes of all windows, by start."""
    return F.when(F.size(words) >= width, F.transform(F.sequence(F.lit(1), F.size(words) - width + 1), lambda i: F.xxhash64(F.slice(words, i, width))))


def contamination(documents: DataFrame, benchmark: DataFrame, width: int = WIDTH, share: float = SHARE) -> DataFrame:
    """doc_id, contaminated, items (sorted ids of the items found), n_windows (consistent hits) of every document."""
    docs = pick(documents, "doc_id", "text").withColumn("doc_id", F.col("doc_id").cast("long"))
    texts = docs.where("doc_id IS NOT NULL AND text IS NOT NULL")
    items = pick(benchmark, "item_id", "text").where(F.col("item_id").isNotNull() & F.col("text").rlike(r"[^\x20\x09-\x0D]"))
    items = items.select(F.col("item_id").cast("long").alias("item_id"), canonical(F.col("text")).alias("canon"), _words(F.col("text")).alias("raw"))
    items = _tokens(settle(items, "benchmark-words")).withColumn("w", F.least(F.size("canon"), F.lit(width)))
    at = F.explode(F.sequence(F.lit(1), F.size("canon") - F.col("w") + 1)).alias("bpos")
    part = lambda c: F.slice(c, F.col("bpos"), F.col("w"))
    cut = items.select("*", at).select("item_id", F.size("canon").alias("length"), "w", "bpos", part("canon").alias("kinds"), part("vals").alias("bvals"), part("low").alias("low"), part("sizes").alias("sizes"))
    slot_words = F.aggregate(F.zip_with("kinds", "sizes", lambda k, n: F.when(k.startswith("<"), n).otherwise(0)), F.lit(0), lambda x, y: x + y)
    cut = cut.withColumn("exact", slot_words * 2 > F.aggregate("sizes", F.lit(0), lambda x, y: x + y))
    cut = cut.withColumn("bwords", F.when(F.col("exact"), F.col("low")).otherwise(F.col("kinds"))).drop("low", "sizes").dropDuplicates(["item_id", "bpos", "bwords"])
    windows = settle(cut.withColumn("h", F.xxhash64("bwords")), "benchmark-windows")
    wanted = windows.select("h", "w", "exact").distinct()
    wanted = settle(wanted, "benchmark-hashes")
    near = F.broadcast(wanted) if small_enough(wanted) else wanted

    kinds = [(r["w"], r["exact"]) for r in wanted.select("w", "exact").distinct().collect()]  # at most 2 * `width` values
    kinds = sorted(kinds) or [(width, False)]
    own = texts.select("doc_id", canonical(F.col("text")).alias("canon"), _words(F.col("text")).alias("raw"))  # each text is read and made canonical once, for all kinds of windows
    if any(exact for _, exact in kinds):
        own = _tokens(own).select("doc_id", F.col("canon").alias("words"), "low")
    else:
        own = own.select("doc_id", F.filter("canon", lambda x, i: ~(x.startswith("<") & (i > 0) & (x == F.get("canon", i - 1)))).alias("words"), F.lit(None).cast("array<string>").alias("low"))
    kind = F.explode(F.array(*[F.struct(F.lit(w).alias("w"), F.lit(exact).alias("exact")) for w, exact in kinds])).alias("kind")
    own = own.select("doc_id", "words", "low", kind).select("doc_id", F.when(F.col("kind.exact"), F.col("low")).otherwise(F.col("words")).alias("words"), "kind.w", "kind.exact")
    own = own.select("doc_id", "w", "exact", F.posexplode(_hashes(F.col("words"), F.col("w"))).alias("pos", "h"))
    found = own.join(near, ["h", "w", "exact"]).select("doc_id", "pos", "h", "w", "exact")
    found = settle(found, "hits")

    some = join_small(texts, found.select("doc_id").distinct(), ["doc_id"], "left_semi")
    words = settle(some.select("doc_id", canonical(F.col("text")).alias("canon"), _words(F.col("text")).alias("raw")), "texts-with-hits")
    places = found.groupBy("doc_id").agg(F.collect_set(F.struct("pos", "w", "exact", "h")).alias("places"))  # positions of the text, never positions x windows
    here = lambda c, x: F.slice(c, x["pos"] + 1, x["w"])
    cells = lambda x: F.struct(x["pos"].alias("pos"), x["w"].alias("w"), x["exact"].alias("exact"), x["h"].alias("h"), here(F.when(x["exact"], F.col("low")).otherwise(F.col("canon")), x).alias("words"), F.when(~x["exact"], here(F.col("vals"), x)).alias("dvals"))
    each = settle(_tokens(words).join(places, "doc_id").select("doc_id", F.explode(F.transform("places", cells)).alias("x")).select("doc_id", "x.*"), "windows-with-hits")
    hits = each.join(F.broadcast(windows) if small_enough(windows, WINDOW_ROWS) else windows, ["h", "w", "exact"]).where("words = bwords")
    used = F.filter(F.arrays_zip(F.col("kinds").alias("kind"), F.col("bvals").alias("b"), F.col("dvals").alias("d")), lambda z: z["kind"].startswith("<") & ~F.col("exact"))
    slots = F.transform(used, lambda z: F.struct(z["b"].alias("b"), z["d"].alias("d")))
    checked = hits.select("doc_id", F.struct("item_id", "length", "bpos", "exact", (F.col("pos") - F.col("bpos")).alias("line"), slots.alias("slots")).alias("x"))
    pairs = F.array_distinct(F.flatten(F.collect_list("x.slots")))
    lines = checked.groupBy("doc_id", "x.item_id", "x.line").agg(F.max("x.length").alias("length"), F.collect_set(F.struct("x.bpos", "x.exact")).alias("hits"), pairs.alias("pairs"))
    lines = settle(lines.where(_agree(F.col("pairs"))).withColumn("n", F.size("hits")), "alignments")
    plain = lambda c: F.countDistinct(F.when(~F.col("exact"), F.col(c)))
    whole = settle(windows.groupBy("item_id").agg(F.countDistinct("bpos").alias("all"), plain("bpos").alias("all_plain"), F.max("length").alias("most")), "item-windows")

    def enough(df: DataFrame) -> DataFrame:
        """The rows whose hits cover the share, and how many they are."""
        n = lambda hits: F.size(F.array_distinct(F.transform(hits, lambda h: h["bpos"])))
        df = df.withColumn("n", n(F.col("hits"))).withColumn("n_plain", n(F.filter("hits", lambda h: ~h["exact"]))).join(F.broadcast(whole) if small_enough(whole) else whole, "item_id")
        by_plain = (F.col("all_plain") > 0) & (F.col("n_plain") >= F.col("all_plain") * share)
        df = df.where(by_plain | (F.col("n") >= F.col("all") * share))
        return df.select("doc_id", "item_id", F.when(by_plain, F.col("n_plain")).otherwise(F.col("n")).alias("n")).groupBy("doc_id", "item_id").agg(F.max("n").alias("n"))

    alone = settle(enough(lines), "one-alignment")
    open_ = lines.join(alone, ["doc_id", "item_id"], "left_anti")
    several = open_.groupBy("doc_id", "item_id").agg(F.flatten(F.collect_list("hits")).alias("hits"), F.count("*").alias("lines")).where("lines > 1")
    open_ = open_.join(enough(several).select("doc_id", "item_id"), ["doc_id", "item_id"], "left_semi")  # the others lack hits on all alignments together
    most = whole.agg(F.max("most")).first()[0] or 0
    kept = alone.unionByName(enough(_chains(open_, most)))
    verdict = settle(kept.groupBy("doc_id").agg(F.sort_array(F.collect_set("item_id")).alias("items"), F.sum("n").alias("n_windows")), "contaminated")
    joined = join_small(docs.select("doc_id"), verdict, ["doc_id"], "left", rows=50_000)  # rows with lists of items
    return joined.select("doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<long>")).alias("items"), F.coalesce(F.col("n_windows").cast("long"), F.lit(0).cast("long")).alias("n_windows"))
