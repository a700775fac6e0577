"""Invariants of built entries: every rule in one pass over the rows, the first failures of each, metrics, gates, golden rows.

An entry row is (key, shard, word, entry_kind, pos, translation, exchange, linked_word, relations); functions take the columns
they name.  No rule brings rows to the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.operators.quality import shard

# Kinds, and what a relation may say.
KINDS = ["standalone", "inflection", "alias"]
TYPES = ["inflection", "origin", "xref", "lexical_origin", "defective", "variant", "self_loop"]
DIRECTIONS = ["outgoing", "incoming"]
DISPLAYS = ["exchange", "reference", "hidden"]
SOURCES = ["exchange", "protected", "derived", "manual", "word_family"]
# Fields of an entry with the JSON types they may have, and whether they are required.
FIELDS = {
    "word": (["string"], True),
    "phonetic": (["string"], False),
    "phonetic_us": (["string"], False),
    "translation": (["string"], False),
    "pos": (["string"], False),
    "exchange": (["string", "array"], False),
    "translation_parts": (["array"], False),
    "translation_detail_parts": (["array"], False),
    "phrasal_verbs": (["array"], False),
    "linked_word": (["string"], False),
    "entry_kind": (["string"], True),
    "display_word": (["string"], False),
    "word_family": (["array"], False),
    "verb_forms": (["array"], False),
    "relations": (["array"], False),
    "parent_relation": (["object", "null"], False),
    "child_relations": (["array"], False),
    "cross_references": (["array"], False),
    "inflection_sources": (["array"], False),
}


def _blank(c: Column) -> Column:
    return F.trim(F.coalesce(c, F.lit(""))) == ""


def row_rules() -> dict[str, Column]:
    """What is wrong with a row by itself, by rule."""
    kind, relations = F.col("entry_kind"), F.coalesce("relations", F.array())
    plain = lambda r: (r["source"] == "word_family") & (r["type"] == "lexical_origin") & (r["display"] == "reference")
    known = lambda r: r["target"].isNotNull() & r["type"].isin(*TYPES) & r["direction"].isin(*DIRECTIONS) & r["navigable"].isNotNull() & r["display"].isin(*DISPLAYS) & r["source"].isin(*SOURCES)
    sure = lambda test: F.coalesce(test, F.lit(False))
    return {
        "alias_has_link": (kind == "alias") & (F.coalesce("linked_word", F.lit("")) == ""),
        "alias_relations": (kind == "alias") & F.exists(relations, lambda r: ~sure(plain(r))),
        "exchange_format": (F.coalesce("exchange", F.lit("")) != "") & ~F.forall(F.split("exchange", "/"), lambda x: x.contains(":")),
        "inflection_has_origin": (kind == "inflection") & ~F.exists(relations, lambda r: r["type"] == "origin"),
        "key_is_word": ~sure(F.lower("key") == F.lower("word")),
        "kind_known": ~sure(kind.isin(*KINDS)),
        "pos_format": (F.coalesce("pos", F.lit("")) != "") & ~F.forall(F.split("pos", "/"), lambda p: F.trim(p).rlike(r"^[a-z]+(?:\+[a-z]+)*\.?(:\d+)?$")),
        "pos_not_blank": (F.coalesce("pos", F.lit("")) != "") & _blank(F.col("pos")),
        "relation_values": F.exists(relations, lambda r: ~sure(known(r))),
        "shard_is_first_letter": F.col("shard").rlike("^[A-Za-z]$") & ~sure(F.lower(F.substring("key", 1, 1)) == F.lower("shard")),
        "standalone_has_text": (kind == "standalone") & _blank(F.col("translation")) & (F.coalesce("linked_word", F.lit("")) == ""),
        "word_not_empty": _blank(F.col("word")),
    }


def violations(entries: DataFrame) -> DataFrame:
    """rule, key: every violation; rules on targets compare with the keys of all entries."""
    each = F.explode(F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), F.lit(name)) for name, test in row_rules().items()]))).alias("rule")
    own = entries.select("key", each).select("rule", "key")
    known = entries.select(F.lower("key").alias("k")).distinct()
    links = entries.where("entry_kind = 'alias' AND linked_word <> ''").select("key", F.lower("linked_word").alias("k"))
    loose = links.join(known, "k", "left_anti").select(F.lit("alias_link_exists").alias("rule"), "key")
    targets = entries.select("key", F.explode("relations").alias("r")).where("r.navigable").select("key", F.lower("r.target").alias("k"))
    dangling = targets.join(known, "k", "left_anti").select(F.lit("targets_exist").alias("rule"), "key").distinct()
    return own.unionByName(loose).unionByName(dangling)


def report(entries: DataFrame, most: int = 10) -> DataFrame:
    """rule, violations, first (the `most` smallest keys): a row for every rule, also for those that nothing violates."""
    names = [*row_rules(), "alias_link_exists", "targets_exist"]
    rules = entries.sparkSession.createDataFrame([(n,) for n in names], "rule string")
    placed = violations(entries).select("rule", F.coalesce("key", F.lit("")).alias("key"))
    counted = placed.groupBy("rule").agg(F.count("*").alias("violations"))
    top = placed.withColumn("rn", F.row_number().over(Window.partitionBy("rule").orderBy("key"))).where(F.col("rn") <= most)
    first = top.groupBy("rule").agg(F.sort_array(F.collect_list("key")).alias("first"))
    df = F.broadcast(rules).join(counted, "rule", "left").join(first, "rule", "left")
    return df.select("rule", F.coalesce("violations", F.lit(0)).alias("violations"), F.coalesce("first", F.array().cast("array<string>")).alias("first"))


def contract(raw: DataFrame) -> DataFrame:
    """rule, key: JSON entries that break the contract: unknown, missing or wrongly typed fields, malformed parts.  raw: key, body (JSON)."""
    df = raw.select("key", F.try_parse_json("body").alias("v"), F.json_object_keys("body").alias("fields"))
    at = lambda c, path: F.try_variant_get(c, path, "variant")

    def kind(c: Column) -> Column:
        """JSON type of a value; null if it isn't there."""
        said = F.schema_of_variant(c)
        return F.when(c.isNull(), None).when(said == "VOID", "null").when(said == "STRING", "string").when(said.startswith("ARRAY"), "array").when(said.startswith("OBJECT"), "object").when(said == "BOOLEAN", "boolean").otherwise("number")

    def bad_items(path: str, test) -> Column:  # noqa: ANN001
        items = F.try_variant_get("v", path, "array<variant>")
        return F.coalesce(F.exists(items, lambda x: ~F.coalesce(test(x), F.lit(False))), F.lit(False))

    is_ = lambda x, path, name: kind(at(x, path)) == name
    detail = lambda x: F.forall(F.try_variant_get(x, "$.details", "array<variant>"), lambda d: F.coalesce(is_(d, "$.text", "string"), F.lit(False)))
    wrong = [F.when(F.coalesce(~kind(at(F.col("v"), f"$.{name}")).isin(*kinds), F.lit(False)), F.lit(name)) for name, (kinds, _) in FIELDS.items()]
    missing = [F.when(~F.coalesce(F.array_contains("fields", name), F.lit(False)), F.lit(name)) for name, (_, needed) in FIELDS.items() if needed]
    tests = {
        "known_fields": F.size(F.array_except(F.coalesce("fields", F.array().cast("array<string>")), F.array(*map(F.lit, FIELDS)))) > 0,
        "required_fields": F.size(F.array_compact(F.array(*missing))) > 0,
        "field_types": F.size(F.array_compact(F.array(*wrong))) > 0,
        "parts": bad_items("$.translation_parts", lambda x: is_(x, "$.pos", "string") & is_(x, "$.meanings", "array")),
        "detail_parts": bad_items("$.translation_detail_parts", lambda x: is_(x, "$.pos", "string") & is_(x, "$.details", "array") & detail(x)),
        "phrases": bad_items("$.phrasal_verbs", lambda x: is_(x, "$.name", "string") & is_(x, "$.translation", "string")),
        "relations": bad_items("$.relations", lambda x: is_(x, "$.target", "string") & F.try_variant_get(x, "$.type", "string").isin(*TYPES) & is_(x, "$.navigable", "boolean")),
    }
    each = F.explode(F.array_compact(F.array(*[F.when(test, F.lit(name)) for name, test in tests.items()]))).alias("rule")
    return df.select("key", each).select("rule", "key")


def metrics(entries: DataFrame) -> DataFrame:
    """One row: entries, by kind, dangling navigable targets, derived relations, standalone entries without a family and verbs without forms, shards and their list.

    entries: word, entry_kind, pos, relations, family, verb_forms.
    """
    kind, none = F.col("entry_kind"), lambda c: F.coalesce(F.size(c), F.lit(0)) <= 0
    facts = entries.agg(
        F.count("*").alias("entry_count"), *[F.count_if(kind == k).alias(k) for k in KINDS],
        F.sum(F.size(F.filter("relations", lambda r: r["source"] == "derived"))).cast("long").alias("derived_relations"),
        F.count_if((kind == "standalone") & none("family")).alias("family_missing"), F.count_if((kind == "standalone") & F.coalesce("pos", F.lit("")).contains("v") & none("verb_forms")).alias("verb_form_missing"),
        F.sort_array(F.collect_set(shard(F.col("word")))).alias("shards"),
    )
    known = entries.select(F.lower("word").alias("k")).distinct()
    targets = entries.select(F.explode("relations").alias("r")).where("r.navigable").select(F.lower("r.target").alias("k"))
    dangling = targets.join(known, "k", "left_anti").agg(F.count("*").alias("dangling_targets"))
    return facts.crossJoin(dangling).withColumn("shard_count", F.size("shards"))  # one row each


def gate(summary: DataFrame) -> DataFrame:
    """rule, ok of a row of metrics: no dangling target, some entries, some standalone ones, some shards."""
    tests = {"dangling": F.col("dangling_targets") == 0, "entries": F.col("entry_count") > 0, "standalone": F.col("standalone") > 0, "shards": F.col("shard_count") > 0}
    return summary.select(F.explode(F.array(*[F.struct(F.lit(k).alias("rule"), F.coalesce(v, F.lit(False)).alias("ok")) for k, v in tests.items()])).alias("r")).select("r.*")


def kind_ranges(entries: DataFrame, ranges: dict[str, tuple[int, int]]) -> DataFrame:
    """entry_kind, n, ok: whether the number of entries of each kind lies between its bounds."""
    wanted = entries.sparkSession.createDataFrame([(k, *v) for k, v in ranges.items()], "entry_kind string, low long, high long")
    df = F.broadcast(wanted).join(entries.groupBy("entry_kind").agg(F.count("*").alias("have")), "entry_kind", "left")
    n = F.coalesce("have", F.lit(0))
    return df.select("entry_kind", n.alias("n"), ((n > F.col("low")) & (n < F.col("high"))).alias("ok"))


def golden(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """word, type, target, ok: whether the entry is there, of the kind, and has a relation of the type to the target.  expected: word, entry_kind, type, target."""
    have = entries.select(F.lower("word").alias("word"), F.col("entry_kind").alias("kind"), "relations")
    df = expected.join(have, "word", "left")
    found = F.exists("relations", lambda r: (r["type"] == F.col("type")) & (F.lower(r["target"]) == F.lower("target")))
    return df.select("word", "type", "target", F.coalesce((F.col("kind") == F.col("entry_kind")) & found, F.lit(False)).alias("ok"))


def phrase_only_on_base(entries: DataFrame, expected: DataFrame) -> DataFrame:
    """base, phrase, on_base, on_others: whether the base entry has the phrasal verb, and how many of its other words have it too or are no entries.

    entries: word, phrasal_verbs; expected: base, phrase, others (array of words).
    """
    has = entries.select(F.lower("word").alias("w"), F.transform("phrasal_verbs", lambda p: p["name"]).alias("names"))
    own = expected.join(has, F.lower("base") == F.col("w"), "left").select("base", "phrase", "others", F.coalesce(F.array_contains("names", F.col("phrase")), F.lit(False)).alias("on_base"))
    each = own.select("base", "phrase", "on_base", F.explode_outer("others").alias("other")).join(has.select(F.col("w").alias("k"), F.col("names").alias("n")), F.lower("other") == F.col("k"), "left")
    bad = F.col("other").isNotNull() & F.coalesce(F.array_contains("n", F.col("phrase")), F.lit(True))
    return each.groupBy("base", "phrase", "on_base").agg(F.count_if(bad).alias("on_others"))
