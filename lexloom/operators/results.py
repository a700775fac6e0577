"""Result rows for display: secondary dictionary, stored provider answers, grouped origin meanings, the primary result."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.fixed import LABEL_POS
from lexloom.functions.pos import literal_map
from lexloom.operators.views import distinct_by, parse_parts, pos_rank

# Slots of the secondary dictionary, language codes, spelling pairs of which the first is hidden.
SECONDARY_SLOTS = {"0": "原形", "p": "过去式", "d": "过去分词", "i": "现在分词", "3": "第三人称单数", "s": "复数"}
LANGUAGES = [
    "auto", "de", "en", "es", "fr", "it", "ja", "ko", "nl", "pl", "pt", "ru", "zh-Hans", "zh-Hant", "bg", "cs", "da", "el", "et", "fi", "hu", "lt", "lv", "ro", "sk", "sl", "sv",
]
SPELLING_PAIRS = [
    ("travelled", "traveled"),
    ("travelling", "traveling"),
    ("cancelled", "canceled"),
    ("cancelling", "canceling"),
    ("levelled", "leveled"),
    ("levelling", "leveling"),
    ("signalled", "signaled"),
    ("signalling", "signaling"),
    ("labelled", "labeled"),
    ("labelling", "labeling"),
    ("fuelled", "fueled"),
    ("fuelling", "fueling"),
    ("totalled", "totaled"),
    ("totalling", "totaling"),
    ("kidnapped", "kidnaped"),
    ("kidnapping", "kidnaping"),
    ("worshipped", "worshiped"),
    ("worshipping", "worshiping"),
]
DEFAULT_POS = "释义"


def language_code(code: Column, fallback: str = "auto") -> Column:
    """Code of the provider: both kinds of Chinese are one, unknown codes give the fallback."""
    return F.when(code.isin("zh-Hans", "zh-Hant"), "zh-CHS").when(code.isin(*LANGUAGES), code).otherwise(fallback)


def bare_phonetic(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.trim(F.coalesce(text, F.lit(""))), r"^[\[/]+", ""), r"[\]/]+$", "")


def secondary_exchange(text: Column) -> Column:
    """Array of (name, word); unknown slots and empty forms are skipped."""
    items = F.filter(F.split(F.coalesce(text, F.lit("")), "/"), lambda x: x.rlike("^[^:]*:.+") & F.substring_index(x, ":", 1).isin(*SECONDARY_SLOTS))
    return F.transform(items, lambda x: F.struct(F.element_at(literal_map(SECONDARY_SLOTS), F.substring_index(x, ":", 1)).alias("name"), F.regexp_replace(x, "^[^:]*:", "").alias("word")))


def secondary_parts(translation: Column, pos: Column, word: Column) -> Column:
    """Lines as (part, meaning), `释义` without a part of speech; no line at all: the parts of speech with the word itself."""
    told = r"^((?:[a-zA-Z0-9+]+\.\s*(?:/\s*)?)+)\s*(.+)$"
    lines = F.filter(F.transform(F.split(F.coalesce(translation, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    parts = F.transform(lines, lambda x: F.when(x.rlike(told), F.struct(F.trim(F.regexp_extract(x, told, 1)).alias("part"), F.regexp_extract(x, told, 2).alias("meaning"))).otherwise(F.struct(F.lit(DEFAULT_POS).alias("part"), x.alias("meaning"))))
    bare = F.transform(F.filter(F.split(F.trim(F.coalesce(pos, F.lit(""))), r"\s+"), lambda p: p != ""), lambda p: F.struct(F.concat(p, F.lit(".")).alias("part"), word.alias("meaning")))
    return F.when(F.size(parts) > 0, parts).otherwise(bare)


def secondary_results(entries: DataFrame) -> DataFrame:
    """word, phonetic, parts, exchanges.  entries: word, phonetic, translation, pos, exchange."""
    return entries.select("word", bare_phonetic(F.col("phonetic")).alias("phonetic"), secondary_parts(F.col("translation"), F.col("pos"), F.col("word")).alias("parts"), secondary_exchange(F.col("exchange")).alias("exchanges"))


def without_variants(words: Column) -> Column:
    """The first word of a spelling pair is hidden where the second is there too."""
    low = F.transform(words, lambda w: F.lower(F.trim(w)))
    return F.filter(words, lambda w: ~F.coalesce(F.array_contains(low, F.element_at(literal_map(dict(SPELLING_PAIRS)), F.lower(F.trim(w)))), F.lit(False)))


WORD = "struct<ukphone:string,usphone:string,phone:string,ukspeech:string,usspeech:string,prototype:string,wfs:array<struct<wf:struct<name:string,value:string>>>,trs:array<struct<pos:string,tran:string,tr:array<struct<l:struct<i:string>,tran:string>>>>>"
BASE_FORM = "原形"


def _provider_answers(answers: DataFrame) -> DataFrame:
    """query_id, w (the word's object), e (that of the monolingual part), rows (array of pos, meaning, each once, in order)."""
    get = lambda path: F.get_json_object("body", path)
    whole = lambda path: F.when(get(path).startswith("{"), get(path))
    word = F.coalesce(get("$.ec.word[0]"), whole("$.ec.word"), get("$.ce.word[0]"), whole("$.ce.word"))
    df = answers.select("query_id", F.from_json(word, WORD).alias("w"), F.from_json(whole("$.ee.word"), WORD).alias("e"))
    told = lambda t, x: F.struct(F.trim(F.coalesce(t["pos"], F.lit(""))).alias("pos"), F.trim(F.coalesce(x, F.lit(""))).alias("meaning"))
    none = F.array().cast("array<struct<pos:string,meaning:string>>")
    inner = lambda t: F.coalesce(t["tr"], F.array().cast("array<struct<l:struct<i:string>,tran:string>>"))
    text = lambda i: F.coalesce(F.array_join(F.from_json(i, "array<string>"), ""), i)  # noqa: E731  (one text or a list of pieces)
    nested = lambda t: F.concat(F.array(told(t, t["tran"])), F.transform(inner(t), lambda n: told(t, text(n["l"]["i"]))))
    plain = lambda t: F.transform(inner(t), lambda n: told(t, n["tran"]))
    said = lambda a: F.filter(F.coalesce(a, none), lambda x: x["meaning"] != "")
    df = df.withColumns({"own": said(F.flatten(F.transform("w.trs", nested))), "other": said(F.flatten(F.transform("e.trs", plain)))})
    rows = F.transform(F.when(F.size("own") > 0, F.col("own")).otherwise(F.col("other")), lambda x: F.struct(F.when(x["pos"] == "", DEFAULT_POS).otherwise(x["pos"]).alias("pos"), x["meaning"].alias("meaning")))
    return df.select("query_id", "w", "e", F.array_distinct(rows).alias("rows"))


def provider_rows(answers: DataFrame) -> DataFrame:
    """query_id, phonetic, pos, meaning, i: meanings of stored JSON answers in order, each once for a part of speech.  answers: query_id, body.

    `ec.word` or `ce.word` may be an object or an array (its first element counts); without meanings there `ee` is used.
    """
    df = _provider_answers(answers)
    phones = F.array(*[bare_phonetic(F.col(c)) for c in ("w.ukphone", "w.usphone", "w.phone", "e.phone", "w.usspeech", "w.ukspeech")])
    phone = F.coalesce(F.try_element_at(F.filter(phones, lambda p: p != ""), F.lit(1)), F.lit(""))
    return df.select("query_id", phone.alias("phonetic"), F.posexplode("rows").alias("i", "r")).select("query_id", "phonetic", "r.pos", "r.meaning", "i")


def provider_results(answers: DataFrame) -> DataFrame:
    """query_id, phonetics (array of type, value), parts (array of part, meanings), exchanges (array of name, word); an answer without a meaning has no row.

    Sounds: the British and the American one, else the plain one (of the monolingual part where the word has none), else
    what is spoken, as it stands.  Parts of speech come in order of first sight; word forms need a name and a form, the base
    form comes last.  answers: query_id, body.
    """
    df = _provider_answers(answers).where(F.size("rows") > 0)
    sound = lambda kind, value: F.array(F.struct(F.lit(kind).alias("type"), F.coalesce(value, F.lit("")).alias("value")))
    heard = lambda sounds: F.filter(sounds, lambda p: p["value"] != "")
    own = heard(F.concat(sound("uk", bare_phonetic(F.col("w.ukphone"))), sound("us", bare_phonetic(F.col("w.usphone")))))
    phone = F.coalesce(F.nullif("w.phone", F.lit("")), F.col("e.phone"))
    rest = heard(F.concat(sound("uk", bare_phonetic(phone)), sound("us", F.col("w.usspeech")), sound("uk", F.col("w.ukspeech"))))
    parts = F.transform(F.array_distinct(F.transform("rows", lambda r: r["pos"])), lambda p: F.struct(p.alias("part"), F.transform(F.filter("rows", lambda r: r["pos"] == p), lambda r: r["meaning"]).alias("meanings")))
    pair = lambda name, word: F.struct(F.trim(F.coalesce(name, F.lit(""))).alias("name"), word.alias("word"))
    forms = F.coalesce(F.transform("w.wfs", lambda x: pair(x["wf"]["name"], F.trim(F.coalesce(x["wf"]["value"], F.lit(""))))), F.array().cast("array<struct<name:string,word:string>>"))
    forms = F.concat(forms, F.array(pair(F.lit(BASE_FORM), F.coalesce("w.prototype", F.lit("")))))
    return df.select("query_id", F.when(F.size(own) > 0, own).otherwise(F.slice(rest, 1, 1)).alias("phonetics"), parts.alias("parts"), F.filter(forms, lambda x: (x["name"] != "") & (x["word"] != "")).alias("exchanges"))


def source_label(word: Column, label: Column) -> Column:
    return F.concat(word, F.lit(" 的"), label)


def grouped_source_parts(asked: DataFrame, entries: DataFrame) -> DataFrame:
    """query_id, i, part, meanings: own parts of a standalone entry, then a block `[X 的 label]` for each origin, nouns first.

    asked: query_id, entry_kind, translation, relations; entries: word, details (array of pos, text, countability).
    Only what the label allows is taken, and no uncountable sense for a plural unless the entry is standalone.
    """
    own = asked.where("entry_kind = 'standalone'").select("query_id", F.posexplode(parse_parts(F.col("translation"))).alias("i", "p"))
    own = own.select("query_id", F.struct(F.lit(0).alias("g"), F.lit(0).alias("r"), F.col("i").alias("i")).alias("place"), F.col("p.pos").alias("part"), F.array("p.meaning").alias("meanings"))
    origins = F.filter("relations", lambda r: (r["type"] == "origin") & (r["direction"] == "outgoing"))
    origins = distinct_by(origins, lambda r: F.concat(r["target"], F.lit(":"), r["label"]))
    each = asked.select("query_id", "entry_kind", F.posexplode(origins).alias("i", "r"))
    met = each.join(entries.select(F.lower("word").alias("k"), "details"), F.lower("r.target") == F.col("k"))
    scope = F.element_at(literal_map(LABEL_POS), F.col("r.label"))
    fits = lambda d: (scope.isNull() | F.array_contains(scope, F.replace(d["pos"], F.lit("."), F.lit("")))) & ((F.col("r.label") != "复数") | (F.col("entry_kind") == "standalone") | (F.coalesce(d["countability"], F.lit("")) != "uncountable"))
    texts = F.array_distinct(F.filter(F.transform(F.filter("details", fits), lambda d: d["text"]), lambda t: F.coalesce(t, F.lit("")) != ""))
    rank = F.coalesce(pos_rank(scope[0]), F.lit(99))
    blocks = met.select("query_id", F.struct(F.lit(1).alias("g"), rank.alias("r"), F.col("i").alias("i")).alias("place"), F.concat(F.lit("["), source_label(F.col("r.target"), F.col("r.label")), F.lit("]")).alias("part"), texts.alias("meanings")).where(F.size("meanings") > 0)
    return own.unionByName(blocks).withColumn("i", F.array(F.col("place.g"), F.col("place.r"), F.col("place.i"))).drop("place")


def scoped_parts(parts: Column, scopes: Column) -> Column:
    """Parts one of whose parts of speech is allowed; all if nothing is."""
    own = lambda p: F.array_distinct(F.regexp_extract_all(F.lower(p["pos"]), F.lit(r"([a-z0-9+]+)(?=\.)"), 1))
    return F.when(F.size(scopes) == 0, parts).otherwise(F.filter(parts, lambda p: F.arrays_overlap(own(p), scopes)))


def phrase_parts(phrases: Column) -> Column:
    """(name, meanings) of phrasal verbs; `phrv.` is shown as `v.`."""
    one = lambda p: F.transform(parse_parts(p["translation"]), lambda x: F.when(x["pos"] == DEFAULT_POS, x["meaning"]).otherwise(F.concat(F.when(x["pos"] == "phrv.", "v.").otherwise(x["pos"]), F.lit(" "), x["meaning"])))
    return F.transform(phrases, lambda p: F.struct(p["name"].alias("pos"), one(p).alias("meanings")))
