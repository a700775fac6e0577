"""Entry parts taken from shredded markup: every extractor is a Column expression over `nodes`."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lexloom.functions.fixed import FAMILY_POS
from lexloom.functions.forms import moved_grades, serialise, slot_forms
from lexloom.functions.pos import family_pos, literal_map, normal_pos, pos_label, valid_pos
from lexloom.functions.text import display, let
from lexloom.operators.fragments import meaning_items
from lexloom.operators.stages import settle
from lexloom.operators.views import distinct_by, share_by_pos
from lexloom.sources.markup import below, first_text, inside, outside, shred, texts, with_class, with_tag

# Verb form names of the markup with their slots and labels.
FORM_SLOTS = {"thirdps": "3", "past": "p", "pastpart": "d", "ptpp": "d", "prespart": "i"}
FORM_LABELS = {"root": "原形", "thirdps": "第三人称单数", "past": "过去式", "pastpart": "过去分词", "ptpp": "过去分词", "prespart": "现在分词"}
CORE_CLASSES = ["ox3ksym_a1", "ox3ksym_a2", "ox3ksym_b1", "ox3ksym_b2", "ox3ksym_c1"]
REFERENCES = {"ptof": "过去式", "ppof": "过去分词", "ptppof": "过去式和过去分词", "presptof": "现在分词", "thirdpsof": "第三人称单数", "plof": "复数", "singof": "单数", "comparof": "比较级", "defat": "相应形式"}


def phonetic(nodes: Column, block: str) -> Column:
    """First .phon in the block (phons_br or phons_n_am), slashes off."""
    return F.replace(first_text(inside(with_class(nodes, "phon"), with_class(nodes, block))), F.lit("/"), F.lit(""))


def core_senses(nodes: Column, fall_back: bool = True) -> Column:
    """Senses outside idioms; all senses if there are none (and fall_back is set)."""
    every = F.filter(nodes, lambda n: (n["tag"] == "li") & F.array_contains(n["cls"], "sense"))
    core = outside(every, with_class(nodes, "idioms"))
    return F.when(F.size(core) > 0, core).otherwise(every) if fall_back else core


def qualifier(nodes: Column, sense: Column) -> Column:
    own = below(nodes, sense)
    said = F.transform(inside(with_tag(own, "chn"), with_class(own, "dis-g")), lambda n: display(n["text"]))
    return F.array_join(F.array_distinct(F.filter(said, lambda x: x != "")), ",")


def countability(nodes: Column, sense: Column) -> Column:
    words = F.regexp_extract_all(F.lower(F.array_join(texts(with_class(below(nodes, sense), "grammar")), " ")), F.lit("[a-z]+"), 0)
    yes, no = F.array_contains(words, "countable"), F.array_contains(words, "uncountable")
    return F.when(yes & no, "both").when(yes, "countable").when(no, "uncountable")


def sense_text(nodes: Column, sense: Column) -> Column:
    """First Chinese text of the definition; old-fashioned senses say so at the end."""
    own = below(nodes, sense)
    text = display(first_text(inside(with_tag(own, "chn"), with_tag(own, "deft"))))
    labels = F.lower(F.array_join(texts(inside(with_class(own, "lb"), with_class(own, "labels"))), " "))
    return F.when((text != "") & labels.rlike("old-fashioned|老式用法"), F.concat(text, F.lit(" [老式用法]"))).otherwise(text)


def reference_text(nodes: Column) -> Column:
    """`X 的过去式` and the like, for an entry whose only content is a cross-reference; empty if there is none."""
    xref = F.try_element_at(with_class(nodes, "xrefs"), F.lit(1))
    word = first_text(with_class(below(nodes, xref), "xh"))
    kind = F.element_at(literal_map(REFERENCES), F.element_at(xref["attrs"], "xt"))
    return F.coalesce(F.when(word != "", F.concat(word, F.lit(" 的"), kind)), F.lit(""))


def exchange(nodes: Column) -> Column:
    """Verb table rows and inflection blocks as slot:form/slot:form.  A third person in -ing is none; a block's form that the table has is skipped unless the block says plural."""
    table = with_class(nodes, "verb_forms_table")
    rows = F.filter(inside(with_tag(nodes, "tr"), table), lambda r: F.element_at(r["attrs"], "form").isin(*FORM_SLOTS))

    def told(r: Column) -> Column:
        own = below(nodes, r)
        cell = F.try_element_at(with_tag(own, "td"), F.lit(1))
        prefix = first_text(with_class(below(nodes, cell), "vf_prefix"))
        return F.struct(F.element_at(literal_map(FORM_SLOTS), F.element_at(r["attrs"], "form")).alias("slot"), F.trim(F.when(cell["text"].startswith(prefix), F.substring(cell["text"], F.length(prefix) + 1, F.length(cell["text"]))).otherwise(cell["text"])).alias("form"))

    verbs = F.filter(F.transform(rows, told), lambda x: ~((x["slot"] == "3") & x["form"].endswith("ing")))
    low = F.transform(verbs, lambda x: F.lower(x["form"]))

    def block(b: Column) -> Column:
        forms = F.filter(texts(with_class(below(nodes, b), "inflected_form")), lambda t: t != "")
        kept = F.filter(forms, lambda t: F.lower(b["text"]).contains("plural") | ~F.array_contains(low, F.lower(t)))
        return F.transform(kept, lambda t: F.struct(F.lit("s").alias("slot"), t.alias("form")))

    every = F.concat(verbs, F.flatten(F.transform(with_class(nodes, "inflections"), block)))
    return F.array_join(F.transform(every, lambda x: F.concat(x["slot"], F.lit(":"), x["form"])), "/")


def verb_forms(nodes: Column) -> Column:
    """Array of (form, label, subject, word, phonetic) of the verb table; equal form, label, subject and word once."""
    rows = F.filter(inside(with_tag(nodes, "tr"), with_class(nodes, "verb_forms_table")), lambda r: F.exists(below(nodes, r), lambda n: n["tag"] == "td"))

    def told(r: Column) -> Column:
        own, form = below(nodes, r), F.element_at(r["attrs"], "form")
        cell = F.try_element_at(with_tag(own, "td"), F.lit(1))
        prefix = first_text(with_class(below(nodes, cell), "vf_prefix"))
        word = F.when((prefix != "") & cell["text"].startswith(prefix), F.substring(cell["text"], F.length(prefix) + 1, F.length(cell["text"]))).otherwise(cell["text"])
        label = F.coalesce(F.element_at(literal_map(FORM_LABELS), form), display(r["text"]))
        return F.struct(form.alias("form"), label.alias("label"), F.nullif(display(prefix), F.lit("")).alias("subject"), display(word).alias("word"), F.nullif(F.replace(first_text(with_class(own, "phon")), F.lit("/"), F.lit("")), F.lit("")).alias("phonetic"))

    told_ = F.filter(F.transform(rows, told), lambda x: x["word"] != "")
    return distinct_by(told_, lambda x: F.array(*[F.coalesce(x[c], F.lit("")) for c in ("form", "label", "subject", "word")]))


_FAMILY_KIND = r"(noun|verb|adjective|adverb|n\.?|v\.?|adj\.?|adv\.?)\b"


def _family_boxes(nodes: Column) -> Column:
    """Marked boxes, else the innermost elements that say Word Family."""
    marked = F.filter(nodes, lambda n: F.arrays_overlap(n["cls"], F.array(F.lit("wordfamily"), F.lit("word_family"))) | (F.element_at(n["attrs"], "unbox") == "wordfamily"))
    says = F.filter(nodes, lambda n: n["text"].rlike(r"(?i)\bword family\b"))
    inner = let(says, lambda all_: F.filter(all_, lambda n: ~F.exists(all_, lambda m: (m["i"] > n["i"]) & (m["i"] <= n["last"]))))
    return F.filter(F.when(F.size(marked) > 0, marked).otherwise(inner), lambda n: F.lower(display(n["text"])).contains("word family"))


def word_family(nodes: Column) -> Column:
    """Array of (word, pos), equal ones once: of each family box its listed members, else its linked words, else `word noun` pairs in its text.

    A linked word has the part of speech of the element behind it, else the one that follows it in the text around it.
    """

    def listed(p: Column) -> Column:
        own = below(nodes, p)
        said = F.try_element_at(with_class(own, "wfp"), F.lit(1))
        return F.struct(display(first_text(with_class(own, "wfw"))).alias("word"), family_pos(display(F.coalesce(F.nullif(F.element_at(said["attrs"], "wfp"), F.lit("")), said["text"], F.lit("")))).alias("pos"))

    def linked(c: Column) -> Column:
        after = F.try_element_at(F.filter(nodes, lambda n: (n["i"] > c["i"]) & (n["up"] == c["up"])), F.lit(1))
        around = F.try_element_at(F.filter(nodes, lambda n: n["i"] == F.element_at(c["up"], -1)), F.lit(1))
        word, near = display(c["text"]), family_pos(display(F.coalesce(after["text"], F.lit(""))))
        found = F.get(F.regexp_extract_all(display(F.coalesce(around["text"], F.lit(""))), F.concat(F.lit("(?i)\\b\\Q"), word, F.lit("\\E\\b\\s+" + _FAMILY_KIND)), 1), F.lit(0))
        return F.struct(word.alias("word"), F.when(near.isin(*set(FAMILY_POS.values())), near).otherwise(family_pos(F.coalesce(found, F.lit("")))).alias("pos"))

    def of(box: Column) -> Column:
        own = below(nodes, box)
        items = F.filter(F.transform(with_class(own, "p"), listed), lambda x: (x["word"] != "") & (x["pos"] != ""))
        link = lambda n: F.arrays_overlap(n["cls"], F.array(F.lit("w"), F.lit("xh"), F.lit("headword"))) | ((n["tag"] == "a") & F.coalesce(F.element_at(n["attrs"], "href").rlike("entry://|/definition/"), F.lit(False)))
        links = F.filter(F.transform(F.filter(own, link), linked), lambda x: (x["word"] != "") & (F.lower(x["word"]) != "word family") & (x["pos"] != ""))
        text, pattern = F.regexp_replace(display(box["text"]), r"[（(]\s*[≠=].*?[）)]", " "), F.lit(r"(?i)\b([A-Za-z][A-Za-z'-]*)\b\s+" + _FAMILY_KIND)
        free = F.zip_with(F.regexp_extract_all(text, pattern, 1), F.transform(F.regexp_extract_all(text, pattern, 2), family_pos), lambda w, k: F.struct(w.alias("word"), k.alias("pos")))
        return let(items, lambda x: F.when(F.size(x) > 0, x).otherwise(let(links, lambda y: F.when(F.size(y) > 0, y).otherwise(F.filter(free, lambda z: F.lower(z["word"]) != "word")))))

    return distinct_by(F.flatten(F.transform(_family_boxes(nodes), of)), lambda x: F.concat(F.lower(x["word"]), F.lit("/"), x["pos"]))


def phrasal_names(nodes: Column) -> Column:
    return F.filter(texts(inside(with_class(nodes, "xh"), with_class(nodes, "phrasal_verb_links"))), lambda x: x != "")


def phrasal_key(name: Column) -> Column:
    return F.lower(F.replace(name, F.lit(" "), F.lit("-")))


def cefr_levels(nodes: Column) -> Column:
    levels = F.transform(F.filter(nodes, lambda n: (n["tag"] == "li") & F.array_contains(n["cls"], "sense")), lambda n: F.element_at(n["attrs"], "cefr"))
    return F.array_join(F.array_sort(F.array_distinct(F.filter(levels, lambda x: x != ""))), ",")


def core_word(nodes: Column) -> Column:
    return F.exists(nodes, lambda n: F.arrays_overlap(n["cls"], F.array(*map(F.lit, CORE_CLASSES)))).cast("int")


def audio(nodes: Column) -> Column:
    links = F.filter(F.transform(with_class(inside(with_tag(nodes, "a"), with_class(nodes, "phons_br")), "sound"), lambda n: F.element_at(n["attrs"], "href")), lambda h: h.startswith("sound://"))
    return F.replace(F.coalesce(F.try_element_at(links, F.lit(1)), F.lit("")), F.lit("sound://"), F.lit(""))


def idioms(nodes: Column) -> Column:
    groups = inside(with_class(nodes, "idm-g"), with_class(nodes, "idioms"))
    said = F.transform(groups, lambda g: F.regexp_replace(first_text(with_class(below(nodes, g), "idm")), r"\s*\|\s*", " | "))
    return F.array_distinct(F.filter(said, lambda x: x != ""))


# Fixed values of the old wide row: order of parts of speech, slots with their labels, marks made full-width.
WIDE_ORDER = ["v", "n", "adj", "adv", "int", "prep", "conj", "pron"]
WIDE_SLOTS = {"3": "第三人称单数", "p": "过去式", "d": "过去分词", "i": "现在分词", "s": "复数形式"}
WIDE_MARKS = (",;()[]", "，；（）［］")


def wide_marks(text: Column) -> Column:
    return F.replace(F.translate(text, *WIDE_MARKS), F.lit("..."), F.lit("…"))


def english_definitions(entries: DataFrame, entry_class: str = "entry") -> DataFrame:
    """key, definition: English definitions of the core senses, a line for each part of speech.  entries: key, nodes."""
    roots = _roots(entries, entry_class)
    own = F.col("own")
    said = F.filter(F.transform(core_senses(own, False), lambda s: display(first_text(with_class(below(own, s), "def")))), lambda x: x != "")
    return _lines_by_pos(roots.select("key", "pos", "at", said.alias("said")), ", ", lambda x: x).withColumnRenamed("line", "definition")


def _lines_by_pos(rows: DataFrame, joiner: str, shown) -> DataFrame:  # noqa: ANN001
    """key, line: `pos. texts` for each part of speech of WIDE_ORDER that has texts.  rows: key, pos, at, said (array)."""
    by_pos = rows.where(F.col("pos").isin(*WIDE_ORDER)).groupBy("key", "pos").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "said"))), lambda x: x["said"])).alias("said")).where(F.size("said") > 0)
    place = F.array_position(F.array(*map(F.lit, WIDE_ORDER)), F.col("pos"))
    line = F.concat("pos", F.lit(". "), shown(F.array_join("said", joiner)))
    return by_pos.groupBy("key").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct(place.alias("p"), line.alias("t")))), lambda x: x["t"]), "\n").alias("line"))


def exchange_lines(text: Column) -> Column:
    """Lines `label：form` of an exchange string; the last form of a slot counts."""
    items = F.filter(F.split(F.coalesce(text, F.lit("")), "/"), lambda x: x.rlike("^[^:]+:.+"))
    last = lambda slot: F.element_at(F.filter(items, lambda x: F.substring_index(x, ":", 1) == slot), -1)
    each = [F.concat(F.lit(f"{label}："), F.regexp_replace(F.when(F.exists(items, lambda x: F.substring_index(x, ":", 1) == slot), last(slot)), "^[^:]*:", "")) for slot, label in WIDE_SLOTS.items()]
    return F.array_compact(F.array(*each))


def wide_rows(lookup: DataFrame, entry_class: str = "entry") -> DataFrame:
    """The old wide dictionary: word, sw, phonetic, definition, translation, pos, collins, oxford, tag, bnc, frq, exchange, detail, audio, idioms.

    Only words with a core sense are kept.  lookup: key, body (markup), ord.  A phrasal verb is named with the first meaning of its own body, a link followed once.
    """
    entries = settle(shred(lookup.select("key", "body", "ord").repartition("key"), "body"), "shredded")  # by key: a source of one file, or one row group, would be read by one task
    nodes, roots = F.col("nodes"), _roots(entries, entry_class)
    own = F.col("own")
    first = F.filter(F.transform(core_senses(own, False), lambda s: F.trim(F.get(F.split(display(first_text(inside(with_tag(below(own, s), "chn"), with_tag(below(own, s), "deft")))), "[,;，；]"), F.lit(0)))), lambda x: x != "")
    told = settle(roots.select("key", "pos", "at", first.alias("said")), "first-meanings")
    shares = told.select("key", "pos", "at", F.explode("said").alias("x"))
    pos = share_by_pos(shares.select("key", F.col("pos").alias("p"), "at"), "key", "p", "at")
    heard = F.coalesce(F.nullif(phonetic(nodes, "phons_br"), F.lit("")), phonetic(nodes, "phons_n_am"))
    parts = entries.select("key", "ord", heard.alias("phonetic"), cefr_levels(nodes).alias("tag"), core_word(nodes).alias("oxford"), exchange(nodes).alias("exchange"), audio(nodes).alias("audio"), F.array_join(idioms(nodes), "\n").alias("idioms"), phrasal_names(nodes).alias("names"))
    meaning = entries.select(F.col("key").alias("name"), F.nullif(display(first_text(inside(with_tag(nodes, "chn"), with_tag(nodes, "deft")))), F.lit("")).alias("told"))
    hop = lookup.where(F.col("body").startswith("@@@LINK=")).select(F.col("key").alias("link"), F.trim(F.regexp_replace("body", "^@@@LINK=", "")).alias("name")).join(meaning.where("told IS NOT NULL"), "name").select(F.col("link").alias("name"), "told")
    meaning = meaning.where("told IS NOT NULL").unionByName(hop)
    named = parts.select("key", F.posexplode("names").alias("i", "name")).join(meaning, "name", "left").select("key", "i", F.concat_ws(" ", display(F.col("name")), "told").alias("t"))
    phrases = named.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("phrases"))
    df = parts.join(pos, "key").join(_lines_by_pos(told, "，", wide_marks), "key", "left").join(english_definitions(entries, entry_class), "key", "left").join(phrases, "key", "left")
    none = F.array().cast("array<string>")
    block = lambda title, lines: F.when(F.size(lines) > 0, F.concat(F.array(F.lit(title)), lines)).otherwise(none)
    phrases = F.coalesce("phrases", none)
    text = F.concat(F.array_compact(F.array("line")), block("词形变化：", exchange_lines(F.col("exchange"))), block("Phrasal Verbs：", F.transform(phrases, wide_marks)))
    return df.select(
        F.col("key").alias("word"), F.lower("key").alias("sw"), "phonetic", F.coalesce("definition", F.lit("")).alias("definition"), F.array_join(text, "\n").alias("translation"), "pos", F.lit(0).alias("collins"), "oxford", "tag",
        F.lit(None).cast("int").alias("bnc"), F.lit(None).cast("int").alias("frq"), "exchange", F.array_join(phrases, "\n").alias("detail"), "audio", "idioms",
    )


def _roots(entries: DataFrame, entry_class: str) -> DataFrame:
    """key, nodes, root, own (nodes below the root), pos, at: entry roots with a valid part of speech."""
    roots = entries.select("key", "nodes", F.explode(with_class(F.col("nodes"), entry_class)).alias("root"))
    roots = roots.withColumn("own", below(F.col("nodes"), F.col("root"))).withColumn("pos", normal_pos(first_text(with_class(F.col("own"), "pos"))))
    return roots.where(valid_pos(F.col("pos"))).withColumn("at", F.col("root.i"))


def meanings(entries: DataFrame, entry_class: str = "entry") -> DataFrame:
    """key, pos, items: sense records of every entry root (elements of `entry_class`) with a valid part of speech, in source order.  entries: key, nodes."""
    roots = _roots(entries, entry_class)
    own = F.col("own")
    records = F.transform(core_senses(own), lambda s: F.struct(sense_text(own, s).alias("text"), qualifier(own, s).alias("qualifier"), countability(own, s).alias("countability")))
    roots = roots.withColumns({"told": F.filter(records, lambda r: r["text"] != ""), "other": reference_text(own)})
    other = F.array(F.struct(F.col("other").alias("text"), F.lit("").alias("qualifier"), F.lit(None).cast("string").alias("countability")))
    each = roots.select("key", "pos", F.col("root.i").alias("at"), F.when(F.size("told") > 0, F.col("told")).otherwise(F.filter(other, lambda r: r["text"] != "")).alias("records"))
    grouped = each.groupBy("key", "pos").agg(F.min("at").alias("at"), F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("at", "records"))), lambda x: x["records"])).alias("records"))
    return meaning_items(grouped.where(F.size("records") > 0), "records").select("key", "pos", "at", "items")


def with_de(text: Column) -> Column:
    """Each segment of an adjective's meaning that has no 的 gets one at its end."""
    segments = F.filter(F.transform(F.split(text, "；"), lambda x: F.trim(x)), lambda x: x != "")
    return F.array_join(F.transform(segments, lambda x: F.when(x.contains("的"), x).otherwise(F.concat(x, F.lit("的")))), "；")


def normalise_entries(lookup: DataFrame, entry_class: str = "entry") -> DataFrame:
    """One row a key whose markup has meanings: word, ord, phonetic, phonetic_us, parts (pos, meanings), details (pos, details), translation, pos, exchange, verb_forms, family, phrasal_names.

    lookup: key, body, ord.  The exchange string has comparatives and superlatives in their own slots.
    """
    entries = settle(shred(lookup.select("key", "body", "ord").repartition("key"), "body"), "shredded")  # by key: a source of one file, or one row group, would be read by one task
    told = settle(meanings(entries.select("key", "nodes"), entry_class), "meanings")
    texts_ = F.transform("items", lambda x: F.when(F.col("pos") == "adj", with_de(x["text"])).otherwise(x["text"]))
    each = F.struct("at", pos_label(F.col("pos")).alias("label"), "pos", texts_.alias("texts"), "items")
    by_key = told.groupBy("key").agg(F.sort_array(F.collect_list(each)).alias("p"), F.sum(F.size("items")).alias("total"))
    summary = F.array_join(F.transform("p", lambda x: F.concat(x["pos"], F.lit(":"), F.bround(F.size(x["items"]) * F.lit(100.0) / F.col("total")).cast("int").cast("string"))), "/")
    lines = F.transform("p", lambda x: F.concat(x["label"], F.lit(" "), F.array_join(x["texts"], "；")))
    shown = by_key.select(
        "key", F.transform("p", lambda x: F.struct(x["label"].alias("pos"), x["texts"].alias("meanings"))).alias("parts"), F.transform("p", lambda x: F.struct(x["label"].alias("pos"), x["items"].alias("details"))).alias("details"),
        F.array_join(lines, "\n").alias("translation"), summary.alias("pos"),
    )
    nodes = F.col("nodes")
    own = entries.select("key", "ord", phonetic(nodes, "phons_br").alias("phonetic"), phonetic(nodes, "phons_n_am").alias("phonetic_us"), exchange(nodes).alias("forms"), verb_forms(nodes).alias("verb_forms"), word_family(nodes).alias("family"), phrasal_names(nodes).alias("phrasal_names"))
    df = own.join(shown, "key")
    moved = let(slot_forms(F.col("forms")), lambda x: serialise(moved_grades(x, F.col("pos"), F.col("key"))))
    return df.withColumn("exchange", moved).drop("forms").withColumnRenamed("key", "word")


def phrasal_verbs(entries: DataFrame) -> DataFrame:
    """word, phrasal_verbs: (name, translation) of the phrasal verbs that are entries themselves.  entries: word, phrasal_names, translation."""
    each = entries.select("word", F.posexplode("phrasal_names").alias("i", "name"))
    known = entries.select(F.lower("word").alias("k"), "translation")
    met = each.join(known, phrasal_key(F.col("name")) == F.col("k")).where("translation <> ''")
    return met.groupBy("word").agg(F.transform(F.sort_array(F.collect_list(F.struct("i", "name", "translation"))), lambda x: F.struct(x["name"].alias("name"), x["translation"].alias("translation"))).alias("phrasal_verbs"))
