"""Fixed values of the lexicon's data model: words, labels and orders that results depend on."""

# Fixed values, stated plainly and in their natural order.
VALID_POS = ["n", "v", "adj", "adv", "int", "prep", "conj", "pron", "art", "num", "det", "modal", "abbr", "ordinal", "aux", "linking", "phrv", "idm", "prefix", "suffix", "combining", "short", "symbol", "infmarker"]
POS_NAMES = {
    "noun": "n", "verb": "v", "adjective": "adj", "adverb": "adv", "exclamation": "int", "preposition": "prep", "conjunction": "conj", "pronoun": "pron",
    "number": "num", "determiner": "det", "modal verb": "modal", "abbreviation": "abbr", "ordinal number": "ordinal", "auxiliary verb": "aux",
    "linking verb": "linking", "phrasal verb": "phrv", "idiom": "idm", "prefix": "prefix", "suffix": "suffix", "combining form": "combining",
    "short form": "short", "symbol": "symbol", "indefinite article": "art", "definite article": "art", "infinitive marker": "infmarker",
}
FAMILY_POS = {"noun": "noun", "verb": "verb", "adjective": "adjective", "adverb": "adverb", "n": "noun", "v": "verb", "adj": "adjective", "adv": "adverb"}
SLOTS = ["3", "p", "d", "i", "s", "c", "sup"]
SLOT_LABELS = {"3": "第三人称单数", "p": "过去式", "d": "过去分词", "i": "现在分词", "s": "复数", "c": "比较级", "sup": "最高级"}
SLOT_FAMILY = {"3": "verb", "p": "verb", "d": "verb", "i": "verb", "s": "noun", "c": "degree", "sup": "degree"}
LABEL_POS = {"第三人称单数": ["v"], "过去式": ["v"], "过去分词": ["v"], "现在分词": ["v"], "复数": ["n"], "比较级": ["adj", "adv"], "最高级": ["adj", "adv"]}
PLURAL, THIRD = "复数", "第三人称单数"
IRREGULAR_COMPARATIVES = ["more", "less", "better", "worse", "farther", "further"]
IRREGULAR_SUPERLATIVES = ["most", "least", "best", "worst", "farthest", "furthest"]
IRREGULAR_PLURALS = {
    "child": "children", "man": "men", "woman": "women", "foot": "feet", "tooth": "teeth", "mouse": "mice", "goose": "geese", "ox": "oxen", "person": "people",
    "cactus": "cacti", "focus": "foci", "fungus": "fungi", "nucleus": "nuclei", "syllabus": "syllabi", "analysis": "analyses", "crisis": "crises",
    "phenomenon": "phenomena", "criterion": "criteria", "datum": "data",
}
PROTECTED = {"found": ("find", "过去式"), "left": ("leave", "过去式"), "ground": ("grind", "过去式"), "saw": ("see", "过去式"), "bound": ("bind", "过去式"), "rose": ("rise", "过去式"), "sprung": ("spring", "过去分词")}
WIDE, NARROW = "［］【】｛｝（），;", "[][]{}(),；"
