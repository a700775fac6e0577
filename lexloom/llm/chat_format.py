"""Chat formatting into budgeted windows; DataFrame functions only.

A turn is written `<|im_start|>role\\ntext<|im_end|>\\n`.  In texts and roles a backslash becomes two and `<|` becomes
`<\\|` (a line break in a role gets a backslash), so no text can hold a marker and every turn can be read back.

Prefix sums of the turns' tokens (words, and 4 for the template) cut a conversation into turn-aligned windows of at most
`budget` tokens; a longer turn stands in a window of its own.  Later windows repeat the system turn and up to `history`
turns before them (of at most a quarter of the budget).  The loss mask covers the text of assistant turns, each in the
one window where it is new; repeated turns are masked.

Turns stay rows throughout: places, sums and repeated turns come from window functions, which spill, and no row holds more
than a window's text, so a conversation of very many turns (all rows without an id are one) takes time in proportion to
them.  What chooses the spans gathers three numbers a turn.  `read_back` and `digests` put a conversation together again,
since a digest is taken of the whole of it.

Rows are ordered by turn (nulls first), then role and text.  Null text or role: empty.  Rows of a null id are one conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lexloom.llm.shared import pick, settle

BUDGET, HISTORY, TEMPLATE_TOKENS = 256, 2, 4
#: Turns whose openings are listed together.
BLOCK = 512
START, END = "<|im_start|>", "<|im_end|>\n"
TURN = r"(?s)^<\|im_start\|>((?:[^\\\n]|\\.)*)\n(.*)$"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def _ordered(conversations: DataFrame, budget: int, history: int) -> DataFrame:
    """Turns by their place i in the conversation (conv_id, i, role, head, body, cost), with the number h of turns that a
    window opening there repeats, the tokens `anew` of such a window with its first new turn, and 1 in `system` if the first turn is the system's."""
    rows = pick(conversations, "conv_id", "turn", "role", "text")
    rows = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    by_turn = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    so_far = by_turn.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = rows.withColumn("cost", (F.size(F.split("text", r"[\x20\x09-\x0D]+")) + TEMPLATE_TOKENS).cast("long"))
    df = df.withColumns({"i": F.row_number().over(by_turn) - 1, "before": F.sum("cost").over(so_far) - F.col("cost"), "cost0": F.first("cost").over(so_far), "system": (F.first("role").over(so_far) == "system").cast("int")})
    df = df.withColumns({f"tokens{h}": F.col("before") - F.lag("before", h).over(by_turn) for h in range(1, history + 1)})
    fits = {h: (F.col("i") - h >= F.col("system")) & (F.col(f"tokens{h}") * 4 <= budget) for h in range(1, history + 1)}
    most = lambda values: F.greatest(F.lit(0), F.lit(0), *[F.when(fits[h], v) for h, v in values.items()])
    head = F.concat(F.lit(START), F.replace(escape(F.col("role")), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    repeated = most({h: F.col(f"tokens{h}") for h in fits})
    return df.select("conv_id", "i", "role", head.alias("head"), escape(F.col("text")).alias("body"), "cost", "system", most({h: F.lit(h) for h in fits}).alias("h"), (F.col("system") * F.col("cost0") + repeated + F.col("cost")).alias("anew"))


def _openings(ordered: DataFrame, budget: int) -> DataFrame:
    """conv_id, i of the turns that open a window, but the first.  Only numbers are gathered, in blocks: each block's list is
    built by itself and put to the others once, so the work grows with the turns."""
    turns = ordered.select("conv_id", "i", "cost", "anew", "system").repartition("conv_id")
    blocks = turns.groupBy("conv_id", F.floor(F.col("i") / BLOCK).alias("block")).agg(F.sort_array(F.collect_list(F.struct("i", "cost", "anew", "system"))).alias("turns"))
    whole = blocks.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("block", "turns"))).alias("blocks"))
    none = F.array().cast("array<int>")
    state = lambda done, here, used: F.struct(done.alias("done"), here.alias("here"), used.alias("used"))

    def step(s: Column, t: Column) -> Column:
        opens = (t["i"] > t["system"]) & (s["used"] + t["cost"] > budget)
        return F.when(opens, state(s["done"], F.concat(s["here"], F.array(t["i"])), t["anew"])).otherwise(state(s["done"], s["here"], s["used"] + t["cost"]))

    close = lambda s: state(F.concat(s["done"], s["here"]), none, s["used"])
    opened = F.aggregate("blocks", state(none, none, F.lit(0).cast("long")), lambda s, b: F.aggregate(b["turns"], s, step, close), lambda s: s["done"])
    return whole.select("conv_id", F.explode(opened).alias("i"))


def format_conversations(conversations: DataFrame, budget: int = BUDGET, history: int = HISTORY) -> DataFrame:
    """conv_id, window, text, context_turns (repeated turns at its start), loss (array of start and length, in code points from 0)."""
    ordered = settle(_ordered(conversations, budget, history), "turns")
    marks = _openings(ordered, budget).withColumn("turn", F.lit(False))
    by_place = Window.partitionBy("conv_id").orderBy("i", "turn")
    so_far = by_place.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    df = ordered.withColumn("turn", F.lit(True)).unionByName(marks, allowMissingColumns=True)
    df = df.withColumns({"window": F.sum(F.when(F.col("turn"), 0).otherwise(1)).over(so_far), "opens": F.coalesce(~F.lag("turn").over(by_place), F.lit(False))}).where("turn")
    first = lambda c: F.when(F.col("opens") & (F.col("system") == 1), F.first(c).over(so_far))
    repeats = {h: F.when(F.lead("opens", h).over(by_place) & (F.lead("h", h).over(by_place) >= h), F.lead("window", h).over(by_place)) for h in range(1, history + 1)}
    df = df.withColumns({"head0": first("head"), "body0": first("body"), **{f"in{h}": w for h, w in repeats.items()}})
    piece = lambda window, place, head, body, new: F.struct(window.alias("window"), F.struct(place.alias("place"), head.alias("head"), body.alias("body"), new.alias("new"), (new & (F.col("role") == "assistant")).alias("loss")).alias("x"))
    again = [F.when(F.col(f"in{h}").isNotNull(), piece(F.col(f"in{h}"), F.col("i"), F.col("head"), F.col("body"), F.lit(False))) for h in repeats]
    own = piece(F.col("window"), F.col("i"), F.col("head"), F.col("body"), F.lit(True))
    system = F.when(F.col("head0").isNotNull(), piece(F.col("window"), F.lit(-1), F.col("head0"), F.col("body0"), F.lit(False)))
    pieces = df.select("conv_id", F.explode(F.array_compact(F.array(own, system, *again))).alias("p")).select("conv_id", "p.*")
    df = pieces.groupBy("conv_id", "window").agg(F.sort_array(F.collect_list("x")).alias("xs"))  # a window's turns: bounded by its budget
    part = lambda x: F.concat(x["head"], x["body"], F.lit(END))
    state = lambda at, loss: F.struct(at.alias("at"), loss.alias("loss"))
    none = F.array().cast("array<struct<start:bigint,length:int>>")

    def masked(s: Column, x: Column) -> Column:
        span = F.struct((s["at"] + F.length(x["head"])).alias("start"), F.length(x["body"]).alias("length"))
        return state(s["at"] + F.length(part(x)), F.when(x["loss"], F.concat(s["loss"], F.array(span))).otherwise(s["loss"]))

    loss = F.aggregate("xs", state(F.lit(0).cast("long"), none), masked, lambda s: s["loss"])
    return df.select("conv_id", F.col("window").cast("int").alias("window"), F.array_join(F.transform("xs", part), "").alias("text"), F.size(F.filter("xs", lambda x: ~x["new"])).alias("context_turns"), loss.alias("loss"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text), loss_text, formatted_chars: parsed from the windows' texts alone."""
    pieces = F.slice(F.split("text", r"<\|im_end\|>\n"), F.col("context_turns") + 1, F.size(F.split("text", r"<\|im_end\|>\n")) - 1 - F.col("context_turns"))
    turns = F.transform(pieces, lambda p: F.struct(unescape(F.regexp_extract(p, TURN, 1)).alias("role"), unescape(F.regexp_extract(p, TURN, 2)).alias("text")))
    masked = F.array_join(F.transform("loss", lambda x: unescape(F.substring("text", x["start"].cast("int") + 1, x["length"].cast("int")))), "")
    rows = formatted.select("conv_id", F.struct("window", turns.alias("turns"), masked.alias("loss"), F.length("text").alias("chars")).alias("w"))
    df = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("w")).alias("ws"))
    return df.select(
        "conv_id",
        F.flatten(F.col("ws.turns")).alias("turns"),
        F.array_join("ws.loss", "").alias("loss_text"),
        F.aggregate("ws.chars", F.lit(0).cast("long"), lambda a, x: a + x).alias("formatted_chars"),
    )


def digests(read: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )
