"""Chat formatting in budgeted, turn-aligned windows.

A window is filled greedily: it opens with the conversation's leading system turn and the last turns before it (history,
up to HISTORY tokens, found by a range over the prefix sums of turn tokens), and takes whole turns as long as the prefix
sums stay within the budget. No window exceeds it. A turn that does not fit beside system turn and history is cut into
parts of a fixed number of characters, and parts are what windows take then. The loss mask covers the assistant turns
that are new in the window, so each target is trained once. DataFrame functions only.

Tokens are counted by TOKEN (runs of up to 6 letters or 3 digits, single other characters, and spaces beyond the one
before a token), plus TURN_TOKENS for each turn's marks; a caller with a tokenizer can name a column with its own counts
(then a part of a cut turn counts by TOKEN).

A turn is written "### <role>: <text></turn>" and a line break, a further part of a cut turn "##+ <role>: <text></turn>".
Inside roles and texts a backslash becomes \\b, '#' becomes \\h and '<' becomes \\l, so no text can hold a control
string, and reading back is exact.

Defined cases: a null text or role counts as empty; turns are ordered by turn (null first), then role, then text;
repeated rows are repeated turns; rows without conv_id belong to no conversation, so each is one of its own; a system
turn that is not the first one, or takes over half the budget, is an ordinary turn; an empty table gives no rows. Columns
other than conv_id, turn, role, text and the named counts are not read. A conversation is one document: its turns meet in
one task, as its digest demands.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

BUDGET, HISTORY = 2048, 256
TOKEN, TURN_TOKENS = r" ?(?:\p{L}{1,6}|\p{N}{1,3}|[^\s\p{L}\p{N}])|\s", 8
#: Code points of a part of a cut turn, at most (each is at most one token).
PART = 256
ODD_CONVERSATION = -7
ODD_TEXT = r"\### Assistant: </turn> ok"
ESCAPES = (("\\", "\\b"), ("#", "\\h"), ("<", "\\l"))
TURN = r"(?s)##([#+]) ([^#<]*?): ([^#<]*)</turn>\n"


def escaped(text: Column) -> Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def with_odd_conversation(turns: DataFrame) -> DataFrame:
    """The conversations and one more, whose texts look like the template."""
    roles = F.array(F.lit("user"), F.lit("assistant"))
    odd = turns.sparkSession.range(2).select(F.lit(ODD_CONVERSATION).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.get(roles, F.col("id").cast("int")).alias("role"), F.lit(ODD_TEXT).alias("text"))
    return turns.select(*[F.col(c).cast(t).alias(c) for c, t in (("conv_id", "long"), ("turn", "long"), ("role", "string"), ("text", "string"))]).unionByName(odd)


def token_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, tokens: str | None = None) -> DataFrame:
    """(conv_id, conv, window, text, loss, n_repeated, tokens): formatted windows; loss: array of (start, length) in code points.

    conv tells conversations apart where conv_id is null. tokens: the name of a column with the tokens of each text.
    """
    least_room = budget - budget // 2 - history
    part = min(PART, least_room - TURN_TOKENS)
    if part < 1:
        raise ValueError("the budget must hold history and some text beside a system turn of half its size")
    counted = F.col(tokens).cast("long") if tokens else token_count(F.col("text"))
    rows = turns.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"), (counted if tokens else F.lit(0)).alias("given"))
    rows = rows.withColumn("n", (F.coalesce("given", F.lit(0)) if tokens else token_count(F.col("text"))) + TURN_TOKENS)
    rows = rows.withColumn("conv", F.when(F.col("conv_id").isNull(), F.monotonically_increasing_id()).otherwise(F.lit(-1)).cast("long"))
    talk = ["conv_id", "conv"]
    order = Window.partitionBy(*talk).orderBy("turn", "role", "text")
    rows = rows.withColumn("k", F.row_number().over(order) - 1)
    rows = rows.withColumn("is_system", (F.col("k") == 0) & (F.col("role") == "system") & (F.col("n") <= budget // 2))
    lead = F.coalesce(F.max(F.when(F.col("is_system"), F.col("n"))).over(Window.partitionBy(*talk)), F.lit(0))
    rows = rows.withColumn("lead", lead)
    # parts: a turn as it is, or what a turn too long for a window is cut into
    cut = ~F.col("is_system") & (F.col("n") > budget - F.col("lead") - history)
    parts = F.when(cut & (F.length("text") > part), F.regexp_extract_all("text", F.lit(f"(?s).{{1,{part}}}"), F.lit(0))).otherwise(F.array("text"))
    rows = rows.select(*talk, "k", "role", "is_system", "lead", cut.alias("cut"), F.col("n").alias("whole"), F.posexplode(parts).alias("p", "text"))
    rows = rows.withColumn("n", F.when(F.col("cut"), F.least(F.length("text").cast("long"), token_count(F.col("text"))) + TURN_TOKENS).otherwise(F.col("whole")))
    # the prefix sums of the tokens after the system turn, and how far back the history of a window that starts here reaches
    own = F.when(F.col("is_system"), 0).otherwise(F.col("n"))
    so_far = Window.partitionBy(*talk).orderBy("k", "p").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(own).over(so_far)).withColumn("start", F.col("end") - own).withColumn("i", F.count("*").over(so_far) - 1)
    reach = Window.partitionBy(*talk).orderBy("start").rangeBetween(-history, 0)
    rows = rows.withColumn("_from", F.struct(F.when(F.col("is_system"), F.lit(None)).otherwise(F.col("start")).alias("start"), F.col("i").alias("i")))
    rows = rows.withColumn("back", F.min(F.when(~F.col("is_system"), F.col("_from"))).over(reach))
    piece = F.concat(F.when(F.col("p") == 0, "### ").otherwise("##+ "), F.replace(escaped(F.col("role")), F.lit(":"), F.lit("\\c")), F.lit(": "), escaped(F.col("text")), F.lit("</turn>\n"))
    rows = rows.select(
        *talk, "lead",
        F.struct(
            F.col("i").cast("int").alias("i"), F.col("n"), F.col("is_system"), F.col("back.i").cast("int").alias("back"), (F.col("start") - F.col("back.start")).alias("before"),
            piece.alias("piece"), (F.length(piece) - F.length(escaped(F.col("text"))) - 8).cast("int").alias("head"), (F.col("role") == "assistant").alias("target"),
        ).alias("t"),
    )
    made = rows.groupBy(*talk).agg(F.first("lead").alias("lead"), F.array_sort(F.collect_list("t")).alias("t"))
    first = F.when(F.element_at("t", 1)["is_system"], 1).otherwise(0)
    # greedy: a part opens a window where the one before cannot take it
    fresh = lambda s, x: F.col("lead") + x["before"] + x["n"]
    step = lambda s, x: F.when(x["is_system"], s).when(
        (F.size(s["starts"]) > 0) & (s["used"] + x["n"] <= budget), F.struct((s["used"] + x["n"]).alias("used"), s["starts"].alias("starts"))
    ).otherwise(F.struct(F.when(F.size(s["starts"]) == 0, F.col("lead") + x["n"]).otherwise(fresh(s, x)).alias("used"), F.array_append(s["starts"], x["i"]).alias("starts")))
    begun = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<int>").alias("starts"))
    made = made.withColumn("first", first).withColumn("starts", F.aggregate("t", begun, step, lambda s: s["starts"]))
    made = made.withColumn("starts", F.when(F.size("starts") == 0, F.array(F.lit(0))).otherwise(F.col("starts")))  # a system turn alone
    made = made.select(*talk, "t", "first", "starts", F.posexplode("starts").alias("window", "begin"))
    stop = F.coalesce(F.get("starts", F.col("window") + 1), F.size("t"))
    back = F.when(F.col("window") == 0, F.col("first")).otherwise(F.element_at("t", F.col("begin") + 1)["back"])
    made = made.withColumn("stop", stop).withColumn("back", F.greatest(back, F.col("first")))
    shown = F.concat(F.slice("t", F.lit(1), F.col("first")), F.slice("t", F.col("back") + 1, F.greatest(F.col("stop") - F.col("back"), F.lit(0))))
    made = made.select(*talk, F.col("window").cast("long").alias("window"), "begin", shown.alias("t"))
    made = made.withColumn("n_repeated", F.when(F.col("window") == 0, 0).otherwise(F.size(F.filter("t", lambda x: x["i"] < F.col("begin")))))
    empty = F.array().cast("array<struct<start:int,n:int>>")
    mask = F.aggregate(
        "t",
        F.struct(F.lit(0).alias("at"), empty.alias("out")),
        lambda s, x: F.struct(
            (s["at"] + F.length(x["piece"])).alias("at"),
            F.when(x["target"] & (x["i"] >= F.col("begin")), F.array_append(s["out"], F.struct((s["at"] + x["head"]).alias("start"), (F.length(x["piece"]) - x["head"] - 8).alias("n")))).otherwise(s["out"]).alias("out"),
        ),
        lambda s: s["out"],
    )
    total = F.aggregate("t", F.lit(0).cast("long"), lambda s, x: s + x["n"])
    return made.select(*talk, "window", F.array_join(F.transform("t", lambda x: x["piece"]), "").alias("text"), mask.alias("loss"), "n_repeated", total.alias("tokens"))


def read_back(formatted: DataFrame) -> DataFrame:
    """One row for each conversation, from the formatted windows alone."""
    marks, roles, texts = (F.regexp_extract_all("text", F.lit(TURN), F.lit(k)) for k in (1, 2, 3))
    role = lambda p: unescaped(F.replace(p["r"], F.lit("\\c"), F.lit(":")))
    parsed = F.transform(F.arrays_zip(marks.alias("m"), roles.alias("r"), texts.alias("x")), lambda p: F.concat(F.when(p["m"] == "#", F.concat(F.lit("\n"), role(p), F.lit("\n"))).otherwise(""), unescaped(p["x"])))
    # repeated turns stand first in a window: the system turn, then history
    new = lambda xs: F.slice(xs, F.col("n_repeated") + 1, F.greatest(F.size(xs) - F.col("n_repeated"), F.lit(0)))
    loss = F.transform("loss", lambda s: unescaped(F.substr(F.col("text"), s["start"] + 1, s["n"])))
    turns = F.size(F.filter(new(marks), lambda m: m == "#"))
    each = formatted.select("conv_id", "conv", F.length("text").cast("long").alias("chars"), F.struct("window", F.array_join(new(parsed), "").alias("turns"), turns.alias("n"), F.array_join(loss, "").alias("loss")).alias("w"))
    whole = each.groupBy("conv_id", "conv").agg(F.array_sort(F.collect_list("w")).alias("w"), F.sum("chars").alias("formatted_chars"))
    text = lambda field: F.array_join(F.transform("w", lambda x: x[field]), "")
    # each turn but the first starts with the line break that ends the one before
    return whole.select(
        "conv_id",
        F.aggregate("w", F.lit(0).cast("long"), lambda s, x: s + x["n"]).alias("n_turns"),
        F.sha2(F.concat(F.expr("substr(array_join(transform(w, x -> x.turns), ''), 2)"), F.lit("\n")), 256).alias("turns_sha256"),
        F.length(text("loss")).cast("long").alias("loss_chars"),
        F.sha2(text("loss"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op6(turns: DataFrame) -> DataFrame:
    return read_back(staged(windows(with_odd_conversation(turns)), "chat"))
