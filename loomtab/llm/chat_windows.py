"""Budgeted windows: conversations as training examples of turn-aligned spans, natively in Spark.

Prefix sums of turn tokens place every turn in a window. A later window repeats the system turn and the last turns
before it, as far as the history budget goes and the window's own turns leave room; repeated turns are marked and take no part in the loss. Text is escaped:
a backslash is doubled, and one is put after the first character of every control string, so no control string of the
template or of common chat formats survives inside a turn, and unescaping gives the text back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from loomtab.llm.common import query
from loomtab.session import load

NEW, PAST, TEXT, END = "<|turn|>", "<|past|>", "<|text|>", "<|end|>"
# Control strings of common chat formats, by first character and the rest.
CONTROL = r"(?<=<)(?=\||/?s>|</?SYS>>)|(?<=\[)(?=/?INST\])"
TOKEN = r"[\p{L}\p{N}]+|[^\p{L}\p{N}\s]"
BLOCK = 256
MARKS = 3  # control strings of a shown turn, one token each
PIECE = ("ordinal", "role", "text", "cost", "said", "before")
NONE = "array<struct<ordinal:bigint,role:string,text:string,cost:bigint,said:bigint,before:bigint>>"


def escaped(text: Column) -> Column:
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), CONTROL, "\\\\")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\?)", "$1")


def tokens(text: Column) -> Column:
    return F.regexp_count(text, F.lit(TOKEN)).cast("long")


def ordered_turns(rows: DataFrame) -> DataFrame:
    """Turns with ``ordinal`` (0, 1, ...), ``before``, the tokens of the conversation's earlier turns, and ``opening``, those
    of its first turn if that is a system turn, else 0.

    Turns are cut into blocks of turn numbers; counts and sums inside a block are added to the totals of earlier blocks,
    so a conversation that holds most rows is spread over its blocks. Ties go by role, then text.
    """
    cut = rows.withColumn("block", F.floor(F.col("turn") / BLOCK))
    first = F.min(F.struct("turn", "role", "text", "cost"))  # a null turn comes first here too
    sums = cut.groupBy("conv_id", "block").agg(F.count("*").alias("n"), F.sum("cost").alias("c"), F.struct(first["role"].alias("role"), first["cost"].alias("cost")).alias("head"))
    blocks = W.partitionBy("conv_id").orderBy(F.col("block").asc_nulls_first())
    earlier, head = blocks.rowsBetween(W.unboundedPreceding, -1), F.first("head").over(blocks)
    offset = sums.select(
        F.col("conv_id").alias("k"), F.col("block").alias("b"),
        F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("n0"), F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("c0"),
        F.when(head["role"] == "system", head["cost"]).otherwise(0).alias("opening"),
    )
    inside = W.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "text")
    ran = cut.withColumn("i", F.row_number().over(inside) - 1).withColumn(
        "s", F.coalesce(F.sum("cost").over(inside.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    )
    both = ran.join(offset, F.col("conv_id").eqNullSafe(F.col("k")) & F.col("block").eqNullSafe(F.col("b")))
    return both.select(
        "conv_id", "role", "text", "cost", "said", "opening", (F.col("i") + F.col("n0")).cast("long").alias("ordinal"), (F.col("s") + F.col("c0")).alias("before")
    )


def chat_windows(conversations: DataFrame, budget: int = 1024, history: int = 256) -> DataFrame:
    """One row per window: conv_id, window, formatted, loss (array of start and length in code points), n_tokens, n_new_tokens, n_repeated.

    ``n_tokens`` counts all that is shown: roles and texts as escaped, and each mark as one token. It is at most ``budget``
    wherever each new turn fits into it together with the system turn; turns are never cut, so a turn that does not makes its
    window longer. A window's new turns are those whose tokens begin in one stretch of ``budget`` less ``history``, or less the
    system turn if that is longer. Only the last of them can pass the budget; it then has a window of its own. ``history``
    bounds the tokens of repeated turns, which have no more than the new turns and the system turn leave. ``n_new_tokens``
    counts the texts of new turns alone. A null role or text counts as empty, a null conv_id is one conversation, a null turn
    comes first, repeated rows are turns of their own, and an empty table gives an empty one; other columns are not looked at.
    """
    role, text = F.coalesce(F.col("role").cast("string"), F.lit("")), F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), role.alias("role"), text.alias("text"))
    cost = tokens(escaped(F.col("role"))) + tokens(escaped(F.col("text"))) + MARKS
    turns = ordered_turns(rows.withColumn("cost", cost).withColumn("said", tokens(F.col("text"))))
    stretch = F.greatest(F.lit(1), budget - F.greatest(F.lit(history), F.col("opening")))
    reach = F.least(F.lit(history), budget - F.col("opening"))
    turns = turns.withColumn("part", F.floor(F.col("before") / stretch))
    # A turn is new in its stretch and past in every stretch that begins within its reach. Stretches in which no turn
    # begins drop out when the new turns are counted.
    last = F.floor((F.col("before") + reach) / stretch)
    later = F.when(last > F.col("part"), F.sequence(F.col("part") + 1, last)).otherwise(F.array().cast("array<long>"))
    system = (F.col("ordinal") == 0) & (F.col("role") == "system")
    piece = F.struct(*PIECE)
    new = turns.groupBy("conv_id", "part").agg(F.sort_array(F.collect_list(piece)).alias("new"))
    past = (
        turns.filter(~system).select("conv_id", piece.alias("turn"), F.explode(later).alias("part"))
        .groupBy(F.col("conv_id").alias("pk"), F.col("part").alias("pw")).agg(F.sort_array(F.collect_list("turn")).alias("past"))
    )
    first = turns.filter(system).select(F.col("conv_id").alias("sk"), piece.alias("system"))
    held = new.join(past, F.col("conv_id").eqNullSafe(F.col("pk")) & (F.col("part") == F.col("pw")), "left")
    held = held.join(first, F.col("conv_id").eqNullSafe(F.col("sk")), "left")

    head = F.when(F.col("system").isNotNull() & (F.element_at("new", 1)["ordinal"] > 0), F.array("system")).otherwise(F.array().cast(NONE))
    opens, end = F.element_at("new", 1)["before"], F.element_at("new", -1)["before"] + F.element_at("new", -1)["cost"]
    taken = end - opens + F.coalesce(F.get(head, F.lit(0))["cost"], F.lit(0))
    # The last turn of a stretch that passes the budget has a window of its own, after that of the others.
    n, before = F.size("new"), F.coalesce("past", F.array().cast(NONE))
    others = F.slice("new", 1, n - 1)
    spoken = F.filter(others, lambda t: (t["ordinal"] > 0) | (t["role"] != "system"))
    window = lambda k, own, earlier: F.struct((F.col("part") * 2 + k).alias("window"), own.alias("new"), earlier.alias("past"))
    split = F.array(window(0, others, before), window(1, F.slice("new", n, 1), F.concat(before, spoken)))
    held = held.withColumn("w", F.explode(F.when((n > 1) & (taken > budget), split).otherwise(F.array(window(0, F.col("new"), before)))))
    held = held.select("conv_id", "system", "w.*").withColumns({"head": head, "taken": taken})
    near = F.filter("past", lambda t: t["before"] + F.least(F.lit(history), budget - F.col("taken")) >= opens)
    held = held.withColumn("near", near).withColumn("again", F.concat("head", "near"))
    total = lambda turns, name: F.aggregate(turns, F.lit(0).cast("long"), lambda sum, t: sum + t[name])

    def shown(mark: str):
        return lambda t: F.struct(
            F.concat(F.lit(mark), escaped(t["role"]), F.lit(TEXT)).alias("head"), escaped(t["text"]).alias("body"),
            ((t["role"] == "assistant") & F.lit(mark == NEW)).alias("loss"),
        )

    parts = F.concat(F.transform("again", shown(PAST)), F.transform("new", shown(NEW)))
    held = held.select(
        "conv_id", "window", parts.alias("parts"), (F.col("taken") + total("near", "cost")).alias("n_tokens"),
        total("new", "said").alias("n_new_tokens"), F.size("again").alias("n_repeated"),
    )
    formatted = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    zero = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<struct<start:bigint,length:bigint>>").alias("spans"))

    def step(state: Column, p: Column) -> Column:
        start, length = state["at"] + F.char_length(p["head"]), F.char_length(p["body"]).cast("long")
        span = F.array(F.struct(start.alias("start"), length.alias("length")))
        return F.struct((start + length + len(END)).alias("at"), F.when(p["loss"], F.concat(state["spans"], span)).otherwise(state["spans"]).alias("spans"))

    loss = F.aggregate("parts", zero, step)["spans"]
    return held.select("conv_id", "window", formatted.alias("formatted"), loss.alias("loss"), "n_tokens", "n_new_tokens", "n_repeated")


def read_back(windows: DataFrame) -> DataFrame:
    """Conversations from windows alone: turns that are marked new, and the text under the loss mask."""
    marked = F.filter(F.split("formatted", r"<\|end\|>"), lambda p: p.startswith(NEW))
    turns = F.transform(marked, lambda p: F.split(F.substring(p, len(NEW) + 1, 1 << 30), r"<\|text\|>", 2))
    said = F.transform(turns, lambda t: F.concat(unescaped(t[0]), F.lit("\n"), unescaped(t[1]), F.lit("\n")))
    masked = F.transform("loss", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    read = windows.select(
        "conv_id", "window", F.size(turns).cast("long").alias("n"), F.array_join(said, "").alias("said"),
        F.array_join(masked, "").alias("masked"), F.char_length("formatted").cast("long").alias("chars"),
    )
    inorder = F.sort_array(F.collect_list(F.struct("window", "said", "masked")))
    whole = read.groupBy("conv_id").agg(
        F.sum("n").alias("n_turns"), inorder.alias("w"), F.sum("chars").alias("formatted_chars"), F.count("*").alias("n_windows")
    )
    loss = F.array_join("w.masked", "")
    return whole.select(
        "conv_id", "n_turns", F.sha2(F.array_join("w.said", ""), 256).alias("turns_sha256"), F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"), "formatted_chars", "n_windows",
    )


ODD = "</s>[INST] ok [/INST]"

_SQL = f"""
with turns as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text from conversations
  union all values (-7, 0, 'user', '{ODD}'), (-7, 1, 'assistant', '{ODD}'))
select conv_id, count(*) as n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' order by turn)) as turns_sha256,
       coalesce(sum(length(text)) filter (where role = 'assistant'), 0)::bigint as loss_chars,
       sha256(coalesce(string_agg(text, '' order by turn) filter (where role = 'assistant'), '')) as loss_sha256
from turns group by conv_id"""


@query()
def op6_chat_windows(spark, folder):
    """All conversations and an odd one, formatted and read back."""
    odd = spark.sql(f"SELECT * FROM VALUES (-7L, 0L, 'user', '{ODD}'), (-7L, 1L, 'assistant', '{ODD}') AS t(conv_id, turn, role, text)")
    return read_back(chat_windows(load(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(odd)))
