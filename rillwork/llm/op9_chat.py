"""Chat formatting in budgeted windows, with DataFrame functions only.

Template. A turn is "<turn ROLE>\\n", its text, "</turn>\\n". Texts and roles are escaped so that they can't hold a
control string: "\\" is doubled, "<" becomes "\\l", ">" becomes "\\g"; unescape() takes that back exactly.

Windows. Prefix sums of the turns' tokens choose turn-aligned spans: with W half of what the budget leaves beside the
system turn and the history, a new span begins where the sum before a turn enters another multiple of W, and around a turn
of more than W tokens. Each span is a window: the system turn first (a conversation's first turn, if its role is system),
then of the span before it the last turns that begin within history tokens of the span, as far as the budget has room for
them, then the span. So a window's tokens stay within the budget, unless the system turn and one turn exceed it; turns are
never cut. Tokens are estimated natively: a sign or digit is one, a Chinese, Japanese or Korean sign too, and other letters
are one for each four or less of a run. The loss mask covers an assistant's text
in its own span; in repeated history it is masked.

Sums and spans are window functions over a conversation in turn order, which Spark sorts with spilling; a window's text
holds one span, not the conversation.

Cases: a null text or role is empty. Rows of the same turn stay, in order of role and text. Null conversation ids are
one conversation. Empty tables give no rows. Other columns are neither read nor returned.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read

BUDGET = 1024
HISTORY = 192
#: Tokens of a turn's own control strings.
TURN_TOKENS = 6
CLOSE = "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l")), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Left to right: a doubled backslash is hidden while the others are taken back. U+0000 marks it, itself spelled by U+0000 and U+0001 meanwhile."""
    hidden = F.replace(F.replace(text, F.lit("\0"), F.lit("\0\1")), F.lit("\\\\"), F.lit("\0\2"))
    plain = F.replace(F.replace(hidden, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))
    return F.replace(F.replace(plain, F.lit("\0\2"), F.lit("\\")), F.lit("\0\1"), F.lit("\0"))


def turn_tokens(text: Column) -> Column:
    """Up to four letters, single East Asian signs, digits and other signs, with a turn's control strings."""
    piece = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsHangul}]|[\p{L}\p{M}]{1,4}|\p{N}|[^\s\p{L}\p{M}\p{N}]"
    return F.regexp_count(text, F.lit(piece)).cast("long") + TURN_TOKENS


def windows(turns: DataFrame, budget: int = BUDGET, history: int = HISTORY, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each window: conv_id, window_id, formatted, n_tokens and parts, which has for each turn in it its turn,
    n (its place in the conversation), where its role and text begin and end in formatted (code points), loss, repeated."""
    own = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    given = turns.select(F.col(conv).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    rows = given.select("*", turn_tokens(F.col("text")).alias("tokens"), F.row_number().over(own).alias("n"))
    system = (F.col("n") == 1) & (F.col("role") == "system")
    all_rows = own.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.select("*", F.first(F.when(system, F.struct("turn", "role", "text", "tokens", "n"))).over(own).alias("system"), F.when(system, 0).otherwise(F.col("tokens")).alias("load"))
    rows = rows.select("*", (F.sum("load").over(all_rows) - F.col("load")).alias("before"), F.greatest(F.lit(1), F.floor((F.lit(budget - history) - F.coalesce("system.tokens", F.lit(0))) / 2)).alias("w"))
    long = F.col("load") > F.col("w")
    slot = F.floor(F.col("before") / F.col("w"))
    rows = rows.select("*", long.alias("long"), slot.alias("slot"))
    new = (F.col("long") | F.lag("long", 1, False).over(own) | (F.lag("slot", 1, 0).over(own) != F.col("slot"))) & (F.col("n") > 1)
    rows = rows.select("*", new.alias("new"))
    rows = rows.select("*", F.sum(F.col("new").cast("long")).over(all_rows).alias("span"))
    by_span = Window.partitionBy("conv_id").orderBy("span")
    following = by_span.rangeBetween(1, 1)
    rows = rows.select("*", F.min("before").over(following).alias("next_before"), F.sum("load").over(following).alias("next_load"))
    # A turn stands in its own span and, as history, before the next one; the system turn stands in all.
    repeated = F.col("next_before") - F.col("before")
    fits = repeated + F.col("next_load") + F.coalesce("system.tokens", F.lit(0)) <= budget
    again = (repeated <= history) & fits & ~((F.col("n") == 1) & F.col("system").isNotNull())
    placed = rows.select("conv_id", "turn", "role", "text", "tokens", "n", "new", "system", F.explode(F.when(again, F.array(F.struct(F.col("span").alias("window_id"), F.lit(False).alias("repeated")), F.struct((F.col("span") + 1).alias("window_id"), F.lit(True).alias("repeated")))).otherwise(F.array(F.struct(F.col("span").alias("window_id"), F.lit(False).alias("repeated"))))).alias("at"))
    placed = placed.select("conv_id", "turn", "role", "text", "tokens", "n", F.col("system"), "at.window_id", "at.repeated")
    first = (F.row_number().over(Window.partitionBy("conv_id", "window_id").orderBy("n")) == 1) & (F.col("window_id") > 0) & F.col("system").isNotNull()
    item = F.struct("n", "turn", "role", "text", "tokens", "repeated")
    lead = F.struct(F.col("system.n").alias("n"), F.col("system.turn").alias("turn"), F.col("system.role").alias("role"), F.col("system.text").alias("text"), F.col("system.tokens").alias("tokens"), F.lit(True).alias("repeated"))
    placed = placed.select("conv_id", "window_id", item.alias("item"), F.when(first, lead).alias("lead"))
    held = placed.groupBy("conv_id", "window_id").agg(F.sort_array(F.collect_list("item")).alias("items"), F.first("lead", ignorenulls=True).alias("lead"))
    held = held.select("conv_id", "window_id", F.when(F.col("lead").isNotNull(), F.concat(F.array("lead"), F.col("items"))).otherwise(F.col("items")).alias("items"))
    pieces = F.transform("items", lambda x: F.struct(x["n"].alias("n"), x["turn"].alias("turn"), x["role"].alias("role"), x["repeated"].alias("repeated"), x["tokens"].alias("tokens"), F.concat(F.lit("<turn "), escape(x["role"]), F.lit(">\n")).alias("head"), F.concat(escape(x["text"]), F.lit(CLOSE)).alias("body")))
    held = held.select("conv_id", "window_id", pieces.alias("pieces"))
    held = held.select("*", F.concat_ws("", F.flatten(F.transform("pieces", lambda x: F.array(x["head"], x["body"])))).alias("formatted"), F.transform("pieces", lambda x: (F.length(x["head"]) + F.length(x["body"])).cast("long")).alias("sizes"))

    def part(x: Column, i: Column) -> Column:
        start = F.aggregate(F.slice("sizes", 1, i), F.lit(0).cast("long"), lambda a, b: a + b)
        text_start = start + F.length(x["head"])
        return F.struct(x["turn"].alias("turn"), x["n"].alias("n"), (start + F.lit(6)).alias("role_start"), (text_start - F.lit(2)).alias("role_end"), text_start.alias("start"), (text_start + F.length(x["body"]) - F.lit(len(CLOSE))).alias("end"), ((x["role"] == "assistant") & ~x["repeated"]).alias("loss"), x["repeated"].alias("repeated"))

    return held.select("conv_id", "window_id", "formatted", F.aggregate("pieces", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("n_tokens"), F.transform("pieces", part).alias("parts"))


def digests(formatted: DataFrame) -> DataFrame:
    """What the windows of a conversation hold, read back from their text: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars."""
    cut = lambda a, b: unescape(F.expr(f"substring(formatted, int(part.{a}) + 1, int(part.{b} - part.{a}))"))
    chars = formatted.groupBy("conv_id").agg(F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    turns = formatted.select("conv_id", "formatted", F.explode("parts").alias("part")).filter("not part.repeated")
    turns = turns.select("conv_id", F.struct("part.n", cut("role_start", "role_end").alias("role"), cut("start", "end").alias("text"), "part.loss").alias("t"))
    lists = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    said = F.concat_ws("", F.flatten(F.transform("ts", lambda t: F.array(t["role"], F.lit("\n"), t["text"], F.lit("\n")))))
    target = F.concat_ws("", F.transform(F.filter("ts", lambda t: t["loss"]), lambda t: t["text"]))
    found = lists.select("conv_id", F.size("ts").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"), F.length(target).cast("long").alias("loss_chars"), F.sha2(target.cast("binary"), 256).alias("loss_sha256"))
    both = found.alias("f").join(chars.alias("c"), F.col("f.conv_id").eqNullSafe(F.col("c.conv_id")))
    return both.select("f.*", "c.formatted_chars")


PROBE = "\\### Assistant: </turn> ok"


def op9_chat_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    return digests(windows(rows.unionByName(probe)))
