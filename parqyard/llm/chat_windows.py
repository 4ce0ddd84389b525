"""Chat formatting in budgeted windows, with a loss mask, in Spark SQL.

Turns of a conversation, in order, are marked as <|role|>text<|end|>; in texts and roles `&`, `<` and `|` are written
as character references, so no text can imitate a mark and reading back is exact. Prefix sums of turn tokens cut a
conversation into spans of whole turns: a span ends where the sum enters the next unit. The unit is the room (the budget
without the system turn and the history) less the largest turn of the conversation that is at most half of the room, so a
span never exceeds the room and mostly fills it; a turn of over half of the room is a span of its own. Each window
holds the system turn (a leading turn of that role), then the last turns of the span before, up to `history` tokens,
then its own span. The loss covers the texts of assistant turns of the own span only: repeated targets are masked.

A window is one row: (conv_id, window, n_turns, n_repeated, n_tokens, formatted, loss_spans), where window is the place
(from 1) of its first own turn, n_repeated leading turns are context repeated from before and loss_spans are (start, length) in code points of formatted, from 0. Only a
turn that alone exceeds the room makes a window exceed the budget.

Tokens are counted as words and two for a turn's marks, unless `count` gives another count of a text column.

Edge cases: null texts and roles are empty. Equal turn numbers are ordered by the MD5 of role and text; null turn numbers
come first. A null conv_id is a conversation of its own. Repeated rows are turns like others. No rows give no windows; extra
columns are ignored. Sums run in ranges of turns, so a conversation of any length is spread over tasks; only the turns of
a window are held together.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import write_table
from .neighbours import running

#: What marks a turn: around the role, and behind the text.
OPEN, CLOSE, END = "<|", "|>", "<|end|>"


def escape(x: Column) -> Column:
    """& < | as character references."""
    for raw, ref in (("&", "&amp;"), ("<", "&lt;"), ("|", "&vert;")):
        x = F.replace(x, F.lit(raw), F.lit(ref))
    return x


def unescape(x: Column) -> Column:
    for raw, ref in (("|", "&vert;"), ("<", "&lt;"), ("&", "&amp;")):
        x = F.replace(x, F.lit(ref), F.lit(raw))
    return x


def tokens(x: Column) -> Column:
    """A turn's tokens: its words (runs of other characters than space and U+0009 to U+000D), and two for its marks."""
    return F.regexp_count(x, F.lit(r"[^\x20\x09-\x0D]+")) + 2


def windows(turns: DataFrame, budget: int = 512, history: int = 96, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", count: Callable[[Column], Column] = tokens) -> DataFrame:
    """The windows of all conversations (see above)."""
    kind = turns.schema[conv].dataType
    t = turns.select(F.col(conv).alias("c"), F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"))
    # the order of turns by what a sample of it may take to the driver: a number and a digest, no texts
    t = t.withColumn("n", count(F.col("text"))).withColumn("tie", F.md5(F.concat("role", F.lit("\n"), "text")))
    first = t.groupBy("c").agg(F.min(F.struct("turn", "tie", (F.col("role") == "system").alias("system"), "n")).alias("f"), F.count("*").alias("turns"))
    first = write_table(first.select(F.col("c").alias("fc"), F.when(F.col("f.system"), F.col("f.n")).otherwise(0).alias("sys_n"), "turns"), "first")
    room = F.lit(budget) - F.col("sys_n") - history
    half = F.greatest(F.lit(1), F.floor(room / 2))
    largest = t.select("c", "n").join(first, F.col("c").eqNullSafe(F.col("fc"))).groupBy("fc", "sys_n", "turns").agg(F.max(F.when(F.col("n") <= half, F.col("n"))).alias("m"))
    first = write_table(largest.withColumn("unit", F.greatest(half, room - F.coalesce("m", F.lit(0)))).drop("m"), "first")
    t = t.join(first, F.col("c").eqNullSafe(F.col("fc"))).withColumn("big", F.col("n") > half)
    t = running(t.drop("fc"), "c", ["turn", "tie"], {"at": F.lit(1), "through": F.col("n"), "bigs": F.col("big").cast("int")})
    t = t.withColumn("before", F.col("through") - F.col("n") - F.col("sys_n")).withColumn("unit", F.floor(F.col("before") / F.col("unit")))
    head = F.concat(F.lit(OPEN), escape(F.col("role")), F.lit(CLOSE))
    t = t.withColumn("head", F.length(head)).withColumn("text", F.concat(head, escape(F.col("text")), F.lit(END)))
    t = write_table(t.withColumn("system", (F.col("at") == 1) & (F.col("sys_n") > 0)), "turns")
    # a span: turns of one unit between two turns that are larger than a unit, or such a turn
    key = ["c", "unit", "bigs", "big"]
    own = t.filter("not system")
    spans = own.groupBy(*key).agg(F.min("at").alias("window"), F.max("at").alias("last"), F.max(F.col("through") - F.col("sys_n")).alias("end"))
    spans = write_table(spans.select(*[F.col(k).alias(f"s_{k}") for k in key], "window", "last", "end"), "spans")
    columns = ["c", "at", "role", "text", "head", "n"]
    placed = own.join(spans, [F.col(k).eqNullSafe(F.col(f"s_{k}")) for k in key])
    repeats = (F.col("end") - F.col("before") <= history) & (F.col("last") < F.col("turns"))
    here = F.struct("window", F.lit(False).alias("repeated"))
    use = F.when(repeats, F.array(here, F.struct((F.col("last") + 1).alias("window"), F.lit(True).alias("repeated")))).otherwise(F.array(here))
    t_own = placed.select(*columns, F.inline(use))
    t_system = t.filter("system").join(spans, F.col("c").eqNullSafe(F.col("s_c")), "left").select(*columns, F.coalesce("window", F.lit(1)).alias("window"), F.coalesce(F.col("window") > 2, F.lit(False)).alias("repeated"))
    t = t_own.unionByName(t_system)
    inside = Window.partitionBy("c", "window").orderBy("at")
    size = F.length("text")
    start = F.coalesce(F.sum(size).over(inside.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    t = t.withColumn("start", start + F.col("head")).withColumn("length", size - F.col("head") - len(END))
    piece = F.struct("at", "text", F.when((F.col("role") == "assistant") & ~F.col("repeated"), F.struct(F.col("start").cast("long").alias("start"), F.col("length").cast("long").alias("length"))).alias("loss"))
    grouped = t.groupBy("c", "window").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.count("*").alias("n_turns"), F.sum(F.col("repeated").cast("long")).alias("n_repeated"), F.sum("n").alias("n_tokens"))
    return grouped.select(
        F.col("c").cast(kind).alias("conv_id"), "window", "n_turns", "n_repeated", "n_tokens", F.array_join("p.text", "").alias("formatted"), F.filter("p.loss", lambda x: x.isNotNull()).alias("loss_spans"),
    )


def turns_of(formatted: DataFrame) -> DataFrame:
    """The own turns of each window, read back: (conv_id, window, place, role, text)."""
    parts = F.filter(F.split("formatted", r"<\|end\|>"), lambda x: x != "")
    t = formatted.select("conv_id", "window", "n_repeated", F.posexplode(parts).alias("place", "part")).filter("place >= n_repeated")
    return t.select("conv_id", "window", "place", unescape(F.expr(f"substring(part, 3, locate('{CLOSE}', part) - 3)")).alias("role"), unescape(F.expr(f"substring(part, locate('{CLOSE}', part) + 2)")).alias("text"))
