"""Chat formatting by prefix-target expansion, in DataFrame functions only.

A turn becomes ``### role:``, a line break, its text and the end mark ``</turn>`` with a line break.
In roles and texts the characters that marks are made of are written as two characters each, so that
no text can look like a mark and the turns can be read back. Every assistant turn makes one example:
all turns before it as context and its text alone under the loss mask. If turns follow the last
assistant turn, one more example holds the whole conversation with nothing to train on, so that the
examples of a conversation always contain all of its turns.

Results for odd input: a null text or role counts as empty; turns with equal number are ordered by
role and text; repeated rows are turns of their own; rows without conversation id form one
conversation; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let

END = "</turn>\n"
# Every character that marks use, and what stands for it; the escape character first.
ESCAPES = [("\\", "\\s"), ("<", "\\l"), ("#", "\\h"), (":", "\\c")]


def _replace(c: Column, old: str, new: str) -> Column:
    return F.replace(c, F.lit(old), F.lit(new))


def escape(c: Column) -> Column:
    for plain, written in ESCAPES:
        c = _replace(c, plain, written)
    return c


def unescape(c: Column) -> Column:
    """The inverse: an escape character is always followed by its letter, so the order is safe from the back."""
    for plain, written in reversed(ESCAPES):
        c = _replace(c, written, plain)
    return c


def formatted(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, turns)`` with the formatted head and body of every turn in order."""
    clean = [F.coalesce(F.col(c), F.lit("")) for c in (role, text)]
    one = F.struct(F.col(turn).alias("turn"), clean[0].alias("role"), clean[1].alias("text"))
    return turns.groupBy(F.col(conv_id).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("ordered")).select(
        "conv_id", F.transform("ordered", lambda t: F.struct(
            (t["role"] == "assistant").alias("trained"),
            F.concat(F.lit("### "), escape(t["role"]), F.lit(":\n")).alias("head"), escape(t["text"]).alias("body"))).alias("turns"))


def prefix_examples(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """``(conv_id, example, text, loss_start, loss_end)``: the mask as code points ``[loss_start, loss_end)`` of the text.

    The last example of a conversation that ends without an assistant turn has an empty mask at its end.
    """
    rows = formatted(turns, conv_id, turn, role, text)
    transcript = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["head"], t["body"], F.lit(END))))

    def with_ends(all_turns: Column) -> Column:
        """End of every turn in the transcript, by one pass over the lengths."""
        lengths = F.transform(all_turns, lambda t: F.length(t["head"]) + F.length(t["body"]) + len(END))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("ends"))
        return F.aggregate(lengths, start, lambda s, n: F.struct((s["at"] + n).alias("at"), F.concat(s["ends"], F.array(s["at"] + n)).alias("ends")))["ends"]

    def targets(ends: Column) -> Column:
        marked = F.transform("turns", lambda t, i: F.struct(
            t["trained"].alias("trained"), F.get(ends, i).alias("stop"), (F.get(ends, i) - len(END)).alias("loss_end"),
            (F.get(ends, i) - len(END) - F.length(t["body"])).alias("loss_start")))
        trained = F.filter(marked, lambda m: m["trained"])
        last = F.element_at(ends, -1)
        rest = F.array(F.struct(F.lit(False).alias("trained"), last.alias("stop"), last.alias("loss_end"), last.alias("loss_start")))
        return F.when(F.element_at("turns", -1)["trained"], trained).otherwise(F.concat(trained, rest))

    rows = rows.select("conv_id", transcript.alias("transcript"), let(with_ends(F.col("turns")), targets).alias("targets"))
    rows = rows.select("conv_id", "transcript", F.posexplode("targets").alias("example", "target"))
    return rows.select("conv_id", "example", F.substring("transcript", F.lit(1), F.col("target.stop")).alias("text"),
                       F.col("target.loss_start").alias("loss_start"), F.col("target.loss_end").alias("loss_end"))


def read_turns(text: Column) -> Column:
    """Roles and texts of a formatted text, as they were."""
    parts = F.filter(F.split(text, END), lambda p: p != "")

    def turn(p: Column) -> Column:
        at = F.locate(":\n", p)
        return F.struct(unescape(F.substring(p, F.lit(5), at - 5)).alias("role"), unescape(F.substring(p, at + 2, F.length(p))).alias("text"))

    return F.transform(parts, turn)


def loss_text(text: Column, start: Column, end: Column) -> Column:
    return unescape(F.substring(text, start + 1, end - start))


def conversation_digests(examples: DataFrame) -> DataFrame:
    """What the examples of each conversation hold: turns, trained text and size."""
    trained = F.struct("example", loss_text(F.col("text"), F.col("loss_start"), F.col("loss_end")).alias("text"))
    rows = examples.groupBy("conv_id").agg(
        F.max_by("text", "example").alias("whole"), F.array_sort(F.collect_list(trained)).alias("trained"), F.sum(F.length("text")).alias("formatted_chars"))
    rows = rows.select("conv_id", read_turns(F.col("whole")).alias("turns"), F.concat_ws("", F.transform("trained", lambda t: t["text"])).alias("loss"), "formatted_chars")
    spelled = F.concat_ws("", F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))))
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(spelled, 256).alias("turns_sha256"),
                       F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
