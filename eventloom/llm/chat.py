"""Chat formatting by prefix-target expansion, in DataFrame operations.

Each assistant turn becomes an example of its own: all turns before it as context, then the turn, of which only the reply's text
is under the loss mask. A turn reads <s>[role]text</s>. The characters that control strings start with are escaped in texts and
roles, so a text can't spell one, and unescaped() gives the text back.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template: what stands for a character inside texts and roles. The first is the escape character itself.
ESCAPES = (("\\", "\\b"), ("<", "\\l"), ("[", "\\o"), ("]", "\\c"))
OPEN, CLOSE = "<s>[", "</s>"


def escaped(text) -> F.Column:
    for plain, code in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescaped(text) -> F.Column:
    for plain, code in reversed(ESCAPES):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def examples(turns: DataFrame, *, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", target_role: str = "assistant") -> DataFrame:
    """(conv_id, n_turns, example, formatted, loss_start, loss_end): one row for each turn of target_role; loss_start and
    loss_end are code points of formatted. A conversation that doesn't end with such a turn has one more example, of all its
    turns and with nothing under the mask, so that no turn is lost.

    Defined cases: null roles and texts are empty; turns are ordered by turn (null first), ties by role, then text; repeated
    rows are turns of their own; rows with a null conv_id are one conversation; an empty table gives no example; other columns
    are ignored."""
    rows = turns.select(F.col(conv_id).alias("conv_id"), F.struct(F.col(turn).alias("turn"), F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    pieces = F.transform("turns", lambda t: F.struct(F.concat(F.lit(OPEN), escaped(t["role"]), F.lit("]")).alias("head"), escaped(t["text"]).alias("body"), (t["role"] == target_role).alias("wanted")))
    n = F.size("pieces")
    ends = F.filter(F.sequence(F.lit(1), n), lambda k: F.element_at("pieces", k)["wanted"] | (k == n))
    each = whole.select("conv_id", pieces.alias("pieces")).select("conv_id", "pieces", F.posexplode(ends).alias("example", "k"))
    last = F.element_at("pieces", F.col("k"))
    built = each.select("conv_id", n.alias("n_turns"), "example", F.array_join(F.transform(F.slice("pieces", 1, F.col("k")), lambda p: F.concat(p["head"], p["body"], F.lit(CLOSE))), "").alias("formatted"), F.length(last["body"]).alias("reply"), last["wanted"].alias("wanted"))
    end = F.length("formatted") - len(CLOSE)
    return built.select("conv_id", F.col("n_turns").cast("long"), "example", "formatted", F.when(F.col("wanted"), end - F.col("reply")).otherwise(end).alias("loss_start"), end.alias("loss_end"))


def read_back(formatted: DataFrame) -> DataFrame:
    """examples() -> a row per conversation: conv_id, n_turns and turns_text (role, newline, text, newline for each turn) read
    from its last example, loss_text (all text under the mask, in order), formatted_chars (of all its examples)."""
    loss = unescaped(F.substring("formatted", F.col("loss_start") + 1, F.col("loss_end") - F.col("loss_start")))
    per = formatted.select("conv_id", "example", "formatted", loss.alias("loss")).groupBy("conv_id").agg(F.max_by("formatted", "example").alias("last"), F.sort_array(F.collect_list(F.struct("example", "loss"))).alias("losses"), F.sum(F.length("formatted").cast("long")).alias("formatted_chars"))
    parts = F.filter(F.split("last", CLOSE), lambda p: p != "")
    read = F.transform("parts", lambda p: F.concat(unescaped(F.substring(p, len(OPEN) + 1, F.instr(p, "]") - len(OPEN) - 1)), F.lit("\n"), unescaped(F.substring(p, F.instr(p, "]") + 1, F.length(p))), F.lit("\n")))
    return per.withColumn("parts", parts).select("conv_id", F.size("parts").cast("long").alias("n_turns"), F.array_join(read, "").alias("turns_text"), F.array_join(F.transform("losses", lambda x: x["loss"]), "").alias("loss_text"), "formatted_chars")
