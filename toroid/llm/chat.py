r"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it are context, and its text alone is trainable.
A conversation that doesn't end with an assistant turn gets one more example of all its turns with nothing to train on,
so that no turn is lost.

A turn is written `<|im_start|>role\ntext<|im_end|>\n`. In roles and texts a backslash is doubled and `<|` becomes
`<\|`, so no control string can come from a text, and both replacements can be undone; a line feed in a role becomes
`\n`.

An example holds a whole prefix, so one conversation's examples grow with the square of its turns; that is the method's
output. The turns of a conversation are gathered once; an example is built row by row from them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    """Undo escape(): a backslash stands for the character after it (a line feed where that is n, in roles only)."""
    return F.regexp_replace(text, r"\\(.)", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # n can follow a single backslash only where a line feed was: real backslashes are doubled
    return F.regexp_replace(F.regexp_replace(role, r"(?<!\\)((?:\\\\)*)\\n", "$1\n"), r"\\(.)", "$1")


def format_chats(turns: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", target_role: str = "assistant") -> DataFrame:
    """Examples: conv_id, example (from 1), target_turn (position from 1; null if nothing is trained), n_turns,
    formatted, loss_start (from 0) and loss_length: the trained characters of formatted, in code points.

    Rows of a conversation go by turn; ties by role and text. Null texts and roles count as empty; a null conv_id is
    a conversation like any other; a null turn comes first. An empty table gives no examples; other columns are not read.
    """
    role, text = F.coalesce(F.col(role_col).cast("string"), F.lit("")), F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    rows = turns.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), role.alias("role"), text.alias("text")).alias("t"))
    head = F.concat(F.lit(START), _escape_role(F.col("t.role")), F.lit("\n"))
    rows = rows.select("conv_id", F.struct("t.turn", F.col("t.role").alias("role"), head.alias("head"), escape(F.col("t.text")).alias("body")).alias("t"))
    whole = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))
    targets = F.filter(F.sequence(F.lit(1), F.size("turns")), lambda i: F.element_at("turns", i)["role"] == target_role)
    rest = F.when(F.element_at("turns", -1)["role"] != target_role, F.array(F.lit(0))).otherwise(F.array().cast("array<int>"))
    each = whole.select("conv_id", "turns", F.posexplode(F.concat(targets, rest)).alias("n", "at"))
    each = each.withColumn("length", F.when(F.col("at") > 0, F.col("at")).otherwise(F.size("turns")))
    shown = F.slice("turns", F.lit(1), F.col("length"))
    before = F.array_join(F.transform(F.slice("turns", F.lit(1), F.col("length") - 1), lambda t: F.concat(t["head"], t["body"], F.lit(END + "\n"))), "")
    each = each.withColumns({"before": before, "last": F.element_at(shown, -1)})
    tail = F.concat("before", "last.head", "last.body", F.lit(END + "\n"))
    return each.select(
        "conv_id", (F.col("n") + 1).alias("example"), F.when(F.col("at") > 0, F.col("at")).alias("target_turn"), F.col("length").alias("n_turns"), tail.alias("formatted"),
        F.when(F.col("at") > 0, F.char_length("before") + F.char_length("last.head")).alias("loss_start"),
        F.when(F.col("at") > 0, F.char_length("last.body")).otherwise(0).alias("loss_length"),
    )


def parse_turns(formatted: Column) -> Column:
    """Array of struct(role, text) read back from a formatted example."""
    parts = F.filter(F.split(formatted, r"\Q<|im_start|>\E"), lambda p: p != "")

    def turn(p: Column) -> Column:
        line = F.instr(p, F.lit("\n"))
        return F.struct(_unescape_role(F.substring(p, F.lit(1), line - 1)).alias("role"), unescape(F.substring(p, line + 1, F.char_length(p) - line - len(END) - 1)).alias("text"))

    return F.transform(parts, turn)


def trained_text(formatted: Column, start: Column, length: Column) -> Column:
    """The text under the loss mask, unescaped; empty where nothing is trained."""
    return F.when(start.isNull(), F.lit("")).otherwise(unescape(F.substring(formatted, start + 1, length)))


def digests(examples: DataFrame) -> DataFrame:
    """For each conversation, from its formatted examples alone: number and SHA-256 of its turns, trained text, size.

    The last example has all turns; each example's mask has one assistant text. Only the last example's turns and the
    masked texts are kept past a row.
    """
    turns = F.array_join(F.transform(parse_turns(F.col("formatted")), lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    each = examples.select(
        "conv_id", "example", "target_turn", "formatted", F.char_length("formatted").cast("long").alias("chars"),
        trained_text(F.col("formatted"), F.col("loss_start"), F.col("loss_length")).alias("trained"),
    )
    whole = each.groupBy("conv_id").agg(
        F.max_by("formatted", "example").alias("formatted"), F.sum("chars").alias("formatted_chars"),
        F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("example", "trained"))), lambda e: e["trained"]), "").alias("trained"),
    )
    read = whole.withColumns({"n_turns": F.size(parse_turns(F.col("formatted"))).cast("long"), "turns": turns})
    return read.select(
        "conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"), F.char_length("trained").cast("long").alias("loss_chars"),
        F.sha2("trained", 256).alias("loss_sha256"), "formatted_chars",
    )
