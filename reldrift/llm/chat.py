"""Chat formatting in Spark expressions: sort turns, merge adjacent ones of a role, concatenate.

A message is ``<|im_start|>role\\n`` + parts joined by ``<|im_sep|>`` + ``<|im_end|>\\n``; the
parts are the texts of adjacent turns of one role.  Inside roles and texts a backslash is
doubled and ``<|`` becomes ``<\\|``, and a line feed in a role becomes ``\\n``, so that no text
can be taken for a control string and reading back is exact.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<|"), F.lit("<\\|"))


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\([\\|])", "$1")


def _escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit("\n"), F.lit("\\n"))


def _unescape_role(role: Column) -> Column:
    # between doubled backslashes a backslash starts an escape, whatever stands before it
    between = F.split(role, r"\\\\", -1)
    plain = F.transform(between, lambda s: F.replace(F.replace(s, F.lit("\\n"), F.lit("\n")), F.lit("<\\|"), F.lit("<|")))
    return F.array_join(plain, "\\")


def sorted_turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, turns), by turn and then by role and text.

    A NULL role or text counts as empty, rows without a turn come first, and rows without a
    conv_id form one conversation.  Other columns are not used.
    """
    turn = F.struct("turn", *[F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")])
    return rows.select("conv_id", turn.alias("_turn")).groupBy("conv_id").agg(F.sort_array(F.collect_list("_turn")).alias("turns"))


def merged_messages(turns: Column) -> Column:
    """Sorted turns -> array<struct<role, parts>>, one for each run of turns of one role."""
    places = F.sequence(F.lit(1), F.size(turns))
    starts = F.filter(places, lambda i: (i == 1) | (F.get(turns, i - 1)["role"] != F.get(turns, i - 2)["role"]))
    ends = F.concat(F.slice(starts, 2, F.size(starts)), F.array(F.size(turns) + 1))
    runs = F.zip_with(starts, ends, lambda a, b: F.slice(turns, a, b - a))
    return F.transform(runs, lambda run: F.struct(F.get(run, 0)["role"].alias("role"), F.transform(run, lambda t: t["text"]).alias("parts")))


def format_conversations(rows: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, messages, formatted, loss_mask).

    ``loss_mask`` has (skip, take, skip_after) in code points of ``formatted`` for every
    turn in order: ``take`` characters count for the loss, the rest does not.  Template
    characters are never under the loss.
    """
    merged = sorted_turns(rows).withColumn("messages", merged_messages(F.col("turns")))

    def text_of(m: Column) -> Column:
        parts = F.transform(m["parts"], escape)
        return F.concat(F.lit(START), _escape_role(m["role"]), F.lit("\n"), F.array_join(parts, SEP), F.lit(END + "\n"))

    def mask_of(m: Column) -> Column:
        head = F.length(_escape_role(m["role"])) + len(START) + 1
        last = F.size(m["parts"]) - 1
        counted = m["role"].isin(*loss_roles)

        def part(p: Column, i: Column) -> Column:
            before = F.when(i == 0, head).otherwise(len(SEP))
            length = F.length(escape(p))
            return F.struct(
                (before + F.when(counted, 0).otherwise(length)).alias("skip"),
                F.when(counted, length).otherwise(0).alias("take"),
                F.when(i == last, len(END) + 1).otherwise(0).alias("skip_after"),
            )

        return F.transform(m["parts"], part)

    return merged.select(
        "conv_id", "messages",
        F.array_join(F.transform("messages", text_of), "").alias("formatted"),
        F.flatten(F.transform("messages", mask_of)).alias("loss_mask"),
    )


def under_loss(formatted: Column, loss_mask: Column) -> Column:
    """The stretches of ``formatted`` under the loss mask, one for each turn that counts, unescaped."""
    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<string>").alias("cut"))

    def step(done: Column, m: Column) -> Column:
        begin = done["at"] + m["skip"]
        piece = F.array(F.substring(formatted, begin + 1, m["take"]))
        return F.struct(
            (begin + m["take"] + m["skip_after"]).alias("at"),
            F.when(m["take"] > 0, F.concat(done["cut"], piece)).otherwise(done["cut"]).alias("cut"),
        )

    return F.transform(F.aggregate(loss_mask, none, step, lambda done: done["cut"]), unescape)


def read_back(formatted: Column) -> Column:
    """Formatted text -> array<struct<role, text>>, one for each turn that went in."""
    messages = F.split(formatted, r"<\|im_start\|>", -1)
    messages = F.slice(messages, 2, F.size(messages))

    def turns_of(m: Column) -> Column:
        role = F.substring_index(m, "\n", 1)
        body = F.substring(m, F.length(role) + 2, F.length(m) - F.length(role) - 1 - len(END) - 1)
        parts = F.split(body, r"<\|im_sep\|>", -1)
        plain = _unescape_role(role)
        return F.transform(parts, lambda p: F.struct(plain.alias("role"), unescape(p).alias("text")))

    return F.flatten(F.transform(messages, turns_of))
