"""Chat formatting with Spark expressions only.

Turns of a conversation are collected as structs and sorted; adjacent turns of one role become one block, whose texts
stand apart by a mark; blocks are concatenated. Template of a block:

    <|turn|>ROLE<|body|>TEXT<|part|>TEXT...<|end|>

Control strings start with ``<|``. In roles and texts every ``<``, run of ``~`` and ``|`` gets one more ``~``, so no text
can hold a control string, and taking one ``~`` away gives the text back. The loss mask covers each assistant text and
nothing else; it is given as runs of (code points outside, code points under the mask).

Null texts and roles count as empty; null turns sort first; equal turns are ordered by role, then text. Rows with a null
conversation id form one conversation. No rows give no rows. Other columns are ignored. A conversation is one output row,
so it has to fit into one string; work is linear in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TURN, BODY, PART, END = "<|turn|>", "<|body|>", "<|part|>", "<|end|>"
LOSS_ROLE = "assistant"


def escaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<(~*)\|", "<~$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<~(~*)\|", "<$1|")


def _literal(mark: str) -> str:
    return mark.replace("|", "\\|")


def format_conversations(turns: DataFrame, loss_role: str = LOSS_ROLE) -> DataFrame:
    """conv_id, formatted, loss_runs from rows (conv_id, turn, role, text)."""
    rows = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
        ).alias("row"),
    )
    sorted_turns = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("row")).alias("turns"))
    # where a block begins: the first turn, and each turn whose role is not that of the turn before
    begins = F.filter(
        F.sequence(F.lit(0), F.size("turns") - 1),
        lambda i: (i == 0) | (F.col("turns")[i]["role"] != F.col("turns")[F.greatest(i - 1, F.lit(0))]["role"]),
    )
    cut = sorted_turns.withColumn("begins", begins)
    stops = F.concat(F.slice("begins", 2, F.size("begins")), F.array(F.size("turns")))
    blocks = F.transform(
        F.arrays_zip(F.col("begins").alias("a"), stops.alias("b")),
        lambda x: F.struct(
            F.col("turns")[x["a"]]["role"].alias("role"),
            F.transform(F.slice("turns", x["a"] + 1, x["b"] - x["a"]), lambda t: escaped(t["text"])).alias("texts"),
        ),
    )
    merged = cut.select("conv_id", blocks.alias("blocks"))
    body = F.array_join(
        F.transform(
            "blocks",
            lambda b: F.concat(F.lit(TURN), escaped(b["role"]), F.lit(BODY), F.array_join(b["texts"], PART), F.lit(END)),
        ),
        "",
    )
    runs = F.flatten(
        F.transform(
            "blocks",
            lambda b: F.transform(
                b["texts"],
                lambda t, k: F.struct(
                    F.when(k == 0, F.char_length(escaped(b["role"])) + len(TURN + BODY)).otherwise(len(PART)).alias("skip"),
                    F.char_length(t).alias("length"),
                    (b["role"] == loss_role).alias("loss"),
                ),
            ),
        )
    )
    return merged.select("conv_id", body.alias("formatted"), runs.alias("loss_runs"))


def read_back(formatted: DataFrame) -> DataFrame:
    """conv_id, turns (role, text, loss) in order, parsed from the formatted text; ``loss`` is that of the mask."""
    blocks = F.slice(F.split("formatted", _literal(END), -1), 1, F.size(F.split("formatted", _literal(END), -1)) - 1)
    parsed = F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.element_at(F.split(b, _literal(BODY), 2), 2), _literal(PART), -1),
                lambda t: F.struct(
                    unescaped(F.substring(F.element_at(F.split(b, _literal(BODY), 2), 1), len(TURN) + 1, 1 << 30)).alias("role"),
                    t.alias("text"),
                ),
            ),
        )
    )
    both = formatted.withColumn("parsed", parsed)
    turns = F.transform(
        F.arrays_zip(F.col("parsed").alias("p"), F.col("loss_runs").alias("r")),
        lambda x: F.struct(
            x["p"]["role"].alias("role"),
            unescaped(x["p"]["text"]).alias("text"),
            # a mask that does not fit the text would show as a missing flag
            F.when(F.char_length(x["p"]["text"]) == x["r"]["length"], x["r"]["loss"]).alias("loss"),
        ),
    )
    return both.select("conv_id", "formatted", turns.alias("turns"))


def digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from the output."""
    read = read_back(formatted)
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: t["text"]), "")
    read = read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), whole.alias("whole"), loss.alias("loss"), "formatted")
    return read.select(
        "conv_id",
        "n_turns",
        F.sha2("whole", 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
