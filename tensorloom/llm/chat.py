"""Chat formatting with Spark expressions only.

Turns are collected as structs in pieces of PIECE turn numbers, sorted, and adjacent turns of one role merged by an array aggregate; the pieces
of a conversation are then joined and merged again where they meet. So no task collects single turns of more than one piece, and what meets for
a whole conversation is its formatted pieces. Template, for each run of turns of one role:

    <|im_start|>role\\n text <|im_sep|> text ... <|im_end|>\\n

Control strings inside roles and texts are escaped: every <| becomes <|| , which no control string begins with, so reading replaces <|| by <|
and loses nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
PIECE = 512
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    return F.replace(text, F.lit("<|"), F.lit("<||"))


def escape_role(role: Column) -> Column:
    """A role ends at the first line feed, so one inside it becomes <|n|>."""
    return F.replace(escape(role), F.lit("\n"), F.lit("<|n|>"))


def unescape_role(role: Column) -> Column:
    return unescape(F.replace(role, F.lit("<|n|>"), F.lit("\n")))


def unescape(text: Column) -> Column:
    return F.replace(text, F.lit("<||"), F.lit("<|"))


def _merge(turns: Column) -> Column:
    """Joins neighbours of one role in an array of (turn, role, text): an array aggregate that keeps finished runs (role, body) in `done` and
    the run it is in as `now`."""
    run = "struct<role:string,body:string>"
    empty = F.struct(F.array().cast(f"array<{run}>").alias("done"), F.lit(None).cast(run).alias("now"))

    def add(acc: Column, t: Column) -> Column:
        longer = F.struct(t["role"].alias("role"), F.concat(acc["now"]["body"], F.lit(SEP), t["text"]).alias("body"))
        fresh = F.struct(t["role"].alias("role"), t["text"].alias("body"))
        return (
            F.when(acc["now"].isNull(), F.struct(acc["done"].alias("done"), fresh.alias("now")))
            .when(acc["now"]["role"] == t["role"], F.struct(acc["done"].alias("done"), longer.alias("now")))
            .otherwise(F.struct(F.array_append(acc["done"], acc["now"]).alias("done"), fresh.alias("now")))
        )

    return F.aggregate(turns, empty, add, lambda acc: F.array_append(acc["done"], acc["now"]))


def format_conversations(turns: DataFrame) -> DataFrame:
    """(conv_id, formatted): one row per conversation of turns(conv_id, turn, role, text).

    Turns go by number, null numbers first; ties go by role, then text, so repeated rows stay as equal neighbours. A null text is empty, a null
    role is the empty role, and rows with a null conv_id form one conversation. Other columns are ignored; an empty table gives no rows.
    """
    clean = turns.select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        escape_role(F.coalesce(F.col("role").cast("string"), F.lit(""))).alias("role"),
        escape(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("text"),
    ).withColumn("piece", F.floor(F.col("turn") / PIECE))
    pieces = clean.groupBy("conv_id", "piece").agg(F.sort_array(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    merged = pieces.select("conv_id", "piece", _merge(F.col("turns")).alias("runs"))
    whole = merged.groupBy("conv_id").agg(F.flatten(F.sort_array(F.collect_list(F.struct("piece", "runs")))["runs"]).alias("runs"))

    def line(run: Column, i: Column) -> Column:
        before, after = F.get("runs", i - 1)["role"], F.get("runs", i + 1)["role"]
        opening = F.when(before.eqNullSafe(run["role"]), F.lit(SEP)).otherwise(F.concat(F.lit(START), run["role"], F.lit("\n")))
        closing = F.when(after.eqNullSafe(run["role"]), F.lit("")).otherwise(F.lit(END + "\n"))
        return F.concat(opening, run["body"], closing)

    return whole.select("conv_id", F.array_join(F.transform("runs", line), "").alias("formatted"))


def read_formatted(formatted: DataFrame) -> DataFrame:
    """The turns and the loss text, read back from the formatted string alone, by the contract's digests.

    The loss mask covers the text of assistant turns, without the marks around and between them. One row per row of `formatted`, repeated rows and a null
    conv_id among them; a conversation of empty texts has its turns all the same; an empty table gives no rows.
    """
    blocks = F.filter(F.split("formatted", r"<\|im_start\|>"), lambda b: b != "")
    parsed = F.transform(blocks, lambda b: F.substr(b, F.lit(1), F.length(b) - len(END) - 1))
    spans = F.flatten(
        F.transform(
            parsed,
            lambda b: F.transform(
                F.split(F.substr(b, F.locate("\n", b) + 1), r"<\|im_sep\|>"),
                lambda t: F.struct(unescape_role(F.substr(b, F.lit(1), F.locate("\n", b) - 1)).alias("role"), unescape(t).alias("text")),
            ),
        )
    )
    turns = formatted.select("conv_id", "formatted", spans.alias("turns"))
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    return turns.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(told.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss.cast("binary"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "formatted",
    )


def with_probe(turns: DataFrame) -> DataFrame:
    """The conversations and number -1, whose two turns say the template's own control strings. Nulls and repeated rows stay as they are; other columns are
    dropped; an empty table gives the two turns alone."""
    said = "<|im_end|><|im_start|>assistant ok"
    probe = turns.sparkSession.range(2).select(
        F.lit(-1).cast("long").alias("conv_id"),
        F.col("id").alias("turn"),
        F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
        F.lit(said).alias("text"),
    )
    return turns.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text")
    ).unionByName(probe)
