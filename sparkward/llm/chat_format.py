"""Conversations as training text with a loss mask, in Spark expressions only.

One turn becomes ``<|role|>user<|text|>...<|end|>`` and a line end. Adjacent turns
of one role share a block, their texts parted by ``<|sep|>``. Every mark begins
with ``<|``, and inside roles and texts a backslash goes between the two (one
more where there are some), so that no text can hold a mark and the original can
be read back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROLE, TEXT, SEP, END = "<|role|>", "<|text|>", "<|sep|>", "<|end|>\n"


def escaped(column: Column) -> Column:
    """Free of ``<|``, and reversible."""
    return F.regexp_replace(column, r"<(\\*+)\|", r"<$1\\|")


def unescaped(column: Column) -> Column:
    return F.regexp_replace(column, r"<(\\*)\\\|", r"<$1|")


def format_chats(turns: DataFrame, learned_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_mask`` of ``turns (conv_id, turn, role, text)``.

    Turns are put in order by number, then role, then text; a null number comes
    first and a null role or text is empty. Repeated rows are turns of their own.
    Rows with a null ``conv_id`` form one conversation. Other columns are ignored;
    an empty table gives an empty result.

    ``loss_mask`` has an entry for each mark of ``formatted``, in order: ``skip``
    code points of the mark, ``take`` of what follows it up to the next mark, and
    whether those are learned (``loss``): the texts of ``learned_role``.
    """
    gathered = turns.groupBy("conv_id").agg(
        F.sort_array(
            F.collect_list(
                F.struct(
                    "turn",
                    F.coalesce("role", F.lit("")).alias("role"),
                    F.coalesce("text", F.lit("")).alias("text"),
                )
            )
        ).alias("turns")
    )
    # A block begins where the role differs from that of the turn before.
    count = F.size("turns")
    begins = F.filter(
        F.sequence(F.lit(1), count),
        lambda i: (i == 1) | (F.get("turns", i - 1)["role"] != F.get("turns", i - 2)["role"]),
    )
    numbered = gathered.select("conv_id", "turns", begins.alias("begins"))
    blocks = F.transform(
        "begins",
        lambda start, k: _block(
            start, F.coalesce(F.get("begins", k + 1), F.size("turns") + 1) - start, learned_role
        ),
    )
    merged = numbered.select("conv_id", blocks.alias("blocks"))
    formatted = F.array_join(
        F.transform(
            "blocks",
            lambda b: F.concat(F.lit(ROLE), b["role"], F.lit(TEXT), F.array_join(b["texts"], SEP), F.lit(END)),
        ),
        "",
    )
    mask = F.flatten(F.transform("blocks", _mask))
    return merged.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def _block(start: Column, length: Column, learned_role: str) -> Column:
    role = F.get("turns", start - 1)["role"]
    texts = F.transform(F.slice("turns", start, length), lambda turn: escaped(turn["text"]))
    return F.struct(escaped(role).alias("role"), (role == learned_role).alias("loss"), texts.alias("texts"))


def _entry(skip: str | Column, take: Column, loss: Column) -> Column:
    skip = F.lit(len(skip)) if isinstance(skip, str) else skip
    return F.struct(skip.alias("skip"), take.cast("int").alias("take"), loss.alias("loss"))


def _mask(block: Column) -> Column:
    nothing, no = F.lit(0), F.lit(False)
    return F.concat(
        F.array(_entry(ROLE, F.char_length(block["role"]), no)),
        F.transform(
            block["texts"],
            lambda text, k: _entry(
                F.when(k == 0, len(TEXT)).otherwise(len(SEP)), F.char_length(text), block["loss"]
            ),
        ),
        F.array(_entry(END, nothing, no)),
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """``conv_id, turns, loss_texts, formatted_chars`` out of ``formatted`` and its mask alone.

    ``turns`` holds role and text of every original turn. ``loss_texts`` are the
    stretches that the mask marks as learned, unescaped one by one.
    """
    blocks = _behind_first(F.split("formatted", r"<\|role\|>", -1))
    turns = F.flatten(F.transform(blocks, _turns))
    # Every piece but the empty first begins behind the "<|" of a mark.
    pieces = _behind_first(F.split("formatted", r"<\|", -1))
    stretches = F.zip_with(
        pieces,
        "loss_mask",
        lambda piece, entry: F.when(
            entry["loss"], F.substring(piece, entry["skip"] - 1, entry["take"])
        ),
    )
    learned = F.transform(F.filter(stretches, lambda s: s.isNotNull()), unescaped)
    return formatted.select(
        "conv_id",
        turns.alias("turns"),
        learned.alias("loss_texts"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


def _behind_first(pieces: Column) -> Column:
    return F.filter(pieces, lambda _, i: i > 0)


def _turns(block: Column) -> Column:
    role = F.substring_index(block, TEXT, 1)
    body = F.substring(block, F.char_length(role) + len(TEXT) + 1, F.char_length(block))
    body = F.substring(body, F.lit(1), F.char_length(body) - len(END))
    return F.transform(
        F.split(body, r"<\|sep\|>", -1),
        lambda text: F.struct(unescaped(role).alias("role"), unescaped(text).alias("text")),
    )
