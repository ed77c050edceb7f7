"""Chat formatting with offset-aligned loss masks.

A conversation is rendered whole, encoded once with offsets, and the sorted spans of the assistant's texts
are intersected with the token spans by binary search. Control strings are added tokens, so a token never
reaches over the border of a text; control strings inside texts are escaped reversibly.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Template: what stands before and after the texts of a role. Other roles: [ROLE]name[/ROLE]text[END], null: [NONE]text[END].
TURNS = {"user": ("[INST]", "[/INST]"), "assistant": ("<s>", "</s>"), "system": ("<<SYS>>", "<</SYS>>")}
LOSS_ROLE = "assistant"
CONTROLS = [c for pair in TURNS.values() for c in pair] + ["[ROLE]", "[/ROLE]", "[NONE]", "[END]"]
#: Also escaped: the tokenizer's own special token.
ESCAPED = [*CONTROLS, "<|endoftext|>"]
RESTS = "|".join(re.escape(c[1:]) for c in ESCAPED)
#: One backslash more after the opening bracket of what would otherwise read as a control string, or as an escaped one.
ESCAPE, UNESCAPE = re.compile(rf"([<\[])(?=\\*(?:{RESTS}))"), re.compile(rf"([<\[])\\(?=\\*(?:{RESTS}))")
SPLIT = re.compile("(" + "|".join(sorted(map(re.escape, CONTROLS), key=len, reverse=True)) + ")")


def escape(text: str) -> str:
    return ESCAPE.sub(r"\1\\", text)


def unescape(text: str) -> str:
    return UNESCAPE.sub(r"\1", text)


def render(turns: list[tuple[str | None, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted conversation and the spans of the texts that count for the loss."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        if role in TURNS:
            before, after = TURNS[role]
        else:
            before, after = "[NONE]" if role is None else f"[ROLE]{escape(role)}[/ROLE]", "[END]"
        text = escape(text)
        if role == LOSS_ROLE:
            spans.append((at + len(before), at + len(before) + len(text)))
        parts += [before, text, after]
        at += len(before) + len(text) + len(after)
    return "".join(parts), spans


def read_back(formatted: str) -> list[tuple[str | None, str]]:
    """The turns of a formatted conversation."""
    roles = {before: role for role, (before, _) in TURNS.items()}
    parts, out, k = SPLIT.split(formatted), [], 1
    while k < len(parts):
        if parts[k] == "[ROLE]":
            out.append((unescape(parts[k + 1]), unescape(parts[k + 3])))
            k += 6
        else:
            out.append((roles.get(parts[k]), unescape(parts[k + 1])))
            k += 4
    return out


def loss_text(formatted: str, starts: list[int], ends: list[int], mask: list[bool]) -> str:
    """All text under the mask, unescaped. Tokens that share a character count it once."""
    parts, last = [], 0
    for start, end, on in zip(starts, ends, mask):
        if on and end > last:
            start = max(start, last)
            parts.append((start, end))
            last = end
    runs: list[list[int]] = []
    for start, end in parts:
        if runs and runs[-1][1] == start:
            runs[-1][1] = end
        else:
            runs.append([start, end])
    return "".join(unescape(formatted[a:b]) for a, b in runs)


@lru_cache(maxsize=2)
def tokenizer_with_controls(path: str):
    from tokenizers import AddedToken, Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.add_tokens([AddedToken(c, normalized=False) for c in CONTROLS])
    return tokenizer


def loss_mask(starts: np.ndarray, ends: np.ndarray, spans: list[tuple[int, int]]) -> np.ndarray:
    """Tokens that overlap a span; both are sorted, so each span is a run of tokens found by binary search."""
    mask = np.zeros(len(starts), bool)
    if spans and len(starts):
        low, high = np.array(spans).T
        first, last = np.searchsorted(ends, low, "right"), np.searchsorted(starts, high, "left")
        for a, b, empty in zip(first, last, low == high):
            if not empty:
                mask[a:b] = True
    return mask


def format_chats(
    rows: DataFrame, tokenizer: str, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """(id, formatted, ids, starts, ends, mask): one row for each conversation.

    Turns are ordered by turn, then role and text; repeated rows are turns of their own; a null text is empty;
    a null role stays null; rows with a null id are one conversation. starts and ends are code points of the
    formatted text. Rows of one conversation meet in one task, as they become one row. Other columns are not
    carried on; an empty table gives an empty table.
    """
    turn = F.struct(F.col(turn_col).alias("turn"), F.col(role_col).cast("string").alias("role"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    grouped = rows.select(F.col(id_col).alias("id"), turn.alias("row")).groupBy("id").agg(F.array_sort(F.collect_list("row")).alias("rows"))
    numbers = T.ArrayType(T.IntegerType())
    schema = T.StructType(
        [
            T.StructField(id_col, rows.schema[id_col].dataType),
            T.StructField("formatted", T.StringType()),
            T.StructField("ids", numbers),
            T.StructField("starts", numbers),
            T.StructField("ends", numbers),
            T.StructField("mask", T.ArrayType(T.BooleanType())),
        ]
    )

    def write(batches):
        tool = tokenizer_with_controls(tokenizer)
        for batch in batches:
            for low in range(0, len(batch), 128):
                part = batch.slice(low, 128)
                rendered = [render([(r["role"], r["text"]) for r in rows]) for rows in part.column(1).to_pylist()]
                out: list[list] = [[], [], [], []]
                for (_, spans), coded in zip(rendered, tool.encode_batch([r[0] for r in rendered], add_special_tokens=False)):
                    offsets = np.array(coded.offsets, np.int32).reshape(-1, 2)
                    mask = loss_mask(offsets[:, 0], offsets[:, 1], spans)
                    for column, values in zip(out, (coded.ids, offsets[:, 0], offsets[:, 1], mask)):
                        column.append(values)
                lists = [pa.array(c, pa.list_(t)) for c, t in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.bool_()))]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([r[0] for r in rendered]), *lists], names=schema.names)

    return grouped.select("id", "rows").mapInArrow(write, schema)
