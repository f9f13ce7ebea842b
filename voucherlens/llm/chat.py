"""Chat formatting with loss masks aligned to token offsets.

A conversation becomes one string: each turn is ``<|im_start|>role<|im_sep|>
text<|im_end|>`` and a line end. The three marks are special tokens, so no token
crosses them. Inside roles and texts every ``<`` before a bar, whatever number of
backslashes stands between, gets one more backslash; taking one away restores
it. The string is encoded once, with offsets. The spans of assistant texts,
sorted, meet the spans of tokens, sorted, by binary search: tokens inside them
bear loss.

Turns of a conversation are dealt to one task and read in order as a stream, so
a task holds one conversation at a time, which its output needs whole.

NULL roles and texts are empty. Turns are ordered by number, NULL last, then by
role and text; repeated turns each count. Rows with a NULL conversation id form
one conversation. An empty table gives an empty result. Other columns are not
read.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from voucherlens.llm.text import table

# Fixed values of the template.
START, SEPARATOR, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"
LOSS_ROLE = "assistant"

_OPENING = re.compile(r"<(\\*)\|")
_ESCAPED = re.compile(r"<\\(\\*)\|")
_TURN = re.compile(re.escape(START) + "(.*?)" + re.escape(SEPARATOR) + "(.*?)" + re.escape(END) + "\n", re.DOTALL)
#: Conversations encoded by one call of the tokenizer, by their characters.
BATCH_CHARS = 1 << 20

_FORMATTED = pa.schema([
    ("conv_id", pa.int64()), ("formatted", pa.large_string()), ("token_ids", pa.list_(pa.int32())),
    ("token_start", pa.list_(pa.int32())), ("token_end", pa.list_(pa.int32())), ("loss_mask", pa.list_(pa.int8())),
])
_DIGEST = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()),
    ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()),
])


def escape(text: str) -> str:
    return _OPENING.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]]) -> tuple[str, list[tuple[int, int]]]:
    """The formatted string and the spans of the texts that bear loss."""
    parts, spans, size = [], [], 0
    for role, text in turns:
        head, body = f"{START}{escape(role)}{SEPARATOR}", escape(text)
        if role == LOSS_ROLE:
            spans.append((size + len(head), size + len(head) + len(body)))
        parts += head, body, END, "\n"
        size += len(head) + len(body) + len(END) + 1
    return "".join(parts), spans


def parse(formatted: str) -> list[tuple[str, str]]:
    """The turns of a formatted string."""
    return [(unescape(role), unescape(text)) for role, text in _TURN.findall(formatted)]


def loss_mask(spans: list[tuple[int, int]], start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """1 for tokens that overlap a span; both are sorted and spans do not touch."""
    mask = np.zeros(len(start), np.int8)
    if spans and len(start):
        begin, past = np.array(spans, np.int64).T
        at = np.searchsorted(begin, end, "left") - 1  # the last span that begins before the token ends
        mask = ((at >= 0) & (past[np.maximum(at, 0)] > start) & (end > start)).astype(np.int8)
    return mask


def masked_text(formatted: str, start: np.ndarray, end: np.ndarray, mask: np.ndarray) -> list[tuple[int, int]]:
    """Spans of the string that tokens under the mask cover, joined where they touch."""
    spans: list[tuple[int, int]] = []
    for a, b in zip(start[mask > 0].tolist(), end[mask > 0].tolist()):
        if spans and a <= spans[-1][1]:
            spans[-1] = spans[-1][0], max(b, spans[-1][1])
        else:
            spans.append((a, b))
    return spans


_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    """The tokenizer with the marks as special tokens, loaded once in a worker."""
    if path not in _tokenizers:
        from tokenizers import AddedToken, Tokenizer

        loaded = Tokenizer.from_file(path)
        loaded.add_special_tokens([AddedToken(m, normalized=False) for m in (START, SEPARATOR, END)])
        _tokenizers[path] = loaded
    return _tokenizers[path]


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, list[tuple[str, str]]]]:
    """Turns of each conversation of a sorted partition."""
    current, turns = None, []
    for rows in batches:
        for conv, role, text in zip(*(rows.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
            if turns and conv != current:
                yield current, turns
                turns = []
            current = conv
            turns.append((role or "", text or ""))
    if turns:
        yield current, turns


def _encoded(conversations: Iterator, path: str) -> Iterator[list[tuple]]:
    """Conversations with their strings, token ids, offsets and masks."""
    held, size = [], 0

    def flush() -> list[tuple]:
        found = tokenizer(path).encode_batch([f for _, f, _ in held], add_special_tokens=False)
        out = []
        for (conv, formatted, spans), e in zip(held, found, strict=True):
            start, end = np.array(e.offsets, np.int64).reshape(-1, 2).T
            out.append((conv, formatted, e.ids, start, end, loss_mask(spans, start, end)))
        return out

    for conv, turns in conversations:
        held.append((conv, *render(turns)))
        size += len(held[-1][1])
        if size >= BATCH_CHARS:
            yield flush()
            held, size = [], 0
    if held:
        yield flush()


def _dealt(conversations: DataFrame) -> DataFrame:
    turns = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    keyed = turns.repartition("conv_id")
    return keyed.sortWithinPartitions("conv_id", F.col("turn").asc_nulls_last(), "role", "text")


def format_conversations(conversations: DataFrame, tokenizer_path: str) -> DataFrame:
    """Formatted string, token ids, token offsets and loss mask of every conversation."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in _encoded(_conversations(batches), tokenizer_path):
            yield table(_FORMATTED, **dict(zip(_FORMATTED.names, map(list, zip(*rows)), strict=True)))

    return _dealt(conversations).mapInArrow(
        run,
        "conv_id long, formatted string, token_ids array<int>, token_start array<int>, "
        "token_end array<int>, loss_mask array<tinyint>",
    )


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of turns and of the text under the mask, from the formatted output alone."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in batches:
            out = []
            columns = [rows.column(c) for c in ("conv_id", "formatted", "token_start", "token_end", "loss_mask")]
            for i in range(rows.num_rows):
                conv, text = columns[0][i].as_py(), columns[1][i].as_py()
                start, end, mask = (c[i].values.to_numpy(zero_copy_only=False) for c in columns[2:])
                turns = parse(text)
                loss = "".join(unescape(text[a:b]) for a, b in masked_text(text, start, end, mask))
                content = "".join(f"{role}\n{said}\n" for role, said in turns)
                out.append((conv, len(turns), _sha(content), len(loss), _sha(loss), len(text)))
            if out:
                yield table(_DIGEST, **dict(zip(_DIGEST.names, zip(*out), strict=True)))

    return formatted.mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long",
    )


def _sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()
