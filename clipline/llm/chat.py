"""Chat formatting with loss masks aligned by character offsets."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clipline.llm.common import map_batches, text_or_empty

#: Control strings: before the role, between role and text, after the text. No escaped text holds one.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"

_CONTROL = regex.compile(r"<(\\*)\|")
_ESCAPED = regex.compile(r"<\\(\\*)\|")


def escape(text: str) -> str:
    r"""One more backslash between ``<`` and ``|``, so that no ``<|`` is left; :func:`unescape` takes it back."""
    return _CONTROL.sub(r"<\\\1|", text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(r"<\1|", text)


def render(turns: list[tuple[str, str]], trained: str) -> tuple[str, np.ndarray]:
    """The whole conversation and the sorted character spans (start, end) of the texts of role ``trained``."""
    parts, spans, at = [], [], 0
    for role, text in turns:
        head, body = f"{TURN}{escape(role)}{BODY}", escape(text)
        if role == trained:
            spans.append((at + len(head), at + len(head) + len(body)))
        parts += [head, body, END]
        at += len(head) + len(body) + len(END)
    return "".join(parts), np.array(spans, dtype=np.int64).reshape(-1, 2)


def span_mask(starts: np.ndarray, ends: np.ndarray, spans: np.ndarray) -> np.ndarray:
    """Which tokens lie in a span: the last span that begins at or before the token is found by binary search."""
    if not len(spans):
        return np.zeros(len(starts), dtype=bool)
    at = np.searchsorted(spans[:, 0], starts, side="right") - 1
    return (at >= 0) & (ends <= spans[np.maximum(at, 0), 1]) & (starts < ends)


class ChatEncoder:
    """A public byte-level vocabulary with the control strings as ids of their own, split off before anything else."""

    def __init__(self, path: str):
        import os

        from tokenizers import AddedToken, Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.add_special_tokens([AddedToken(x, normalized=False) for x in (TURN, BODY, END)])
        self.control = {self.tokenizer.token_to_id(x): x for x in (TURN, BODY, END)}
        ascii_, extra = {*range(33, 127), *range(161, 173), *range(174, 256)}, 0
        byte_of = {}
        for byte in range(256):  # the printable stand-ins of byte-level vocabularies
            byte_of[chr(byte) if byte in ascii_ else chr(256 + extra)] = byte
            extra += byte not in ascii_
        self.bytes_of = {}
        for token, i in self.tokenizer.get_vocab(with_added_tokens=False).items():
            if all(c in byte_of for c in token):
                self.bytes_of[i] = bytes(byte_of[c] for c in token)

    def encode(self, texts: list[str]) -> list:
        return self.tokenizer.encode_batch(texts, add_special_tokens=False)

    def text_of(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode("utf-8")

    def turns_of(self, ids: list[int]) -> list[tuple[str, str]]:
        """Roles and texts read back from the ids of a conversation."""
        turns, fields, run = [], [], []
        for i in ids:
            kind = self.control.get(i)
            if kind is None:
                run.append(i)
            elif kind == TURN:
                fields, run = [], []
            else:
                fields.append(unescape(self.text_of(run)))
                run = []
                if kind == END:
                    turns.append((fields[0], fields[1]))
        return turns

    def masked_texts(self, ids: list[int], mask: list[bool]) -> list[str]:
        """The texts under the mask, one for each unbroken run of masked ids."""
        out, run = [], []
        for i, on in zip([*ids, -1], [*mask, False]):
            if on:
                run.append(i)
            elif run:
                out.append(unescape(self.text_of(run)))
                run = []
        return out


def format_conversations(rows: DataFrame, tokenizer_path: str, trained: str = "assistant", conv_id: str = "conv_id",
                         turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, formatted, input_ids, loss_mask: each conversation rendered, encoded once and masked.

    Turns are ordered by turn, then role and text, so ties and repeated rows
    have one order; null roles and texts are empty; rows with a null conv_id
    are one conversation. A conversation is rendered whole in one row. An empty
    text makes no masked ids. Extra columns are ignored; an empty table gives
    no rows.
    """
    turns = rows.select(F.col(conv_id).cast("long").alias("conv_id"), F.struct(
        F.col(turn).alias("turn"), text_or_empty(role).alias("role"), text_or_empty(text).alias("text")).alias("t"))
    whole = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns"))

    def make():
        encoder = ChatEncoder(tokenizer_path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            texts, ids, masks = [], [], []
            for low in range(0, batch.num_rows, 64):
                made = [render([(t["role"], t["text"]) for t in x.as_py()], trained)
                        for x in batch.column(1).slice(low, 64)]
                texts += [x for x, _ in made]
                for (_, spans), own in zip(made, encoder.encode([x for x, _ in made])):
                    offsets = np.array(own.offsets, dtype=np.int64).reshape(-1, 2)
                    ids.append(own.ids)
                    masks.append(span_mask(offsets[:, 0], offsets[:, 1], spans).tolist())
            return pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(ids, pa.list_(pa.int32())),
                 pa.array(masks, pa.list_(pa.bool_()))], ["conv_id", "formatted", "input_ids", "loss_mask"])
        return work

    return map_batches(whole, make,
                       "conv_id long, formatted string, input_ids array<int>, loss_mask array<boolean>")


def read_back(formatted: DataFrame, tokenizer_path: str) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, from ids and masks alone."""
    def make():
        encoder = ChatEncoder(tokenizer_path)

        def work(batch: pa.RecordBatch) -> pa.RecordBatch:
            out = []
            for chars, ids, mask in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                turns = encoder.turns_of(ids)
                digest = hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8")).hexdigest()
                loss = "".join(encoder.masked_texts(ids, mask))
                out.append((len(turns), digest, len(loss), hashlib.sha256(loss.encode("utf-8")).hexdigest(), chars))
            columns = list(zip(*out)) or [[]] * 5
            types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            return pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, t) for c, t in zip(columns, types)]],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])
        return work

    rows = formatted.select("conv_id", F.length("formatted").cast("long").alias("n"), "input_ids", "loss_mask")
    return map_batches(rows, make, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, "
                                   "loss_sha256 string, formatted_chars long")
