"""Operator 7: chat formatting by token-level assembly."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from folio.llm.bpe import LibraryWords, byte_alphabet, frugal, slices
from folio.llm.common import parts_for, session_of
from folio.llm.token_counts import tokenizer_spec

#: Ids after the vocabulary's own: begin of a turn, end of its role, end of a turn. As text, the template is
#: <|turn|>ROLE<|says|>TEXT<|end|>, without anything between turns.
TURN, SAYS, END = 50257, 50258, 50259
MARKS = {TURN: "<|turn|>", SAYS: "<|says|>", END: "<|end|>"}
#: Strings that some template gives a meaning; they occur in contents and must not act there.
CONTROL = (
    *MARKS.values(), "<|endoftext|>", "<|startoftext|>", "<|im_start|>", "<|im_end|>", "<|system|>", "<|user|>", "<|assistant|>",
    "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
)
MARK = "␛"
_CONTROL = re.compile("|".join(map(re.escape, CONTROL)))
_MARKED = re.compile(f"{MARK}({MARK}?)")


def escaped(text: str) -> str:
    """No control string is left: a mark goes in after its first character; marks of the text are doubled."""
    return _CONTROL.sub(lambda m: m[0][0] + MARK + m[0][1:], text.replace(MARK, MARK * 2))


def unescaped(text: str) -> str:
    return _MARKED.sub(r"\1", text)


SEGMENTS = "conv_id long, turn long, tie long, ids array<int>, loss array<boolean>"


def format_chats(turns: DataFrame, vocabulary: str) -> DataFrame:
    """Token segments of formatted conversations: a row a turn, to be joined in order of ``turn`` and ``tie`` within ``conv_id``.

    Role and text of a turn are escaped and encoded apart from each other; the reserved ids are spliced around
    them, so no token spans a boundary and no content makes a reserved id. ``loss`` marks the tokens of an assistant's
    text, from prefix sums over the lengths of segments. Map-only: a task encodes rows wherever they are, so a conversation of any length
    is spread over all tasks.

    Turns go by ``turn`` (nulls first), equal ones by ``tie``, a hash of role and text. Null text or role: empty. Null
    conv_id: a conversation of its own. Repeated rows are turns of their own. Empty table: empty result. Other columns are
    not read.
    """
    spec = session_of(turns).sparkContext.broadcast(tokenizer_spec(vocabulary))

    def run(batches):
        words = LibraryWords(spec.value, spaced=True)
        words.tokenizer.encode_special_tokens = True
        of_role: dict[str, np.ndarray] = {}
        for batch in batches:
            for part, texts in slices(batch, "text"):
                roles = [x or "" for x in part.column(3).to_pylist()]
                new = [r for r in dict.fromkeys(roles) if r not in of_role]
                if len(of_role) + len(new) > 1000:  # roles are few; if they aren't, none is kept
                    of_role, new = {}, list(dict.fromkeys(roles))
                of_role |= zip(new, words.encode([escaped(r) for r in new]), strict=True)
                ids, loss = [], []
                for role, body in zip(roles, words.batch(pa.array([escaped(t) for t in texts.to_pylist()], pa.string())), strict=True):
                    parts = [[TURN], of_role[role], [SAYS], body, [END]]
                    ends = np.cumsum([len(p) for p in parts])
                    mask = np.zeros(ends[-1] + 1, np.int8)
                    if role == "assistant":
                        mask[ends[2]] += 1
                        mask[ends[3]] -= 1
                    ids.append(np.concatenate(parts).astype(np.int32))
                    loss.append(np.cumsum(mask[:-1]).astype(bool))
                yield pa.RecordBatch.from_arrays(
                    [*part.columns[:3], pa.array(ids, pa.list_(pa.int32())), pa.array(loss, pa.list_(pa.bool_()))], names=["conv_id", "turn", "tie", "ids", "loss"]
                )

    own = [F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")]
    return turns.select(*own, F.xxhash64("role", "text").alias("tie"), "role", "text").mapInArrow(frugal(run), SEGMENTS)


class Decoder:
    """Bytes of ids, many at a time: tokens' bytes lie in one array."""

    def __init__(self, spec: str):
        alphabet, vocab = byte_alphabet(), json.loads(spec)["model"]["vocab"]
        plain = [b""] * (max(*vocab.values(), *MARKS) + 1)
        for token, i in vocab.items():
            plain[i] = bytes(alphabet[c] for c in token)
        for i, mark in MARKS.items():
            plain[i] = mark.encode()
        self.size = np.fromiter(map(len, plain), np.int64, len(plain))
        self.begin = np.cumsum(self.size) - self.size
        self.pool = np.frombuffer(b"".join(plain), np.uint8)

    def of(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.pool[np.repeat(self.begin[ids] - ends + n, n) + np.arange(ends[-1])].tobytes() if len(ids) and ends[-1] else b""


def read_chats(segments: DataFrame, vocabulary: str) -> DataFrame:
    """Digests of conversations from formatted segments alone: a row a conversation.

    ``formatted_chars`` counts the code points of the decoded ids, reserved ones as their marks. One shuffle puts the segments in order; a
    task streams them and holds one segment and one digest at a time, so a conversation's length costs time but no memory.
    """
    spec = session_of(segments).sparkContext.broadcast(tokenizer_spec(vocabulary))
    schema = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long, n_ids long, n_loss_ids long"

    def run(batches):
        decoder = Decoder(spec.value)
        now, rows = None, []

        def closed(x):
            return (x["conv_id"], x["turns"], x["all"].hexdigest(), x["loss_chars"], x["loss"].hexdigest(), x["chars"], x["ids"], x["loss_ids"])

        kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
        names = [f.split()[0] for f in schema.split(", ")]
        for batch in batches:
            for i, conv_id in enumerate(batch.column(0).to_pylist()):
                ids, loss = (np.asarray(batch.column(c)[i].values) for c in (1, 2))
                loss = loss.astype(bool)
                if now is None or now["conv_id"] != conv_id:
                    if now:
                        rows.append(closed(now))
                    now = {"conv_id": conv_id, "turns": 0, "all": hashlib.sha256(), "loss": hashlib.sha256(), "loss_chars": 0, "chars": 0, "ids": 0, "loss_ids": 0}
                says = int(np.flatnonzero(ids == SAYS)[0])
                role, text = (decoder.of(x).decode() for x in (ids[1:says], ids[says + 1 : -1]))
                now["turns"] += 1
                now["all"].update(f"{unescaped(role)}\n{unescaped(text)}\n".encode())
                wanted = unescaped(decoder.of(ids[loss]).decode())
                now["loss"].update(wanted.encode())
                now["loss_chars"] += len(wanted)
                now["chars"] += len(role) + len(text) + sum(len(MARKS[int(k)]) for k in ids[[0, says, -1]])
                now["ids"] += len(ids)
                now["loss_ids"] += int(loss.sum())
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                rows = []
        if now:
            yield pa.RecordBatch.from_arrays([pa.array([c], k) for c, k in zip(closed(now), kinds, strict=True)], names=names)

    ordered = segments.repartition(parts_for(segments), "conv_id").sortWithinPartitions("conv_id", "turn", "tie")
    return ordered.select("conv_id", "ids", "loss").mapInArrow(run, schema)
