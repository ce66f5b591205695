"""Conversations as token ids with a loss mask, assembled from separately encoded segments."""

from __future__ import annotations

import hashlib
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import shared

#: The template's marks: a turn is ``START role SEP text END``. Their ids follow the vocabulary's own.
START, SEP, END = "<|im_start|>", "<|im_sep|>", "<|im_end|>"

_RUN, _LONG_RUN = re.compile(r"<(\|+)"), re.compile(r"<\|(\|+)")

#: Characters that the vocabulary file's splitting and this module's class alike, and white space beside a blank.
_ODD, _BLANKS = re.compile("[^\\x00-\\x1b\\x20-\\u024f]"), re.compile(r" \s|\s ")


def escape(text: str) -> str:
    """One bar more after every ``<`` that a bar follows: no control string is left in the text."""
    return _RUN.sub(r"<|\1", text) if "<|" in text else text


def unescape(text: str) -> str:
    return _LONG_RUN.sub(r"<\1", text) if "<||" in text else text


def chat_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Codec:
    """A byte-level vocabulary (lossless) and the three reserved ids after its own.

    Texts split into words before any merge, so a word's ids don't depend on its neighbours; they are encoded once,
    by the library's merge model, and kept, up to ``most`` words. Texts with characters beyond the Latin blocks go to the library whole.
    """

    _one: dict[str, Codec] = {}

    def __init__(self, path: str, most: int = 400_000):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        self.tokenizer.encode_special_tokens = True
        n = self.tokenizer.get_vocab_size()
        self.start, self.sep, self.end = n, n + 1, n + 2
        #: the byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in plain]
        byte = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}
        self.bytes = [b""] * n
        for token, i in self.tokenizer.get_vocab().items():
            self.bytes[i] = bytes(byte[c] for c in token) if all(c in byte for c in token) else token.encode()
        self.spelt, self.merge = {b: c for c, b in byte.items()}, self.tokenizer.model.tokenize
        #: how byte-level vocabularies split texts (fixed value of the file format)
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+").findall
        self.first: dict[str, bytes] = {}
        self.after: dict[str, bytes] = {}

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in cls._one:
            cls._one[path] = cls(path)
        return cls._one[path]

    def _pieces(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text that this module may split."""
        spelt = self.spelt
        ids = [t.id for w in self.split(text) for t in self.merge("".join([spelt[b] for b in w.encode()]))]
        return np.asarray(ids, "<i4").tobytes()

    def _miss(self, known: dict[str, bytes], word: str, blank: str) -> bytes:
        got = self._pieces(blank + word)
        if len(word) <= 64:
            if len(known) >= self.most:
                known.clear()
            known[word] = got
        return got

    def encode(self, text: str) -> np.ndarray:
        """Ids of ``text``, escaped."""
        text = escape(text)
        if _ODD.search(text):
            return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, np.int32)
        if _BLANKS.search(text):
            return np.frombuffer(self._pieces(text), "<i4")
        head, *words = text.split(" ")
        first, after, miss = self.first, self.after, self._miss
        return np.frombuffer(b"".join([(first.get(head) or miss(first, head, "")) if head else b"", *[after.get(w) or miss(after, w, " ") for w in words]]), "<i4")

    def decode(self, ids) -> str:
        """The escaped text of ids without reserved ones."""
        return b"".join(map(self.bytes.__getitem__, ids)).decode()


def _lists(parts: list[np.ndarray], kind: str) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(x) for x in parts], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(parts or [np.empty(0)]).astype(kind)))


def format_chats(chats: DataFrame, vocabulary: str | None = None, most_ids: int = 1 << 16) -> DataFrame:
    """Rows (conv_id, turn, role, text) to rows (conv_id, piece, ids, mask) in one order per conversation.

    A conversation's turns meet, sorted, as texts; there segments are encoded one by one
    and reserved ids spliced between them. The mask is the prefix sum of +1 at the start and -1
    behind the end of each assistant text. A conversation is emitted in pieces of whole turns of about
    ``most_ids`` ids and streams through its task, so that memory stays bounded however many turns it has.

    Turns with equal numbers follow by role, then text; null turns come first. A null role or text is
    empty; each row without conv_id is a conversation of its own, so such rows spread over all tasks; an empty table gives no rows; other
    columns are ignored.
    """
    path = vocabulary or chat_vocabulary()
    conv = chats.schema["conv_id"]
    rows = chats.select("conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    ids_type = T.ArrayType(T.IntegerType())
    alone = F.when(F.col("conv_id").isNull(), F.xxhash64("turn", "role", "text"))
    sent = rows.repartition("conv_id", alone).sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def assemble(batches):
        codec = Codec.of(path)
        marks = [np.asarray([x], np.int32) for x in (codec.start, codec.sep, codec.end)]
        now, piece, segments, flips, size = None, 0, [], [], 0
        done: list[tuple] = []

        def close():
            nonlocal segments, flips, size, piece
            if segments:
                ids = np.concatenate(segments)
                steps = np.zeros(len(ids) + 1, np.int8)
                for s, e in flips:
                    steps[s] += 1
                    steps[e] -= 1
                done.append((now, piece, ids, np.cumsum(steps, dtype=np.int8)[:-1]))
                piece += 1
            segments, flips, size = [], [], 0

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array([x[0] for x in done], types[0]), pa.array([x[1] for x in done], pa.int32()), _lists([x[2] for x in done], "int32"), _lists([x[3] for x in done], "int8")], names=["conv_id", "piece", "ids", "mask"])
            done.clear()
            return out

        types, first, role_ids = [pa.int64()], True, {}
        for b in batches:
            types = [b.column("conv_id").type]
            for c, role, text in zip(*(b.column(x).to_pylist() for x in ("conv_id", "role", "text")), strict=True):
                if first or c is None or c != now:
                    close()
                    now, piece, first = c, 0, False
                elif size >= most_ids:
                    close()
                if role not in role_ids:
                    if len(role_ids) > 1000:
                        role_ids.clear()
                    role_ids[role] = codec.encode(role)
                name, ids = role_ids[role], codec.encode(text)
                if role == "assistant":
                    flips.append((size + 2 + len(name), size + 2 + len(name) + len(ids)))
                segments += [marks[0], name, marks[1], ids, marks[2]]
                size += 3 + len(name) + len(ids)
            if done:
                yield flush()
        close()
        if done:
            yield flush()

    fields = [conv, T.StructField("piece", T.IntegerType()), T.StructField("ids", ids_type), T.StructField("mask", T.ArrayType(T.ByteType()))]
    return sent.mapInArrow(shared.trimmed(assemble), T.StructType(fields))


def read_back(formatted: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """What the formatted rows say, from ids and mask alone, one row per conversation.

    Rows must come as ``format_chats`` gives them: a conversation's pieces in order, in one partition.
    """
    path = vocabulary or chat_vocabulary()
    names = ["n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    kinds = [T.LongType(), T.StringType(), T.LongType(), T.StringType(), T.LongType()]

    def run(batches):
        codec = Codec.of(path)
        marks = len(START) + len(SEP) + len(END)
        state: dict | None = None
        done: list[tuple] = []

        def close():
            if state:
                done.append((state["conv"], state["turns"], state["all"].hexdigest(), state["chars"], state["loss"].hexdigest(), state["formatted"]))

        def flush(kind):
            cols = list(zip(*done, strict=True))
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(cols[0], kind), *(pa.array(c) for c in cols[1:])], names=["conv_id", *names])

        kind = pa.int64()
        for b in batches:
            kind = b.column("conv_id").type
            for conv, piece, ids, mask in zip(b.column("conv_id").to_pylist(), b.column("piece").to_pylist(), b.column("ids"), b.column("mask"), strict=True):
                if piece == 0:
                    close()
                    state = {"conv": conv, "turns": 0, "all": hashlib.sha256(), "chars": 0, "loss": hashlib.sha256(), "formatted": 0}
                ids, mask = ids.values.to_numpy(), mask.values.to_numpy()
                reserved = np.nonzero(ids >= codec.start)[0]
                if list(ids[reserved]) != [codec.start, codec.sep, codec.end] * (len(reserved) // 3):
                    raise ValueError("the reserved ids don't alternate as the template says")
                ids, told = ids.tolist(), {}
                for s, m, e in reserved.reshape(-1, 3).tolist():
                    role, text = codec.decode(ids[s + 1 : m]), codec.decode(ids[m + 1 : e])
                    told[m + 1, e] = plain = unescape(text)
                    state["turns"] += 1
                    state["all"].update(f"{unescape(role)}\n{plain}\n".encode())
                    state["formatted"] += len(role) + len(text) + marks
                steps = np.diff(np.concatenate([[0], mask, [0]]))
                for s, e in zip(np.nonzero(steps == 1)[0].tolist(), np.nonzero(steps == -1)[0].tolist(), strict=True):
                    text = told[s, e] if (s, e) in told else unescape(codec.decode(ids[s:e]))
                    state["chars"] += len(text)
                    state["loss"].update(text.encode())
            if done:
                yield flush(kind)
        close()
        if done:
            yield flush(kind)

    return formatted.mapInArrow(shared.trimmed(run), T.StructType([formatted.schema["conv_id"], *(T.StructField(n, k) for n, k in zip(names, kinds, strict=True))]))
