"""SentencePiece ids by a merge-type prefix table, and texts from ids.

A pair of pieces is compatible if merging their joined letters gives the pair
again. Merging a text gives the one sequence of pieces of which all neighbours
are compatible, and the sequence of a prefix ends in one token: the only piece
that ends there, as an automaton over all pieces tells, and is compatible with
the last token of the prefix before it. So one pass from left to right stores
each prefix's last token, and the ids are read off from the end, without a
queue of merges and in time linear in the text. A letter that is no piece merges with
nothing; it is written as its bytes' pieces.

No piece goes over the start of a word, as the model is read, so
words are encoded apart and workers keep the ids of those they have met. A
model for which that does not hold takes whole texts through the table.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from folioscope.llm.common import text_of

#: The mark that the library writes for a blank.
BLANK = "▁"
#: Words whose ids a worker keeps in each of two generations, and their most letters; pairs whose compatibility it keeps before that memory starts anew.
MEMORY_WORDS, MEMORY_CHARS, MEMORY_PAIRS = 400_000, 40, 1_000_000
_RUNS = re.compile(f"{BLANK}*[^{BLANK}]+|{BLANK}+")
#: Bytes of ids that are handed over at once.
_HELD = 1 << 23


@lru_cache(maxsize=4)
def library(model: str):
    """The library's own processor; one per worker process."""
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=model)


class PrefixTable:
    """A model's pieces: which tokens end where, and which may follow each other."""

    def __init__(self, model: str):
        import ahocorasick

        self.library = sp = library(model)
        self.piece = {i: sp.id_to_piece(i) for i in range(sp.vocab_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))}
        self.score = {p: sp.get_score(i) for i, p in self.piece.items()}
        self.id = {p: i for i, p in self.piece.items()}
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.bytes)):
            raise ValueError("the model has no pieces for bytes")
        letters = {c for p in self.id for c in p}
        if letters - self.id.keys():
            raise ValueError("a letter of a piece is no piece")
        self.cut_at_words = not any(a != BLANK and b == BLANK for p in self.id for a, b in zip(p, p[1:]))
        self._ending = ahocorasick.Automaton()
        for p, i in self.id.items():
            self._ending.add_word(p, (i, len(p), {}))  # and whether it may follow the tokens that it has been asked for
        self._ending.make_automaton()
        self._told = 0

    def merged(self, text: str) -> list[str]:
        """The pieces of a short text, merge by merge: the best-scored pair first, of equal ones the leftmost."""
        parts = list(text)
        while len(parts) > 1:
            best = max(range(len(parts) - 1), key=lambda k: (self.score.get(parts[k] + parts[k + 1], -np.inf), -k))
            if parts[best] + parts[best + 1] not in self.score:
                break
            parts[best : best + 2] = [parts[best] + parts[best + 1]]
        return parts

    def follows(self, before: int, token: int) -> bool:
        """Whether the token may come after another, or, after none (-1), begin a text."""
        two = [self.piece[i] for i in (before, token) if i >= 0]
        return self.merged("".join(two)) == two

    def encode(self, text: str) -> list[int]:
        """Ids of a text as the library writes it (see BLANK)."""
        last, sizes = [-1] * len(text), [1] * len(text)  # by the prefix's end: its last token and that one's letters
        for end, (token, n, known) in self._ending.iter(text):
            if last[end] < 0:
                before = last[end - n] if end >= n else -1  # none: the text begins, or a letter that is no piece
                fits = known.get(before)
                if fits is None:
                    fits = known[before] = self.follows(before, token)
                    self._told += 1
                if fits:
                    last[end], sizes[end] = token, n
        if self._told > MEMORY_PAIRS:
            self.forget()
        ids, at = [], len(text) - 1
        while at >= 0:
            if last[at] < 0:
                ids.extend(self.bytes[b] for b in reversed(text[at].encode()))
            else:
                ids.append(last[at])
            at -= sizes[at]
        ids.reverse()
        return ids

    def forget(self) -> None:
        for _, _, known in self._ending.values():
            known.clear()
        self._told = 0


class _Kept(dict):
    """key -> ids as bytes, made when first asked for.

    A full generation becomes the old one: what is asked for again moves on to the new one, the rest goes with it.
    """

    def __init__(self, make: Callable[[str], bytes], most: int):
        self._make, self._most = make, most
        self._old: dict[str, bytes] = {}

    def __missing__(self, key: str) -> bytes:
        made = self._old.get(key)
        if made is None:
            made = self._make(key)
        if len(key) <= MEMORY_CHARS:
            if len(self) >= self._most:
                self._old = dict(self)
                self.clear()
            self[key] = made
        return made


class PieceEncoder:
    """text -> ids as little-endian int32 bytes."""

    _made: dict[str, PieceEncoder] = {}

    def __init__(self, model: str):
        self.table = PrefixTable(model)
        self._words = _Kept(lambda word: self._whole(BLANK + word), MEMORY_WORDS)  # of whose blanks the first is left out

    @classmethod
    def of(cls, model: str) -> PieceEncoder:
        """One per worker process: the words it knows outlast a task."""
        if model not in cls._made:
            cls._made[model] = cls(model)
        return cls._made[model]

    def _whole(self, text: str) -> bytes:
        ids = self.table.encode(text)
        return struct.pack(f"<{len(ids)}i", *ids)

    def __call__(self, text: str) -> bytes:
        text = self.table.library.normalize(text)
        if not self.table.cut_at_words:
            return self._whole(text)
        if BLANK * 2 in text or text.endswith(BLANK):
            head, words = [], _RUNS.findall(text)
            if words and words[0][0] != BLANK:
                head, words = words[:1], words[1:]
            words = [w[1:] for w in words]
        else:
            first, *words = text.split(BLANK)
            head = [first] if first else []
        return b"".join([*map(self._whole, head), *map(self._words.__getitem__, words)])


def _encoded(model: str, end_id: int):
    end = struct.pack("<i", end_id)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = PieceEncoder.of(model)
        for batch in batches:
            done, part, held = 0, [], 0
            for k, text in enumerate(batch.column(1)):
                part.append(encode(text.as_py()) + end)
                held += len(part[-1])
                if held > _HELD or k + 1 == batch.num_rows:
                    lengths = np.fromiter((len(x) // 4 for x in part), np.int64, len(part))
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(part), "<i4"), pa.int32()))
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(done, len(part)), ids], ["doc_id", "ids"])
                    done, part, held = k + 1, [], 0

    return run


def _decoded(model: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = library(model).decode  # a worker that only decodes makes no table
        for batch in batches:
            done, texts, held = 0, [], 0
            for k, ids in enumerate(batch.column(1)):
                texts.append(decode(ids.values.to_pylist()) if len(ids.values) else "")
                held += len(texts[-1])
                if held > _HELD or k + 1 == batch.num_rows:
                    yield pa.RecordBatch.from_arrays([*batch.slice(done, len(texts)).columns, pa.array(texts, pa.string())], ["doc_id", "ids", "decoded"])
                    done, texts, held = k + 1, [], 0

    return run


def encode(docs: DataFrame, model: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids): each text's ids as the library gives them, without sampling, and the end id after them.

    Defined cases: a null or empty text has the end id only; letters that are no piece become bytes; repeated rows and null ids each give a
    row; an empty table gives no rows; texts are encoded whole; other columns are ignored.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    out = rows.mapInArrow(_encoded(model, end_id), "doc_id long, ids array<int>")
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)


def decode(tokens: DataFrame, model: str, id_col: str = "doc_id") -> DataFrame:
    """(id, ids, decoded): the library's text of all ids of a row; null or no ids are the empty text."""
    rows = tokens.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce("ids", F.array().cast("array<int>")).alias("ids"))
    out = rows.mapInArrow(_decoded(model), "doc_id long, ids array<int>, decoded string")
    return out if id_col == "doc_id" else out.withColumnRenamed("doc_id", id_col)
