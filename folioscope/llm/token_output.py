"""Token ids in ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Writing: rows are dealt by ranges of the document id, one for each FILE_BYTES
of input but a few a core at least, and sorted, so file k
holds smaller ids than file k + 1, each stripe and row group has a narrow
[min, max] of doc_id, and a lookup by id skips files, stripes and row groups
by their indexes and Bloom filters. The text is shuffled once, before it is
encoded; ids never are.

Encoding: a word's ids depend on the word alone, because this tokenizer's
pattern never spans white space. Workers keep the ids of words they have met
and put a document together from them; a word of Latin-1 letters goes straight
to the tokenizer's model, any other chunk through its whole pipeline. The tests
hold this against encoding whole texts.
"""

from __future__ import annotations

import math
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from folioscope.llm.common import input_bytes, text_of, work_dir

#: Words whose ids a worker keeps, and their most characters; beyond that number the memory starts anew, so it is bounded in bytes too.
MEMORY_WORDS, MEMORY_CHARS = 800_000, 40
#: Input behind one file.
FILE_BYTES = 256 << 20
#: Rows that share an id and a text go to so many ranges.
SALTS = 64
#: Letters that lower-casing and composing can only map within the set, one by one.
_LATIN = re.compile("[A-Za-zÀ-ÖØ-öø-ÿ]+").fullmatch
#: Such a word and ASCII symbols after it: the tokenizer's pattern always cuts between them. Its contractions need a letter after the apostrophe, its special tokens a letter inside.
_SUFFIXED = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-/:-@\[-`{-~]+)").fullmatch


def _byte_letters() -> dict[int, str]:
    """Code point -> how byte-level BPE writes its UTF-8 bytes: printable Latin-1 as it is, the others from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) if b in printable else chr(256 + others.index(b)) for b in range(256)}
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(0xDF, 0x100)}


class _Words(dict):
    """word -> ids as bytes, made when first asked for."""

    def __init__(self, tokenizer):
        self._encode, self._tokenize = tokenizer.encode, tokenizer.model.tokenize
        self._letters = _byte_letters()

    def __missing__(self, chunk: str) -> bytes:
        if parts := _SUFFIXED(chunk):
            made = self[parts[1]] + self[parts[2]]
        else:
            if _LATIN(chunk):
                ids = [t.id for t in self._tokenize(chunk.lower().translate(self._letters))]
            else:
                ids = self._encode(chunk, add_special_tokens=False).ids
            made = struct.pack(f"<{len(ids)}I", *ids)
        if len(chunk) <= MEMORY_CHARS:
            self[chunk] = made
        return made


class WordEncoder:
    """text -> ids as little-endian uint32 bytes."""

    _made: dict[str, WordEncoder] = {}

    def __init__(self, vocabulary: str):
        from tokenizers import Tokenizer

        self._words = _Words(Tokenizer.from_file(vocabulary))

    @classmethod
    def of(cls, vocabulary: str) -> WordEncoder:
        """One per worker process: the words it knows outlast a task."""
        if vocabulary not in cls._made:
            cls._made[vocabulary] = cls(vocabulary)
        return cls._made[vocabulary]

    def __call__(self, text: str) -> bytes:
        # The tokenizer lower-cases, but only after it has looked for special tokens and composed marks:
        # doing it first is the same where neither can occur.
        if text.isascii() and "<|" not in text:
            text = text.lower()
        words = self._words
        if len(words) > MEMORY_WORDS:
            words.clear()
        return b"".join(map(words.__getitem__, text.replace("\n", " ").split(" ")))


def _encoder(vocabulary: str, end_id: int):
    end = np.asarray([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = WordEncoder.of(vocabulary)
        for batch in batches:
            texts = batch.column(1)
            # Some rows at a time: ids take up to four times the room of their text.
            done, part, held = 0, [], 0
            for k in range(len(texts)):
                ids = encode(texts[k].as_py() or "") + end
                part.append(ids)
                held += len(ids)
                if held > 1 << 23 or k + 1 == len(texts):
                    lengths = np.fromiter((len(x) // 4 for x in part), np.int64, len(part))
                    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
                    values = pa.array(np.frombuffer(b"".join(part), "<i4"), pa.int32())
                    yield pa.RecordBatch.from_arrays(
                        [
                            batch.column(0).slice(done, len(part)),
                            pa.array(lengths),
                            pa.ListArray.from_arrays(pa.array(offsets), values),
                        ],
                        ["doc_id", "n_tokens", "ids"],
                    )
                    done, part, held = k + 1, [], 0

    return run


def write_tokens(
    docs: DataFrame,
    path: str,
    vocabulary: str,
    end_id: int = 2,
    id_col: str = "doc_id",
    text_col: str = "text",
    stripe_mb: int = 64,
    row_index_stride: int = 1000,
) -> None:
    """Writes (doc_id, n_tokens, ids) as ORC below ``path``, in ascending doc_id over files in name order.

    Defined cases: a null text is empty, and an empty text has the end id
    only; equal ids are ordered by a hash of the text, then the text, and all
    written, and as such rows may be many (null ids are all equal), they
    are dealt by that hash too; null ids come first; an empty table writes no rows; other columns are not written;
    texts of any length are encoded whole, one row each.
    """
    n = max(4 * docs.sparkSession.sparkContext.defaultParallelism, math.ceil(input_bytes(docs, text_col) / FILE_BYTES))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))
    # Which of several equal rows goes where makes no difference to what is written.
    salt = F.pmod(F.monotonically_increasing_id(), F.lit(SALTS))
    rows = rows.withColumns({"hash": F.xxhash64("text"), "salt": salt})
    ordered = rows.repartitionByRange(n, "doc_id", "hash", "salt").sortWithinPartitions("doc_id", "hash", "text").select("doc_id", "text")
    ordered.mapInArrow(_encoder(vocabulary, end_id), "doc_id long, n_tokens long, ids array<int>").write.options(
        **{
            "compression": "zstd",
            "orc.stripe.size": str(stripe_mb << 20),
            "orc.row.index.stride": str(row_index_stride),
            "orc.create.index": "true",
            "orc.bloom.filter.columns": "doc_id",
            "orc.bloom.filter.fpp": "0.01",
        }
    ).orc(path)


def read_tokens(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids); a filter on doc_id prunes by the files' metadata."""
    return spark.read.schema("doc_id long, n_tokens long, ids array<int>").orc(path)


def _file_name() -> Column:
    return F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids = batch.column(2)
        offsets = ids.offsets.to_numpy()
        data = memoryview(np.ascontiguousarray(ids.values.to_numpy(zero_copy_only=False), dtype="<i4")).cast("B")
        crc = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(offsets, offsets[1:])]
        lengths = pa.array(np.diff(offsets).astype(np.int64))
        yield pa.RecordBatch.from_arrays(
            [batch.column(0), lengths, pa.array(crc, pa.int64()), batch.column(3), batch.column(4)],
            ["doc_id", "n_tokens", "ids_crc32", "file", "at"],
        )


def digests(tokens: DataFrame) -> DataFrame:
    """(doc_id, n_tokens, ids_crc32, file, at) counted and hashed from the ids that were read back."""
    # Rows of a file keep their order in a task, and this id grows with it; splits of a file are in order of offset.
    at = F.struct(F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"))
    rows = tokens.select("doc_id", "n_tokens", "ids", _file_name().alias("file"), at.alias("at"))
    return rows.mapInArrow(
        _digests, "doc_id long, n_tokens long, ids_crc32 long, file string, at struct<block: long, row: long>"
    )


def token_output(
    docs: DataFrame, vocabulary: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Writes the token files in the shared folder and returns (doc_id, start, n_tokens, ids_crc32) read back from them.

    ``start`` = ids in earlier files + ids before the row in its own file: the
    window runs over one file's rows, and one row a file is all that is summed
    over the whole output. See write_tokens() for nulls, ties and empty texts.
    """
    spark = docs.sparkSession
    path = work_dir(spark, "tokens", keep=True)
    write_tokens(docs, path, vocabulary, end_id, id_col, text_col)
    tokens = read_tokens(spark, path)
    rows = digests(tokens)
    # The counts are a column of their own: this pass doesn't touch the ids.
    files = tokens.groupBy(_file_name().alias("file")).agg(F.sum("n_tokens").alias("n"))
    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)
    files = files.select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("file").orderBy("at").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("ahead", F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    return rows.join(files, "file").select(
        F.col("doc_id").alias(id_col), (F.col("ahead") + F.col("base")).alias("start"), "n_tokens", "ids_crc32"
    )
