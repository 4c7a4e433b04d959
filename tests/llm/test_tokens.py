import os
import zlib

import numpy as np
import public_tokenizers
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm.common import work_dir
from folioscope.llm.token_output import WordEncoder, read_tokens, token_output, write_tokens
from tests.llm.cases import TEXTS, docs, empty, rows_of

PATH = public_tokenizers.path("word_bpe_49k.json")
WHOLE = Tokenizer.from_file(PATH)
FAST = WordEncoder(PATH)


def whole(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aB'.,*# \n\t_-<|>1²é\u0301\u030c日"), st.characters(codec="utf-8")), max_size=60))
def test_words_encode_as_whole_texts(text):
    assert np.frombuffer(FAST(text), "<u4").tolist() == whole(text)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=[chr(c) for c in range(0xC0, 0x100)] + list("abzAZ. ×÷"), max_size=40))
def test_latin_words(text):
    assert np.frombuffer(FAST(text), "<u4").tolist() == whole(text)


def test_special_strings():
    for text in ("a <|endoftext|>. b", "<|ENDOFTEXT|>", "x<|startoftext|>y, z.", "J\u030c it's I'LL. ok, A.B, c_. d"):
        assert np.frombuffer(FAST(text), "<u4").tolist() == whole(text)


def text_hash(text):
    return int(np.uint64(xxhash.xxh64_intdigest((text or "").encode(), 42)).view(np.int64))


def brute(rows):
    """Equal ids go by the hash of their text: see write_tokens()."""
    at, out = 0, []
    for i, t, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, text_hash(r[1]), r[1] or "")):
        ids = [*whole(t), 2]
        out.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return sorted(out, key=repr)


def test_cases(spark):
    assert rows_of(token_output(docs(spark), PATH)) == brute(TEXTS)
    assert rows_of(token_output(empty(spark), PATH)) == []


def test_a_table(spark, sf):
    df = spark.read.parquet(f"{sf}/documents.parquet")
    assert rows_of(token_output(df, PATH)) == brute([(r.doc_id, r.text, None) for r in df.collect()])


def test_lookups_are_pushed_down(spark, sf):
    path = work_dir(spark, "orc")
    write_tokens(spark.read.parquet(f"{sf}/documents.parquet"), path, PATH)
    df = read_tokens(spark, path).where("doc_id = 7")
    assert "PushedFilters: [IsNotNull(doc_id), EqualTo(doc_id,7)]" in df._jdf.queryExecution().toString()
    assert [r.doc_id for r in df.collect()] == [7]


def test_files_have_bloom_filters_and_several_stripes(spark, tmp_path):
    path = str(tmp_path / "orc")
    rows = spark.range(200_000).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id") % 50).alias("text"))
    write_tokens(rows.coalesce(1), path, PATH, stripe_mb=0, row_index_stride=1000)
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    stripes, blooms, last = [], 0, -1
    for file in sorted(p for p in os.listdir(path) if p.endswith(".orc")):
        at = jvm.org.apache.hadoop.fs.Path(f"{path}/{file}")
        reader = jvm.org.apache.orc.OrcFile.createReader(at, jvm.org.apache.orc.OrcFile.readerOptions(conf))
        stripes.append(reader.getStripes().size())
        assert str(reader.getSchema().toString()).startswith("struct<doc_id:bigint")
        columns = spark.sparkContext._gateway.new_array(jvm.boolean, reader.getSchema().getMaximumId() + 1)
        for k in range(len(columns)):
            columns[k] = True
        index = reader.rows().readRowIndex(0, columns, columns)
        blooms += index.getBloomFilterIndex()[1] is not None
        low, high = (spark.read.orc(f"{path}/{file}").agg(F.min("doc_id"), F.max("doc_id")).first())
        assert last < low
        last = high
    assert blooms == len(stripes) and max(stripes) >= 2, (stripes, blooms)


def test_rows_without_ids_are_dealt_out(spark):
    """A third of all rows without an id, another third whole copies of one row: no file gets more than three times the mean."""
    rows = spark.range(3000).select(
        F.when(F.col("id") % 3 == 1, F.lit(7)).when(F.col("id") % 3 == 2, F.col("id")).alias("doc_id"),
        F.when(F.col("id") % 3 == 1, F.lit("copy of one")).otherwise(F.concat(F.lit("text "), "id")).alias("text"),
    )
    path = work_dir(spark, "orc")
    write_tokens(rows, path, PATH)
    files = read_tokens(spark, path).groupBy(F.col("_metadata.file_path")).count().collect()
    sizes = [r["count"] for r in files]
    assert sum(sizes) == 3000 and len(sizes) > 4 and max(sizes) <= 3 * 3000 / len(sizes), sizes


def test_very_long_tokens_are_not_remembered():
    encode = WordEncoder(PATH)
    long = "x" * 200_000
    assert np.frombuffer(encode(f"a {long} b"), "<u4").tolist() == whole(f"a {long} b")
    assert long not in encode._words and "a" in encode._words
