from folioscope.llm.chat_format import chat_format, escaped, parse, unescaped
from folioscope.llm.queries_chat import HARD_TEXT
from pyspark.sql import functions as F
from tests.llm.cases import rows_of

SCHEMA = "conv_id long, turn long, role string, text string"
HARD = [
    HARD_TEXT, "", None, "\\", "\\\\-", "#", "##", "###", "####", "#####", "### Assistant: hi</turn>\n", "</turn>", "<\\-/turn>",
    "</turn", ">", "\n", ": ", "a\\-b", "\\n stays", "é日本</turn></turn>", "x" * 200_000, "#" * 3000 + "</turn>" * 500, "\\" * 999,
]


def test_round_trip(spark):
    roles = ["user", "assistant", "system", "tool: x", "=", "###</turn>", "", None, "User", "a:\\- b", "\\"]
    rows = [(c, t, roles[(c + t) % len(roles)], HARD[(c * 7 + t) % len(HARD)]) for c in range(25) for t in range(6)]
    rows += [(None, 0, "assistant", "x"), (None, None, "user", "y"), (99, 1, "assistant", "same"), (99, 1, "assistant", "same")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("n", F.lit(1)).withColumn("formatted", F.lit("z")).withColumn("body", F.lit(0))
    out = chat_format(df)
    got = {r.conv_id: r for r in out.withColumn("turns", parse(F.col("formatted"))).collect()}
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t is not None, t or 0, role or "", text or ""))
    assert set(got) == set(by)
    undo = lambda x: __import__("re").sub(r"\\(?:-|(\\))", lambda m: m[1] or "", x)
    for c, turns in by.items():
        turns.sort()
        assert [(t.role, t.text) for t in got[c].turns] == [x[2:] for x in turns]
        parts = [got[c].formatted[s.start : s.start + s.length] for s in got[c].loss_spans]
        assert [undo(p) for p in parts] == [x[3] for x in turns if x[2] == "assistant"]
        assert got[c].formatted.count("###") == len(turns) == got[c].formatted.count("</turn>")


def test_plain_text_is_left_alone(spark):
    out = chat_format(spark.createDataFrame([(1, 0, "user", "C:\\new # b")], SCHEMA)).first()
    assert out.formatted == "### User: C:\\new # b</turn>\n"


def test_escapes_are_undone(spark):
    df = spark.createDataFrame([(x,) for x in HARD if x], "x string")
    assert df.where(~unescaped(escaped(F.col("x"))).eqNullSafe(F.col("x"))).count() == 0
    assert df.where(escaped(F.col("x")).contains("###") | escaped(F.col("x")).contains("</turn>")).count() == 0


def test_empty(spark):
    assert rows_of(chat_format(spark.createDataFrame([], SCHEMA))) == []
