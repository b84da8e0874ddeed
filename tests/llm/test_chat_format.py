from hashlib import sha256

from pyspark.sql import functions as F

from lattice.llm import chat_format as m

SCHEMA = "conv_id long, turn long, role string, text string, example int, text2 string"
ROWS = [
    (1, 0, "system", "be <|end|> good\\", 9, "x"),
    (1, 1, "user", "</s>[INST] <<SYS>> hi", 9, "x"),
    (1, 2, "assistant", "a\\<|b\n[/INST]é", 9, "x"),
    (1, 3, "user", None, 9, "x"),
    (1, 4, "assistant", "", 9, "x"),
    (1, 5, "assistant", "last", 9, "x"),
    (2, 0, "user", "only <", 9, "x"),
    (3, 0, "assistant", "twice", 9, "x"),
    (3, 0, "assistant", "twice", 9, "x"),
    (None, None, None, None, 9, "x"),
    (None, 1, "assistant", "orphan", 9, "x"),
]


def hex_(s):
    return sha256(s.encode()).hexdigest()


def plain(rows):
    out = {}
    for c in {r[0] for r in rows}:
        turns = sorted((-1 if r[1] is None else r[1], r[2] or "", r[3] or "") for r in rows if r[0] == c)
        loss = "".join(t for _, r, t in turns if r == "assistant")
        out[c] = (len(turns), hex_("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), hex_(loss))
    return out


def test_read_back_equals_input(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    got = {r["conv_id"]: tuple(r)[1:5] for r in m.read_back(m.expand(df)).collect()}
    assert got == plain(ROWS)


def test_each_assistant_turn_is_an_example(spark):
    rows = m.expand(spark.createDataFrame(ROWS, SCHEMA)).filter("conv_id = 1").orderBy("example").collect()
    assert [r["target"] for r in rows] == [3, 5, 6]
    assert [r["n_turns"] for r in rows] == [3, 5, 6]
    for shorter, longer in zip(rows, rows[1:]):
        assert longer["text"].startswith(shorter["text"])
    assert [r["text"][r["loss_start"] : r["loss_start"] + r["loss_chars"]] for r in rows][2] == "last"
    tail = m.expand(spark.createDataFrame(ROWS, SCHEMA)).filter("conv_id = 2").collect()
    assert [(r["target"], r["loss_chars"], r["whole"]) for r in tail] == [(None, 0, True)]


def test_escaping_is_reversible(spark):
    texts = ["", "\\", "<|", "<\\|", "<<|", "</s>", "[INST]", "<<SYS>><</SYS>>", "\\\\<|turn|>", "<", "|>", "é<|é"]
    df = spark.createDataFrame([(t,) for t in texts], "t string").withColumn("e", m.escaped(F.col("t"))).withColumn("u", m.unescaped(F.col("e")))
    for r in df.collect():
        assert r["u"] == r["t"]
        assert not any(s in r["e"] for s in ("<|", "</s>", "[INST]", "[/INST]", "<<SYS>>"))


def test_empty(spark):
    assert m.read_back(m.expand(spark.createDataFrame([], SCHEMA))).count() == 0
