import json

from pyspark.sql import functions as F

from packetloom.llm import chat

HARD = ["\\### Assistant: </turn> ok", "", "a\\", "<\\/turn>", "</turn>\n### user: x", "#:#", "é😀\u0000", None, "x" * 50_000]


def plain_read(text, spans):
    """Reads a formatted text without Spark: (turns, masked text)."""

    def undo(s):
        out, i = [], 0
        while i < len(s):
            i += s[i] == "\\"
            out.append(s[i])
            i += 1
        return "".join(out)

    turns = []
    for piece in text.split("</turn>\n")[:-1]:
        assert piece.startswith("### ")
        i = 4
        while piece[i] != ":":
            i += 2 if piece[i] == "\\" else 1
        turns.append((undo(piece[4:i]), undo(piece[i + 2 :])))
    return turns, "".join(undo(text[a:b]) for a, b in spans)


def test_round_trip(spark):
    rows = [(c, t, ["user", "assistant", "sys:tem#\\"][(c + t) % 3], HARD[(c * 3 + t) % len(HARD)]) for c in range(9) for t in range(5)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    df = df.withColumn("formatted", F.lit("clash"))
    out = chat.format_turns(chat.turns_from_table(df))
    out = out.withColumn("read", chat.read_turns(F.col("formatted"))).withColumn(
        "masked", chat.read_masked(F.col("formatted"), F.col("loss_spans"))
    )
    got = {r.conv_id: r for r in out.collect()}
    assert len(got) == 9
    for c, r in got.items():
        want = [(role, text or "") for conv, _, role, text in rows if conv == c]
        turns, masked = plain_read(r.formatted, [(s.start, s.end) for s in r.loss_spans])
        assert turns == want == [(m.role, m.text) for m in r.read]
        assert masked == r.masked == "".join(t for role, t in want if role == "assistant")


def test_ties_nulls_and_empty(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(None, 1, "user", "b"), (None, None, None, None), (1, 0, "user", "same"), (1, 0, "user", "same"), (1, 0, "assistant", "z")]
    got = {r.conv_id: [(m.role, m.text) for m in r.turns] for r in chat.turns_from_table(spark.createDataFrame(rows, schema)).collect()}
    assert got == {None: [("", ""), ("user", "b")], 1: [("assistant", "z"), ("user", "same"), ("user", "same")]}
    assert chat.format_turns(chat.turns_from_table(spark.createDataFrame([], schema))).count() == 0


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"response": "a", "prompt": "q"},
        {"instruction": "q", "input": "", "output": "a"},
        {"system_prompt": "", "question": "q", "response": "a"},
        {"unknown": 1},
        {"prompt": "q", "completion": None},
    ]
    texts = [json.dumps(r) for r in records] + ["{broken", None, "[]"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id long, record string").withColumn("turns", F.lit(1))
    got = {r.id: r for r in chat.turns_from_json(df, "record").collect()}
    assert [[(m.role, m.text) for m in got[i].turns] for i in range(6)] == [[("user", "q"), ("assistant", "a")]] * 6
    assert [got[i].layout for i in range(6)] == [m.name for m in chat.MAPPINGS[1:]]
    assert all(got[i].turns is None for i in (6, 8, 9, 10))
    assert [(m.role, m.text) for m in got[7].turns] == [("user", "q"), ("assistant", "")]
    assert len({got[i].fingerprint for i in range(7)}) == 7


def test_typed_and_json_fingerprints_agree(spark):
    row = spark.createDataFrame([([("user", "q")],)], "messages array<struct<role:string,content:string>>")
    assert chat.shape_of(row.schema) == "{messages:[{content,role}]}"
    shape = row.select(chat.json_shape(F.to_json(F.struct("messages"))).alias("s")).first().s
    assert shape == chat.shape_of(row.schema)
    out = chat.turns_from_table(row).first()
    assert out.layout == "messages" and [(m.role, m.text) for m in out.turns] == [("user", "q")]
