from tallyframe.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, segments string, state int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], SCHEMA)


def test_texts_with_control_strings_come_back(spark):
    texts = ["\\### Assistant: </turn> ok", "\\b\\h\\e\\c", "### user: hi </turn>\n### assistant: no", "####", "\\\\", "", None, "a: b: c", " </turn>\n"]
    rows = [(1, i, ("user", "assistant")[i % 2], t) for i, t in enumerate(texts)] + [(2, 0, "odd: ### role", "x")]
    out = chat.format_chats(frame(spark, rows)).withColumn("back", chat.read_back(chat.F.col("formatted")))
    got = {r.conv_id: r for r in out.collect()}
    assert [(t.role, t.text) for t in got[1].back] == [(r, t or "") for _, _, r, t in rows[:-1]]
    assert [(t.role, t.text) for t in got[2].back] == [("odd: ### role", "x")]
    assert [s.text for s in got[1].segments if s.loss] == [s.text for s in got[1].segments[1::3]][1::2]
    assert "".join(s.text for s in got[1].segments) == got[1].formatted


def test_machine(spark):
    orders = {1: "user assistant", 2: "system user assistant user assistant", 3: "assistant user", 4: "user user assistant", 5: "user", 6: "system assistant", 7: "user assistant tool"}
    rows = [(i, k, role, "t") for i, o in orders.items() for k, role in enumerate(o.split())]
    got = {r.conv_id: r.valid for r in chat.format_chats(frame(spark, rows)).collect()}
    assert got == {1: True, 2: True, 3: False, 4: False, 5: False, 6: False, 7: False}


def test_odd_rows(spark):
    rows = [(None, None, None, None), (None, 1, "user", "x"), (3, 0, "user", "é" * 50_000), (3, 0, "user", "é" * 50_000)]
    got = {r.conv_id: r for r in chat.format_chats(frame(spark, rows)).collect()}
    assert set(got) == {None, 3} and len(got[None].segments) == len(got[3].segments) == 6
    assert chat.format_chats(frame(spark, [])).count() == 0
