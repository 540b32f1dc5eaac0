import random

from wordloom.llm import chat

HARD = ["", None, "</s>", "<|next|>", "<|role:user|>", "\\", "\\l", "\\\\sb", "<s>[INST] ok [/INST]", "|", "a\nb", "é😀", "[", "x" * 5000]


def test_round_trip(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "assistant", "system", None, "next", "a|>b<"]), rng.choice(HARD))
            for c in range(60) for t in range(rng.randint(1, 9))]
    rows += [(None, 1, "user", "a"), (None, None, "assistant", "b"), (70, 2, "user", "b"), (70, 2, "user", "a"), (70, 2, "user", "a")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").selectExpr(
        "*", "1 AS mask", "'x' AS formatted", "'y' AS _turns").repartition(5)
    found = chat.read_chats(chat.format_chats(df)).collect()
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t is not None, t or 0, r or "", x or ""))
    assert len(found) == len(by)
    for row in found:
        turns = [(r, x) for *_, r, x in sorted(by[row.conv_id])]
        assert [(t.role, t.text) for t in row.turns] == turns
        assert row.trained_text == "".join(x for r, x in turns if r == "assistant")
        assert sum(m.skip + m.take for m in row["mask"]) == len(row.formatted)
        assert row.formatted.count("</s>") == sum(i == 0 or turns[i][0] != turns[i - 1][0] for i in range(len(turns)))


def test_no_text_can_look_like_a_control_string(spark):
    df = spark.createDataFrame([(1, 0, "user", "".join(map(str, HARD)))], "conv_id bigint, turn bigint, role string, text string")
    formatted = chat.format_chats(df).first().formatted
    assert formatted.count("<") == 3 and formatted.startswith("<s><|role:user|>") and formatted.endswith("</s>")


def test_long_conversation_and_empty(spark):
    df = spark.range(5000).selectExpr("1L AS conv_id", "id AS turn", "if(id % 3 = 0, 'user', 'assistant') AS role", "cast(id AS string) AS text")
    row = chat.read_chats(chat.format_chats(df)).first()
    assert len(row.turns) == 5000 and row.trained_text == "".join(str(i) for i in range(5000) if i % 3)
    assert chat.format_chats(df.limit(0)).count() == 0
