"""Chat formatting: round trips, loss spans, typed parts, control strings in texts and roles."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from gatelens.llm import chat

MARKS = ["<s>", "</s>", "[INST]", "[/INST]", "<image>", "<audio>", "<document>", "<text>"]


def part(kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None):
    return (kind, text, ref, width, height, seconds, pages)


def turns(spark, rows):
    df = spark.createDataFrame(rows, f"conv_id long, turn long, role string, parts array<{chat.PART}>")
    for c in ("turn_no", "head", "rendered", "pieces", "at", "row", "rows", "turns", "learned"):
        df = df.withColumn(c, F.lit("clash"))
    return df.repartition(3)


def noise(rng):
    tokens = [*MARKS, "\\", "\\\\", "<", ">", "[", "]", "/s>", "s>", "INST]", "image>", "\n", "é", "😀", "word ", "<\\/s>", "[\\\\INST]", "$1", "\\$"]
    return "".join(rng.choices(tokens, k=rng.randint(0, 14)))


def chats(seed=1, n=60):
    rng, rows = random.Random(seed), []
    for conv in [*range(n), None]:
        for turn in [*range(rng.randint(1, 6))]:
            role = rng.choice(["user", "assistant", "assistant", "system", "</s>[INST]", "", None])
            kind = rng.random()
            if kind < 0.1:
                parts = None
            elif kind < 0.2:
                parts = []
            else:
                parts = [rng.choice([part("text", noise(rng)), part("text", None), part("text", noise(rng)), part("image", None, "i", 100, 57),
                                     part("audio", "no text", "a", None, None, 2.01), part("document", None, "d", pages=3), part("image")])
                         for _ in range(rng.randint(1, 5))]
            rows.append((conv, None if rng.random() < 0.1 else turn, role, parts))
    return rows


def text_of(parts):
    return "".join(p[1] or "" for p in parts or [] if p[0] == "text")


def test_round_trip_of_any_text(spark):
    rows = chats()
    got = chat.format_chats(turns(spark, rows), F.col("parts")).withColumn("turns", chat.read_turns(F.col("formatted"))) \
        .withColumn("learned", chat.under_loss(F.col("formatted"), F.col("loss"))).collect()
    assert len(got) == 61
    for g in got:
        mine = [r for r in rows if r[0] == g["conv_id"]]
        assert g["n_turns"] == len(mine) == len(g["turns"])
        want = sorted((r[2] or "", text_of(r[3]), tuple(p[0] for p in r[3] or [] if p[0] != "text")) for r in mine)
        have = sorted((t["role"], "".join(p["text"] or "" for p in t["parts"]), tuple(p["kind"] for p in t["parts"] if p["kind"] != "text")) for t in g["turns"])
        assert have == want
        numbered = [r for r in mine if r[1] is not None]
        assert [t["role"] for t in g["turns"]][len(mine) - len(numbered):] == [r[2] or "" for r in numbered]
        assert sorted(g["learned"]) == sorted("".join(text_of(r[3]) for r in mine if r[2] == "assistant"))
        for a in g["attachments"]:
            assert g["formatted"][a["start"]:].startswith(chat.PLACEHOLDERS[a["kind"]])
            assert a["tokens"] == {"i": 4 * 3, "a": 51, "d": 3 * 256, None: 1}[a["ref"]]
        assert g["attachment_tokens"] == sum(a["tokens"] for a in g["attachments"])
        assert len(g["attachments"]) == sum(p[0] != "text" for r in mine for p in r[3] or [])


def test_loss_spans_are_the_assistants_texts(spark):
    rows = [(1, 0, "user", [part("text", "a</s>")]), (1, 1, "assistant", [part("text", "x<"), part("text", "/s>"), part("image", ref="r"), part("text", "<image>")]),
            (1, 2, "user", [part("image", ref="q")]), (1, 3, "assistant", [part("text", "é😀")])]
    g = chat.format_chats(turns(spark, rows), F.col("parts")).first()
    assert g["formatted"] == ("<s>[INST]user[/INST]a<\\/s></s><s>[INST]assistant[/INST]x<<text>/s><image><\\image></s>"
                              "<s>[INST]user[/INST]<image></s><s>[INST]assistant[/INST]é😀</s>")
    assert [g["formatted"][s["start"]:s["start"] + s["length"]] for s in g["loss"]] == ["x<", "/s>", "<\\image>", "é😀"]
    assert [(a["turn_no"], a["ref"]) for a in g["attachments"]] == [(1, "r"), (2, "q")]


def test_read_back_of_plain_conversations(spark):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system"]), None if rng.random() < 0.1 else noise(rng) * rng.choice([1, 1, 300])) for c in range(20) for t in range(rng.randint(1, 7))]
    rows += [(7, 1, "user", "again"), (7, 1, "user", "again")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = chat.read_back(chat.format_chats(df, chat.text_part(F.col("text")))).collect()
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for g in got:
        mine = sorted((t, r, x or "") for c, t, r, x in rows if c == g["conv_id"])
        learned = "".join(x for _, r, x in mine if r == "assistant")
        assert (g["n_turns"], g["loss_chars"], g["loss_sha256"]) == (len(mine), len(learned), sha(learned))
        assert g["turns_sha256"] == sha("".join(f"{r}\n{x}\n" for _, r, x in mine))


def test_texts_without_control_strings_stay(spark):
    text = "if a < b and c[0] > 1: print('\\n') # <b>[x]</b>"
    assert spark.range(1).select(chat.escape(F.lit(text)).alias("t")).first()["t"] == text


def test_empty_table_unknown_kind_and_no_python(spark):
    empty = turns(spark, [(1, 0, "user", None)]).where("false")
    formatted = chat.read_back(chat.format_chats(empty, F.col("parts")))
    assert formatted.count() == 0
    plan = formatted._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(Exception, match="no rule for a part of kind video"):
        chat.format_chats(turns(spark, [(1, 0, "user", [part("video")])]), F.col("parts")).collect()
