import hashlib
import json
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from spatiofuse.llm import chat
from spatiofuse.llm.catalog import PROBE, QUERIES
from tests.llm.conftest import table

TURNS = "conv_id long, turn long, role string, text string"


def digest(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute(rows):
    conversations = defaultdict(list)
    for r in rows:
        conversations[r["conv_id"]].append((r["turn"], r["role"] or "", r["text"] or ""))
    conversations[-1] += [(0, "user", PROBE), (1, "assistant", PROBE)]
    for c, turns in conversations.items():
        turns.sort(key=lambda t: (t[0] is not None, t))
        loss = "".join(t[2] for t in turns if t[1] == "assistant")
        yield c, (len(turns), digest("".join(f"{r}\n{t}\n" for _, r, t in turns)), len(loss), digest(loss))


def test_fixture(spark, folder):
    got = QUERIES["op7_chat_formatting"](spark, folder).collect()
    assert {r["conv_id"]: (r["n_turns"], r["turns_sha256"], r["loss_chars"], r["loss_sha256"]) for r in got} == dict(brute(table(folder, "conversations")))
    assert {r["layout"] for r in got} == {"messages"} and all(r["formatted_chars"] > r["loss_chars"] for r in got)


def formatted(spark, records):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(records)], "i int, record string")
    df = chat.formatted(chat.canonical(df)).withColumns({"back": chat.read_back(F.col("formatted")), "loss": chat.masked(F.col("formatted"), F.col("loss_spans"))})
    return [r for r in df.orderBy("i").collect()]


def test_layouts(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"content": "b", "role": "assistant"}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"prompt": "a", "completion": "b"}, {"response": "b", "prompt": "a"},
        {"instruction": "a", "input": "", "output": "b"}, {"instruction": "a", "output": "b"}, {"instruction": "a", "input": "more", "output": "b"},
        {"system": "s", "instruction": "a", "output": "b"},
        {"prompt": None, "completion": "b"}, {"question": "a"}, {"messages": []}, {"prompt": 5, "completion": True},
    ]
    got = formatted(spark, [json.dumps(r) for r in records] + ["not json", None, ""])
    pair = [("user", "a"), ("assistant", "b")]
    turns = [[tuple(t) for t in r["turns"]] for r in got]
    assert turns[:6] == [pair] * 6 and turns[6] == [("user", "a\n\nmore"), ("assistant", "b")] and turns[7] == [("system", "s"), *pair]
    assert turns[8] == [("user", ""), ("assistant", "b")] and turns[11] == [("user", "5"), ("assistant", "true")]
    assert turns[9] == turns[10] == turns[12] == turns[13] == turns[14] == []
    assert [r["layout"] for r in got] == ["messages", "shared", "prompt", "response", "instruction", "task", "instruction", "system", "prompt", None, None, "prompt", None, None, None]
    assert all([tuple(t) for t in r["back"]] == t for r, t in zip(got, turns)) and got[0]["loss"] == "b"


def test_control_strings_are_reversible(spark):
    rng = random.Random(2)
    bits = ["<|", "|>", "<", "|", "\\", "<|end|>\n", "<|user|>\n", "</s>", "<s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>", "[", "x", "\n", "é", "<\\|", "<\\\\|", "s>", "🙂", " "]
    texts = ["".join(rng.choices(bits, k=rng.randint(0, 12))) for _ in range(400)]
    records = [json.dumps({"messages": [{"role": "user", "content": a}, {"role": "as|s%7C", "content": b}, {"role": "assistant", "content": c}]}) for a, b, c in zip(texts[::3], texts[1::3], texts[2::3])]
    for r, a, b, c in zip(formatted(spark, records), texts[::3], texts[1::3], texts[2::3]):
        assert [tuple(t) for t in r["back"]] == [("user", a), ("as|s%7C", b), ("assistant", c)] and r["loss"] == c
        body = r["formatted"]
        for head in ("<|user|>\n", "<|as%7Cs%257C|>\n", "<|assistant|>\n"):
            body = body.replace(head, "\0", 1)
        body = body.replace("<|end|>\n", "\0")
        assert not any(x in body for x in chat.CONTROLS)


def test_edges(spark, make_docs):
    rows = [(1, 0, "user", None), (1, 1, None, "t"), (1, None, "user", "first"), (2, 0, "user", "same"), (2, 0, "user", "same"), (None, 0, "assistant", "n"), (3, 0, "assistant", "x" * 200_000)]
    df = spark.createDataFrame(rows, TURNS).withColumn("messages", F.lit(1)).withColumn("record", F.lit("r"))
    done = chat.formatted(chat.canonical(chat.records_of_turns(df))).withColumn("back", chat.read_back(F.col("formatted"))).collect()
    back = {r["conv_id"]: [tuple(t) for t in r["back"]] for r in done}
    assert back == {1: [("user", "first"), ("user", ""), ("", "t")], 2: [("user", "same")] * 2, None: [("assistant", "n")], 3: [("assistant", "x" * 200_000)]}
    assert chat.records_of_turns(spark.createDataFrame([], TURNS)).count() == 0


def test_long_conversations_come_from_their_rows(spark, monkeypatch):
    """Beyond the record size the result is the same as by JSON; a record that cannot be parsed is not lost in silence."""
    rows = [(1, 0, "human", 'a "quoted" \\ text\n\u00e9'), (1, 1, None, "t"), (1, None, "gpt", None), (2, 0, "assistant", "<|end|>\n" * 30), (None, 3, "user", "")]
    def run():
        done = chat.formatted(chat.canonical(chat.records_of_turns(spark.createDataFrame(rows, TURNS))))
        return sorted((str(r["conv_id"]), r["layout"], r["turns"], r["formatted"], r["loss_spans"]) for r in done.collect())
    by_json = run()
    for most in (0, 200):
        monkeypatch.setattr(chat, "RECORD_BYTES", most)
        assert run() == by_json
    with pytest.raises(Exception, match="too long to be parsed"):
        chat.canonical(spark.createDataFrame([(1, "[" * 2000)], "i int, record string")).collect()
