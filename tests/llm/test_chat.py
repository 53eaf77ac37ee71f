import json

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewater.llm import chat


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "to\nol", "", "a\\"]), st.text(alphabet=st.sampled_from(list("</s>[INST] \\\nabé🙂")), max_size=40)), max_size=6))
def test_round_trip(turns):
    text, spans = chat.format_turns(turns)
    assert chat.parse(text) == turns
    assert "".join(chat.unescape(text[a:b]) for a, b in spans) == "".join(t for r, t in turns if r == "assistant")


def test_no_control_string_survives_in_a_body():
    for c in chat.CONTROL:
        assert c not in chat.escape(f"x{c}{c}y\\{c}")


@pytest.mark.parametrize(
    "record, turns",
    [
        ({"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]}, [("user", "a"), ("assistant", "")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"from": "human", "value": "a"}], "system": "s"}, [("system", "s"), ("user", "a")]),
        ({"instruction": "do", "input": "this", "output": "done"}, [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"instruction": "do", "output": "done"}, [("user", "do"), ("assistant", "done")]),
        ({"prompt": "p", "completion": "c", "id": 7, "meta": {"x": [1]}}, [("user", "p"), ("assistant", "c")]),
        ({"question": "q", "answer": "a"}, [("user", "q"), ("assistant", "a")]),
        ({"input": {"text": "i"}, "output": {"text": "o"}}, [("user", "i"), ("assistant", "o")]),
        ([{"role": "user", "content": "bare"}], [("user", "bare")]),
        ({"prompt": "a", "prompt_id": "7", "messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"system": "s", "messages": [{"role": "user", "content": "a"}]}, [("system", "s"), ("user", "a")]),
        ({"instruction": "do", "input": "this", "output": "done", "prompt": "Below is: do this"}, [("user", "do\n\nthis"), ("assistant", "done")]),
        ({"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "image", "url": "u"}, "c"]}, {"role": "assistant", "content": "b"}]}, [("user", 'a\n{"type": "image", "url": "u"}\nc'), ("assistant", "b")]),
        ({"messages": [{"role": "assistant", "content": None, "tool_calls": [{"name": "f"}]}]}, [("assistant", '{"name": "f"}')]),
        ({"messages": []}, []),
        ({"messages": ["a"]}, [("unknown", '{"messages": ["a"]}')]),
        ({"messages": [{"role": "user", "content": []}]}, [("user", "")]),
        ({"prompt": "p", "chosen": "c", "rejected": "r"}, [("user", "p"), ("assistant", "c")]),
        ({"prompt": "p", "chosen": [{"role": "user", "content": "p"}, {"role": "assistant", "content": "c"}]}, [("user", "p"), ("assistant", "c")]),
        ({"system": "s", "question": "q", "answer": "a"}, [("system", "s"), ("user", "q"), ("assistant", "a")]),
        ({"prompt": [{"role": "user", "content": "p"}], "chosen": [{"role": "assistant", "content": "c"}], "rejected": [{"role": "assistant", "content": "r"}]}, [("user", "p"), ("assistant", "c")]),
        ({"prompt": [{"role": "user", "content": "p"}], "completion": [{"role": "assistant", "content": "c"}]}, [("user", "p"), ("assistant", "c")]),
        ({"messages": [{"role": "user", "content": "a"}, {"from": "gpt", "value": "b"}, "loose", {"who": "x"}, {"role": "user"}]}, [("user", "a"), ("assistant", "b"), ("unknown", "loose"), ("unknown", '{"who": "x"}'), ("user", "")]),
        ({"conversations": [{"from": "human", "value": "a"}, {"role": "assistant", "content": "b"}]}, [("user", "a"), ("assistant", "b")]),
        ({"conversations": [{"role": "user", "content": "a"}]}, [("user", "a")]),
        ({"system_prompt": "s", "question": "q", "response": "r"}, [("system", "s"), ("user", "q"), ("assistant", "r")]),
        ({"inputs": "i", "targets": "t"}, [("user", "i"), ("assistant", "t")]),
        ({"unknown": 1}, [("unknown", '{"unknown": 1}')]),
        (None, []),
    ],
)
def test_layouts(record, turns):
    assert chat.to_turns(record)[2] == turns


def test_fingerprint_ignores_values_and_order():
    a, *_ = chat.to_turns({"prompt": "x", "completion": "y"})
    b, *_ = chat.to_turns({"completion": "longer", "prompt": None, "extra": {"k": 1}})
    assert a == b


def test_frame_edges(spark):
    rows = [(1, json.dumps({"prompt": "p", "completion": "c"}), "f"), (2, None, "f"), (3, "not json", "f"), (1, json.dumps({"prompt": "p", "completion": "c"}), "f")]
    got = chat.format_records(spark.createDataFrame(rows, "id long, record string, formatted string")).collect()
    assert sorted((r["id"], r["formatted"]) for r in got) == [(1, "<s>user\np</s><s>assistant\nc</s>")] * 2 + [(2, ""), (3, "<s>unknown\nnot json</s>")]
    assert {r["id"]: r["mapping"] for r in got} == {1: "prompt completion", 2: None, 3: None}
    assert chat.read_back(chat.format_records(spark.createDataFrame([], "id long, record string"))).count() == 0


def test_rows_with_nulls_and_repeats(spark):
    rows = [(1, 1, "assistant", None), (1, 0, "user", "hi"), (1, 0, "user", "hi"), (None, 0, None, "x")]
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_records(chat.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 0 and got[None]["n_turns"] == 1
