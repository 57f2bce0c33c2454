import json
from hashlib import sha256

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from helixframe.llm import chat

HOSTILE = st.lists(st.sampled_from([*chat.CONTROL, "\\", "<", "|", "[", "]", ">", "\n", "x", "é", "<|end|>\n", "<|turn:user|0>\n", "<|image_0|>", "[\\INST]"]) | st.text(max_size=3), max_size=12).map("".join)


@given(HOSTILE, HOSTILE)
@settings(max_examples=500, deadline=None)
def test_escape_is_reversible_and_safe(text, role):
    escaped = chat.escape(text)
    assert chat.unescape(escaped) == text and not any(c in escaped for c in chat.CONTROL)
    rendered, start, length = chat.render_turn(role, escaped)
    who, body, learnt = chat.read_turn(rendered)
    assert (who, chat.unescape(body), learnt) == (role, text, role == "assistant")
    assert chat.unescape(rendered[start : start + length]) == (text if learnt else "")


def test_parts_keep_their_order():
    parts = [{"type": "text", "text": "a<|"}, {"type": "image", "ref": "i.png", "tiles": 2}, {"type": "text", "text": "b"}, {"type": "audio", "ref": "s.wav", "milliseconds": 2500}, {"type": "document", "ref": "d.pdf", "pages": 3}]
    body, found = chat.flatten(parts)
    assert body == "a<\\|<|image_0|>b<|audio_1|><|document_2|>"
    assert found == [("image", 0, "i.png", 1152), ("audio", 1, "s.wav", 150), ("document", 2, "d.pdf", 1536)]
    with pytest.raises(ValueError):
        chat.flatten([{"type": "video"}])


def test_conversations(spark):
    rows = [(1, 1, "assistant", "yes <|end|>"), (1, 0, "user", "ask"), (2, 0, "user", None), (2, 1, "assistant", ""), (3, 0, None, "x"), (None, 0, "assistant", "n"), (4, 0, "assistant", "t"), (4, 0, "assistant", "t")]
    df = spark.createDataFrame([(*r, 9) for r in rows], "conv_id long, turn long, role string, text string, formatted int").unionByName(chat.hostile_conversation(spark).selectExpr("*", "1 AS formatted")).repartition(3)
    got = {r.conv_id: r for r in chat.read_back(chat.format_turns(df)).collect()}
    assert len(got) == 6
    for conv in got:
        own = sorted((t, r or "", x or "") for c, t, r, x in [*rows, (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")] if c == conv)
        learnt = "".join(x for _, r, x in own if r == "assistant")
        assert got[conv].n_turns == len(own) and got[conv].turns_sha256 == sha256("".join(f"{r}\n{x}\n" for _, r, x in own).encode()).hexdigest()
        assert got[conv].loss_chars == len(learnt) and got[conv].loss_sha256 == sha256(learnt.encode()).hexdigest()
    assert chat.read_back(chat.format_turns(df.limit(0))).collect() == []


def test_typed_parts_of_rows(spark):
    parts = json.dumps([{"type": "text", "text": "see"}, {"type": "image", "ref": "u"}])
    df = spark.createDataFrame([(1, 0, "user", None, parts), (1, 1, "assistant", "fine", None)], "conv_id long, turn long, role string, text string, parts string")
    a, b = chat.format_turns(df, parts="parts").orderBy("turn").collect()
    assert a.attachments[0].ref == "u" and a.expanded_tokens == 576 and "see<|image_0|>" in a.formatted
    assert b.loss_length == 4 and b.expanded_tokens == 0
