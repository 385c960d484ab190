"""Chat formatting: round trips, placeholders, masks; the digests against SQL."""

import json

import duckdb
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessella.llm import chat, queries, sql

pieces = st.lists(st.sampled_from([*chat.CONTROLS, "<", "[", "\\", "/", "s>", "INST]", "|image|>", "\n", " ", "é🙂", "x"]), max_size=12).map("".join)
things = st.one_of(
    pieces,
    st.builds(lambda t: {"type": "text", "text": t}, pieces),
    st.builds(lambda k, r: {"type": k, "ref": r}, st.sampled_from(list(chat.PLACES)), pieces),
)


def merged(parts):
    """What reading back gives: texts side by side as one, attachments as their kind."""
    out = []
    for p in parts:
        p = p if isinstance(p, str) else p["text"] if p["type"] == "text" else {"type": p["type"]}
        if isinstance(p, str) and out and isinstance(out[-1], str):
            out[-1] += p
        elif p != "":
            out.append(p)
    return out


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.one_of(st.sampled_from(["user", "assistant", "system"]), pieces), st.lists(things, max_size=5)), max_size=4))
def test_round_trip(turns):
    made = [chat.format_turn(role, parts) for role, parts in turns]
    assert chat.read("".join(m["text"] for m in made)) == [(role, merged(parts)) for role, parts in turns]
    for m, (role, parts) in zip(made, turns, strict=True):
        places = [p for p in parts if isinstance(p, dict) and p["type"] != "text"]
        assert [(a["kind"], a["ref"]) for a in m["attachments"]] == [(p["type"], p["ref"]) for p in places]
        assert all(m["text"].startswith(chat.PLACES[a["kind"]], a["at"]) for a in m["attachments"])
        if role == "assistant" and not places:
            assert chat.unescape(m["text"][m["mask"][0]["start"] : m["mask"][0]["end"]]) == "".join(merged(parts))


@given(pieces)
def test_escaped_text_holds_no_control_string(text):
    assert not any(c in chat.escape(text) for c in chat.CONTROLS) and chat.unescape(chat.escape(text)) == text
    assert chat.unescape_role(chat.escape_role(text)) == text and "\n" not in chat.escape_role(text)


def test_parts_and_token_counts():
    parts = [
        "see ", {"type": "text", "text": "this:"}, {"type": "image", "ref": "a.png", "width": 29, "height": 14}, {"type": "audio", "ref": "b.wav", "seconds": 1.5},
        {"type": "document", "ref": "c.pdf", "pages": 3}, {"type": "document", "ref": "d", "parts": ["inside ", {"type": "image", "ref": 7}]}, {"type": "video", "ref": "x"}, 5,
    ]
    got = chat.format_turn("user", parts)
    assert [(a["kind"], a["ref"], a["tokens"]) for a in got["attachments"]] == [("image", "a.png", 3), ("audio", "b.wav", 38), ("document", "c.pdf", 768), ("document", "d", 1), ("image", "7", 1)]
    assert got["text"] == '<s>user\n[INST] see this:<|image|><|audio|><|document|><|document|>inside <|image|>{"type": "video", "ref": "x"}5 [/INST]</s>'
    assert got["mask"] == [] and chat.format_turn(None, [])["text"] == "<s>\n[SYS]  [/SYS]</s>"
    with pytest.raises(ValueError):
        chat.read(got["text"] + "<s>user\nno frame</s>")


def test_assembled_rows(spark):
    rows = [(1, k, "assistant" if k % 2 else "user", json.dumps([f"t{k} <s>", {"type": "image", "ref": f"r{k}"}, "end"])) for k in range(40)]
    rows += [(2, 0, "user", "not json"), (3, 0, "assistant", '{"type": "text"}'), (4, 0, "assistant", None)]
    df = spark.createDataFrame([(*r[:3], "plain", r[3]) for r in rows], "conv_id long, turn long, role string, text string, content string")
    got = chat.assemble(chat.format_turns(df, parts="content"), most=150).orderBy("conv_id", "part").collect()
    mine = [r for r in got if r.conv_id == 1]
    assert len(mine) > 5 and [r.part for r in mine] == list(range(len(mine))) and sum(r.n_turns for r in mine) == 40 and all(len(r.text) <= 150 for r in mine)
    assert [a.ref for r in mine for a in r.attachments] == [f"r{k}" for k in range(40)]
    assert all(r.text.startswith("<|image|>", a.at) for r in mine for a in r.attachments)
    assert [chat.unescape(r.text[m.start : m.end]) for r in mine for m in r.mask] == [f"t{k} <s><|image|>end" for k in range(1, 40, 2)]
    assert [chat.read(r.text)[0] for r in got if r.conv_id > 1] == [("user", ["not json"]), ("assistant", ['{"type": "text"}']), ("assistant", ["plain"])]


def test_digest_equals_sql(spark, tmp_path):
    odd = [
        (None, 0, "user", "a"), (None, 1, "assistant", "b"), (5, None, "assistant", None), (5, 1, None, "x"), (5, 1, "user", "z"), (5, 1, "user", "z"), (5, 1, "user", "<s> a"), (5, 2, "assistant", "<\\s>\\n</s> 🙂é"),
        (6, 3, "rôle\n\\<s>", ""), (6, 2, "", "y" * 50000), (6, 2, "assistant", "[\\/INST] [INST]\n" * 500), (7, 0, "user", "only"), (8, 9, "assistant", "tail <"), (8, 10, "user", "s> \\"),
    ]
    odd += [(9, k, "assistant" if k % 2 else "user", f"hot {k}") for k in range(3000)]
    spark.createDataFrame([(*r, 1, "x") for r in odd], "conv_id long, turn long, role string, text string, part int, mask string").write.parquet(f"{tmp_path}/conversations.parquet")
    for place, files in ((str(tmp_path), f"{tmp_path}/conversations.parquet/*.parquet"), ("/root/testdata/sf0.001", "/root/testdata/sf0.001/conversations.parquet")):
        made = queries.op13_chat_formatting(spark, place)
        rel = duckdb.sql(f"WITH conversations AS (SELECT * FROM '{files}') {sql.chat().strip().replace('WITH c AS', ', c AS', 1)}")
        assert rel.columns == made.columns
        assert sorted(map(tuple, made.collect()), key=repr) == sorted(rel.fetchall(), key=repr)


def test_parts_do_not_change_digests(spark):
    turns = chat.format_turns(spark.createDataFrame([(k % 3, k, "assistant" if k % 2 else "user", f"<s>{k}") for k in range(60)], "conv_id long, turn long, role string, text string"))
    assert sorted(chat.digest(turns, most=1).collect()) == sorted(chat.digest(turns).collect())
    assert chat.digest(turns.limit(0)).collect() == []
