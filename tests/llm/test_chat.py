import hashlib
import json
import random

from codeloom.llm import chat

SCHEMA = "conv_id long, turn long, role string, text string, id string"


def test_escaping_is_reversible_and_leaves_no_control_string():
    r = random.Random(1)
    parts = ["<", "/s>", "<s>", "</s>", "[INST]", "[/INST]", "\\", "n", "\n", "<|im_start|>", "<|im_end|>\n", "<<SYS>>", "a", "|im_end|>"]
    for _ in range(3000):
        s = "".join(r.choice(parts) for _ in range(r.randrange(8)))
        assert chat.unescape(chat.escape(s)) == s
        assert not any(c in chat.escape(s) for c in chat.CONTROL)
        turns = [(r.choice(["user", "we\nird", "<s>", "a\\", ""]), s), ("assistant", s)]
        formatted, spans = chat.template(turns)
        assert chat.read_back(formatted) == turns
        assert [chat.unescape(formatted[a:b]) for a, b in spans] == [s]


def test_layouts_by_fingerprint(spark):
    records = [
        {"messages": [{"role": "user", "content": "a"}, {"role": "assistant", "content": None}]},
        {"conversations": [{"from": "human", "value": "a"}, {"from": "gpt", "value": "b"}]},
        {"turns": [{"speaker": "bot", "text": "b"}]},
        {"prompt": "a", "response": "b"},
        {"instruction": "s", "input": "a", "output": "b"},
        {"question": "a", "answer": {"x": 1}},
        {"messages": []},
        {"messages": [{"role": "user", "content": "a", "extra": 1}]},
        {"other": 1},
        [],
    ]
    rows = [(k, json.dumps(x)) for k, x in enumerate(records)] + [(20, None), (21, "{broken")]
    got = {r.id: r for r in chat.format_records(spark.createDataFrame(rows, "id long, record string")).collect()}
    layouts = [got[k].layout for k in range(10)]
    assert layouts == ["messages", "share", "turns", "prompt", "instruction with input", "unknown", "messages", "unknown", "unknown", "unknown"]
    assert chat.read_back(got[1].formatted) == [("user", "a"), ("assistant", "b")]
    assert chat.read_back(got[4].formatted) == [("system", "s"), ("user", "a"), ("assistant", "b")]
    assert got[20].formatted is None and got[21].layout == "unknown"


def test_digests_against_brute_force(spark, sf_dir):
    said = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said += [(-1, 0, "user", None), (-1, 1, None, "\\ </s>"), (-1, 1, "assistant", "x"), (-1, 1, "assistant", "x"), (None, 0, "assistant", "n"), (-2, 5, "assistant", ""), (-3, 0, "user", "only")]
    frame = spark.createDataFrame([(*s, "own") for s in said], SCHEMA)
    got = chat.digests(chat.format_records(chat.records_of(frame))).collect()
    talks = {}
    for c, n, r, t in said:
        talks.setdefault(c, []).append((n, r or "", t or ""))
    assert {r.id for r in got} == set(talks) and len(got) == len(talks)
    for r in got:
        turns = sorted(talks[r.id])
        loss = "".join(t for _, role, t in turns if role == "assistant")
        assert (r.n_turns, r.loss_chars) == (len(turns), len(loss))
        assert r.turns_sha256 == hashlib.sha256("".join(f"{role}\n{t}\n" for _, role, t in turns).encode()).hexdigest()
        assert r.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_table(spark):
    assert chat.digests(chat.format_records(chat.records_of(spark.createDataFrame([], SCHEMA)))).count() == 0


def test_odd_roles_and_records(spark):
    said = [(1, 0, "user,assistant", "x"), (2, 0, "human", "h"), (2, 1, "gpt", "g"), (3, 0, None, None), *((k, t, r, f"{k} {t}") for k in range(10, 30) for t, r in enumerate(("user", "assistant")))]
    said += [(k, t, r, "y" * 100_000) for k in range(30, 36) for t, r in enumerate(("system", "user", "assistant"))]
    formatted = chat.format_records(chat.records_of(spark.createDataFrame(said, "conv_id long, turn long, role string, text string")))
    rows = {r.id: r for r in formatted.collect()}
    assert {chat.read_back(rows[2].formatted)[0][0], chat.read_back(rows[1].formatted)[0][0]} == {"human", "user,assistant"}
    assert len({r.layout for r in rows.values()}) > 5 and "unknown" not in {r.layout for r in rows.values()}
    for k in range(10, 30):
        assert chat.read_back(rows[k].formatted) == [("user", f"{k} 0"), ("assistant", f"{k} 1")]
    odd = spark.createDataFrame([(1, '{"messages": [1, "a"]}'), (2, '{"messages": [{"role": 5, "content": ["a"]}]}'), (3, "no json"), (4, None), (5, '{"messages": {"role": "a", "content": "b"}}')], "id long, record string")
    got = {r.id: r for r in chat.digests(chat.format_records(odd)).collect()}
    assert {k for k, r in got.items() if r.n_turns is None} == {1, 2, 3, 4, 5}
