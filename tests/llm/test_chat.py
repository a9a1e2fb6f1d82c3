import hashlib
import json
import random

from logweave.llm import chat as C

ODD = ["", "\\", "</s>[INST] ok [/INST]", "[INST", "]", "\\[INST]", "<<SYS>>", "<<<s>", "<</ROLE>>", "a\nb\x00", "漢😀", " ", "[/INST]\\\\</s>\\", "x" * 30_000]


def test_turns_come_back():
    rnd = random.Random(4)
    for _ in range(300):
        turns = [(rnd.choice(["user", "assistant", "system", "tool", "", "<s>", "a\\b"]), "".join(rnd.choice(ODD[:-1]) for _ in range(rnd.randint(0, 5)))) for _ in range(rnd.randint(0, 6))]
        formatted = [C.format_turn(*t) for t in turns]
        assert C.parse("".join(f for f, _, _ in formatted)) == turns
        for (_, text), (f, begin, end) in zip(turns, formatted):
            assert C.unescape(f[begin:end]) == text


def test_layouts():
    turns = [("user", "q"), ("assistant", "a")]
    same = [
        {"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": "a"}]},
        {"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}]},
        {"prompt": "q", "completion": "a"},
        {"prompt": "q", "response": "a"},
        {"instruction": "q", "output": "a"},
    ]
    found = [C.canonical_turns(json.dumps(r)) for r in same]
    assert [t for _, t in found] == [turns] * 5
    assert len({f for f, _ in found}) == 5
    three = {"instruction": "s", "input": None, "output": "a"}
    assert C.canonical_turns(json.dumps(three))[1] == [("system", "s"), ("user", ""), ("assistant", "a")]
    assert C.canonical_turns(json.dumps(dict(reversed(same[2].items())))) == found[2]  # order of fields
    assert C.canonical_turns('{"unknown": {"deep": [1]}}')[1] == []
    assert C.canonical_turns(None) == C.canonical_turns("no json") == C.canonical_turns("[1]") == (None, [])


def expected(rows):
    out = {}
    for key in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == key), key=lambda r: r[1])
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        loss = "".join(r[3] or "" for r in own if r[2] == "assistant")
        out[key] = (len(own), hashlib.sha256(turns.encode()).hexdigest(), len(loss), hashlib.sha256(loss.encode()).hexdigest())
    return out


def test_conversations_against_brute_force(spark):
    rnd = random.Random(6)
    rows = [(k, t, rnd.choice(["user", "assistant", "system", "human", None]), rnd.choice([*ODD, None])) for k in [*range(40), None] for t in range(rnd.randint(1, 12))]
    rows += [(99, t, "assistant", f"t{t}") for t in range(5000)]  # a hot conversation
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "1 AS key", "2 AS place").repartition(5)
    records = C.records_of_turns(df, "conv_id", "turn", "role", "text")
    segments = C.format_chats(records, "conv_id", "turn", "record")
    assert segments.filter("formatted IS NULL").count() == 0
    assert segments.select("layout").distinct().count() > 5
    found = {r.conv_id: r for r in C.read_back(segments, "conv_id").collect()}
    want = expected(rows)
    assert {k: tuple(v)[1:5] for k, v in found.items()} == want
    assert sum(r.formatted_chars for r in found.values()) == segments.selectExpr("sum(length(formatted))").first()[0]


def test_empty_and_unknown(spark):
    none = spark.createDataFrame([], "conv_id long, turn long, record string")
    assert C.read_back(C.format_chats(none, "conv_id", "turn", "record"), "conv_id").count() == 0
    odd = spark.createDataFrame([(1, 0, None), (1, 1, '{"messages": []}'), (2, 0, '{"prompt": "p", "response": "r"}'), (2, 0, '{"prompt": "p", "response": "r"}')], none.schema)
    got = {r.conv_id: r for r in C.read_back(C.format_chats(odd, "conv_id", "turn", "record"), "conv_id").collect()}
    assert (got[1].n_turns, got[1].formatted_chars) == (0, 0)
    assert (got[2].n_turns, got[2].loss_chars) == (4, 2)


def test_further_paths_are_ignored_and_optional_ones_may_be_missing():
    def turns(value):
        return C.canonical_turns(json.dumps(value))[1]

    pair = [("user", "p"), ("assistant", "r")]
    assert turns({"prompt": "p", "response": "r", "id": 7, "meta": {"a": [1, {"b": 2}]}}) == pair
    assert turns({"prompt": "p", "response": "r", "system": "s"}) == [("system", "s"), *pair]
    assert turns({"instruction": "p", "output": "r", "system": ""}) == [("system", ""), *pair]
    messages = [{"role": "user", "content": "p", "name": "x"}, {"role": "assistant", "content": "r"}]
    assert turns({"messages": messages, "id": "k"}) == pair
    assert turns({"messages": [messages[0], "no object", None, 3, messages[1]]}) == pair
    assert turns({"conversations": [{"from": "human", "value": "p"}, {"from": "gpt", "value": "r", "weight": 0}]}) == pair
    assert turns({"prompt": "p", "messages": messages}) == [] and turns({"other": 1}) == [] and turns({"messages": []}) == []
    sets = [paths for m in C.MAPPINGS for paths in m.path_sets]
    assert len(set(sets)) == len(sets)  # no record has two mappings


def test_records_that_cannot_be_followed(spark):
    deep = '{"prompt": ' + "[" * 100_000 + "]" * 100_000 + "}"
    nested = '{"prompt": ' + '{"a": ' * 900 + "1" + "}" * 900 + "}"
    lone = r'{"role": "user", "content": "a\ud800b \ud83d\ude00"}'
    rows = [(1, 0, deep), (2, 0, nested), (3, 0, lone), (4, 0, None), (5, 0, "[1"), (6, 0, '{"\\ud800": 1, "prompt": "p"}')]
    found = C.format_chats(spark.createDataFrame(rows, "conv_id long, turn long, record string"), "conv_id", "turn", "record").collect()
    by = {r.conv_id: r.formatted for r in found}
    assert by.keys() == {1, 2, 3, 4, 5, 6} and by[1] is by[4] is by[5] is None
    assert by[3] == "[INST] a\ufffdb \U0001f600 [/INST]" and by[6] == "[INST] p [/INST]"
    assert by[2] is None or "[INST]" in by[2]
