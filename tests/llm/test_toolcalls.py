import json
import random

from gridpile.llm import toolcalls as tc

CALLS = "conv_id long, call_id string, tool string, arguments string, after array<string>, content string"
RESULTS = "conv_id long, call_id string, content string, tool string"
SCHEMAS = {"add": {"type": "object", "required": ["a"], "additionalProperties": False, "properties": {"a": {"type": "integer", "minimum": 0}, "b": {"type": "array", "items": {"type": "number"}}, "c": {"enum": ["x", None]}}}}


def brute_levels(edges, ids):
    level = {}
    while True:
        new = {i: 1 + max((level[b] for b in edges.get(i, [])), default=-1) for i in ids if i not in level and all(b in level for b in edges.get(i, []))}
        if not new:
            return level
        level |= new


def test_levels_of_a_random_graph(spark):
    """Chains, joins, cycles and what hangs on them, forward and backward references alike."""
    r = random.Random(2)
    ids = [f"c{i}" for i in range(120)]
    shuffled = ids[:]
    r.shuffle(shuffled)
    after = {}
    for i, c in enumerate(shuffled):
        after[c] = r.sample(shuffled[:i], min(i, r.choice([0, 1, 1, 1, 1, 2, 3])))
    after |= {"y1": ["y3"], "y2": ["y1"], "y3": ["y2"], "hang": ["y2"], "hang2": ["hang", "c1"], "self": ["self"], "odd": ["nobody", None]}
    rows = [(7, c, "add", '{"a":1}', a, "") for c, a in after.items()]
    got = {x.call_id: x.level for x in tc.link_calls(spark.createDataFrame(rows, CALLS), spark.createDataFrame([], RESULTS), SCHEMAS).collect()}
    want = brute_levels({c: [b for b in a if b in after] for c, a in after.items()}, list(after))
    assert got == {c: want.get(c) for c in after}


def test_links_and_checks(spark):
    calls = [
        (1, "a", "add", '{"a": 2.0, "b": [1, 2.5]}', [], "q"), (1, "a", "add", '{"a": 3}', [], "q"), (2, "a", "add", '{"a": -1}', ["zz"], "q"),
        (1, "b", "sub", "{}", None, ""), (1, "c", "add", "{", ["a"], ""), (1, "d", "add", None, ["a", "b"], ""), (None, "e", "add", '{"a":1,"c":"y","z":0}', [], ""), (1, None, "add", '{"a":1}', ["a"], ""), (1, None, "add", '{"a":1}', ["a"], "")]
    results = [(1, "a", "üb\"er", "t"), (1, "a", "zz", "t"), (2, "b", "no call", "t"), (1, None, "x", "t"), (None, "e", "yes", "t")]
    got = tc.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMAS).collect()
    by = {(x.conv_id, x.call_id): x for x in got}
    assert len(got) == 8
    a = by[1, "a"]
    assert a.linked and a.valid and a.level == 0 and a.json == '{"arguments":{"a":2,"b":[1,2.5]},"call_id":"a","name":"add","result":"zz"}'
    assert not by[2, "a"].linked and by[2, "a"].problems == "$.a: below minimum"
    assert by[1, "b"].problems == "$: no such tool" and by[1, "c"].problems == "$: not JSON" and by[1, "c"].level == 1 and by[1, "d"].problems == "$: not object"
    assert by[None, "e"].linked and by[None, "e"].problems == "$.c: not in enum; $: z not allowed"
    assert by[1, None].level is None and not by[1, None].linked


def test_one_conversation_with_a_long_chain(spark):
    """Two thousand calls of one conversation, each needing the one before: levels come by doubling."""
    n = 2000
    rows = [(1, t, "user" if t % 2 == 0 else "assistant", f"text {t}") for t in range(n)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = tc.link_calls(*tc.conversation_calls(df), tc.REPLY)
    levels = sorted(x.level for x in got.collect())
    assert levels == list(range(n // 2)) and got.where("not linked or not valid").count() == 0


def test_conversations_by_brute_force(spark, small):
    df = spark.read.parquet(f"{small}/conversations.parquet")
    rows = df.collect()
    texts = {(r.conv_id, r.turn, r.role): r.text for r in rows}
    got = {(r.conv_id, r.call_id): r for r in tc.link_calls(*tc.conversation_calls(df), tc.REPLY).collect()}
    users = [r for r in rows if r.role == "user"]
    assert len(got) == len(users)
    for u in users:
        g = got[u.conv_id, f"turn-{u.turn}"]
        level, t = 0, u.turn
        while (u.conv_id, t - 2, "user") in texts:
            level, t = level + 1, t - 2
        answer = texts.get((u.conv_id, u.turn + 1, "assistant"))
        assert g.level == level and g.linked == (answer is not None)
        assert g.json == json.dumps({"arguments": {"text": u.text, "turn": u.turn}, "call_id": f"turn-{u.turn}", "name": "reply", "result": answer}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert tc.link_calls(*tc.conversation_calls(df.limit(0)), tc.REPLY).count() == 0


def test_no_schema_or_number_ends_the_job(spark):
    """Lists of types, unknown keywords, ill-formed schemas, huge numbers, deep nesting; a null conversation is not the one called "-"."""
    assert tc.problems("a", {"type": ["string", "null"]}) == [] and tc.problems(None, {"type": ["string", "null"]}) == [] and tc.problems(1, {"type": ["string", "null"]}) == ["$: not string or null"]
    assert tc.problems("a", {"pattern": "b"}) == ["$: pattern is not supported"] and tc.problems(1, {"anyOf": []}) == ["$: anyOf is not supported"]
    assert tc.problems(True, {"enum": [1]}) == ["$: not in enum"] and tc.problems(1.0, {"enum": [1]}) == [] and tc.problems({"a": [True]}, {"const": {"a": [1]}}) == ["$: not the constant"]
    assert tc.problems(10**400, {"type": "integer"}) == [] and tc.problems(2.5, {"type": "integer"}) == ["$: not integer"] and tc.problems({"z": 1}, {"additionalProperties": {"type": "string"}}) == ["$.z: not string"]
    schemas = SCHEMAS | {"odd": {"type": {"a": 1}}, "bad": {"minimum": "x"}, "list": [], "enum": {"enum": 3}}
    big = '{"a": ' + "9" * 400 + "}"
    calls = [("-", "a", "add", big, [], ""), (None, "a", "add", '{"a": 1}', [], ""), ("1", "b", "odd", "1", [], ""), ("1", "c", "bad", "1", [], ""), ("1", "d", "list", "1", [], ""), ("1", "e", "enum", "1", [], ""), ("1", "f", "add", "[" * 100_000, [], ""), ("1", "g", "add", '{"a": ' + "9" * 6000 + "}", [], "")]
    results = [(None, "a", "of null", "t"), ("1", "b|c", "x", "t")]
    text = lambda schema: schema.replace("conv_id long", "conv_id string")
    got = {(r.conv_id, r.call_id): r for r in tc.link_calls(spark.createDataFrame(calls, text(CALLS)), spark.createDataFrame(results, text(RESULTS)), schemas).collect()}
    assert len(got) == 8 and got["-", "a"].valid and not got["-", "a"].linked and got[None, "a"].linked
    assert not any(got["1", c].valid for c in "bcdefg") and got["1", "f"].problems == got["1", "g"].problems == "$: not JSON"


def test_calls_that_texts_hold(spark):
    """Named and nested forms, arguments as object and as text, results by identifier; bad arguments, unknown tools and texts that are no JSON."""
    calls = {"tool_calls": [
        {"id": "c1", "name": "reply", "arguments": {"text": "hi", "turn": 3}}, {"id": "c2", "function": {"name": "reply", "arguments": '{"text": "", "turn": -1}'}, "after": ["c1", "turn-0"]},
        {"id": "c3", "name": "weather", "arguments": {"b": 1, "a": [1.0, "\u00e9"]}}, {"name": "reply", "arguments": "{"}, None]}
    rows = [
        (1, 0, "user", "what?", 9), (1, 1, "assistant", json.dumps(calls), 9), (1, 2, "tool", '{"tool_call_id": "c2", "content": {"b": 1}}', 9), (1, 3, "tool", '{"tool_call_id": "c1", "content": "yes"}', 9),
        (1, 4, "tool", "tool_call_id of none", 9), (2, 1, "assistant", "about tool_calls: {", 9), (2, 2, "assistant", '{"tool_calls": 3}', 9), (2, 3, "assistant", None, 9), (2, 4, "tool", None, 9),
        (None, 0, "assistant", '{"tool_calls": [{"id": "c1", "name": null, "arguments": null}]}', 9), (3, 0, "user", None, 9), (3, 1, None, "x", 9)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, c int")
    got = {(r.conv_id, r.call_id): r for r in tc.link_calls(*tc.conversation_calls(df), tc.REPLY).collect()}
    assert set(got) == {(1, "turn-0"), (1, "c1"), (1, "c2"), (1, "c3"), (1, None), (None, "c1"), (3, "turn-0")}
    assert got[1, "c1"].valid and got[1, "c1"].json == '{"arguments":{"text":"hi","turn":3},"call_id":"c1","name":"reply","result":"yes"}'
    c2 = got[1, "c2"]
    assert c2.level == 1 and c2.linked and not c2.valid and c2.problems == "$.text: too short; $.turn: below minimum" and json.loads(c2.json)["result"] == '{"b":1}'
    assert got[1, "c3"].problems == "$: no such tool" and not got[1, "c3"].linked and '"arguments":{"a":[1,"é"],"b":1}' in got[1, "c3"].json
    assert got[1, None].problems == "$: not JSON" and got[None, "c1"].problems == "$: no such tool" and got[1, "turn-0"].linked
    assert got[3, "turn-0"].problems == "$: text missing" and not got[3, "turn-0"].linked
