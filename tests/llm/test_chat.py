"""Tool-call linking against a plain reading of its rules."""

import json
import random
import re

import pytest

from redactum.llm import chat

CALLS = "conv_id long, turn long, call_id string, name string, arguments string, depends_on array<string>, position string"
RESULTS = "conv_id long, turn long, call_id string, content string, item string"
SCHEMAS = [("add", "a", "number", True, 0.0, 10.0), ("add", "note", "string", False, 2.0, 5.0), ("add", "on", "boolean", False, None, None)]


@pytest.fixture
def link(spark):
    schemas = spark.createDataFrame(SCHEMAS, "name string, param string, type string, required boolean, low double, high double")

    def run(calls, results, messages=()):
        c = spark.createDataFrame([(*x, "x") for x in calls], CALLS)
        r = spark.createDataFrame([(*x, "x") for x in results], RESULTS)
        m = spark.createDataFrame(list(messages), "conv_id long, turn long, role string, content string")
        return chat.link_tool_calls(c, r, schemas, m)

    return run


def test_links_order_and_json(link):
    out = link(
        [(1, 0, "a", "add", '{"note": "abc", "a": 1}', []), (1, 2, "b", "add", '{"a":2.5}', ["a"]), (1, 4, "a", "add", '{"a":3}', ["zz"]), (2, 0, None, "add", "{}", [])],
        [(1, 1, "a", 'say "é"\n'), (1, 3, "b", None), (1, 5, "q", "lost"), (2, 1, None, "none")],
        [(1, -1, "system", "hi")],
    ).collect()
    rows = {(r.conv_id, r.position): r for r in out}
    assert [rows[(1, i)].turn for i in range(7)] == [-1, 0, 1, 2, 3, 4, 5]
    assert rows[(1, 1)].json == '{"arguments":{"a":1,"note":"abc"},"id":"a","name":"add","type":"call"}'
    assert rows[(1, 2)].json == '{"content":"say \\"é\\"\\n","id":"a","type":"result"}'
    assert rows[(1, 4)].json == '{"content":null,"id":"b","type":"result"}'
    assert rows[(1, 0)].json == '{"content":"hi","role":"system","type":"message"}'
    assert rows[(1, 1)].linked and rows[(1, 2)].linked and rows[(1, 0)].linked is None
    assert sorted(rows[(1, 5)].errors) == ["depends:zz", "duplicate:"] and rows[(1, 6)].errors == ["orphan:"]
    assert not rows[(2, 0)].linked and not rows[(2, 1)].linked
    for r in out:
        assert json.dumps(json.loads(r.json), sort_keys=True, separators=(",", ":"), ensure_ascii=False) == r.json


@pytest.mark.parametrize(
    ("name", "arguments", "errors"),
    [
        ("add", '{"a": 1}', []), ("add", '{"a": 11}', ["high:a"]), ("add", '{"a": -1.5}', ["low:a"]), ("add", '{"a": "1"}', ["type:a"]), ("add", "{}", ["missing:a"]),
        ("add", '{"a": 1, "b": 2}', ["unknown:b"]), ("add", '{"a":1,"note":"x"}', ["low:note"]), ("add", '{"a":1,"on":true,"note":"123456"}', ["high:note"]), ("add", "not json", ["json:"]),
        ("add", "[1]", ["json:"]), ("add", None, ["json:"]), ("sub", "{}", ["tool:"]), (None, "{}", ["tool:"]), ("add", '{"a": null}', ["type:a"]),
    ],
)
def test_arguments(link, name, arguments, errors):
    (row,) = link([(1, 0, "a", name, arguments, None)], []).collect()
    assert row.errors == errors
    json.loads(row.json)


def test_results_before_calls_are_put_in_order(link):
    out = link([(1, 5, "a", "add", '{"a":1}', []), (1, 4, "b", "add", '{"a":1}', ["a"]), (2, 0, "x", "add", '{"a":1}', ["y"]), (2, 1, "y", "add", '{"a":1}', ["x"])], [(1, 0, "a", "r"), (1, 1, "b", "s")]).collect()
    order = [(r.call_id, r.kind) for r in sorted((r for r in out if r.conv_id == 1), key=lambda r: r.position)]
    assert order == [("a", 0), ("a", 1), ("b", 0), ("b", 1)]
    assert all(r.cyclic for r in out if r.conv_id == 2) and not any(r.cyclic for r in out if r.conv_id == 1)


def test_items_wait_directly_behind_the_latest_they_need(link):
    calls = [(1, 0, "a", "add", '{"a":1}', ["c"]), (1, 2, "b", "add", '{"a":1}', []), (1, 4, "c", "add", '{"a":1}', ["b"]), (1, 6, "d", "add", '{"a":1}', [])]
    out = link(calls, [(1, t + 1, i, "r") for _, t, i, *_ in calls]).collect()
    order = [(r.call_id, r.kind) for r in sorted(out, key=lambda r: r.position)]
    assert order == [("b", 0), ("b", 1), ("c", 0), ("c", 1), ("a", 0), ("a", 1), ("d", 0), ("d", 1)]


def test_cycles_take_what_is_behind_them(link):
    calls = [(1, 0, "a", "add", '{"a":1}', ["c"]), (1, 1, "b", "add", '{"a":1}', ["a"]), (1, 2, "c", "add", '{"a":1}', ["b"]), (1, 3, "d", "add", '{"a":1}', ["c"]), (1, 4, "e", "add", '{"a":1}', []), (1, 5, "f", "add", '{"a":1}', ["f"])]
    out = {r.call_id: (r.position, r.cyclic) for r in link(calls, []).collect()}
    assert out == {"e": (0, False), "a": (1, True), "b": (2, True), "c": (3, True), "d": (4, True), "f": (5, True)}


@pytest.mark.parametrize("items", [0, 512])  # by joins only, and folded
def test_orders_by_joins_and_folded(link, monkeypatch, items):
    monkeypatch.setattr(chat, "FOLD_ITEMS", items)
    calls = [(1, 0, "a", "add", '{"a":1}', ["c"]), (1, 1, "b", "add", '{"a":1}', ["a"]), (1, 2, "c", "add", '{"a":1}', ["b"]), (1, 3, "d", "add", '{"a":1}', ["c"]), (1, 4, "e", "add", '{"a":1}', ["g"]), (1, 5, "f", "add", '{"a":1}', ["f"]), (1, 6, "g", "add", '{"a":1}', [])]
    calls += [(None, i, f"n{i}", "add", '{"a":1}', [f"n{i + 1}"] if i < 5 else []) for i in range(6)]
    out = link(calls, []).collect()
    assert {r.call_id: (r.position, r.cyclic) for r in out if r.conv_id} == {"g": (0, False), "e": (1, False), "a": (2, True), "b": (3, True), "c": (4, True), "d": (5, True), "f": (6, True)}
    assert [r.turn for r in sorted((r for r in out if not r.conv_id), key=lambda r: r.position)] == [5, 4, 3, 2, 1, 0]


def test_a_long_chain_takes_few_jobs(spark, link):
    n = 2000
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    calls = [(1, i, f"c{i}", "add", '{"a":1}', [f"c{i + 1}"] if i + 1 < n else []) for i in range(n)]
    out = link(calls, []).collect()
    jobs = len(tracker.getJobIdsForGroup("chain"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert [r.turn for r in sorted(out, key=lambda r: r.position)] == list(range(n - 1, -1, -1)) and not any(r.cyclic for r in out)
    assert jobs < 250


def test_random_links_against_plain_relaxation(link):
    rng = random.Random(4)
    for _ in range(3):
        n = 14
        calls = [(1, i, f"c{i}", "add", '{"a":1}', [f"c{j}" for j in rng.sample(range(n), rng.randrange(3)) if j < i or rng.random() < 0.3]) for i in range(n)]
        at = {i: (i, 0) for i in range(n)}
        cyclic = set()
        for _ in range(n * n):
            for _, i, _, _, _, needs in calls:
                for j in (int(x[1:]) for x in needs):
                    if j in cyclic or at[j][1] > n:
                        cyclic.add(i)
                    at[i] = max(at[i], (at[j][0], at[j][1] + 1))
        want = sorted(range(n), key=lambda i: (i in cyclic, at[i] if i not in cyclic else (0, 0), i))
        out = sorted(link(calls, []).collect(), key=lambda r: r.position)
        assert [r.turn for r in out] == want and {r.turn for r in out if r.cyclic} == cyclic


def test_null_conversations_repeated_rows_and_empty_tables(link):
    out = link([(None, None, "a", "add", '{"a":1}', None)] * 2, [(None, 3, "a", "r")]).collect()
    assert len(out) == 3 and sorted(r.position for r in out) == [0, 1, 2]
    assert link([], []).count() == 0
    assert link([], [], [(1, 0, "user", None)]).count() == 1


def test_long_conversations_are_ranked_in_spans(link, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 4)
    out = link([(1, i, f"c{i}", "add", '{"a":1}', []) for i in range(0, 40, 2)], [(1, i + 1, f"c{i}", "r") for i in range(0, 40, 2)]).collect()
    assert [r.turn for r in sorted(out, key=lambda r: r.position)] == list(range(40))


def test_last_user_turn_across_spans(spark, monkeypatch):
    monkeypatch.setattr(chat, "SPAN", 3)
    roles = ["system", "user", "assistant", "assistant", "assistant", "assistant", "assistant", "user", "user", "assistant"]
    turns = spark.createDataFrame([(1, i, r, "t", "x") for i, r in enumerate(roles)] + [(None, None, "user", None, "x"), (None, 5, "assistant", "t", "x")], "conv_id long, turn long, role string, text string, asked string")
    got = {r.turn: r.asked for r in chat.asked_before(turns.drop("asked")).collect() if r.conv_id == 1}
    assert got == {0: None, 1: None, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 7, 9: 8}


def test_no_python_on_the_main_path(spark):
    plan = chat.op2_chat_links(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow|Cartesian|NestedLoop", plan)
    assert plan.count("ShuffledHashJoin") >= 3
