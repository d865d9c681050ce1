import json
import random

from folioforge.llm import queries, tool_calls as T

CALLS = "conv_id long, call_id string, number long, name string, arguments string, depends_on array<string>, extra int"
RESULTS = "conv_id long, call_id string, output string"
SCHEMA = {
    "search": {"required": ["q"], "properties": {"q": {"type": "string", "minLength": 2, "maxLength": 9}, "n": {"type": "integer", "minimum": 1, "maximum": 5}, "how": {"enum": ["a", "b"]}, "x": {"type": "number"}}, "additionalProperties": False},
    "free": {"properties": {"o": {"type": "object"}, "l": {"type": "array"}, "b": {"type": "boolean"}, "z": {"type": "null"}}},
}


def run(spark, calls, results):
    return T.link_calls(spark.createDataFrame(calls, CALLS), spark.createDataFrame(results, RESULTS), SCHEMA).collect()


def test_linking_and_status(spark):
    rows = run(spark, [
        (1, "a", 0, "free", "{}", None, 1), (1, "b", 1, "free", '{"o":{},"l":[1],"b":true,"z":null}', ["a"], 1),
        (2, "a", 0, "free", "{}", [], 1), (2, "a", 0, "free", "{}", [], 1), (None, "n", 3, "free", "{}", ["zzz"], 1), (3, None, 0, "free", "{}", [], 1),
    ], [(1, "a", "out"), (9, "q", "lost"), (None, "n", None), (2, "a", "x"), (2, "a", "w")])
    got = {(r["conv_id"], r["call_id"]): (r["status"], r["errors"], r["copies"]) for r in rows}
    assert got == {
        (1, "a"): ("linked", [], 1), (1, "b"): ("pending", [], 1), (2, "a"): ("linked", [], 2), (9, "q"): ("orphan", [], 1),
        (None, "n"): ("linked", ["depends_on: no zzz"], 1), (3, None): ("pending", ["call_id: missing"], 1),
    }


def test_validation(spark):
    cases = {
        '{"q":"ab"}': [], '{"q":"abc","n":3,"how":"b","x":1.5}': [], "{}": ["q: missing"], '{"q":1}': ["q: not string"],
        '{"q":"a"}': ["q: too short"], '{"q":"0123456789"}': ["q: too long"], '{"q":"ab","n":"x"}': ["n: not integer"],
        '{"q":"ab","n":2.5}': ["n: not integer"], '{"q":"ab","n":0}': ["n: below minimum"], '{"q":"ab","n":6}': ["n: above maximum"],
        '{"q":"ab","how":"c"}': ["how: not in enum"], '{"q":"ab","zz":1,"y":2}': ["y,zz: not allowed"], "[1]": ["arguments: not an object"],
        "not json": ["arguments: not an object"], "": ["arguments: not an object"], '{"q":null}': ["q: not string"],
    }
    rows = run(spark, [(1, f"c{k}", k, "search", a, [], 1) for k, a in enumerate(cases)] + [(1, "u", 99, "other", "{}", [], 1), (1, "v", 99, None, None, [], 1)], [])
    got = {r["call_id"]: r["errors"] for r in rows}
    assert [got[f"c{k}"] for k in range(len(cases))] == list(cases.values())
    assert got["u"] == got["v"] == ["name: unknown tool"]


def test_canonical_json(spark):
    a = {"z": [1, {"b": None, "a": "é\n\"x"}], "a": True, "m": {"y": 2, "x": 1.5}}
    [r] = run(spark, [(1, "a", 4, "free", json.dumps(a, indent=2), ["q", "b"], 1)], [(1, "a", "done")])
    want = {"arguments": a, "depends_on": ["b", "q"], "id": "a", "name": "free", "output": "done", "rank": 4}
    assert r["message"] == json.dumps(want, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def test_topological_order(spark):
    rnd = random.Random(1)
    calls, edges = [], []
    for c in range(6):
        order = list(range(14))
        rnd.shuffle(order)
        for i in range(14):
            deps = [f"k{order[j]}" for j in range(i) if rnd.random() < 0.25]
            edges += [(c, f"k{order[i]}", d) for d in deps]
            calls.append((c, f"k{order[i]}", order[i], "free", "{}", deps, 1))
    rank = {(r["conv_id"], r["call_id"]): r["rank"] for r in run(spark, calls, [])}
    assert len(rank) == 84 and edges and all(rank[c, a] > rank[c, d] for c, a, d in edges)


def reference(calls):
    """(ranks, calls on cycles) by plain search; dependencies on a call on a cycle are left out."""
    deps = {k: {d for d in ds if d in calls} for k, (_, ds) in calls.items()}

    def above(k):
        seen, todo = set(), list(deps[k])
        while todo:
            if (x := todo.pop()) not in seen:
                seen.add(x)
                todo += deps[x]
        return seen

    cyclic = {k for k in calls if k in above(k)}
    rank = {}

    def of(k):
        if k not in rank:
            rank[k] = calls[k][0] if k in cyclic else max([calls[k][0], *(of(d) + 1 for d in deps[k] - cyclic)])
        return rank[k]

    return {k: of(k) for k in calls}, cyclic


def test_order_and_cycles_on_random_graphs(spark):
    rnd = random.Random(5)
    rows, want = [], {}
    for c in range(30):
        n = rnd.randint(1, 14)
        p = rnd.choice([0.05, 0.1, 0.2])
        calls = {f"k{i}": (rnd.randrange(6), sorted({f"k{j}" for j in range(n) if rnd.random() < p})) for i in range(n)}
        rows += [(c, k, num, "free", "{}", [*deps, *deps[:1]], 1) for k, (num, deps) in calls.items()]
        rank, cyclic = reference(calls)
        want |= {(c, k): (rank[k], "cycle" if k in cyclic else "pending") for k in calls}
    got = {(r["conv_id"], r["call_id"]): (r["rank"], r["status"]) for r in run(spark, rows, [])}
    assert got == want and {s for _, s in want.values()} == {"cycle", "pending"}


def test_long_chains_and_cycles_take_few_rounds(spark, monkeypatch):
    written = []
    plain = T.materialise
    monkeypatch.setattr(T, "materialise", lambda df, name: written.append(name) or plain(df, name))
    n = 3000
    rows = [(1, f"c{i}", n - i, "free", "{}", [f"c{i - 1}"] if i else [], 1) for i in range(n)]
    got = {r["call_id"]: r["rank"] for r in run(spark, rows, [])}
    assert got == {f"c{i}": n + i for i in range(n)} and len(written) <= 20
    del written[:]
    ring = [(1, f"c{i}", 0, "free", "{}", [f"c{(i + 1) % 1000}"], 1) for i in range(1000)] + [(1, f"d{i}", 0, "free", "{}", [f"d{i - 1}" if i else "c5"], 1) for i in range(50)]
    got = {r["call_id"]: (r["rank"], r["status"]) for r in run(spark, ring, [])}
    assert got == {f"c{i}": (0, "cycle") for i in range(1000)} | {f"d{i}": (i, "pending") for i in range(50)} and len(written) <= 45


def test_calls_with_several_dependencies_take_few_rounds(spark, monkeypatch):
    """A thousand calls, each of which depends on the two before it, and a wide graph."""
    tables = []
    real = T.materialise
    monkeypatch.setattr(T, "materialise", lambda df, name: tables.append(name) or real(df, name))
    calls = [(1, f"k{k}", None, "free", "{}", [f"k{k - j}" for j in (1, 2) if k >= j], 1) for k in range(1000)]
    calls += [(2, f"w{k}", None, "free", "{}", [f"w{j}" for j in range(k % 3, min(k, 60), 3)] if k >= 60 else [], 1) for k in range(200)]
    rows = run(spark, calls, [])
    got = {(r["conv_id"], r["call_id"]): r["rank"] for r in rows}
    assert [got[1, f"k{k}"] for k in range(1000)] == list(range(1000)) and {got[2, f"w{k}"] for k in range(60, 200)} == {1}
    assert tables.count("resolved") <= 15 and all(r["status"] == "pending" for r in rows)


def test_clashing_columns(spark):
    calls = spark.createDataFrame([(1, "a", 0, "free", "{}", ["b"], 1, 2), (1, "b", 0, "free", "{}", [], 1, 2)], "conv_id long, call_id string, number long, name string, arguments string, depends_on array<string>, rank int, least int")
    results = spark.createDataFrame([(1, "a", "x", 3)], "conv_id long, call_id string, output string, n_results int")
    got = {r["call_id"]: (r["rank"], r["status"]) for r in T.link_calls(calls, results, SCHEMA).collect()}
    assert got == {"a": (1, "linked"), "b": (0, "pending")}


def test_conversations(spark, sf):
    turns = spark.read.parquet(f"{sf}/conversations.parquet").collect()
    rows = queries.op6_tool_calls(spark, sf).collect()
    text = {(r["conv_id"], r["turn"]): r["text"] or "" for r in turns}
    users, answers = {(r["conv_id"], r["turn"]) for r in turns if r["role"] == "user"}, {(r["conv_id"], r["turn"]) for r in turns if r["role"] == "assistant"}
    got = {(r["conv_id"], r["call_id"]): r for r in rows}
    assert len(got) == len(rows) == len(users | {(c, t - 1) for c, t in answers})
    for c, t in users:
        r = got[c, f"call:{c}:{t}"]
        m = json.loads(r["message"])
        depth = next(k for k in range(t + 2) if (c, t - 2 * k - 2) not in users)
        errors = ["prompt: too long"] if len(text[c, t]) > T.PROMPT_CHARS else []
        assert (r["status"], r["rank"], r["errors"]) == ("linked" if (c, t + 1) in answers else "pending", depth, errors)
        assert m["depends_on"] == ([f"call:{c}:{t - 2}"] if (c, t - 2) in users else []) and m["arguments"]["turn"] == t


def test_empty(spark):
    assert run(spark, [], []) == []


def test_different_results_and_calls_of_one_id_are_kept(spark):
    calls = [(1, "a", 0, "f", '{"x":1}', [], 1), (1, "a", 0, "f", '{"x":2}', [], 1), (1, "b", 1, "f", '{"x":1}', [], 1), (1, "b", 1, "f", '{"x":1}', [], 1)]
    results = [(1, "a", "one"), (1, "b", "two"), (1, "b", "three"), (1, "b", "two")]
    got = {r["call_id"]: r for r in run(spark, calls, results)}
    assert [json.loads(c)["arguments"] for c in got["a"]["other_calls"]] == ['{"x":2}']
    assert got["b"]["other_outputs"] == ["two"] and got["b"]["n_results"] == 3
    assert got["a"]["other_outputs"] == [] and got["b"]["other_calls"] == [] and got["b"]["copies"] == 2
