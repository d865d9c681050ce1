"""Tool-call linking, with DataFrame operations only.

Calls and results are hash-joined by their identifier; calls are put in topological order of what they depend on;
arguments are validated against the schema of their tool; and every linked call is serialised as canonical JSON (keys
sorted, no spaces). Nothing is collected by conversation: a conversation may hold any share of the rows.

Order: a call's rank is its own number in the conversation, or one more than the greatest rank of the calls it depends on if
that is more. Where numbers already are such an order this takes one look and no round. Else chains of dependencies are
halved in every round. All calls on a cycle get the status `cycle` and keep their number; for calls that depend on them,
such dependencies are left out.

calls: conv_id, call_id, number, name, arguments (JSON text), depends_on (array of call ids). results: conv_id, call_id,
output. Defined cases: a call without an id or with arguments that are no JSON object is invalid; a call without a
result is `pending`, a result without a call `orphan`; calls (or results) with one id count once, the least row stands
and `copies` tells how many there were; where such calls or results differ the others are kept in `other_calls` (JSON
texts) and `other_outputs` (without nulls), and `n_results` counts the results; dependencies that do not exist are listed as errors; empty tables give no rows;
other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioforge.llm.common import materialise, release

#: Rank above which none is raised (only nodes on cycles get there).
MOST = 1 << 50
#: Deps of a node, and of its deps, up to which they are replaced by their own.
FEW = 66
#: JSON schema types as they appear in the type names of variants.
TYPES = {"string": "^STRING", "integer": "^(BIGINT|DECIMAL\\(\\d+,0\\))$", "number": "^(BIGINT|DOUBLE|DECIMAL)", "boolean": "^BOOLEAN", "array": "^ARRAY", "object": "^OBJECT", "null": "^VOID"}


def violations(args: Column, parsed: Column, schema: dict) -> Column:
    """Messages on what in an object breaks its schema: type, required, properties (type, enum, minimum, maximum, minLength,
    maxLength) and additionalProperties."""
    out: list[Column] = []
    props = schema.get("properties", {})
    keys = F.json_object_keys(args)
    for name in schema.get("required", []):
        out.append(F.when(~F.array_contains(keys, name), F.lit(f"{name}: missing")))
    for name, rule in props.items():
        value = F.try_variant_get(parsed, f"$.{name}", "variant")
        there = F.array_contains(keys, name)
        kind = F.schema_of_variant(value)
        if "type" in rule:
            out.append(F.when(there & ~kind.rlike(TYPES[rule["type"]]), F.lit(f"{name}: not {rule['type']}")))
        if "enum" in rule:
            out.append(F.when(there & ~F.to_json(value).isin([_json(x) for x in rule["enum"]]), F.lit(f"{name}: not in enum")))
        number = F.when(kind.rlike(TYPES["number"]), F.try_variant_get(parsed, f"$.{name}", "double"))
        text = F.when(kind.rlike(TYPES["string"]), F.try_variant_get(parsed, f"$.{name}", "string"))
        if "minimum" in rule:
            out.append(F.when(there & (number < rule["minimum"]), F.lit(f"{name}: below minimum")))
        if "maximum" in rule:
            out.append(F.when(there & (number > rule["maximum"]), F.lit(f"{name}: above maximum")))
        if "minLength" in rule:
            out.append(F.when(there & (F.length(text) < rule["minLength"]), F.lit(f"{name}: too short")))
        if "maxLength" in rule:
            out.append(F.when(there & (F.length(text) > rule["maxLength"]), F.lit(f"{name}: too long")))
    if schema.get("additionalProperties", True) is False:
        more = F.array_except(keys, F.array(*(F.lit(n) for n in props)))
        out.append(F.when(F.size(more) > 0, F.concat(F.array_join(F.array_sort(more), ","), F.lit(": not allowed"))))
    listed = F.filter(F.array(*out), lambda m: m.isNotNull()) if out else F.array().cast("array<string>")
    return F.when(keys.isNull(), F.array(F.lit("arguments: not an object"))).otherwise(listed)


def _json(x: object) -> str:
    import json

    return json.dumps(x, ensure_ascii=False, separators=(",", ":"), sort_keys=True)


def validate(calls: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """calls with `parsed` (variant) and `errors`."""
    parsed = F.try_parse_json("arguments")
    checks = F.array(F.lit("name: unknown tool"))
    for name, schema in schemas.items():
        checks = F.when(F.col("name") == name, violations(F.col("arguments"), F.col("parsed"), schema)).otherwise(checks)
    return calls.withColumn("parsed", parsed).withColumn("errors", F.coalesce(checks, F.array(F.lit("arguments: not an object"))))


def _key(*cols: str | Column) -> Column:
    """One string for the values of columns, nulls apart from all others."""
    cols = [F.col(c) if isinstance(c, str) else c for c in cols]
    return F.concat(*(F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-")) for c in cols))


def resolved(nodes: DataFrame) -> DataFrame:
    """(node, least, deps) with the deps left that can not be resolved: those on a cycle or above one; least is final for all others.

    nodes: node, least (what its rank is at least), deps (array of (dep, up): its rank is `up` above that of dep at least).
    In each round deps without deps are taken in. Other deps are replaced by their own deps, the greatest `up` kept, where
    they have a single one, or few, as the node itself: so a chain takes a round for each doubling of its length, and so does
    what lies within FEW calls where calls have several deps; beyond, a round takes in a stretch of about 2 * FEW. While some node
    has deps on no cycle, one at least is resolved in each round."""
    now, left = nodes, None
    while True:
        open_ = now.where("size(deps) > 0").count()
        if not open_ or open_ == left:
            return now
        left = open_
        below = now.select(F.col("node").alias("dep"), F.col("least").alias("low"), F.col("deps").alias("further"))
        links = now.where("size(deps) > 0").select("node", F.size("deps").alias("own"), F.explode("deps").alias("x")).select("node", "own", "x.dep", "x.up").join(below, "dep")
        n = F.size("further")
        over = F.transform("further", lambda f: F.struct(f["dep"].alias("dep"), F.least(f["up"] + F.col("up"), F.lit(MOST)).alias("up")))
        then = F.when((n <= 1) | ((n <= FEW) & (F.col("own") <= FEW)), over).otherwise(F.array(F.struct("dep", "up")))
        raised = links.select("node", F.least(F.col("low") + F.col("up"), F.lit(MOST)).alias("low"), F.explode_outer(then).alias("x"))
        per = raised.groupBy("node", "x.dep").agg(F.max("low").alias("low"), F.max("x.up").alias("up")).groupBy("node")
        got = per.agg(F.max("low").alias("low"), F.sort_array(F.collect_list(F.when(F.col("dep").isNotNull(), F.struct("dep", "up")))).alias("after"))
        after = now.join(got, "node", "left").select("node", F.greatest("least", "low").alias("least"), F.coalesce("after", F.col("deps")).alias("deps"))
        before, now = now, materialise(after, "resolved")
        if before is not nodes:
            release(before)


def on_cycles(stuck: DataFrame) -> DataFrame:
    """(node) of the nodes that stand on a cycle. stuck: node, deps (array of (dep, up)), as resolved() leaves them open, with their first deps.

    Each node follows one of its deps; the image of following often enough is on cycles, which are found by doubling. Cycles
    are merged into one node each, what is then resolvable goes, and the rest is looked at again: nested cycles take a turn each."""
    edges = materialise(stuck.select("node", F.explode("deps").alias("x")).select("node", "x.dep").distinct(), "cycle_edges")
    member = materialise(stuck.select("node", F.col("node").alias("comp")), "members")
    found = edges.where("node = dep").select("node")
    while True:
        comp = member.select(F.col("node").alias("dep"), F.col("comp").alias("to"))
        outer = edges.join(member, "node").join(comp, "dep").where("comp != to").select(F.col("comp").alias("node"), F.col("to").alias("dep")).distinct()
        deps = outer.groupBy("node").agg(F.collect_set(F.struct("dep", F.lit(0).cast("long").alias("up"))).alias("deps"))
        graph = member.select(F.col("comp").alias("node")).distinct().join(deps, "node", "left").select("node", F.lit(0).cast("long").alias("least"), F.coalesce("deps", F.array().cast("array<struct<dep:string,up:bigint>>")).alias("deps"))
        graph = materialise(graph, "merged")
        rest = resolved(graph).where("size(deps) > 0").select("node")
        n = rest.count()
        if not n:
            return found.unionByName(member.groupBy("comp").agg(F.count("*").alias("m")).where("m > 1").join(member, "comp").select("node")).distinct()
        alive = rest.select(F.col("node").alias("dep"))
        follow = graph.join(rest, "node", "left_semi").select("node", F.explode("deps").alias("x")).select("node", "x.dep").join(alive, "dep", "left_semi")
        jump = materialise(follow.groupBy("node").agg(F.min("dep").alias("to")).withColumn("low", F.col("to")), "jump")
        for _ in range(max(1, (n - 1).bit_length())):
            then = jump.select(F.col("node").alias("to"), F.col("to").alias("end"), F.col("low").alias("more"))
            last, jump = jump, materialise(jump.join(then, "to").select("node", F.col("end").alias("to"), F.least("low", "more").alias("low")), "jump")
            release(last)
        cycle = jump.join(jump.select(F.col("to").alias("node")).distinct(), "node", "left_semi").select(F.col("node").alias("comp"), "low")
        member = materialise(member.join(cycle, "comp", "left").select("node", F.coalesce("low", "comp").alias("comp")), "members")


def ranks(calls: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(conv_id, call_id, rank, is_cycle) with each call above those it depends on, and (conv_id, call_id, dep) with no such dep."""
    nodes = calls.select("conv_id", "call_id", F.coalesce("number", F.lit(0)).cast("long").alias("rank"), "depends_on")
    links = nodes.select("conv_id", "call_id", "rank", F.explode(F.array_distinct("depends_on")).alias("dep")).where("dep is not null")
    target = nodes.select(F.col("conv_id").alias("_c"), F.col("call_id").alias("dep"), F.col("rank").alias("below"))
    same = F.col("conv_id").eqNullSafe(F.col("_c"))
    edges = materialise(links.join(target, (links["dep"] == target["dep"]) & same, "left").select("conv_id", "call_id", "rank", links["dep"], "below"), "edges")
    missing = edges.where("below is null").select("conv_id", "call_id", "dep")
    late = edges.where("rank <= below").select("conv_id").distinct()
    plain = nodes.select("conv_id", "call_id", "rank", F.lit(False).alias("is_cycle"))
    if late.isEmpty():  # numbers already are an order
        return plain, missing
    within = lambda d: d.join(late.withColumnRenamed("conv_id", "_l"), F.col("conv_id").eqNullSafe(F.col("_l")), "left_semi")
    deps = within(edges.where("below is not null")).select(_key("conv_id", "call_id").alias("node"), F.struct(_key("conv_id", "dep").alias("dep"), F.lit(1).cast("long").alias("up")).alias("x"))
    deps = deps.groupBy("node").agg(F.collect_set("x").alias("deps"))
    none = F.array().cast("array<struct<dep:string,up:bigint>>")
    graph = within(plain).select(_key("conv_id", "call_id").alias("node"), F.col("rank").alias("least")).join(deps, "node", "left")
    graph = materialise(graph.select("node", "least", F.coalesce("deps", none).alias("deps")), "graph")
    done = resolved(graph)
    cycles = None
    if not (stuck := done.where("size(deps) > 0").select("node")).isEmpty():
        within_stuck = graph.join(stuck, "node", "left_semi").select("node", F.explode("deps").alias("x")).select("node", "x.dep").join(stuck.withColumnRenamed("node", "dep"), "dep", "left_semi")
        cycles = materialise(on_cycles(stuck.join(within_stuck.groupBy("node").agg(F.collect_list(F.struct("dep", F.lit(1).cast("long").alias("up"))).alias("deps")), "node")), "cycles")
        free = graph.select("node", F.explode("deps").alias("x")).join(cycles.select(F.col("node").alias("dep")), F.col("x.dep") == F.col("dep"), "left_anti").join(cycles, "node", "left_anti")
        again = graph.select("node", "least").join(free.groupBy("node").agg(F.collect_list("x").alias("deps")), "node", "left")
        done = resolved(materialise(again.select("node", "least", F.coalesce("deps", none).alias("deps")), "graph"))
    final = done.select("node", "least")
    final = final.withColumn("is_cycle", F.lit(False)) if cycles is None else final.join(cycles.withColumn("is_cycle", F.lit(True)), "node", "left")
    known = plain.withColumn("node", _key("conv_id", "call_id")).drop("is_cycle").join(final, "node", "left")
    return known.select("conv_id", "call_id", F.coalesce("least", "rank").alias("rank"), F.coalesce("is_cycle", F.lit(False)).alias("is_cycle")), missing


def link_calls(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """conv_id, call_id, name, rank, status, errors, copies, message (canonical JSON), n_results, other_calls and other_outputs of every call, and
    of orphan results."""
    one = F.struct("number", "name", "arguments", "depends_on")
    calls = calls.groupBy("conv_id", "call_id").agg(F.min(one).alias("x"), F.count("*").alias("copies"), F.sort_array(F.collect_set(one)).alias("all"))
    others = F.transform(F.slice("all", 2, F.size("all")), lambda c: F.to_json(c))
    calls = calls.select("conv_id", "call_id", "x.*", "copies", others.alias("other_calls"))
    calls = materialise(validate(calls, schemas), "calls")
    outputs = results.groupBy("conv_id", "call_id").agg(F.min("output").alias("output"), F.count("*").alias("n_results"), F.sort_array(F.collect_set("output")).alias("all"))
    outputs = outputs.select("conv_id", "call_id", "output", "n_results", F.slice("all", 2, F.size("all")).alias("other_outputs"))
    rank, missing = ranks(calls)
    lost = missing.groupBy("conv_id", "call_id").agg(F.sort_array(F.collect_set(F.concat(F.lit("depends_on: no "), "dep"))).alias("lost"))

    def on(left: str, right: str) -> Column:
        return F.col(f"{left}.conv_id").eqNullSafe(F.col(f"{right}.conv_id")) & (F.col(f"{left}.call_id") == F.col(f"{right}.call_id"))

    both = calls.alias("c").join(rank.alias("k"), on("c", "k"), "left").join(lost.alias("l"), on("c", "l"), "left").join(outputs.alias("o"), on("c", "o"), "full")
    errors = F.concat(F.coalesce("c.errors", F.array().cast("array<string>")), F.coalesce("l.lost", F.array().cast("array<string>")), F.when(F.col("c.copies").isNotNull() & F.col("c.call_id").isNull(), F.array(F.lit("call_id: missing"))).otherwise(F.array().cast("array<string>")))
    none = F.array().cast("array<string>")
    more_calls, more_outputs = F.coalesce("other_calls", none), F.coalesce("other_outputs", none)
    status = F.when(F.col("c.copies").isNull(), "orphan").when(F.col("is_cycle"), "cycle").when(F.col("n_results").isNull(), "pending").otherwise("linked")
    conv, call = F.coalesce("c.conv_id", "o.conv_id"), F.coalesce("c.call_id", "o.call_id")
    message = F.to_json(F.struct(F.col("parsed").alias("arguments"), F.array_sort("depends_on").alias("depends_on"), call.alias("id"), F.col("name"), F.col("output"), F.col("rank")))
    return both.select(conv.alias("conv_id"), call.alias("call_id"), "name", "rank", status.alias("status"), errors.alias("errors"), F.coalesce("copies", "n_results").alias("copies"), message.alias("message"), F.coalesce("n_results", F.lit(0)).alias("n_results"), more_calls.alias("other_calls"), more_outputs.alias("other_outputs"))


# Conversations as calls


PROMPT_CHARS = 300
ANSWER = {
    "answer": {
        "required": ["conversation", "prompt", "turn"],
        "properties": {"conversation": {"type": "integer", "minimum": 0}, "prompt": {"type": "string", "minLength": 1, "maxLength": PROMPT_CHARS}, "turn": {"type": "integer", "minimum": 0}},
        "additionalProperties": False,
    }
}


def turns_as_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every user turn as a call of the tool `answer`, which depends on the user turn before; every assistant turn as the
    result of the turn before it. Calls carry no number, so their order comes from what they depend on."""
    ident = lambda turn: F.concat_ws(":", F.lit("call"), F.col("conv_id"), turn)
    args = F.to_json(F.struct(F.col("text").alias("prompt"), F.col("turn"), F.col("conv_id").alias("conversation")))
    asked = turns.where("role = 'user'").select("conv_id", ident(F.col("turn")).alias("call_id"), F.lit(None).cast("long").alias("number"), F.lit("answer").alias("name"), args.alias("arguments"), F.col("turn"))
    before = asked.select(F.col("conv_id").alias("_c"), (F.col("turn") + 2).alias("_t")).distinct()
    calls = asked.join(before, F.col("conv_id").eqNullSafe(F.col("_c")) & (F.col("turn") == F.col("_t")), "left")
    needs = F.when(F.col("_t").isNotNull(), F.array(ident(F.col("turn") - 2))).otherwise(F.array().cast("array<string>"))
    results = turns.where("role = 'assistant'").select("conv_id", ident(F.col("turn") - 1).alias("call_id"), F.col("text").alias("output"))
    return calls.select("conv_id", "call_id", "number", "name", "arguments", needs.alias("depends_on")), results
