"""Tool-call linking in DataFrame functions only.

Messages are rows (conv_id, turn, role, text). The text of an assistant message with calls is a JSON object with tool_calls, an
array of objects with id, name and arguments (an object, or a string that holds one); the text of a tool message is a JSON
object with tool_call_id and content. A string argument "$ID" refers to the result of the call ID of the same
conversation, so its call depends on that one.

Calls and results are hash-joined on conversation and identifier. Calls are ordered so that each stands behind the calls it
depends on and, as far as that allows, in the order of their turns: a call's place is the pair (turn that it waits for,
steps behind it), the greatest of its own turn and its dependencies' places one step on. Where all calls of a conversation stand
behind what they need, their turns are their places. Of the other conversations, one with up to `LOCAL` calls with dependencies is ordered in one
aggregation. In larger ones, calls that need one call are led past it by pointer doubling, to the first call that needs none or
several, in as many joins as the logarithm of the chain; those are settled in rounds, each once all it needs is settled.
Arguments are checked against schemas (rows tool, property, type, required), and calls are
written as canonical JSON: keys sorted, no white space.

Defined cases: messages that are no calls or results give no rows; a call without id or without result is unlinked; of
several results of a call the first turn counts; calls that repeat an id each get a row, but rows that repeat
a whole call (conversation, turn, place, id, name and arguments, null being a value like any other) count once; dependencies on unknown ids are
ignored; calls in a cycle of dependencies, or behind one, get place null, stand at the end and have the error "cycle";
arguments that are null or no JSON object have the error "json"; a call of a tool without schema has the error "tool"; null
conv_ids are one conversation; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import discard, materialize, running

CALLS_PER_CHUNK = 4096
#: Calls of a conversation that are ordered in one aggregation, whose work grows with the square.
LOCAL = 128
#: Parts that the calls of one conversation are dealt to where they are counted.
SALTS = 8
#: Stands for a null conv_id where rows are dealt by it.
NO_CONV = -(1 << 62)


def parse(messages: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Calls (key, conv_id, turn, at, call_id, name, arguments, is_object) and results (conv_id, call_id, turn, content) of messages, which are gone through once."""
    calls = F.from_json("text", "tool_calls array<struct<id string, name string, arguments string>>")["tool_calls"]
    as_calls = F.transform(calls, lambda c, i: F.struct(i.alias("at"), c.id.alias("call_id"), c["name"].alias("name"), c.arguments.alias("arguments"), F.lit(None).cast("string").alias("content")))
    result = F.from_json("text", "tool_call_id string, content string")
    as_result = F.transform(F.array(result), lambda r: F.struct(F.lit(None).cast("int").alias("at"), r.tool_call_id.alias("call_id"), F.lit(None).cast("string").alias("name"), F.lit(None).cast("string").alias("arguments"), r.content.alias("content")))
    found = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.explode(F.when(F.col("role") == "assistant", as_calls).when(F.col("role") == "tool", as_result)).alias("x"))
    found = found.select("conv_id", "turn", "x.*").where("at is not null or call_id is not null")
    # a null field is left out of the JSON, a value is not, so no two different calls have the same text
    whole = F.md5(F.to_json(F.struct("conv_id", "turn", "at", "call_id", "name", "arguments")))
    is_object = F.coalesce(F.expr("schema_of_variant(try_parse_json(arguments)) like 'OBJECT%'"), F.lit(False))
    found = materialize(found.withColumns({"key": F.when(F.col("at").isNotNull(), whole), "is_object": is_object}), "tool-messages")
    return found.where("at is not null").drop("content"), found.where("at is null").select("conv_id", "call_id", "turn", "content")


def places(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """(key, place) of each call that is in no cycle nor behind one; calls (key, seq), needs (conv_id, key, on).

    place is a struct (seq, step) by which calls stand behind all they need.
    """
    seqs = materialize(calls.select("key", "seq"), "tool-calls")
    plain = seqs.select("key", _place(F.col("seq"), F.lit(0)).alias("place"))
    of = lambda name, seq: seqs.select(F.col("key").alias(name), F.col("seq").alias(seq))
    edges = materialize(needs.join(of("key", "seq"), "key").join(of("on", "on_seq"), "on"), "tool-needs")
    moved = materialize(edges.where("on_seq >= seq").select(F.col("conv_id").alias("_conv")).distinct(), "tool-moved")
    if not moved.head(1):
        return plain
    edges = materialize(edges.join(moved, F.col("conv_id").eqNullSafe(F.col("_conv")), "left_semi").withColumn("root", F.coalesce("conv_id", F.lit(NO_CONV))), "tool-needs")
    nodes = edges.select("root", "key", "seq").unionByName(edges.select("root", F.col("on").alias("key"), F.col("on_seq").alias("seq"))).distinct()
    nodes = nodes.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)).cast("int"))
    sizes = nodes.groupBy("root").agg(F.count("*").alias("n")).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    nodes = materialize(nodes.join(sizes, ["root", "salt"]), "tool-nodes")
    few, many = nodes.where(F.col("n") <= LOCAL), nodes.where(F.col("n") > LOCAL)
    settled = _ordered(few, edges)
    if many.head(1):
        settled = settled.unionByName(_rounds(many, edges.join(many.select("key"), "key", "left_semi").select("key", "on")))
    return plain.join(nodes.select("key"), "key", "left_anti").unionByName(settled)


def _place(seq: Column, step: Column) -> Column:
    return F.struct(seq.cast("long").alias("seq"), step.cast("long").alias("step"))


def _ordered(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Places of the calls of small conversations (root, key, seq): calls whose needs are all settled are settled, until none is left or none moves."""
    wants = edges.drop("root").join(nodes.select("key", "root"), "key").groupBy("root", "key").agg(F.collect_set("on").alias("needs"))
    graph = nodes.join(wants, ["root", "key"], "left").groupBy("root").agg(F.collect_list(F.struct("key", _place(F.col("seq"), F.lit(0)).alias("own"), F.coalesce("needs", F.array().cast("array<string>")).alias("needs"))).alias("g"))
    graph = graph.select("root", F.col("g.key").alias("keys"), F.col("g.own").alias("own"), F.col("g.needs").alias("needs"))
    graph = materialize(graph.withColumn("idx", F.expr("transform(needs, x -> transform(x, k -> cast(array_position(keys, k) - 1 as int)))")).drop("needs"), "tool-graphs")
    places = F.expr("""
        aggregate(sequence(0, size(own)), named_struct('s', transform(own, x -> cast(null as struct<seq: bigint, step: bigint>)), 'open', -1),
          (a, r) -> if(size(filter(a.s, x -> x is null)) = a.open, a, named_struct('s', transform(a.s, (p, i) -> case when p is not null then p when exists(idx[i], j -> a.s[j] is null) then null
            else array_max(concat(array(own[i]), transform(idx[i], j -> named_struct('seq', a.s[j].seq, 'step', a.s[j].step + 1)))) end), 'open', size(filter(a.s, x -> x is null)))),
          a -> a.s)
    """)
    return graph.select(F.explode(F.arrays_zip("keys", places.alias("place"))).alias("x")).select(F.col("x.keys").alias("key"), F.col("x.place").alias("place")).where("place is not null")


def _led(ones: DataFrame) -> DataFrame:
    """Calls that need one call (key, on, own), led to the first one behind which no such call follows: key, on, steps, least.

    The place of key is the greatest of least and that of on, steps further. Calls that go round in a circle, or lead to one, stay with an
    `on` that is a key.
    """
    led = materialize(ones.select("key", "on", F.lit(1).cast("long").alias("steps"), F.col("own").alias("least")), "tool-led")
    # pointers double in length, so after these rounds only circles are left
    for _ in range(led.count().bit_length()):
        then = led.select(F.col("key").alias("on"), F.col("on").alias("_on"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
        further = _place(F.col("_least.seq"), F.col("_least.step") + F.col("steps"))
        new = led.join(then, "on", "left").select(
            "key", F.coalesce("_on", "on").alias("on"), (F.col("steps") + F.coalesce("_steps", F.lit(0))).alias("steps"),
            F.when(F.col("_on").isNull(), F.col("least")).otherwise(F.greatest("least", further)).alias("least"), F.col("_on").isNotNull().alias("moved"),
        )
        new = materialize(new, "tool-led")
        discard(led)
        led = new
        if not led.where("moved").head(1):
            break
    return led.drop("moved")


def _rounds(calls: DataFrame, needs: DataFrame) -> DataFrame:
    """Places of calls (key, seq): chains of single needs are led past first, the others are settled once all they need is."""
    counts = needs.distinct().groupBy("key").agg(F.count("*").alias("n"))
    calls = materialize(calls.select("key", _place(F.col("seq"), F.lit(0)).alias("own")).join(counts, "key", "left"), "tool-places")
    led = _led(needs.distinct().join(calls.where("n = 1").select("key", "own"), "key"))
    settled = calls.where("n is null").select("key", F.col("own").alias("place"))

    several = needs.distinct().join(calls.where("n > 1"), "key")
    over = led.select(F.col("key").alias("on"), F.col("on").alias("_on"), F.col("steps").alias("_steps"), F.col("least").alias("_least"))
    several = several.join(over, "on", "left").select(
        "key", "n", F.coalesce("_on", "on").alias("on"), (F.coalesce("_steps", F.lit(0)) + 1).alias("steps"),
        F.when(F.col("_on").isNull(), F.col("own")).otherwise(F.greatest("own", _place(F.col("_least.seq"), F.col("_least.step") + 1))).alias("least"),
    )
    waiting = materialize(several, "tool-waiting")
    while waiting.head(1):
        reached = waiting.join(settled.withColumnRenamed("key", "on"), "on").groupBy("key", "n").agg(
            F.count("*").alias("m"), F.max(F.greatest("least", _place(F.col("place.seq"), F.col("place.step") + F.col("steps")))).alias("place")
        )
        new = materialize(reached.where("m = n").select("key", "place"), "tool-settled")
        if not new.head(1):  # what is left waits for a circle
            break
        left = materialize(waiting.join(new.select("key"), "key", "left_anti"), "tool-waiting")
        discard(waiting)
        settled, waiting = materialize(settled.unionByName(new), "tool-places"), left
    at = settled.select(F.col("key").alias("on"), "place")
    chains = led.join(at, "on").select("key", F.greatest("least", _place(F.col("place.seq"), F.col("place.step") + F.col("steps"))).alias("place"))
    return settled.unionByName(chains)


def link(messages: DataFrame, schemas: DataFrame) -> DataFrame:
    """One row for each call: conv_id, position, call_id, name, linked, valid, errors (sorted), json."""
    whole, results = parse(messages)
    # texts move twice at most (arguments to their key; contents to the ids they answer and on to the keys), so calls go on without them
    calls = materialize(whole.drop("arguments").dropDuplicates(["key"]), "tool-calls")
    fields = whole.where("is_object").select("conv_id", "key", "name", F.explode(F.expr("from_json(arguments, 'map<string,variant>')")).alias("property", "value"))
    fields = fields.select("conv_id", "key", "name", "property", F.expr("schema_of_variant(value)").alias("kind"), F.expr("try_variant_get(value, '$', 'string')").alias("text"))

    # what each call needs: "$ID" names the first call of that id in the conversation
    named = calls.where("call_id is not null").groupBy("conv_id", "call_id").agg(F.min(F.struct("turn", "at", "key")).alias("first"))
    refs = fields.where("kind = 'STRING' and text like '$%'").select("conv_id", "key", F.substring("text", 2, 1 << 30).alias("call_id")).distinct()
    needs = refs.join(named, refs.conv_id.eqNullSafe(named.conv_id) & (refs.call_id == named.call_id)).select(refs.conv_id, "key", F.col("first.key").alias("on"))
    seq = F.col("turn") * (1 << 20) + F.col("at")
    placed = places(calls.select("key", F.coalesce(seq, F.lit(-1)).alias("seq")), needs).withColumnRenamed("key", "_p")

    # positions are counted over keys and places alone, so that texts are not sorted for them
    late = F.struct(F.coalesce(F.col("place.seq"), F.lit((1 << 62))).alias("a"), F.col("place.step").alias("b"), seq.alias("c"), F.col("key").alias("d"))
    turns = calls.select("key", "conv_id", "turn", "at").join(placed, F.col("key") == F.col("_p"), "left").select("key", "conv_id", late.alias("_order"), F.col("place").isNull().alias("cycle"))
    turns = turns.select(F.col("key").alias("_p"), F.coalesce("conv_id", F.lit(NO_CONV)).alias("_conv"), F.floor(F.col("_order.a") / ((1 << 20) * CALLS_PER_CHUNK)).alias("_chunk"), "_order", "cycle")
    turns = running(turns, "_conv", "_chunk", [F.col("_order")], F.lit(1), "position").select("_p", "position", "cycle")

    # arguments against schemas
    known = schemas.select("tool").distinct()
    kinds = F.create_map(*[F.lit(x) for x in ("BIGINT", "integer", "STRING", "string", "BOOLEAN", "boolean", "DOUBLE", "number", "VOID", "null")])
    kind = F.when(F.col("kind").startswith("OBJECT"), "object").when(F.col("kind").startswith("ARRAY"), "array").when(F.col("kind").startswith("DECIMAL"), "number").otherwise(kinds[F.col("kind")])
    rule = schemas.select(F.col("tool").alias("name"), "property", "type", "required")
    seen = fields.withColumn("kind", kind).join(known.withColumnRenamed("tool", "name"), "name", "left_semi").join(rule, ["name", "property"], "left")
    fits = (F.col("kind") == F.col("type")) | ((F.col("type") == "number") & (F.col("kind") == "integer"))
    wrong = seen.where(F.col("type").isNull() | ~F.coalesce(fits, F.lit(False))).select("key", F.concat(F.when(F.col("type").isNull(), "unknown:").otherwise("type:"), "property").alias("error"))
    due = calls.where("is_object").select("key", "name").join(rule.where("required"), "name").select("key", "property")
    missing = due.join(fields.select("key", "property"), ["key", "property"], "left_anti").select("key", F.concat(F.lit("missing:"), "property").alias("error"))
    no_tool = calls.join(known, calls.name == known.tool, "left_anti").select("key", F.lit("tool").alias("error"))
    no_json = calls.where("not is_object").select("key", F.lit("json").alias("error"))
    errors = wrong.unionByName(missing).unionByName(no_tool).unionByName(no_json).groupBy("key").agg(F.collect_set("error").alias("errors"))

    dealt = [F.coalesce("conv_id", F.lit(NO_CONV)).alias("_conv"), F.col("call_id").alias("_call")]
    first = results.groupBy(*dealt).agg(F.min(F.struct("turn", "content")).alias("result"))
    answers = calls.select(F.col("key").alias("_a"), *dealt).join(first, ["_conv", "_call"]).select("_a", "result")
    rows = (
        calls.join(whole.groupBy("key").agg(F.max("arguments").alias("arguments")), "key").join(turns, F.col("key") == turns["_p"])
        .join(errors.withColumnRenamed("key", "_e"), F.col("key") == F.col("_e"), "left").join(answers, F.col("key") == F.col("_a"), "left")
    )
    found = F.sort_array(F.array_union(F.coalesce("errors", F.array().cast("array<string>")), F.when(F.col("cycle"), F.array(F.lit("cycle"))).otherwise(F.array().cast("array<string>"))))
    quoted = lambda c: F.regexp_extract(F.to_json(F.struct(c.alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1)
    text = lambda c: F.when(c.isNull(), "null").otherwise(quoted(c))
    json = F.concat(
        F.lit('{"arguments":'), F.coalesce(F.when(F.col("is_object"), F.expr("to_json(try_parse_json(arguments))")), text(F.col("arguments"))), F.lit(',"id":'), text(F.col("call_id")),
        F.lit(',"name":'), text(F.col("name")), F.lit(',"result":'), text(F.col("result.content")), F.lit("}"),
    )
    out = rows.select("conv_id", "position", "call_id", "name", F.col("result").isNotNull().alias("linked"), found.alias("errors"), json.alias("json"))
    return out.select("conv_id", "position", "call_id", "name", "linked", (F.size("errors") == 0).alias("valid"), F.array_join("errors", ",").alias("errors"), "json")


def as_messages(conversations: DataFrame) -> DataFrame:
    """Conversations as messages with tool calls: each user turn is a call of answer, each assistant turn behind one its result.

    A call refers to the user turn before it, if there is one. Where the digest of its id begins with 0 to 3 and a user turn follows, it
    refers to that one instead, whose call then refers to none unless it refers onwards as well; with 0 that call keeps its own
    reference, so that the two need each other. A system turn is a call of configure.
    """
    # the last user turn before and the first behind: within a chunk of turns, else in other chunks, so that one long conversation is no single task
    asked, chunk = F.when(F.col("role") == "user", F.col("turn")), F.floor(F.col("turn") / CALLS_PER_CHUNK)
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), "role", "text").withColumns({"_conv": F.coalesce(F.col("conv_id").cast("long"), F.lit(NO_CONV)), "_chunk": F.coalesce(chunk, F.lit(NO_CONV))})
    ends = rows.groupBy("_conv", "_chunk").agg(F.max(asked).alias("last"), F.min(asked).alias("first"))
    chunks, turns = W.partitionBy("_conv"), W.partitionBy("_conv", "_chunk")
    ends = ends.withColumns({
        "earlier": F.max("last").over(chunks.orderBy("_chunk").rowsBetween(W.unboundedPreceding, -1)),
        "later": F.min("first").over(chunks.orderBy(F.desc("_chunk")).rowsBetween(W.unboundedPreceding, -1)),
    }).where("earlier is not null or later is not null").select("_conv", "_chunk", "earlier", "later")
    near = {"_before": F.max(asked).over(turns.orderBy("turn").rangeBetween(W.unboundedPreceding, -1)), "_behind": F.min(asked).over(turns.orderBy(F.desc("turn")).rangeBetween(W.unboundedPreceding, -1))}
    # dealt by plain columns, so that the window's rows are joined where they are
    rows = rows.withColumns(near).join(ends, ["_conv", "_chunk"], "left")
    rows = rows.select("conv_id", "turn", "role", "text", F.coalesce("_before", "earlier").alias("before"), F.coalesce("_behind", "later").alias("behind"))
    name = lambda turn: F.concat(F.lit("c"), F.col("conv_id"), F.lit("-"), turn)
    digit = lambda turn: F.substring(F.md5(name(turn)), 1, 1)
    onwards = lambda turn: F.coalesce(digit(turn) <= "3", F.lit(False))
    after = F.when(onwards(F.col("turn")) & F.col("behind").isNotNull(), F.col("behind")).when(~onwards(F.col("before")) | (digit(F.col("before")) == "0"), F.col("before"))
    ask = F.to_json(F.struct(F.col("text").alias("prompt"), F.concat(F.lit("$"), name(after)).alias("after"), F.col("turn").alias("turn")))
    call = lambda tool, arguments: F.to_json(F.struct(F.array(F.struct(name(F.col("turn")).alias("id"), F.lit(tool).alias("name"), arguments.alias("arguments"))).alias("tool_calls")))
    result = F.to_json(F.struct(name(F.col("before")).alias("tool_call_id"), F.col("text").alias("content")))
    text = F.when(F.col("role") == "user", call("answer", ask)).when(F.col("role") == "system", call("configure", F.to_json(F.struct(F.col("text").alias("instruction"))))).otherwise(result)
    return rows.select("conv_id", "turn", F.when(F.col("role").isin("user", "system"), "assistant").otherwise("tool").alias("role"), text.alias("text"))
