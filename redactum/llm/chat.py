"""Chat formatting: tool calls linked to their results, ordered, validated and serialised, with DataFrame functions only."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from redactum.llm import common

#: Turns of a conversation ranked in one task.
SPAN = 1024
CALL, RESULT, MESSAGE = 0, 1, 2
#: Items and links of a conversation that one row may hold while it is ordered; larger ones are ordered by joins.
FOLD_ITEMS, FOLD_LINKS = 512, 4096


def _first(rows: DataFrame, name: str) -> DataFrame:
    """The earliest turn of each (conv_id, call_id) and how many there are; at most one row for each key."""
    return rows.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min("turn").alias(f"{name}_turn"), F.count("*").alias(f"n_{name}s"))


def _keyed(rows: DataFrame, other: DataFrame, left: str, right: str) -> DataFrame:
    """Left hash join by identifier; null conversations are one conversation, null identifiers match nothing."""
    r = other.withColumnsRenamed({"conv_id": "_conv", right: "_id"}).hint("shuffle_hash")
    return rows.join(r, rows["conv_id"].eqNullSafe(r["_conv"]) & (rows[left] == r["_id"]), "left").drop("_conv", "_id")


def argument_errors(calls: DataFrame, schemas: DataFrame) -> DataFrame:
    """(item, errors) of calls whose arguments break their schema; errors are sorted 'what:parameter' strings.

    schemas: name, param, type (string, integer, number, boolean, array, object), required, low, high; the bounds hold
    for a number's value or a string's length. An unknown tool or arguments that are no JSON object (null and empty
    ones too) are errors. Calls without errors have no row; an empty table gives none; only the named columns are read.
    """
    known = schemas.groupBy("name").agg(F.count("*").alias("params"))
    base = calls.select("item", "name", F.try_parse_json("arguments").alias("v")).join(known, "name", "left")
    is_object = F.schema_of_variant("v").startswith("OBJECT")
    whole = base.select("item", F.when(F.col("params").isNull(), F.lit("tool:")).when(F.col("v").isNull() | ~is_object, F.lit("json:")).alias("error")).where("error IS NOT NULL")
    good = base.where(F.col("params").isNotNull() & F.col("v").isNotNull() & is_object)
    given = good.lateralJoin(calls.sparkSession.tvf.variant_explode(F.col("v").outer())).select("item", "name", F.col("key").alias("param"), "value")
    kind = F.schema_of_variant("value")
    given = given.select(
        "item", "name", "param",
        F.when(kind == "STRING", "string").when(kind.isin("BIGINT"), "integer").when(kind.startswith("DECIMAL") | kind.isin("DOUBLE", "FLOAT"), "number")
        .when(kind == "BOOLEAN", "boolean").when(kind.startswith("ARRAY"), "array").when(kind.startswith("OBJECT"), "object").otherwise("null").alias("kind"),
        F.when(kind == "STRING", F.length(F.try_variant_get("value", "$", "string")).cast("double")).otherwise(F.try_variant_get("value", "$", "double")).alias("size"),
    )
    s = schemas.select("name", "param", "type", "required", "low", "high")
    both = given.join(s, ["name", "param"], "left")
    fits = (F.col("kind") == F.col("type")) | ((F.col("type") == "number") & (F.col("kind") == "integer"))
    error = F.when(F.col("type").isNull(), "unknown").when(~fits, "type").when(F.col("size") < F.col("low"), "low").when(F.col("size") > F.col("high"), "high")
    wrong = both.select("item", F.concat(error, F.lit(":"), "param").alias("error")).where("error IS NOT NULL")
    needed = good.select("item", "name").join(s.where("required"), "name").select("item", "name", "param")
    missing = needed.join(given.select("item", "param"), ["item", "param"], "left_anti").select("item", F.concat(F.lit("missing:"), "param").alias("error"))
    return whole.unionByName(wrong).unionByName(missing).groupBy("item").agg(F.array_sort(F.collect_set("error")).alias("errors"))


def _positions(items: DataFrame, span: Column, *order: str) -> DataFrame:
    """items with `position` (from 0) of each in its conversation by (span, *order).

    A conversation is ranked span by span, with the counts of earlier spans added, so that a long one is shared among
    tasks.
    """
    items = items.withColumn("span", span)
    spans = items.groupBy("conv_id", "span").agg(F.count("*").alias("n"))
    earlier = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    base = spans.select(F.col("conv_id").alias("_c"), F.col("span").alias("_s"), F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("base"))
    ranked = items.withColumn("rank", F.row_number().over(Window.partitionBy("conv_id", "span").orderBy(*order)) - 1)
    on = ranked["conv_id"].eqNullSafe(base["_c"]) & (ranked["span"] == base["_s"])
    return ranked.join(base, on).withColumn("position", (F.col("base") + F.col("rank")).cast("long")).drop("_c", "_s", "base", "rank", "span")


def topological_order(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, position, cyclic) of items (conv_id, turn, kind, call_id, item). edges (before, after, conv_id): item
    `before` must stand before item `after`.

    One order for all conversations: an item stands at its own turn or, if it must wait for later ones, directly behind
    the latest of them; among those that wait for the same item the longer chain of waiting comes later, then the
    order of turns decides. Items on or behind a cycle are flagged and come last. Where every edge leads to a later
    turn this is the order of turns, which a join proves; only other conversations go through delays().
    """
    items = _positions(items, F.floor(F.coalesce("turn", F.lit(-1)) / SPAN), "turn", "kind", "call_id", "item").select("conv_id", "item", F.col("position").alias("pos"))
    items = common.materialize(items, "turns")
    at = items.select(F.col("item").alias("x"), "pos")
    placed = edges.join(at.withColumnsRenamed({"x": "before", "pos": "p"}), "before").join(at.withColumnsRenamed({"x": "after", "pos": "q"}), "after")
    placed = common.materialize(placed.select("conv_id", "before", "after", "p", "q").distinct(), "placed")
    links = placed.groupBy("conv_id").agg(F.count("*").alias("links"), F.max((F.col("p") >= F.col("q")).cast("int")).alias("early")).where("early = 1")
    sizes = items.groupBy("conv_id").agg(F.count("*").alias("n")).withColumnRenamed("conv_id", "_c")
    bad = common.materialize(links.join(sizes, links["conv_id"].eqNullSafe(sizes["_c"])).select("conv_id", ((F.col("n") <= FOLD_ITEMS) & (F.col("links") <= FOLD_LINKS)).alias("small")), "unordered")
    in_turn = items.select("conv_id", "item", F.col("pos").alias("position"), F.lit(False).alias("cyclic"))
    if bad.isEmpty():
        return in_turn.drop("conv_id")

    def only(rows: DataFrame, which: str, how: str = "left_semi") -> DataFrame:
        b = bad.where(which).select(F.col("conv_id").alias("_c"))
        return rows.join(b, rows["conv_id"].eqNullSafe(b["_c"]), how)

    delayed = fold(only(items, "small"), only(placed, "small"))
    if not bad.where("NOT small").isEmpty():
        waiting = only(items, "NOT small")
        delayed = delayed.unionByName(waiting.join(delays(waiting.select("item", "pos"), only(placed, "NOT small").select("before", "after")), "item"))
    span = F.struct(F.col("cyclic"), F.floor(F.col("key") / SPAN).alias("part"))
    ordered = _positions(delayed, span, "key", "depth", "pos").select("item", "position", "cyclic")
    return only(in_turn, "true", "left_anti").select("item", "position", "cyclic").unionByName(ordered)


def fold(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(conv_id, item, pos, key, depth, cyclic) as delays() has them, for items (conv_id, item, pos) and edges (conv_id,
    p, q) of conversations of bounded size, whose positions count from 0 without gaps.

    A conversation is one row; sweeps over its items place each behind its predecessors until nothing moves. What a
    walk of as many steps as there are items reaches lies on or behind a cycle.
    """
    before = edges.groupBy("conv_id", F.col("q").alias("_q")).agg(F.collect_list("p").alias("before")).withColumnRenamed("conv_id", "_c")
    rows = items.join(before, items["conv_id"].eqNullSafe(before["_c"]) & (items["pos"] == before["_q"]), "left")
    none = F.array().cast("array<bigint>")
    rows = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("pos", "item", F.coalesce("before", none).alias("before")))).alias("x"))
    rows = rows.select("conv_id", "x", F.size("x").alias("n"))
    zero = F.lit(0).cast("long")

    def later(own: Column, other: Column) -> Column:
        place = F.greatest(F.struct(own.key.alias("key"), own.depth.alias("depth")), F.struct(other.key.alias("key"), (other.depth + 1).alias("depth")))
        return F.struct(place.key.alias("key"), place.depth.alias("depth"), F.greatest(own.steps, other.steps + 1).alias("steps"))

    def sweep(state: Column) -> Column:
        return F.transform(F.col("x"), lambda i: F.aggregate(i.before, F.get(state, i.pos.cast("int")), lambda own, u: later(own, F.get(state, u.cast("int")))))

    def once(acc: Column, _: Column) -> Column:
        moved = F.element_at(F.transform(F.array(sweep(acc.state)), lambda new: F.struct(new.alias("state"), (new != acc.state).alias("moved"))), 1)
        return F.when(acc.moved, moved).otherwise(acc)

    start = F.transform(F.col("x"), lambda i: F.struct(i.pos.alias("key"), zero.alias("depth"), zero.alias("steps")))
    end = F.aggregate(F.sequence(F.lit(1), F.col("n")), F.struct(start.alias("state"), F.lit(True).alias("moved")), once)
    placed = rows.select("conv_id", "n", F.explode(F.arrays_zip(F.col("x"), end.state.alias("s"))).alias("i"))
    cyclic = F.col("i.s.steps") >= F.col("n")
    return placed.select("conv_id", F.col("i.x.item").alias("item"), F.col("i.x.pos").alias("pos"), F.when(cyclic, zero).otherwise(F.col("i.s.key")).alias("key"), F.when(cyclic, zero).otherwise(F.col("i.s.depth")).alias("depth"), cyclic.alias("cyclic"))


def delays(items: DataFrame, edges: DataFrame) -> DataFrame:
    """(item, key, depth, cyclic) of items (item, pos): key is the largest pos among the item and all that it must wait
    for, depth the length of the longest chain from there. edges (before, after).

    A round lets every item that is placed too early wait for the latest of its predecessors, its parent from then on;
    then pointers to parents are doubled until they reach an item that waits for none, so that a chain of any length
    is placed in one round of logarithmically many joins. A pointer that never gets there leads into a cycle.
    """
    spark = items.sparkSession
    rounds, jumps = common.Rounds(spark, "placed"), common.Rounds(spark, "pointers")
    edges = common.materialize(edges, "edges")
    none = F.lit(None).cast("long")
    state = rounds.write(items.select("item", F.col("pos").alias("key"), F.lit(0).cast("long").alias("depth"), F.lit(False).alias("cyclic"), none.alias("parent")))
    doublings = max(1, state.count()).bit_length() + 1
    place = lambda: F.struct("cyclic", "key", "depth")
    while True:
        before = state.select(F.col("item").alias("before"), F.struct("cyclic", "key", F.when(F.col("cyclic"), 0).otherwise(F.col("depth") + 1).cast("long").alias("depth")).alias("least"))
        wait = edges.join(before, "before").groupBy(F.col("after").alias("item")).agg(F.max(F.struct("least", "before")).alias("w"))
        early = state.join(wait, "item").where(F.col("w.least") > place()).select("item", F.col("w.before").alias("next"))
        early = common.materialize(early, "early")
        if early.isEmpty():
            return state.drop("parent")
        state = state.join(early, "item", "left").withColumn("parent", F.coalesce("next", "parent")).drop("next")
        pointer = jumps.write(state.select("item", F.coalesce("parent", "item").alias("to"), F.col("parent").isNotNull().cast("long").alias("steps"), F.lit(1).cast("long").alias("more")))
        for _ in range(doublings):
            ahead = pointer.select(F.col("item").alias("to"), F.col("to").alias("further"), F.col("steps").alias("ahead"))
            pointer = jumps.write(pointer.join(ahead, "to").select("item", F.col("further").alias("to"), (F.col("steps") + F.col("ahead")).alias("steps"), F.col("ahead").alias("more")))
            if pointer.where("more > 0").isEmpty():
                break
        root = state.select(F.col("item").alias("to"), F.col("parent").isNotNull().alias("loop"), F.col("cyclic").alias("r_cyclic"), F.col("key").alias("r_key"), F.col("depth").alias("r_depth"))
        reached = pointer.drop("more").join(root, "to").select("item", "loop", "r_cyclic", F.struct("r_key", (F.col("r_depth") + F.col("steps")).alias("r_depth")).alias("r"))
        both = state.join(reached, "item").withColumn("cyclic", F.col("cyclic") | F.col("loop") | F.col("r_cyclic"))
        now = F.greatest(F.struct(F.col("key").alias("r_key"), F.col("depth").alias("r_depth")), F.col("r"))
        zero = F.lit(0).cast("long")
        # an item known to be cyclic waits for nothing more
        state = rounds.write(both.withColumn("now", now).select("item", F.when(F.col("cyclic"), zero).otherwise(F.col("now.r_key")).alias("key"), F.when(F.col("cyclic"), zero).otherwise(F.col("now.r_depth")).alias("depth"), "cyclic", F.when(~F.col("cyclic"), F.col("parent")).alias("parent")))


def link_tool_calls(calls: DataFrame, results: DataFrame, schemas: DataFrame, messages: DataFrame | None = None) -> DataFrame:
    """Calls, results and plain messages of conversations, linked, ordered, validated and serialised.

    calls: conv_id, turn, call_id, name, arguments (JSON), depends_on (call ids whose results the call needs);
    results: conv_id, turn, call_id, content; messages: conv_id, turn, role, content.
    Returns a row for each: conv_id, turn, kind, call_id, position, linked, cyclic, errors, json.

    A result belongs to the earliest call of its identifier in its conversation. linked: the other side exists (null
    for messages). errors of a call: broken schema rules, `duplicate:` for a later call of the same id, `depends:id`
    for an unknown call; of a result: `orphan:`. A call stands before its results and behind the results it needs;
    items on or behind a cycle are flagged and come last. json is canonical: keys sorted, no spaces, arguments that
    are no JSON as a string. Null conv_ids are one conversation, null turns come first, null call ids link to nothing;
    null and empty texts are kept apart and texts of any length are kept whole; repeated rows stay, ties of a turn go
    by kind, id and row; empty tables give no rows; only the named columns are read, whatever else there is.
    """
    c = calls.select("conv_id", "turn", "call_id", "name", "arguments", "depends_on", F.lit(CALL).alias("kind"))
    r = results.select("conv_id", "turn", "call_id", "content", F.lit(RESULT).alias("kind"))
    every = c.unionByName(r, allowMissingColumns=True)
    if messages is not None:
        m = messages.select("conv_id", "turn", "role", "content", F.lit(MESSAGE).alias("kind"))
        every = every.unionByName(m, allowMissingColumns=True)
    else:
        every = every.withColumn("role", F.lit(None).cast("string"))
    every = common.materialize(every.withColumn("item", F.monotonically_increasing_id()), "items")
    c, r = every.where(F.col("kind") == CALL), every.where(F.col("kind") == RESULT)
    first_call, first_result = _first(c, "call"), _first(r, "result")
    lead = c.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min_by("item", F.struct("turn", "item")).alias("owner"))
    linked_calls = _keyed(c, first_result, "call_id", "call_id")
    linked_calls = _keyed(linked_calls, lead, "call_id", "call_id")
    linked_results = _keyed(r, lead, "call_id", "call_id")
    needs = c.select("conv_id", "item", F.explode("depends_on").alias("need")).distinct()
    needed = _keyed(needs, first_call, "need", "call_id")
    unknown = needed.where("n_calls IS NULL").groupBy("item").agg(F.array_sort(F.collect_set(F.concat(F.lit("depends:"), "need"))).alias("unknown"))
    # edges: a call before its results; what a call needs, results and where there are none the call, before it
    to_result = linked_results.where("owner IS NOT NULL").select(F.col("owner").alias("before"), F.col("item").alias("after"), "conv_id")
    last_result = r.where(F.col("call_id").isNotNull()).groupBy("conv_id", "call_id").agg(F.min_by("item", F.struct("turn", "item")).alias("reply"))
    behind = _keyed(_keyed(needs, last_result, "need", "call_id"), lead, "need", "call_id").select(F.coalesce("reply", "owner").alias("before"), F.col("item").alias("after"), "conv_id").where("before IS NOT NULL")
    edges = common.materialize(to_result.unionByName(behind), "links")
    ordered = topological_order(every.select("conv_id", "turn", "kind", "call_id", "item"), edges)

    no = F.array().cast("array<string>")
    errors = argument_errors(c, schemas)
    done_calls = linked_calls.join(errors, "item", "left").join(unknown, "item", "left").select(
        "item", F.coalesce(F.col("n_results") > 0, F.lit(False)).alias("linked"),
        F.concat(F.coalesce("errors", no), F.coalesce("unknown", no), F.when(F.coalesce(F.col("owner") != F.col("item"), F.lit(False)), F.array(F.lit("duplicate:"))).otherwise(no)).alias("errors"),
    )
    done_results = linked_results.select("item", F.col("owner").isNotNull().alias("linked"), F.when(F.col("owner").isNull(), F.array(F.lit("orphan:"))).otherwise(no).alias("errors"))
    state = done_calls.unionByName(done_results)
    out = every.join(ordered, "item").join(state, "item", "left")
    return out.select("conv_id", "turn", "kind", "call_id", "position", "linked", "cyclic", F.coalesce("errors", no).alias("errors"), canonical_json().alias("json"))


def _quoted(value: Column) -> Column:
    """A JSON string, null for null."""
    return F.coalesce(F.regexp_extract(F.to_json(F.struct(value.cast("string").alias("x"))), r"(?s)^\{\"x\":(.*)\}$", 1), F.lit("null"))


def _text(value: Column) -> Column:
    return F.when(value.isNull(), "null").otherwise(_quoted(value))


def _object(**fields: Column) -> Column:
    parts = [F.concat(F.lit(f'"{k}":'), fields[k]) for k in sorted(fields)]
    return F.concat(F.lit("{"), reduce(lambda a, b: F.concat(a, F.lit(","), b), parts), F.lit("}"))


def canonical_json() -> Column:
    arguments = F.coalesce(F.to_json(F.try_parse_json("arguments")), _text(F.col("arguments")))
    call = _object(arguments=arguments, id=_text(F.col("call_id")), name=_text(F.col("name")), type=F.lit('"call"'))
    result = _object(content=_text(F.col("content")), id=_text(F.col("call_id")), type=F.lit('"result"'))
    message = _object(content=_text(F.col("content")), role=_text(F.col("role")), type=F.lit('"message"'))
    return F.when(F.col("kind") == CALL, call).when(F.col("kind") == RESULT, result).otherwise(message)


def asked_before(turns: DataFrame) -> DataFrame:
    """turns with `asked`: the last user turn before each, found within spans of turns and carried over from earlier
    spans, so that a long conversation is shared among tasks."""
    user = F.when(F.col("role") == "user", F.col("turn"))
    t = turns.withColumn("span", F.floor(F.coalesce("turn", F.lit(-1)) / SPAN))
    before = Window.partitionBy("conv_id").orderBy("span").rowsBetween(Window.unboundedPreceding, -1)
    carried = t.groupBy("conv_id", "span").agg(F.max(user).alias("m")).select(F.col("conv_id").alias("_c"), F.col("span").alias("_s"), F.max("m").over(before).alias("carried"))
    within = Window.partitionBy("conv_id", "span").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    near = t.withColumn("near", F.last(user, ignorenulls=True).over(within))
    on = near["conv_id"].eqNullSafe(carried["_c"]) & (near["span"] == carried["_s"])
    return near.join(carried, on).withColumn("asked", F.coalesce("near", "carried")).drop("_c", "_s", "span", "near", "carried")


def conversation_calls(turns: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A conversation read as tool use: each user turn calls `answer`, each assistant turn returns a result for the last
    user turn before it, and a call needs the call before it. Other turns are plain messages.

    So that faulty tool use occurs too, the first hex digit of a text's MD5 changes its turn. Calls: 0 or 1 repeat the
    id of the call before, 2 or 3 need the next call in place of the one before (two such neighbours may wait for each
    other), 4 gives a number as a string, 5 names an unknown tool, 6 leaves out a required argument, 7 also needs a call
    that does not exist. Results: 0 or 1 name a call that does not exist.
    """
    t = common.materialize(asked_before(turns.select("conv_id", "turn", "role", "text")), "asked")
    user, assistant = F.coalesce(F.col("role") == "user", F.lit(False)), F.coalesce(F.col("role") == "assistant", F.lit(False))
    follows = t.where(user & F.col("asked").isNotNull()).groupBy("conv_id", "asked").agg(F.min("turn").alias("next")).withColumnsRenamed({"conv_id": "_c", "asked": "_t"})
    digit = F.coalesce(F.substring(F.md5(F.col("text").cast("binary")), 1, 1), F.lit(""))
    conv = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    name = lambda turn, word="call": F.concat(F.lit(f"{word}_"), conv, F.lit("_"), turn.cast("string"))
    chars, question = F.coalesce(F.length("text").cast("string"), F.lit("null")), _text(F.col("text"))
    quoted = F.concat(F.lit('"'), chars, F.lit('"'))
    arguments = F.when(digit == "4", _object(chars=quoted, question=question)).when(digit == "6", _object(chars=chars)).otherwise(_object(chars=chars, question=question))
    calls = t.where(user)
    calls = calls.join(follows, calls["conv_id"].eqNullSafe(follows["_c"]) & (calls["turn"] == follows["_t"]), "left").drop("_c", "_t")
    needs = F.when(digit.isin("2", "3"), F.array(name(F.col("next")))).otherwise(F.array(name(F.col("asked")), F.when(digit == "7", name(F.col("turn"), "gone"))))
    call_id = F.when(digit.isin("0", "1") & F.col("asked").isNotNull(), name(F.col("asked"))).otherwise(name(F.col("turn")))
    tool = F.when(digit == "5", "reply").otherwise("answer")
    calls = calls.select("conv_id", "turn", call_id.alias("call_id"), tool.alias("name"), arguments.alias("arguments"), F.array_compact(needs).alias("depends_on"))
    returns = F.when(digit.isin("0", "1"), name(F.col("turn"), "lost")).otherwise(name(F.col("asked")))
    results = t.where(assistant).select("conv_id", "turn", returns.alias("call_id"), F.col("text").alias("content"))
    messages = t.where(~user & ~assistant).select("conv_id", "turn", "role", F.col("text").alias("content"))
    return calls, results, messages


def op2_chat_links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations as linked, ordered and validated tool use; see conversation_calls() for the reading and
    link_tool_calls() for hostile rows."""
    turns = common.read_table(spark, sf_dir, "conversations")
    schemas = spark.sql("SELECT * FROM VALUES ('answer', 'question', 'string', true, 20D, 400D), ('answer', 'chars', 'integer', true, 1D, 1000000D) AS t(name, param, type, required, low, high)")
    calls, results, messages = conversation_calls(turns)
    out = link_tool_calls(calls, results, schemas, messages)
    return out.select("conv_id", "turn", F.element_at(F.array(F.lit("call"), F.lit("result"), F.lit("message")), F.col("kind") + 1).alias("kind"), "call_id", "position", F.coalesce("linked", F.lit(False)).alias("linked"), "cyclic", F.array_join("errors", ",").alias("errors"), "json")


OP2_SQL = r"""
WITH RECURSIVE t AS (
  SELECT conv_id, turn, role, text, substr(md5(text), 1, 1) AS d,
         last_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS asked,
         first_value(CASE WHEN role = 'user' THEN turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS next
  FROM conversations),
i AS (
  SELECT conv_id, turn, role, text, d, CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind,
         CASE WHEN role = 'user' AND d IN ('0', '1') AND asked IS NOT NULL THEN 'call_' || conv_id || '_' || asked
              WHEN role = 'user' THEN 'call_' || conv_id || '_' || turn
              WHEN role = 'assistant' AND d IN ('0', '1') THEN 'lost_' || conv_id || '_' || turn
              WHEN role = 'assistant' THEN 'call_' || conv_id || '_' || asked END AS call_id,
         CASE WHEN role <> 'user' THEN [] WHEN d IN ('2', '3') THEN ['call_' || conv_id || '_' || next]
              ELSE ['call_' || conv_id || '_' || asked, CASE WHEN d = '7' THEN 'gone_' || conv_id || '_' || turn END] END AS needs,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS pos
  FROM t),
owner AS (SELECT conv_id, call_id, min(pos) AS pos FROM i WHERE kind = 'call' GROUP BY ALL),
reply AS (SELECT conv_id, call_id, min(pos) AS pos FROM i WHERE kind = 'result' AND call_id IS NOT NULL GROUP BY ALL),
need AS (SELECT conv_id, pos, unnest(needs) AS id FROM i),
known AS (SELECT n.conv_id, n.pos, n.id, o.pos AS owner, coalesce(r.pos, o.pos) AS before
          FROM need n LEFT JOIN owner o ON n.conv_id = o.conv_id AND n.id = o.call_id LEFT JOIN reply r ON n.conv_id = r.conv_id AND n.id = r.call_id WHERE n.id IS NOT NULL),
edge AS (SELECT i.conv_id, o.pos AS before, i.pos AS after FROM i JOIN owner o ON i.conv_id = o.conv_id AND i.call_id = o.call_id WHERE i.kind = 'result'
         UNION SELECT conv_id, before, pos FROM known WHERE before IS NOT NULL),
n AS (SELECT conv_id, count(*) AS n FROM i GROUP BY conv_id),
path AS (SELECT conv_id, pos, pos AS key, 0 AS depth, 0 AS steps FROM i
         UNION SELECT e.conv_id, e.after, greatest(e.after, p.key), CASE WHEN e.after > p.key THEN 0 ELSE p.depth + 1 END, p.steps + 1
         FROM path p JOIN edge e ON p.conv_id = e.conv_id AND p.pos = e.before JOIN n ON n.conv_id = p.conv_id WHERE p.steps <= n.n),
placed AS (SELECT path.conv_id, pos, max(steps) > max(n) AS cyclic, max(row(key, depth)) AS place FROM path JOIN n ON n.conv_id = path.conv_id GROUP BY path.conv_id, pos),
ranked AS (SELECT conv_id, pos, cyclic, row_number() OVER (PARTITION BY conv_id ORDER BY cyclic, CASE WHEN NOT cyclic THEN place END, pos) - 1 AS position FROM placed),
bad AS (SELECT conv_id, pos, list_sort(list('depends:' || id)) AS unknown FROM (SELECT DISTINCT * FROM known) WHERE owner IS NULL GROUP BY ALL),
x AS (SELECT i.*, ranked.position, ranked.cyclic, owner.pos AS owner, reply.pos AS reply, coalesce(unknown, []) AS unknown, length(text) AS chars
      FROM i JOIN ranked ON i.conv_id = ranked.conv_id AND i.pos = ranked.pos LEFT JOIN bad ON i.conv_id = bad.conv_id AND i.pos = bad.pos
      LEFT JOIN owner ON i.conv_id = owner.conv_id AND i.call_id = owner.call_id LEFT JOIN reply ON i.conv_id = reply.conv_id AND i.call_id = reply.call_id)
SELECT conv_id, turn, kind, call_id, CAST(position AS BIGINT) AS position,
       CASE kind WHEN 'call' THEN reply IS NOT NULL WHEN 'result' THEN owner IS NOT NULL ELSE false END AS linked, cyclic,
       array_to_string(CASE kind WHEN 'message' THEN [] WHEN 'result' THEN CASE WHEN owner IS NULL THEN ['orphan:'] ELSE [] END ELSE
         CASE WHEN d = '5' THEN ['tool:'] ELSE list_filter([
             CASE WHEN d <> '6' AND chars > 400 THEN 'high:question' END, CASE WHEN d <> '4' AND chars < 1 THEN 'low:chars' END,
             CASE WHEN d <> '6' AND chars < 20 THEN 'low:question' END, CASE WHEN d = '6' THEN 'missing:question' END, CASE WHEN d = '4' THEN 'type:chars' END], lambda e: e IS NOT NULL) END
         || unknown || CASE WHEN owner <> pos THEN ['duplicate:'] ELSE [] END END, ',') AS errors,
       CASE kind WHEN 'call' THEN '{"arguments":{"chars":' || CASE WHEN d = '4' THEN '"' || chars || '"' ELSE CAST(chars AS VARCHAR) END || CASE WHEN d = '6' THEN '' ELSE ',"question":' || to_json(text) END
                                   || '},"id":' || to_json(call_id) || ',"name":"' || CASE WHEN d = '5' THEN 'reply' ELSE 'answer' END || '","type":"call"}'
                 WHEN 'result' THEN '{"content":' || to_json(text) || ',"id":' || coalesce(CAST(to_json(call_id) AS VARCHAR), 'null') || ',"type":"result"}'
                 ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || ',"type":"message"}' END AS json
FROM x
"""
