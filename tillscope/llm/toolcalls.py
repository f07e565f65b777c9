"""Chat formatting: calls of tools linked with their results, in order, as canonical JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import settled

LINKED, NO_RESULT, NO_CALL, FURTHER = "linked", "no_result", "no_call", "further_result"
#: JSON types of an argument, by the prefix of the type that Spark finds in the parsed JSON.
TYPES = {
    "string": ("STRING",),
    "integer": ("BIGINT",),
    "number": ("BIGINT", "DOUBLE", "FLOAT", "DECIMAL"),
    "boolean": ("BOOLEAN",),
    "array": ("ARRAY",),
    "object": ("OBJECT",),
}


def order(calls: DataFrame) -> DataFrame:
    """(call_id, depth, several): how many calls come before each, through their parents.

    A parent that isn't among the calls counts as none. The depth of a call on a cycle, or behind
    one, is null. Where repeated calls of one id name different parents, several is true and the
    least one is followed. Parents are followed by doubling: each round looks twice as far, so a chain of n
    calls takes log2(n) rounds.
    """
    ids = settled(
        calls.where("call_id is not null")
        .groupBy("call_id")
        .agg(
            F.min("parent_id").alias("parent"),
            F.coalesce(F.min("parent_id") < F.max("parent_id"), F.lit(False)).alias("several"),
        )
    )
    known = ids.select(F.col("call_id").alias("parent"), F.lit(True).alias("there"))
    steps = (
        ids.join(known, "parent", "left")
        .select("call_id", "several", F.when(F.col("there"), F.col("parent")).alias("ahead"))
        .withColumn("depth", F.when(F.col("ahead").isNull(), 0).otherwise(1).cast("bigint"))
    )
    steps = settled(steps)
    rounds, total = 0, steps.count()
    while (1 << rounds) <= total and not steps.where("ahead is not null").isEmpty():
        next_ = steps.select(
            F.col("call_id").alias("ahead"), F.col("ahead").alias("beyond"), F.col("depth").alias("more")
        )
        steps = settled(
            steps.join(next_, "ahead", "left").select(
                "call_id",
                "several",
                F.col("beyond").alias("ahead"),
                (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"),
            )
        )
        rounds += 1
    depth = F.when(F.col("ahead").isNull(), F.col("depth")).alias("depth")
    return steps.select("call_id", depth, "several")


def problems(tool: Column, arguments: Column, parsed: Column, schemas: dict[str, dict]) -> Column:
    """What is wrong with the arguments, as an array of strings; empty if nothing.

    `schemas`: for each tool its arguments by name, each a dict with `type` (see TYPES), and
    optionally `required` (true by default), `least` (of a number, or a string's length).
    """
    known = tool.isin(*schemas) if schemas else F.lit(False)
    found: list[Column] = [
        F.when(~F.coalesce(known, F.lit(False)), F.lit("unknown tool")),
        F.when(parsed.isNull(), F.lit("not JSON")),
    ]
    for name, schema in schemas.items():
        names = F.json_object_keys(arguments)
        extra = F.array_except(names, F.array(*[F.lit(k) for k in schema]))
        own = tool == name
        found.append(F.when(own & F.get(extra, 0).isNotNull(), F.concat(F.lit("unexpected "), F.get(extra, 0))))
        for key, rule in schema.items():
            path = f"$['{key}']"
            value = F.try_variant_get(parsed, path, "variant")
            kind = F.schema_of_variant(value)
            fits = F.lit(False)
            for prefix in TYPES[rule["type"]]:
                fits = fits | kind.startswith(prefix)
            missing = value.isNull() | F.coalesce(F.is_variant_null(value), F.lit(True))
            if rule.get("required", True):
                found.append(F.when(own & parsed.isNotNull() & missing, F.lit(f"missing {key}")))
            found.append(F.when(own & ~missing & ~fits, F.lit(f"{key} is no {rule['type']}")))
            if "least" in rule:
                size = (
                    F.length(F.try_variant_get(parsed, path, "string"))
                    if rule["type"] == "string"
                    else F.try_variant_get(parsed, path, "double")
                )
                found.append(F.when(own & (size < rule["least"]), F.lit(f"{key} is too small")))
    return F.array_compact(F.array(*found))


def link(calls: DataFrame, results: DataFrame, schemas: dict[str, dict]) -> DataFrame:
    """Calls with their results: (call_id, name, state, n_results, depth, errors, valid, json).

    `calls` has call_id, parent_id, name (strings) and arguments (JSON text); `results` has call_id
    and content (text). Both are joined by call_id: a call without result is `no_result`, a result
    without call `no_call`. Of several results of a call the least text stands in the call's row and
    n_results counts them all; each other text has a row of its own, `further_result` (`no_call`
    without a call), with the number of results that have it, so no text is lost. A null call_id
    links with nothing. Repeated calls each get their row and their result; other columns are not
    looked at; empty tables give their side's rows only.

    depth orders the calls (see `order`). errors and valid come from the schemas, and a call with
    several parents has an error; results that stand alone are not valid. json is canonical: keys in order, no space, numbers and strings in one form;
    arguments that are not JSON stand in it as text.
    """
    calls = calls.select("call_id", "parent_id", "name", "arguments")
    texts = settled(
        results.where("call_id is not null")
        .groupBy("call_id", "content")
        .agg(F.count("*").alias("n_results"))
    )
    content = settled(
        texts.groupBy("call_id").agg(
            F.min("content").alias("content"), F.sum("n_results").alias("n_results")
        )
    )
    depths = settled(order(calls))
    least = content.select("call_id", F.col("content").alias("least"))
    known = depths.select("call_id", "depth", F.lit(True).alias("is_further"))
    further = (
        texts.join(least, "call_id").where("content > least").drop("least").join(known, "call_id", "left")
    )
    nameless = results.where("call_id is null").select(
        "call_id", "content", F.lit(1).cast("bigint").alias("n_results")
    )
    # Not one full join: Spark can't split a call_id that many calls bear on the side of the calls
    # there. depths and content have one row for each call_id.
    whole = (
        calls.withColumn("is_call", F.lit(True))
        .join(depths.join(content, "call_id", "left"), "call_id", "left")
        .unionByName(content.join(depths, "call_id", "left_anti"), allowMissingColumns=True)
        .unionByName(nameless, allowMissingColumns=True)
        .unionByName(further, allowMissingColumns=True)
    )
    is_call = F.coalesce("is_call", F.lit(False))
    state = F.when(F.col("is_further"), FURTHER).when(~is_call, NO_CALL).when(F.col("n_results").isNull(), NO_RESULT).otherwise(LINKED)
    whole = whole.withColumn("parsed", F.try_parse_json("arguments"))
    errors = problems(F.col("name"), F.col("arguments"), F.col("parsed"), schemas)
    several = F.when(F.col("several"), F.array(F.lit("several parents")))
    errors = F.concat(errors, F.coalesce(several, F.array().cast("array<string>")))
    alone = F.when(F.col("is_further"), "further result").otherwise("no call")
    errors = F.when(is_call, errors).otherwise(F.array(alone))
    whole = whole.select("*", state.alias("state"), errors.alias("errors"))

    def text(c: str) -> Column:
        # An object of one key, to have the string escaped, without its frame.
        framed = F.to_json(F.struct(F.col(c).alias("a")))
        return F.when(F.col(c).isNull(), "null").otherwise(F.substr(framed, F.lit(6), F.length(framed) - 6))

    json = F.concat(
        F.lit('{"arguments":'),
        F.coalesce(F.to_json("parsed"), text("arguments")),
        F.lit(',"id":'),
        text("call_id"),
        F.lit(',"name":'),
        text("name"),
        F.lit(',"result":'),
        text("content"),
        F.lit("}"),
    )
    return whole.select(
        "call_id",
        "name",
        "state",
        F.coalesce("n_results", F.lit(0)).cast("bigint").alias("n_results"),
        "depth",
        "errors",
        (is_call & (F.size("errors") == 0)).alias("valid"),
        json.alias("json"),
    )


def calls_of(turns: DataFrame, tool: str, conversation: str = "conv_id") -> tuple[DataFrame, DataFrame]:
    """(calls, results) of plain conversations: each user turn asks the tool, the next answers.

    A user turn's call is named after conversation and turn; its parent is the user turn two
    before. An assistant turn is the result of the turn before it. Turns of other roles are neither.
    """
    number = F.col("turn").cast("bigint")

    def name(at: Column) -> Column:
        return F.concat(F.col(conversation).cast("string"), F.lit("-"), at.cast("string"))

    arguments = F.to_json(
        F.struct(F.col("text").alias("prompt"), number.alias("turn")), {"ignoreNullFields": "false"}
    )
    calls = turns.where("role = 'user'").select(
        name(number).alias("call_id"),
        name(number - 2).alias("parent_id"),
        F.lit(tool).alias("name"),
        arguments.alias("arguments"),
    )
    results = turns.where("role = 'assistant'").select(
        name(number - 1).alias("call_id"), F.col("text").alias("content")
    )
    return calls, results
