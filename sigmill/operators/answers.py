"""Validation of model answers held in a table. Row-local native expressions throughout.

An answer is text a model returned. Nothing here calls a model; answers, completions and
frequency reports are inputs.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.functions import text as tx
from sigmill.functions.expr import let, with_once
from sigmill.schemas import first_violation

# Fixed values.
PAIN_FIELDS = ("body", "audience", "quote")
MAX_PAINS = 3
MIN_PHRASES, MAX_PHRASES, MAX_PHRASE_CHARS = 3, 5, 120
EXTRACT_COUNTERS = ("valid", "hallucinated", "schema_invalid", "invalid_json", "degraded_parse", "extra_fields")

_ANSWER_ENTRY = (
    "struct<pos:int,ok:boolean,extra:boolean,grounded:boolean,body:string,audience:string,quote:string>"
)


def _kind(value: Column) -> Column:
    return F.schema_of_variant(value)


def _is_object(value: Column) -> Column:
    return F.coalesce(_kind(value).startswith("OBJECT"), F.lit(False))


def _field(value: Column, path: str, kind: str = "variant") -> Column:
    return F.try_variant_get(value, path, kind)


def _string_field(value: Column, path: str) -> Column:
    """The field if it is a JSON string, else NULL (numbers are not turned into text)."""
    return F.when(_kind(_field(value, path)) == "STRING", _field(value, path, "string"))


def _int_field(value: Column, path: str) -> Column:
    """The field if it is a JSON integer, else NULL (a boolean is not a number)."""
    return F.when(_kind(_field(value, path)) == "BIGINT", _field(value, path, "bigint"))


def _array_field(value: Column, path: str) -> Column:
    return F.when(_kind(_field(value, path)).startswith("ARRAY"), _field(value, path, "array<variant>"))


def validate_extract(
    answers: DataFrame, answer_col: str = "answer", text_col: str = "text", max_pains: int = MAX_PAINS
) -> DataFrame:
    """Judge extract answers against their source text.

    Adds ``parsed`` (the answer holds a pains list), ``entries`` (every judged entry with its
    verdict) and the counters. Entries are judged in order until ``max_pains`` valid ones are in;
    later ones are not counted at all.
    """

    def pains_list(body: Column) -> Column:
        direct = tx.strict_json(body)
        # Prose inside the fence: fall back to the span between the outer braces.
        salvaged = F.when(tx.is_fenced(answer_col), tx.strict_json(tx.braces_slice(body)))
        return let(
            F.coalesce(direct, salvaged), lambda json: F.when(_is_object(json), _array_field(json, "$.pains"))
        )

    staged = with_once(answers, "_pains", let(tx.unfence(answer_col), pains_list))

    def judged(entry: Column, pos: Column) -> Column:
        is_object = _is_object(entry)
        values = {name: _string_field(entry, f"$.{name}") for name in PAIN_FIELDS}
        shaped = reduce(lambda a, b: a & b, [F.coalesce(tx.has_text(v), F.lit(False)) for v in values.values()])
        keys = F.map_keys(entry.cast("map<string,variant>"))
        extra = F.size(F.array_except(keys, F.array(*[F.lit(f) for f in PAIN_FIELDS]))) > 0
        return F.struct(
            pos.cast("int").alias("pos"),
            (is_object & shaped).alias("ok"),
            F.when(is_object, extra).otherwise(F.lit(False)).alias("extra"),
            F.coalesce(F.contains(F.col(text_col), values["quote"]), F.lit(False)).alias("grounded"),
            *[v.alias(name) for name, v in values.items()],
        )

    staged = staged.withColumn("_all", F.transform("_pains", judged))
    valid_at = F.transform(F.filter("_all", lambda e: e["ok"] & e["grounded"]), lambda e: e["pos"])
    # The cap-th valid entry is the last one looked at.
    staged = staged.withColumn("_stop", F.try_element_at(valid_at, F.lit(max_pains)))
    staged = staged.withColumn(
        "entries",
        F.coalesce(
            F.filter("_all", lambda e: F.col("_stop").isNull() | (e["pos"] <= F.col("_stop"))),
            F.array().cast(f"array<{_ANSWER_ENTRY}>"),
        ),
    )

    def count(test) -> Column:  # noqa: ANN001
        return F.size(F.filter("entries", test)).cast("bigint")

    parsed = F.col("_pains").isNotNull()
    return (
        staged.withColumn("parsed", parsed)
        .withColumn("valid", count(lambda e: e["ok"] & e["grounded"]))
        .withColumn("hallucinated", count(lambda e: e["ok"] & ~e["grounded"]))
        .withColumn("schema_invalid", count(lambda e: ~e["ok"]))
        .withColumn("invalid_json", (~F.col("parsed")).cast("bigint"))
        .withColumn("degraded_parse", (F.col("parsed") & tx.is_fenced(answer_col)).cast("bigint"))
        .withColumn("extra_fields", count(lambda e: e["ok"] & e["extra"]))
        .drop("_pains", "_all", "_stop")
    )


def _exploded(validated: DataFrame, post_id: str, entries: Column) -> DataFrame:
    # The outer form: a plain explode infers a non-empty filter and judges every answer twice.
    rows = validated.select(F.col(post_id).alias("raw_post_id"), F.explode_outer(entries).alias("e"))
    return rows.filter("e.pos IS NOT NULL")


def accepted_pains(validated: DataFrame, post_id: str) -> DataFrame:
    """One row per accepted pain: ``raw_post_id, pos, body, audience, quote``."""
    kept = F.filter("entries", lambda e: e["ok"] & e["grounded"])
    return _exploded(validated, post_id, kept).select("raw_post_id", "e.pos", "e.body", "e.audience", "e.quote")


def rejected_pains(validated: DataFrame, post_id: str) -> DataFrame:
    """One row per rejected entry with its reason."""
    bad = F.filter("entries", lambda e: ~(e["ok"] & e["grounded"]))
    return _exploded(validated, post_id, bad).select(
        "raw_post_id",
        "e.pos",
        F.when(~F.col("e.ok"), F.lit("schema_invalid")).otherwise(F.lit("hallucinated")).alias("reason"),
    )


def extract_status(parsed: Column, call_failed: Column) -> Column:
    """New status of an attempted post; NULL leaves it pending after a failed call."""
    return F.when(~call_failed, F.when(parsed, F.lit("extracted")).otherwise(F.lit("failed")))


def fold_counters(validated: DataFrame) -> DataFrame:
    return validated.agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in EXTRACT_COUNTERS])


def parse_score(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Shape check of score answers: adds ``score``, ``rationale_md``, ``quotes`` and ``reason``.

    All or nothing; ``reason`` is the first rule broken. Grounding is checked by ``ground_scores``.
    """

    def verdict(json: Column) -> Column:
        kind = _kind(_field(json, "$.score"))
        number = F.when(
            (kind == "BIGINT") | kind.startswith("DECIMAL") | (kind == "DOUBLE"), _field(json, "$.score", "double")
        )
        rationale, quotes = _string_field(json, "$.rationale_md"), _array_field(json, "$.quotes")
        rules = {
            "invalid_json": json.isNotNull(),
            "not_an_object": _is_object(json),
            "score_not_a_number": number.isNotNull(),
            "score_out_of_range": number.between(0, 100),
            "empty_rationale": tx.has_text(rationale),
            "no_quotes": F.size(quotes) > 0,
            "quote_not_a_string": F.forall(quotes, lambda q: _kind(q) == "STRING"),
        }
        return F.struct(
            first_violation(rules).alias("reason"),
            number.alias("score"),
            rationale.alias("rationale_md"),
            F.transform(quotes, lambda q: F.try_variant_get(q, "$", "string")).alias("quotes"),
        )

    judged = with_once(answers, "_v", let(tx.strict_json(answer_col), verdict))
    return _unless_rejected(judged.withColumn("reason", F.col("_v.reason")), "_v", ("score", "rationale_md", "quotes"))


def _unless_rejected(judged: DataFrame, verdict: str, names: tuple[str, ...]) -> DataFrame:
    """The verdict's values as columns, NULL on a rejected answer."""
    ok = F.col("reason").isNull()
    return judged.withColumns({n: F.when(ok, F.col(f"{verdict}.{n}")) for n in names}).drop(verdict)


def ground_scores(parsed: DataFrame, bodies: DataFrame, key: str = "cluster_id") -> DataFrame:
    """Reject scores with a quote that occurs in no body of their cluster.

    ``bodies`` holds ``(key, body)`` and is never gathered per cluster: each body reports which
    quotes it holds, and the hits are deduplicated on the map side before they are counted.
    """
    # A rejected answer has no quotes, so it finds nothing.
    wanted = parsed.select(key, F.array_distinct("quotes").alias("_quotes"))
    hits = (
        bodies.select(key, "body")
        .join(wanted, key)
        .select(key, F.explode(F.filter("_quotes", lambda q: F.contains(F.col("body"), q))).alias("_quote"))
        .distinct()
        .groupBy(key)
        .agg(F.count(F.lit(1)).alias("_found"))
    )
    grounded = F.coalesce("_found", F.lit(0)) == F.size(F.array_distinct("quotes"))
    bad = F.col("reason").isNull() & ~grounded
    out = parsed.join(hits, key, "left").withColumn(
        "reason", F.when(bad, F.lit("quote_not_grounded")).otherwise(F.col("reason"))
    )
    ok = F.col("reason").isNull()
    return out.withColumns({n: F.when(ok, F.col(n)) for n in ("score", "rationale_md", "quotes")}).drop("_found")


def stored_score(score: Column) -> Column:
    """Rubric scale 0-100 to stored scale 0-10 with two decimals."""
    return F.bround(score.cast("decimal(20,10)") / 10, 2).cast("decimal(5,2)")


def parse_phrases(answers: DataFrame, answer_col: str = "answer") -> DataFrame:
    """Shape check of phrase answers: adds ``phrases`` (distinct, order kept) and ``reason``.

    Three to five non-blank strings, counted before dedup, each at most 120 characters.
    """

    def verdict(json: Column) -> Column:
        return let(F.when(_is_object(json), _array_field(json, "$.phrases")), lambda raw: judged(json, raw))

    def judged(json: Column, raw: Column) -> Column:
        texts = F.transform(raw, lambda p: F.when(_kind(p) == "STRING", tx.strip(F.try_variant_get(p, "$", "string"))))
        rules = {
            "invalid_json": json.isNotNull(),
            "not_an_object": _is_object(json),
            "no_phrases": F.size(raw) > 0,
            "blank_or_not_a_string": F.forall(texts, lambda p: F.coalesce(p != "", F.lit(False))),
            "wrong_count": F.size(raw).between(MIN_PHRASES, MAX_PHRASES),
            "too_long": F.forall(texts, lambda p: F.length(p) <= MAX_PHRASE_CHARS),
        }
        return F.struct(first_violation(rules).alias("reason"), F.array_distinct(texts).alias("phrases"))

    out = with_once(answers, "_v", let(tx.strict_json(answer_col), verdict))
    return _unless_rejected(out.withColumn("reason", F.col("_v.reason")), "_v", ("phrases",))


def parse_completion(raw: DataFrame, body_col: str, default_model: Column) -> DataFrame:
    """Completion JSON to ``answer, prompt_tokens, completion_tokens, model, call_failed``."""

    def read(json: Column) -> Column:
        found = _is_object(json)
        content = F.coalesce(_string_field(json, "$.choices[0].message.content"), F.lit(""))
        # A non-string model name is shown as its JSON text.
        model = F.coalesce(_string_field(json, "$.model"), F.to_json(_field(json, "$.model")))
        zero = F.lit(0).cast("bigint")
        return F.struct(
            (~found).alias("call_failed"),
            F.when(found, content).alias("answer"),
            F.coalesce(_int_field(json, "$.usage.prompt_tokens"), zero).alias("prompt_tokens"),
            F.coalesce(_int_field(json, "$.usage.completion_tokens"), zero).alias("completion_tokens"),
            model.alias("model"),
        )

    parts = ("call_failed", "answer", "prompt_tokens", "completion_tokens")
    return (
        with_once(raw, "_v", let(tx.strict_json(body_col), read))
        .withColumns({n: F.col(f"_v.{n}") for n in parts} | {"model": F.coalesce(F.col("_v.model"), default_model)})
        .drop("_v")
    )


def parse_frequency(raw: DataFrame, body_col: str) -> DataFrame:
    """Frequency report JSON to ``frequency``; NULL when there is no usable total."""
    total = let(tx.strict_json(body_col), lambda json: _int_field(json, "$.results[0].total"))
    return raw.withColumn("frequency", let(total, lambda n: F.when(n >= 0, n)))


def token_cost(prompt_tokens: Column, completion_tokens: Column, price_per_mtok: Column) -> Column:
    """Cost in account currency; no price or no tokens cost nothing."""
    tokens = (prompt_tokens + completion_tokens).cast("decimal(18,0)")
    cost = (tokens * price_per_mtok.cast("decimal(12,4)") / F.lit(1_000_000).cast("decimal(10,0)")).cast(
        "decimal(28,10)"
    )
    return F.coalesce(cost, F.lit(0).cast("decimal(28,10)"))


def micro_units(cost: Column) -> Column:
    """Whole millionths; a half goes away from zero."""
    return F.round(cost * 1_000_000, 0).cast("bigint")
