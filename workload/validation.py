"""Model-answer validation queries. Answers are synthesised from the whole documents table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators import answers as an
from sigmill.operators import prompts
from sigmill.plans import reports, stages
from workload.base import Tables, query, spread_words, spread_words_sql, stamp


def _json(**fields: Column) -> Column:
    return F.to_json(F.struct(*[v.alias(k) for k, v in fields.items()]))


def _pain(quote: Column, body: str = "b", **extra: Column) -> Column:
    return _json(body=F.lit(body), audience=F.lit("a"), quote=quote, **extra)


def _list(*items: Column) -> Column:
    return F.concat(F.lit('{"pains":['), F.concat_ws(",", *items), F.lit("]}"))


def _extract_answers(t: Tables) -> DataFrame:
    """One answer per document, in ten shapes by id."""
    quote = F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(40))
    last = F.right("text", F.lit(30))
    wrong = F.concat(quote, F.lit("¤"))
    shapes = [
        _list(_pain(quote, confidence=F.lit(1))),
        F.concat(F.lit("```json\n"), _list(_pain(quote)), F.lit("\n```")),
        _list(_pain(quote, body=" \t")),
        _list(_pain(wrong), _pain(last)),
        _list(F.lit("42"), _pain(quote)),
        F.lit("[1,2,3]"),
        _list(_pain(quote), _pain(wrong), _pain(quote), _pain(last), _pain(wrong), _pain(quote)),
        F.lit("Sorry, no."),
        F.concat(F.lit("```\nHere it is: "), _list(_pain(quote)), F.lit(" done\n```")),
        _list(),
    ]
    answer = shapes[0]
    for i, shape in enumerate(shapes[1:], 1):
        answer = F.when(F.col("doc_id") % 10 == i, shape).otherwise(answer)
    return t.documents.select("doc_id", "text", answer.alias("answer"))


_ANSWERS = """
    SELECT doc_id, text, CASE doc_id % 10
        WHEN 0 THEN CAST(to_json({'pains': [{'body': 'b', 'audience': 'a', 'quote': q, 'confidence': 1}]}) AS VARCHAR)
        WHEN 1 THEN '```json' || chr(10) || CAST(to_json({'pains': [{'body': 'b', 'audience': 'a', 'quote': q}]}) AS VARCHAR) || chr(10) || '```'
        WHEN 2 THEN CAST(to_json({'pains': [{'body': ' ' || chr(9), 'audience': 'a', 'quote': q}]}) AS VARCHAR)
        WHEN 3 THEN CAST(to_json({'pains': [{'body': 'b', 'audience': 'a', 'quote': q || '¤'}, {'body': 'b', 'audience': 'a', 'quote': r}]}) AS VARCHAR)
        WHEN 4 THEN '{"pains":[42,' || CAST(to_json({'body': 'b', 'audience': 'a', 'quote': q}) AS VARCHAR) || ']}'
        WHEN 5 THEN '[1,2,3]'
        WHEN 6 THEN CAST(to_json({'pains': [{'body': 'b', 'audience': 'a', 'quote': x} for x in [q, q || '¤', q, r, q || '¤', q]]}) AS VARCHAR)
        WHEN 7 THEN 'Sorry, no.'
        WHEN 8 THEN '```' || chr(10) || 'Here it is: ' || CAST(to_json({'pains': [{'body': 'b', 'audience': 'a', 'quote': q}]}) AS VARCHAR) || ' done' || chr(10) || '```'
        ELSE '{"pains":[]}' END AS answer
    FROM (SELECT doc_id, text, substr(text, length(text) // 2 + 1, 40) AS q, right(text, 30) AS r FROM documents)"""
# Parsing in plain SQL: fence, JSON, entries in order, the running cap.
_PARSED = f"""
    SELECT doc_id, text, fenced, TRY_CAST(CASE WHEN json_valid(inner_text) THEN inner_text
               WHEN fenced THEN regexp_extract(inner_text, '(?s)[{{].*[}}]') END AS JSON) AS j
    FROM (SELECT doc_id, text, fenced, CASE WHEN fenced THEN regexp_extract(answer, '(?s)^```[^\\n]*\\n(.*)\\n```$', 1)
                 ELSE answer END AS inner_text
          FROM (SELECT *, starts_with(answer, '```') AND ends_with(answer, '```') AS fenced FROM ({_ANSWERS})))"""
_ENTRIES = f"""
    SELECT doc_id, pos, ok, extra, grounded, body, audience, quote,
           coalesce(sum(CASE WHEN ok AND grounded THEN 1 ELSE 0 END)
               OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) < 3 AS judged
    FROM (SELECT doc_id, pos, json_extract_string(e, '$.body') AS body, json_extract_string(e, '$.audience') AS audience,
                 json_extract_string(e, '$.quote') AS quote,
                 coalesce(json_type(e) = 'OBJECT' AND json_type(e, '$.body') = 'VARCHAR' AND json_type(e, '$.audience') = 'VARCHAR'
                     AND json_type(e, '$.quote') = 'VARCHAR' AND regexp_matches(json_extract_string(e, '$.body'), '[^\\s]')
                     AND regexp_matches(json_extract_string(e, '$.audience'), '[^\\s]')
                     AND regexp_matches(json_extract_string(e, '$.quote'), '[^\\s]'), false) AS ok,
                 coalesce(json_type(e) = 'OBJECT' AND len(list_filter(json_keys(e),
                     lambda k: k NOT IN ('body', 'audience', 'quote'))) > 0, false) AS extra,
                 coalesce(contains(text, json_extract_string(e, '$.quote')), false) AS grounded
          FROM (SELECT doc_id, text, CAST(i AS INTEGER) AS pos, json_extract(j, '$.pains[' || i || ']') AS e
                FROM ({_PARSED}), unnest(range(CAST(CASE WHEN json_type(j, '$.pains') = 'ARRAY'
                     THEN json_array_length(j, '$.pains') ELSE 0 END AS BIGINT))) AS u(i)))"""
_PER_POST = f"""
    SELECT p.doc_id, coalesce(json_type(p.j) = 'OBJECT' AND json_type(p.j, '$.pains') = 'ARRAY', false) AS parsed, p.fenced,
           count(*) FILTER (WHERE e.judged AND e.ok AND e.grounded) AS valid,
           count(*) FILTER (WHERE e.judged AND e.ok AND NOT e.grounded) AS hallucinated,
           count(*) FILTER (WHERE e.judged AND NOT e.ok) AS schema_invalid,
           count(*) FILTER (WHERE e.judged AND e.ok AND e.extra) AS extra_fields
    FROM ({_PARSED}) p LEFT JOIN ({_ENTRIES}) e ON e.doc_id = p.doc_id GROUP BY ALL"""


@query(
    "extract_validate",
    f"""SELECT doc_id, parsed, valid, hallucinated, schema_invalid, CAST(NOT parsed AS BIGINT) AS invalid_json,
               CAST(parsed AND fenced AS BIGINT) AS degraded_parse, extra_fields,
               CASE WHEN parsed THEN 'extracted' ELSE 'failed' END AS fetch_status
        FROM ({_PER_POST})""",
)
def extract_validate(t: Tables) -> DataFrame:
    judged = an.validate_extract(_extract_answers(t))
    status = an.extract_status(F.col("parsed"), F.lit(False)).alias("fetch_status")
    return judged.select("doc_id", "parsed", *an.EXTRACT_COUNTERS, status)


@query(
    "extract_counters",
    f"""SELECT CAST(sum(valid) AS BIGINT) AS valid, CAST(sum(hallucinated) AS BIGINT) AS hallucinated,
               CAST(sum(schema_invalid) AS BIGINT) AS schema_invalid, count(*) FILTER (WHERE NOT parsed) AS invalid_json,
               count(*) FILTER (WHERE parsed AND fenced) AS degraded_parse, CAST(sum(extra_fields) AS BIGINT) AS extra_fields
        FROM ({_PER_POST})""",
)
def extract_counters(t: Tables) -> DataFrame:
    return an.fold_counters(an.validate_extract(_extract_answers(t)))


@query(
    "extract_pains",
    f"SELECT doc_id, pos, body, audience, quote FROM ({_ENTRIES}) WHERE judged AND ok AND grounded",
)
def extract_pains(t: Tables) -> DataFrame:
    pains = an.accepted_pains(an.validate_extract(_extract_answers(t)), "doc_id")
    return pains.withColumnRenamed("raw_post_id", "doc_id")


@query(
    "extract_rejects",
    f"""SELECT doc_id, pos, CASE WHEN NOT ok THEN 'schema_invalid' ELSE 'hallucinated' END AS reason
        FROM ({_ENTRIES}) WHERE judged AND NOT (ok AND grounded)""",
)
def extract_rejects(t: Tables) -> DataFrame:
    rejects = an.rejected_pains(an.validate_extract(_extract_answers(t)), "doc_id")
    return rejects.withColumnRenamed("raw_post_id", "doc_id")


def _completions(t: Tables) -> DataFrame:
    """Completion JSON per document: some without usage, some with a boolean token count, some broken."""
    usage = F.when(
        F.col("doc_id") % 4 == 1, F.lit('{"prompt_tokens":true,"completion_tokens":5}')
    ).otherwise(
        F.concat(F.lit('{"prompt_tokens":'), F.col("n_chars").cast("string"), F.lit(',"completion_tokens":7}'))
    )
    content = _json(content=F.col("answer"))
    body = F.concat(
        F.lit('{"choices":[{"message":'), content, F.lit("}]"),
        F.when(F.col("doc_id") % 5 != 2, F.concat(F.lit(',"usage":'), usage)).otherwise(F.lit("")),
        F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(',"model":"m'), (F.col("doc_id") % 3).cast("string"), F.lit('"')))
        .otherwise(F.lit("")),
        F.lit("}"),
    )
    raw = F.when(F.col("doc_id") % 17 == 3, F.concat(body, F.lit("}"))).otherwise(body)
    rows = _extract_answers(t).join(t.documents.select("doc_id", "n_chars"), "doc_id")
    return rows.select("doc_id", "text", raw.alias("raw"))


_COMPLETIONS = f"""
    SELECT a.doc_id, a.doc_id % 17 = 3 AS call_failed, a.answer,
           CASE WHEN a.doc_id % 17 = 3 OR a.doc_id % 5 = 2 OR a.doc_id % 4 = 1 THEN 0 ELSE d.n_chars END AS prompt_tokens,
           CAST(CASE WHEN a.doc_id % 17 = 3 OR a.doc_id % 5 = 2 THEN 0 WHEN a.doc_id % 4 = 1 THEN 5 ELSE 7 END AS BIGINT)
               AS completion_tokens,
           CASE WHEN a.doc_id % 17 = 3 OR a.doc_id % 3 = 0 THEN 'fallback' ELSE 'm' || a.doc_id % 3 END AS model
    FROM ({_ANSWERS}) a JOIN documents d ON d.doc_id = a.doc_id"""


@query(
    "parse_completions",
    f"""SELECT doc_id, call_failed, CASE WHEN call_failed THEN NULL ELSE md5(answer) END AS answer_md5,
               prompt_tokens, completion_tokens, model FROM ({_COMPLETIONS})""",
)
def parse_completions(t: Tables) -> DataFrame:
    parsed = an.parse_completion(_completions(t), "raw", F.lit("fallback"))
    # DuckDB writes JSON keys in the order given and no blanks, as the built-in writer does.
    return parsed.select(
        "doc_id", "call_failed", F.md5("answer").alias("answer_md5"),
        F.col("prompt_tokens").cast("bigint").alias("prompt_tokens"),
        F.col("completion_tokens").cast("bigint").alias("completion_tokens"), "model",
    )


_PRICES = "(VALUES ('m1', 1.25), ('m2', 0.5), ('fallback', NULL)) AS p(model, price)"


def _prices(t: Tables) -> DataFrame:
    rows = [("m1", "1.25"), ("m2", "0.5"), ("fallback", None)]
    return t.spark.createDataFrame(rows, "model string, price string").select(
        "model", F.col("price").cast("decimal(12,4)").alias("price_per_mtok")
    )


@query(
    "extract_stage",
    f"""SELECT count(*) AS processed, CAST(sum(valid) FILTER (WHERE NOT call_failed) AS BIGINT) AS extracted,
               count(*) FILTER (WHERE NOT call_failed AND NOT parsed) AS failed,
               count(*) FILTER (WHERE call_failed) AS llm_errors,
               CAST(round(sum(CASE WHEN parsed AND NOT call_failed THEN
                   (prompt_tokens + completion_tokens) * CAST(coalesce(price, 0) AS DECIMAL(12,4)) ELSE 0 END)) AS BIGINT) AS cost_micro
        FROM (SELECT c.*, x.parsed, x.valid, p.price
              FROM ({_COMPLETIONS}) c JOIN ({_PER_POST}) x ON x.doc_id = c.doc_id
              JOIN (SELECT id FROM post_v WHERE coalesce(fetch_status, 'new') IN ('new', 'fetched')) r ON r.id = c.doc_id
              LEFT JOIN {_PRICES} ON p.model = c.model)""",
    ("post_v",),
)
def extract_stage(t: Tables) -> DataFrame:
    done = t.spark.createDataFrame([], "raw_post_id bigint")
    pending = stages.pending_posts(t.post, done)
    completions = an.parse_completion(_completions(t).drop("text"), "raw", F.lit("fallback")).withColumnRenamed(
        "doc_id", "post_id"
    )
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    result = stages.extract(pending, completions, _prices(t), "pv", now)
    return result.counters.select("processed", "extracted", "failed", "llm_errors", "cost_micro")


@query(
    "model_cost",
    f"""SELECT model, CAST(sum(tokens) AS BIGINT) AS tokens, CAST(CAST(sum(cost) AS DECIMAL(28,10)) AS DOUBLE) AS cost,
               CAST(round(sum(cost) * 1000000) AS BIGINT) AS cost_micro
        FROM (SELECT 'm' || conv_id % 4 AS model, length(text) AS tokens,
                     CAST(length(text) * CAST(coalesce(p.price, 0) AS DECIMAL(12,4)) AS DECIMAL(28,10)) / 1000000 AS cost
              FROM conversations LEFT JOIN {_PRICES} ON p.model = 'm' || conv_id % 4)
        GROUP BY model""".replace("CAST(length(text) * CAST(coalesce(p.price, 0) AS DECIMAL(12,4)) AS DECIMAL(28,10)) / 1000000",
                                  "CAST(length(text) * CAST(coalesce(p.price, 0) * 10000 AS BIGINT) AS DECIMAL(28,10)) * CAST(0.0000000001 AS DECIMAL(10,10))"),
)
def model_cost(t: Tables) -> DataFrame:
    said = t.conversations.select(
        F.concat(F.lit("m"), (F.col("conv_id") % 4).cast("string")).alias("model"),
        F.when(F.col("role") != "assistant", F.length("text")).otherwise(0).alias("prompt"),
        F.when(F.col("role") == "assistant", F.length("text")).otherwise(0).alias("completion"),
    )
    priced = said.join(_prices(t), "model", "left")
    cost = an.token_cost(F.col("prompt"), F.col("completion"), F.col("price_per_mtok"))
    total = priced.groupBy("model").agg(F.sum(F.col("prompt") + F.col("completion")).alias("tokens"), F.sum(cost).alias("c"))
    return total.select(
        "model", "tokens", F.col("c").cast("double").alias("cost"), an.micro_units(F.col("c")).alias("cost_micro")
    )


# Documents of a cluster; the number of clusters follows the table.
_PER_CLUSTER = 10


def _cluster_of() -> Column:
    return F.floor(F.col("doc_id") / _PER_CLUSTER).alias("cluster_id")


def _score_answers(t: Tables) -> DataFrame:
    """One score answer per group of documents; the quotes are cut from the middle of the group's last text."""
    grouped = t.documents.groupBy(_cluster_of()).agg(F.max_by("text", "doc_id").alias("text"))
    c = F.col("cluster_id")
    quote = F.substr("text", F.floor(F.length("text") / 2).cast("int") + 1, F.lit(25))
    quotes = (
        F.when(c % 7 == 0, F.array(quote, F.concat(quote, F.lit("¤"))))
        .when(c % 9 == 0, F.array().cast("array<string>"))
        .otherwise(F.array(quote, F.lit(""), quote))
    )
    score = F.when(c % 8 == 0, F.lit("true")).when(c % 6 == 0, F.lit("87.5")).otherwise((c * 5 % 130 - 5).cast("string"))
    text = F.concat(
        F.lit('{"score":'), score, F.lit(',"rationale_md":"'), F.when(c % 5 == 0, F.lit(" ")).otherwise(F.lit("fine")),
        F.lit('","quotes":'),
        F.when(c % 11 == 0, F.lit("[1]")).otherwise(F.to_json(quotes)), F.lit("}"),
    )
    answer = F.when(c % 13 == 0, F.concat(F.lit("```\n"), text, F.lit("\n```"))).otherwise(text)
    return grouped.select("cluster_id", answer.alias("answer"))


_SCORE_REASON = f"""
    SELECT c AS cluster_id, sc AS score, CASE
        WHEN c % 13 = 0 THEN 'invalid_json' WHEN c % 8 = 0 THEN 'score_not_a_number'
        WHEN sc < 0 OR sc > 100 THEN 'score_out_of_range' WHEN c % 5 = 0 THEN 'empty_rationale'
        WHEN c % 11 <> 0 AND c % 7 <> 0 AND c % 9 = 0 THEN 'no_quotes' WHEN c % 11 = 0 THEN 'quote_not_a_string'
        WHEN c % 7 = 0 AND NOT grounded THEN 'quote_not_grounded' END AS reason
    FROM (SELECT g.c, CASE WHEN g.c % 6 = 0 THEN 87.5 ELSE CAST(g.c * 5 % 130 - 5 AS DOUBLE) END AS sc,
                 EXISTS (SELECT 1 FROM documents d WHERE d.doc_id // {_PER_CLUSTER} = g.c
                         AND contains(d.text, substr(g.text, length(g.text) // 2 + 1, 25) || '¤')) AS grounded
          FROM (SELECT doc_id // {_PER_CLUSTER} AS c, arg_max(text, doc_id) AS text FROM documents GROUP BY 1) g)"""


@query(
    "score_validate",
    f"""SELECT cluster_id, reason, CASE WHEN reason IS NULL THEN score END AS score,
               CASE WHEN reason IS NULL THEN round(score / 10, 2) END AS stored FROM ({_SCORE_REASON})""",
)
def score_validate(t: Tables) -> DataFrame:
    bodies = t.documents.select(_cluster_of(), F.col("text").alias("body"))
    judged = an.ground_scores(an.parse_score(_score_answers(t)), bodies)
    return judged.select("cluster_id", "reason", "score", an.stored_score(F.col("score")).cast("double").alias("stored"))


@query(
    "score_stage",
    f"""SELECT count(*) AS clusters, count(*) FILTER (WHERE reason IS NULL) AS scored,
               count(reason) AS rejected,
               CAST(count(*) FILTER (WHERE reason IS NULL) >= 3 AND max(score) FILTER (WHERE reason IS NULL)
                    - min(score) FILTER (WHERE reason IS NULL) < 10 AS BIGINT) AS sanity_flag
        FROM ({_SCORE_REASON}) WHERE cluster_id % 3 <> 1""",
)
def score_stage(t: Tables) -> DataFrame:
    bodies = t.documents.select(_cluster_of(), F.col("text").alias("body"))
    clusters = bodies.select(F.col("cluster_id").alias("id")).distinct()
    stored = clusters.filter("id % 3 = 1").select(F.col("id").alias("cluster_id"))
    todo = stages.unscored_clusters(clusters, stored)
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    return stages.score(todo, _score_answers(t), bodies, now).counters


def _phrase_answers(t: Tables) -> DataFrame:
    """Phrase answers from the words of every document."""
    words = spread_words((F.col("doc_id") % 7).cast("int"))
    d = F.col("doc_id")
    phrases = (
        F.when(d % 11 == 0, F.transform(words, lambda w: F.concat(w, F.lit(" "), F.repeat(F.lit("x"), F.lit(118)))))
        .when(d % 5 == 0, F.array(F.lit(" same"), F.lit("same "), F.lit("other"), F.lit("same")))
        .otherwise(F.transform(words, lambda w: F.concat(F.lit("how "), w)))
    )
    text = F.concat(
        F.lit('{"phrases":'),
        F.when(d % 13 == 0, F.lit('["a","b",3]')).when(d % 17 == 0, F.lit('["a","b"," "]')).otherwise(F.to_json(phrases)),
        F.lit("}"),
    )
    return t.documents.select("doc_id", F.when(d % 19 == 0, F.concat(text, F.lit("."))).otherwise(text).alias("answer"))


_PHRASES = f"""
    SELECT doc_id, CASE WHEN doc_id % 19 = 0 THEN 'invalid_json' WHEN doc_id % 13 = 0 OR doc_id % 17 = 0 THEN 'blank_or_not_a_string'
               WHEN len(ps) = 0 THEN 'no_phrases' WHEN len(ps) NOT BETWEEN 3 AND 5 THEN 'wrong_count'
               WHEN len(list_filter(ps, lambda p: length(p) > 120)) > 0 THEN 'too_long' END AS reason, ps
    FROM (SELECT doc_id, [trim(p, ' ' || chr(9) || chr(10) || chr(13)) for p in CASE
              WHEN doc_id % 11 = 0 THEN [w || ' ' || repeat('x', 118) for w in {spread_words_sql("(doc_id % 7)")}]
              WHEN doc_id % 5 = 0 THEN ['same', 'same', 'other', 'same']
              ELSE ['how ' || w for w in {spread_words_sql("(doc_id % 7)")}] END] AS ps FROM documents)"""


@query(
    "phrases_validate",
    f"""SELECT doc_id, reason, CASE WHEN reason IS NULL THEN (
              SELECT string_agg(p, '|' ORDER BY first_at) FROM (
                SELECT p, min(i) AS first_at FROM (SELECT unnest(ps) AS p, generate_subscripts(ps, 1) AS i) GROUP BY p)) END AS phrases
        FROM ({_PHRASES})""",
)
def phrases_validate(t: Tables) -> DataFrame:
    return an.parse_phrases(_phrase_answers(t)).select("doc_id", "reason", F.array_join("phrases", "|").alias("phrases"))


@query(
    "parse_frequencies",
    """SELECT doc_id, CASE WHEN doc_id % 7 IN (0, 1, 2, 3) THEN NULL ELSE n_chars END AS frequency FROM documents""",
)
def parse_frequencies(t: Tables) -> DataFrame:
    n = F.col("n_chars").cast("string")
    d = F.col("doc_id") % 7
    raw = (
        F.when(d == 0, F.lit('{"results":[]}'))
        .when(d == 1, F.lit('{"results":[{"total":true}]}'))
        .when(d == 2, F.concat(F.lit('{"results":[{"total":-'), n, F.lit("}]}")))
        .when(d == 3, F.concat(F.lit("<html>"), n))
        .otherwise(F.concat(F.lit('{"results":[{"total":'), n, F.lit('},{"total":1}]}')))
    )
    parsed = an.parse_frequency(t.documents.select("doc_id", raw.alias("raw")), "raw")
    return parsed.select("doc_id", "frequency")


@query(
    "demand_confirmed",
    "SELECT cluster_id FROM check_v GROUP BY cluster_id HAVING max(frequency) >= 9900",
    ("check_v",),
)
def demand_confirmed(t: Tables) -> DataFrame:
    return stages.confirmed_clusters(t.checks, 9900)


@query(
    "latest_checks",
    """SELECT cluster_id, phrase, arg_max(frequency, seq) AS frequency, strftime(max(checked_at), '%Y-%m-%d %H:%M:%S') AS checked_at
       FROM check_v GROUP BY cluster_id, phrase ORDER BY max(checked_at) DESC, phrase""",
    ("check_v",),
)
def latest_checks(t: Tables) -> DataFrame:
    from sigmill.operators.merge import upsert_last_wins

    empty = t.checks.filter("false").withColumn("id", F.lit(""))
    current = upsert_last_wins(empty, t.checks, ["cluster_id", "phrase"], ["checked_at", "seq"])
    return current.orderBy(F.desc("checked_at"), "phrase").select("cluster_id", "phrase", "frequency", stamp("checked_at"))


@query(
    "cluster_checks",
    """SELECT phrase, frequency, strftime(checked_at, '%Y-%m-%d %H:%M:%S') AS checked_at FROM dealt_check_v
       WHERE cluster_id = 5 ORDER BY dealt_check_v.checked_at DESC, phrase""",
    ("dealt_check_v",),
)
def cluster_checks(t: Tables) -> DataFrame:
    return reports.demand_checks(t.dealt_checks, 5).withColumn("checked_at", stamp("checked_at"))


@query(
    "newest_check",
    "SELECT cluster_id, strftime(max(checked_at), '%d.%m.%Y') AS newest FROM check_v GROUP BY cluster_id",
    ("check_v",),
)
def newest_check(t: Tables) -> DataFrame:
    return t.checks.groupBy("cluster_id").agg(F.date_format(F.max("checked_at"), "dd.MM.yyyy").alias("newest"))


@query(
    "rationale_marker",
    f"""SELECT s.cluster_id, s.rationale_md || CASE WHEN c.cluster_id IS NOT NULL THEN '{stages.DEMAND_NOTE}' ELSE '' END
               AS rationale_md
        FROM score_v s LEFT JOIN (SELECT cluster_id FROM check_v GROUP BY cluster_id HAVING max(frequency) >= 9900) c
          ON c.cluster_id = s.cluster_id""",
    ("score_v", "check_v"),
)
def rationale_marker(t: Tables) -> DataFrame:
    confirmed = stages.confirmed_clusters(t.checks, 9900)
    # Applied twice: the second pass changes nothing.
    once = stages.annotate_scores(t.score, confirmed)
    return stages.annotate_scores(once, confirmed).select("cluster_id", "rationale_md")


@query(
    "validate_stage",
    f"""WITH j AS (SELECT doc_id, reason, ps FROM ({_PHRASES}) WHERE doc_id % 3 <> 0),
             p AS (SELECT DISTINCT doc_id, unnest(ps) AS phrase FROM j WHERE reason IS NULL),
             f AS (SELECT p.doc_id, p.phrase, q.frequency FROM p LEFT JOIN (
                     SELECT DISTINCT phrase, CAST(('0x' || substr(sha256(phrase), 1, 8)) AS BIGINT) % 10001 AS frequency
                     FROM p WHERE length(phrase) % 4 <> 0) q ON q.phrase = p.phrase)
        SELECT (SELECT count(*) FROM j) AS clusters, (SELECT count(*) FROM f) AS phrases,
               (SELECT count(frequency) FROM f) AS validated, (SELECT count(reason) FROM j) AS rejected,
               (SELECT count(*) FROM f WHERE frequency IS NULL) AS api_errors,
               (SELECT count(DISTINCT doc_id) FROM f WHERE frequency >= 100) AS demand_confirmed,
               (SELECT count(DISTINCT doc_id) FROM f WHERE frequency >= 100 AND doc_id % 2 = 0) AS rationale_updated""",
)
def validate_stage(t: Tables) -> DataFrame:
    from sigmill.functions.text import hash_bucket

    answers = _phrase_answers(t).withColumnRenamed("doc_id", "cluster_id")
    clusters = t.documents.select(F.col("doc_id").alias("id"))
    now = F.lit("2024-02-01 00:00:00").cast("timestamp")
    checks = clusters.filter("id % 3 = 0").select(
        F.lit("c").alias("id"), F.col("id").alias("cluster_id"), F.lit("old").alias("phrase"),
        F.lit(1).cast("bigint").alias("frequency"), now.alias("checked_at"),
    )
    stale = stages.stale_clusters(clusters, checks, now)
    known = (
        an.parse_phrases(answers).select(F.explode_outer("phrases").alias("phrase")).distinct()
        .filter(F.length("phrase") % 4 != 0)
        .withColumn("frequency", hash_bucket("phrase", 10_001))
    )
    scores = clusters.filter("id % 2 = 0").select(F.col("id").alias("cluster_id"), F.lit("why").alias("rationale_md"))
    return stages.validate(stale, answers, known, scores, checks, now).counters


@query(
    "post_prompts",
    "SELECT doc_id, md5('Up to 3 from:' || chr(10) || text || chr(10)) AS prompt_md5 FROM documents",
)
def post_prompts(t: Tables) -> DataFrame:
    template = "{# comment -#}\nUp to {{ max_pains }} from:\n{{ post_text }}\n"
    rendered = prompts.render(template, max_pains=F.lit(an.MAX_PAINS), post_text=F.col("text"))
    return t.documents.select("doc_id", F.md5(rendered).alias("prompt_md5"))


@query(
    "cluster_prompts",
    """SELECT c.id AS cluster_id, md5(string_agg(line, chr(10) ORDER BY rk)) AS prompt_md5
       FROM cluster_v c JOIN (
         SELECT cluster_id, rk, CASE WHEN rk = 1 THEN 'Facts:' || chr(10) || head || chr(10) ELSE '' END || '- ' || body
                || CASE WHEN rk = n THEN chr(10) || 'End' ELSE '' END AS line
         FROM (SELECT p.cluster_id, p.body, row_number() OVER w AS rk, count(*) OVER (PARTITION BY p.cluster_id) AS n, h.head
               FROM pain_v p JOIN (
                 SELECT c.id, 'Размер кластера: ' || c.size || ' постов' || chr(10) || 'Типы постов (kind_mix): {'
                        || concat_ws(', ', CASE WHEN demand > 0 THEN '"demand": ' || demand END,
                             CASE WHEN complaint > 0 THEN '"complaint": ' || complaint END,
                             CASE WHEN discussion > 0 THEN '"discussion": ' || discussion END) || '}' || chr(10)
                        || 'Число разных источников: ' || x.posts || chr(10) || 'Первый пост: ' || strftime(x.lo, '%Y-%m-%d %H:%M:%S')
                        || chr(10) || 'Последний пост: ' || strftime(x.hi, '%Y-%m-%d %H:%M:%S') || chr(10) || chr(10)
                        || 'Боли кластера:' AS head
                 FROM cluster_v c JOIN (SELECT p.cluster_id, count(DISTINCT p.raw_post_id) AS posts, min(r.created_at) AS lo,
                                               max(r.created_at) AS hi
                                        FROM pain_v p JOIN post_v r ON r.id = p.raw_post_id GROUP BY 1) x ON x.cluster_id = c.id
               ) h ON h.id = p.cluster_id
               WINDOW w AS (PARTITION BY p.cluster_id ORDER BY p.created_at, p.id))) l ON l.cluster_id = c.id
       GROUP BY c.id""",
    ("cluster_v",),
)
def cluster_prompts(t: Tables) -> DataFrame:
    facts = t.cluster.join(reports.cluster_facts(t.members, t.post).withColumnRenamed("cluster_id", "id"), "id")
    block = prompts.fact_block(F.col("size"), F.col("kind_mix"), F.col("posts"), F.col("first_seen"), F.col("last_seen"))
    parts = prompts.body_parts(t.members, "cluster_id", ["created_at", "id"], per_part=16)
    rendered = prompts.cluster_prompts(
        "Facts:\n{{ cluster_summary }}\nEnd", facts.select(F.col("id").alias("cluster_id"), block.alias("facts")),
        parts, "cluster_id", "cluster_summary",
    )
    joined = rendered.groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("part", "prompt"))).alias("p"))
    text = F.array_join(F.transform("p", lambda x: x["prompt"]), "\n")
    return joined.select("cluster_id", F.md5(text).alias("prompt_md5"))
