"""Prompt rendering as columns. A long cluster is rendered in ordered parts of bounded size."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sigmill.operators.ordering import with_rank_in_group

# Bodies per rendered part. Parts joined in order by line breaks are the whole text.
BODIES_PER_PART = 1000

# Fixed display texts of the fact block.
BODIES_HEADER = "Боли кластера:"


class PromptTemplateError(ValueError):
    """A template is unusable or names a variable nobody provides."""


def render(template: str, **values: Column) -> Column:
    """Substitute ``{{ name }}`` placeholders; a placeholder without a value is an error.

    Values are inserted as they are: text that looks like a placeholder stays text.
    """
    template = re.sub(r"\{#-?.*?-?#\}\s*", "", template, flags=re.DOTALL)
    pieces = re.split(r"\{\{\s*(\w+)\s*\}\}", template)
    missing = sorted(set(pieces[1::2]) - set(values))
    if missing:
        raise PromptTemplateError(f"no value for {', '.join(missing)}")
    if any("{{" in literal or "{%" in literal for literal in pieces[::2]):
        raise PromptTemplateError("unsupported template syntax")
    columns = [
        values[piece].cast("string") if i % 2 else F.lit(piece) for i, piece in enumerate(pieces)
    ]
    return F.concat(*columns)


def body_parts(
    bodies: DataFrame, group: str, order: list[str], body: str = "body", per_part: int = BODIES_PER_PART
) -> DataFrame:
    """Ordered bodies of every group in parts of at most ``per_part``: ``group, part, bodies``.

    No task gathers more than one part, however large a group is.
    """
    ranked = with_rank_in_group(bodies.select(group, *dict.fromkeys([*order, body])), group, order)
    part = F.floor((F.col("rank") - 1) / per_part).cast("int").alias("part")
    gathered = ranked.groupBy(group, part).agg(F.collect_list(F.struct("rank", F.col(body).alias("b"))).alias("_l"))
    return gathered.select(
        group, "part", F.transform(F.array_sort("_l"), lambda x: x["b"]).alias("bodies")
    )


def bullet_lines(bodies: Column) -> Column:
    return F.array_join(F.transform(bodies, lambda b: F.concat(F.lit("- "), b)), "\n")


def fact_block(
    size: Column, kind_mix: Column, sources: Column, first_seen: Column, last_seen: Column
) -> Column:
    """Facts about one cluster, ending in the header of its body lines."""
    # Fixed display texts.
    kinds = F.concat(
        F.lit("{"),
        F.array_join(
            F.transform(
                F.map_entries(kind_mix),
                lambda e: F.concat(F.lit('"'), e["key"], F.lit('": '), e["value"].cast("string")),
            ),
            ", ",
        ),
        F.lit("}"),
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("Размер кластера: "), size.cast("string"), F.lit(" постов")),
        F.concat(F.lit("Типы постов (kind_mix): "), kinds),
        F.concat(F.lit("Число разных источников: "), sources.cast("string")),
        F.concat(F.lit("Первый пост: "), first_seen.cast("string")),
        F.concat(F.lit("Последний пост: "), last_seen.cast("string")),
        F.lit(""),
        F.lit(BODIES_HEADER),
    )


def cluster_prompts(template: str, facts: DataFrame, parts: DataFrame, key: str, variable: str) -> DataFrame:
    """Rendered prompts: ``key, part, parts, prompt``.

    ``facts`` holds ``(key, facts)``. A cluster that fits one part has one row with the whole
    prompt; a larger one has several, to be joined in order by line breaks. The template's text
    before the variable opens the first part, the text after it closes the last.
    """
    marker = re.split(r"\{\{\s*" + re.escape(variable) + r"\s*\}\}", re.sub(r"\{#-?.*?-?#\}\s*", "", template, flags=re.DOTALL))
    if len(marker) != 2:
        raise PromptTemplateError(f"the template must use {variable} exactly once")
    counted = parts.groupBy(key).agg((F.max("part") + 1).alias("parts"))
    first = F.col("part") == 0
    last = F.col("part") == F.col("parts") - 1
    text = F.concat(
        F.when(first, F.concat(F.lit(marker[0]), F.col("facts"), F.lit("\n"))).otherwise(F.lit("")),
        bullet_lines(F.col("bodies")),
        F.when(last, F.lit(marker[1])).otherwise(F.lit("")),
    )
    return parts.join(counted, key).join(facts, key).select(key, "part", "parts", text.alias("prompt"))
