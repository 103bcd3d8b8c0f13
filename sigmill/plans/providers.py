"""The model-provider registry: a small operator-kept table with one active row and prices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sigmill.functions import text as tx
from sigmill.operators import merge
from sigmill.operators.dedup import keep_one

# Fixed values.
PROVIDER_KINDS = ("fake", "openai_compat")


def provider_rules() -> dict:
    """Input rules shared by add and update, for ``sigmill.schemas.split_valid``."""
    return {
        "name": tx.has_text("name"),
        "kind": F.col("kind").isin(*PROVIDER_KINDS),
        "base_url": (F.col("kind") != "openai_compat") | tx.has_text("base_url"),
    }


def listing(providers: DataFrame) -> DataFrame:
    """Every provider, the active one first; the secret leaves only as its mask."""
    return providers.select(
        "name", "kind", "base_url", "model", tx.mask_secret("api_key").alias("key_masked"), "is_active"
    ).orderBy(F.desc("is_active"), "name")


def active(providers: DataFrame) -> DataFrame:
    return providers.filter("is_active")


def add(providers: DataFrame, new: DataFrame) -> DataFrame:
    """Rows to append; a name that exists is left out (it is changed by ``update``).

    Names that are one once blanks are cut off give one row.
    """
    clean = keep_one(new.withColumns({c: tx.strip(c) for c in ("name", "base_url", "model")}), ["name"])
    return clean.join(providers.select("name"), "name", "left_anti").select(*new.columns)


def update(providers: DataFrame, changes: DataFrame) -> DataFrame:
    """Set kind, address, model and secret by name; an empty secret keeps the stored one.

    An unknown name is an error.
    """
    stored = providers.select("name", F.col("api_key").alias("_old"))
    clean = changes.withColumns({c: tx.strip(c) for c in ("name", "base_url", "model")})
    filled = clean.join(stored, "name", "left").withColumn(
        "api_key", tx.keep_if_blank(F.col("api_key"), F.col("_old"))
    )
    return merge.update_keyed(providers, filled.drop("_old"), "name", strict=True)


def set_default(providers: DataFrame, name: str) -> DataFrame:
    return merge.set_single_active(providers, "name", name)


def set_enabled(providers: DataFrame, name: str, enabled: bool) -> DataFrame:
    """Enabling means becoming the only active one; disabling may leave none."""
    return set_default(providers, name) if enabled else merge.set_inactive(providers, "name", name)


def delete(providers: DataFrame, names: DataFrame) -> tuple[DataFrame, DataFrame]:
    return merge.delete_keys(providers, names, "name")


def price_table(providers: DataFrame) -> DataFrame:
    """Price per model of the active provider, as the extract stage takes it."""
    return active(providers).select("model", "price_per_mtok")
