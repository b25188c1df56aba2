"""Open JSON records: settings, templates, server properties, message content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusloom.functions.text import js_trim
from corpusloom.schemas import STORED_FILES


def json_string(record: Column, path: str) -> Column:
    """A string field of a VARIANT; null when absent or of another type."""
    value = F.try_variant_get(record, path, "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(record, path, "string"))


def json_number(record: Column, path: str) -> Column:
    value = F.try_variant_get(record, path, "variant")
    kind = F.schema_of_variant(value)
    numeric = kind.isin("BIGINT", "DOUBLE", "FLOAT") | F.startswith(kind, F.lit("DECIMAL"))
    return F.when(numeric, F.try_variant_get(record, path, "double"))


def metadata_string(record: Column, key: str, fallback: str = "") -> Column:
    return F.coalesce(json_string(record, f"$.{key}"), F.lit(fallback))


def _first_text(*values: Column) -> Column:
    return F.coalesce(*[F.nullif(js_trim(v), F.lit("")) for v in values])


def model_name(props: Column) -> Column:
    """Direct names, then nested names, then the last part of a model path."""
    names = ("model_name", "model", "model_alias")
    nested = "$.default_generation_settings.params."
    path = _first_text(json_string(props, "$.model_path"), json_string(props, nested + "model_path"))
    last = js_trim(F.element_at(F.split(path, r"[\\/]"), -1))
    last = F.when(last == "", js_trim(path)).otherwise(last)
    return F.coalesce(
        _first_text(*[json_string(props, f"$.{n}") for n in names]),
        _first_text(*[json_string(props, nested + n) for n in names]),
        last,
        F.lit("local"),
    )


def context_window(props: Column) -> Column:
    return F.coalesce(
        json_number(props, "$.n_ctx"),
        json_number(props, "$.default_generation_settings.n_ctx"),
        F.lit(0.0),
    ).cast("long")


def config_coalesce(primary: Column, legacy: Column, default) -> Column:
    return F.coalesce(primary, legacy, default if isinstance(default, Column) else F.lit(default))


def merge_section(custom: Column, section: str, defaults: dict[str, str]) -> Column:
    """One template section: each missing field falls back to its default."""
    return F.struct(
        *[F.coalesce(json_string(custom, f"$.{section}.{k}"), F.lit(v)).alias(k) for k, v in defaults.items()]
    )


def merge_conversation_template(custom: Column, system_default: str, user_default: str) -> Column:
    """System and user prompt with their older key names as second choice."""
    return F.struct(
        F.coalesce(json_string(custom, "$.systemPrompt"), json_string(custom, "$.system"), F.lit(system_default)).alias(
            "system_prompt"
        ),
        F.coalesce(json_string(custom, "$.userPrompt"), json_string(custom, "$.user"), F.lit(user_default)).alias(
            "user_prompt"
        ),
    )


def message_text(content: Column) -> Column:
    """Text of a message whose content (VARIANT) is a string or an object."""
    return F.coalesce(json_string(content, "$"), json_string(content, "$.text"), F.lit(""))


def message_files(content: Column) -> Column:
    """Attachments of a message; an absent list is an empty array."""
    listed = F.from_json(F.to_json(F.try_variant_get(content, "$.filesMetadata", "variant")), STORED_FILES)
    return F.transform(
        F.coalesce(listed, F.array()),
        lambda f: F.struct(
            f["name"].alias("name"),
            f["content"].alias("content"),
            F.coalesce(f["isAutomatic"], F.lit(False)).alias("is_automatic"),
            F.coalesce(f["isRepository"], F.lit(False)).alias("is_repository"),
        ),
    )
