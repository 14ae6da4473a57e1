"""Model responses as a table: fences, parsing, rescue, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ringweave.functions.normalize import strip
from ringweave.schema import NARRATIVE

PROMPT_HEAD = "Explain this fraud verdict for a risk analyst.\n"


def strip_code_fences(text: Column) -> Column:
    """Drop a leading ``` line and a trailing ``` around a response."""
    trimmed = strip(text)
    opened = F.regexp_replace(trimmed, r"^```[^\n]*\n", "")
    closed = F.regexp_replace(opened, r"(?U)```\s*$", "")
    return strip(F.when(trimmed.startswith("```"), closed).otherwise(trimmed))


def _parsed(text: Column) -> Column:
    """The narrative, or null unless it is one whole object with exact types."""
    value = F.from_json(text, NARRATIVE, {"mode": "PERMISSIVE"})
    kinds = F.from_json(text, "map<string,string>")
    whole = text.rlike(r"(?s)^\{.*\}$")
    # JSON kinds, so that a number or an object never passes as text
    kind = {n: F.schema_of_variant(F.try_variant_get(F.try_parse_json(text), f"$.{n}", "variant")) for n in ("summary", "risk_factors", "recommended_action")}
    exact = (
        (kind["summary"] == "STRING") & (kind["recommended_action"] == "STRING")
        & ((kind["risk_factors"] == "ARRAY<STRING>") | (F.get_json_object(text, "$.risk_factors") == "[]"))
    )
    complete = exact & (
        value["summary"].isNotNull() & value["risk_factors"].isNotNull() & value["recommended_action"].isNotNull()
        & ~F.exists(value["risk_factors"], lambda f: f.isNull())
    )
    return F.when(whole & kinds.isNotNull() & F.coalesce(complete, F.lit(False)), value)


def validate_narratives(responses: DataFrame, text: str = "response") -> DataFrame:
    """Add ``parse_status`` (parsed, rescued, invalid) and ``narrative``."""
    cleaned = strip_code_fences(F.col(text))
    inner = F.regexp_extract(F.col("_clean"), r"(?s)\{.*\}", 0)
    staged = responses.withColumn("_clean", cleaned).withColumn("_inner", inner)
    whole, rescued = _parsed(F.col("_clean")), _parsed(F.col("_inner"))
    out = staged.withColumn("_whole", whole).withColumn("_rescued", rescued)
    return out.select(
        *responses.columns,
        F.when(F.col("_whole").isNotNull(), "parsed").when(F.col("_rescued").isNotNull(), "rescued").otherwise("invalid").alias("parse_status"),
        F.coalesce("_whole", "_rescued").alias("narrative"),
    )


def narrative_status(parse_status: Column) -> Column:
    return F.when(parse_status == "invalid", "SKIPPED").otherwise("DONE")


def narrative_prompt(evidence: Column) -> Column:
    """Prompt text around the evidence bundle of a verdict."""
    return F.concat(F.lit(PROMPT_HEAD), F.to_json(evidence, {"ignoreNullFields": "false"}))
