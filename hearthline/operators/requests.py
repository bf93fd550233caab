"""Annotation request tables."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def request_table(
    titles: DataFrame, key: str, title: str, prompts: Mapping[str, tuple[str, str]], temperatures: Sequence[float],
    model: str, max_tokens: int, url: str = "/v1/chat/completions",
) -> DataFrame:
    """config, custom_id, request: one request document per listing, prompt and temperature.

    ``prompts`` maps a name to (system text, user template with {title}). The few set-ups are literals exploded in
    place, so no second table is joined.
    """
    setups = F.array(
        *[
            F.struct(
                F.lit(f"{name}_t{str(t).replace('.', 'p')}").alias("config"), F.lit(system).alias("system"),
                F.lit(user).alias("user"), F.lit(float(t)).alias("temperature"),
            )
            for name, (system, user) in prompts.items()
            for t in temperatures
        ]
    )
    rows = titles.select(F.col(key).cast("string").alias("custom_id"), F.col(title).alias("_title"), F.explode(setups).alias("s"))
    content = F.replace(F.col("s.user"), F.lit("{title}"), F.coalesce("_title", F.lit("")))
    messages = F.array(
        F.struct(F.lit("system").alias("role"), F.col("s.system").alias("content")),
        F.struct(F.lit("user").alias("role"), content.alias("content")),
    )
    body = F.struct(
        F.lit(model).alias("model"), messages.alias("messages"), F.col("s.temperature").alias("temperature"), F.lit(max_tokens).alias("max_tokens")
    )
    document = F.to_json(F.struct("custom_id", F.lit("POST").alias("method"), F.lit(url).alias("url"), body.alias("body")))
    return rows.select("s.config", "custom_id", document.alias("request"))
