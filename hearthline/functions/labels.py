"""Title labels and tolerant reading of annotator answers."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from hearthline import config


def keyword_label(text: Column, keywords: Sequence[str]) -> Column:
    """1 when any keyword occurs (case-sensitive), else 0; null text gives 0."""
    hit = reduce(lambda a, b: a | b, [text.contains(word) for word in keywords])
    return F.coalesce(hit, F.lit(False)).cast("int")


def keyword_labels(text: str, dictionary: Mapping[str, Sequence[str]] = config.TITLE_KEYWORDS, prefix: str = "") -> dict[str, Column]:
    return {f"{prefix}{name}": keyword_label(F.col(text), words) for name, words in dictionary.items()}


def positive_count(labels: Sequence[str]) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(name).cast("int"), F.lit(0)) for name in labels])


def any_positive(labels: Sequence[str]) -> Column:
    return (positive_count(labels) > 0).cast("int")


def object_text(raw: Column) -> Column:
    """The part from the first brace to the last; drops code fences and surrounding prose."""
    body = F.regexp_extract(raw, r"(?s)(\{.*\})", 1)
    return F.when(F.length(body) > 0, body)


def parsed_object(raw: Column) -> Column:
    """map<string,string> of the answer, null when it is not one JSON object."""
    return F.from_json(object_text(raw), "map<string,string>", {"mode": "PERMISSIVE"})


def parse_ok(parsed: Column) -> Column:
    return parsed.isNotNull()


def answer_value(parsed: Column, label: str) -> Column:
    """A non-zero number or true is 1; a missing key is 0; a failed parse stays null."""
    text = F.lower(F.element_at(parsed, F.lit(label)))
    number = text.try_cast("double")
    positive = (text == "true") | (F.coalesce(number, F.lit(0.0)) != 0)
    return F.when(parsed.isNotNull(), F.coalesce(positive, F.lit(False)).cast("int"))


def response_content(line: Column) -> Column:
    """Message text of one response line, null when the line reports an error."""
    error = F.get_json_object(line, "$.error")
    content = F.get_json_object(line, "$.response.body.choices[0].message.content")
    return F.when(error.isNull() | (error == ""), content)
