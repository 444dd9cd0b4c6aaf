"""Prompts for a planning model."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def user_prompt(url: Column, title: Column, intent: Column, visible: Column | None = None, elements: Column | None = None) -> Column:
    """The parts of a prompt by lines; elements are given as compact JSON."""
    parts = [F.concat(F.lit("Page URL: "), F.coalesce(url, F.lit("<unknown>"))), F.concat(F.lit("Page Title: "), F.coalesce(title, F.lit("<unknown>")))]
    if visible is not None:
        parts.append(F.concat(F.lit("\nVisible Text (sanitized):\n"), visible))
    if elements is not None:
        parts.append(F.concat(F.lit("\nInteractive Elements ("), F.size(elements).cast("string"), F.lit("):\n"), F.to_json(elements)))
    return F.concat_ws("\n", *parts, F.concat(F.lit("\nUser Task: "), intent), F.lit("\nRespond with tasks.json:"))


def messages(system: Column, user: Column) -> Column:
    return F.array(F.struct(F.lit("system").alias("role"), system.alias("content")), F.struct(F.lit("user").alias("role"), user.alias("content")))
