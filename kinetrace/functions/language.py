"""Prompts and text clean-up."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def formalised(text: Column) -> Column:
    """Lower case without anything but letters, digits, _ and white space (of any script)."""
    return F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", "")


def text_or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def picked(options: Column, *key: Column, seed: int = 0) -> Column:
    """A choice of an array's items that any engine repeats; null of an empty one."""
    n = F.size(options)
    text = F.concat_ws(":", F.lit(str(seed)), *[F.coalesce(k.cast("string"), F.lit("null")) for k in key])
    drawn = F.conv(F.substring(F.md5(text), 1, 12), 16, 10).cast("long")
    return F.when(n > 0, options[F.pmod(drawn, F.when(n > 0, n).otherwise(1)).cast("int")])


def episode_task(tasks: Column, episode: Column, seed: int = 0) -> Column:
    """One of an episode's tasks, the same for all its frames; empty if it has none."""
    return F.coalesce(picked(tasks, episode, seed=seed), F.lit(""))


def named(code: Column, names: dict[int, str], default: str) -> Column:
    """The name of a rounded code (half to even)."""
    table = F.create_map(*[x for k, v in names.items() for x in (F.lit(k), F.lit(v))])
    return F.coalesce(F.try_element_at(table, F.bround(code).cast("int")), F.lit(default))


def arm_prompt(side: str, number: Column, instrument: Column, color: Column) -> Column:
    return F.concat(F.lit(f"arm {side}: "), F.bround(number).cast("int").cast("string"), F.lit(f". {side} instrument: "), instrument, F.lit(" ("), color, F.lit(")"))


def state_prompt(arms: list[Column], procedure: Column) -> Column:
    """Arm sentences, then the procedure."""
    return F.concat_ws(". ", *arms, procedure)


def cleaned_tool(tool: Column) -> Column:
    """Trimmed lower case; none for null, empty, none, nan and null."""
    own = F.lower(F.trim(tool))
    return F.when(own.isNull() | own.isin("", "none", "nan", "null"), F.lit("none")).otherwise(own)


def tool_prompt(tools: list[tuple[str, Column]], instruction: Column) -> Column:
    """``label: tool`` parts, then the instruction unless it is empty, nan or none."""
    parts = [F.concat(F.lit(f"{label}: "), cleaned_tool(tool)) for label, tool in tools]
    own = F.trim(instruction)
    return F.concat_ws(". ", *parts, F.when(~F.lower(F.coalesce(own, F.lit(""))).isin("", "nan", "none"), own))


def numbered_path(pattern: str, chunk: Column, episode: Column) -> Column:
    """chunk-%03d/episode_%06d and the like."""
    return F.format_string(pattern, chunk, episode)


def checkpoint_step(path: Column) -> Column:
    return F.regexp_extract(path, r"checkpoint-(\d+)", 1).cast("int")


def tag_of_env(env: Column, prefixes: dict[str, str]) -> Column:
    table = F.create_map(*[F.lit(x) for kv in prefixes.items() for x in kv])
    return F.try_element_at(table, F.split_part(env, F.lit("/"), F.lit(1)))
