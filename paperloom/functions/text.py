"""Whitespace, code fences, prompts and paths."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed


def strip(text: Column) -> Column:
    """Remove every leading and trailing whitespace character, Unicode ones too."""
    return F.trim(text, F.lit(fixed.WHITESPACE))


def strip_code_fence(text: Column) -> Column:
    """Body of a text that is one fenced block; any other text only stripped."""
    # The body of a match is never NULL; texts that do not match come back unchanged.
    return strip(F.regexp_replace(strip(text), fixed.FENCE_PATTERN, "$1"))


def user_prompt(question: Column, title: Column, abstract: Column) -> Column:
    return F.concat(
        F.lit(fixed.QUESTION_HEADING), question,
        F.lit(fixed.TITLE_HEADING), title,
        F.lit(fixed.ABSTRACT_HEADING), abstract,
    )


def build_messages(question: Column, title: Column, abstract: Column) -> Column:
    """Chat messages of one labeling job: the fixed system text, then the job."""

    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.array(
        message("system", F.lit(fixed.CLASSIFIER_SYSTEM_TEXT)),
        message("user", user_prompt(question, title, abstract)),
    )


def is_blank_input(*columns: Column) -> Column:
    """True when any model input is NULL or empty: such a job gets no model call."""
    blank = F.lit(False)
    for column in columns:
        blank = blank | (F.coalesce(column, F.lit("")) == "")
    return blank


def file_stem(path: Column) -> Column:
    """Last path segment without its last suffix (a leading dot is no suffix)."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.regexp_replace(name, r"(?<=.)\.[^.]*$", "")


def last_segment(url: Column) -> Column:
    return F.element_at(F.split(url, "/"), -1)


def is_unsafe_member(path: Column) -> Column:
    """True for an archive member that would land outside its target folder.

    Walks the segments keeping the depth: an absolute path or a depth below
    zero at any point is an escape.
    """
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lowest"))

    def step(state: Column, segment: Column) -> Column:
        move = F.when(segment == "..", -1).when(segment.isin("", "."), 0).otherwise(1)
        depth = state["depth"] + move
        return F.struct(depth.alias("depth"), F.least(state["lowest"], depth).alias("lowest"))

    lowest = F.aggregate(F.split(path, "/"), start, step, lambda state: state["lowest"])
    return path.startswith("/") | (lowest < 0)
