"""Cut a long text into chunks at paragraph borders."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .. import fixed_values as fixed
from .json_rules import let

_BLOCK = 256


def chunks(text: Column, max_chars: int) -> Column:
    """ARRAY<STRING> of the pieces of ``text``; joined they give ``text`` again.

    A text of at most ``max_chars`` is one piece. Otherwise each window of
    ``max_chars`` characters is cut at its last blank line when that lies
    behind 85% of the window, else at its end.

    Finding a character offset costs time in proportion to the offset. The text
    is therefore first split into segments of ``max_chars``: a window touches at
    most two of them, so the work stays proportional to the text.
    """
    threshold = int(max_chars * fixed.CHUNK_CUT_RATIO)
    segments = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{max_chars}}}"), F.lit(0))
    most_windows = F.ceil(F.char_length(text) / F.lit(float(threshold + 1))).cast("int") + 1

    def cut_length(window: Column) -> Column:
        # What follows the last blank line; the whole window when there is none.
        size = F.char_length(window)
        border = size - F.char_length(F.substring_index(window, "\n\n", -1)) - 2
        return let(border, lambda b: F.when(b > threshold, b).otherwise(size))

    def walk(parts: Column) -> Column:
        def window(start: Column, size: Column) -> Column:
            first = F.floor(start / max_chars).cast("int")
            both = F.concat(F.get(parts, first), F.coalesce(F.get(parts, first + 1), F.lit("")))
            return F.substring(both, start - first * max_chars + 1, size)

        def step(state: Column, _: Column) -> Column:
            at, chars = state["at"], state["chars"]

            def advanced(size: Column) -> Column:
                cut = F.struct(at.alias("start"), size.alias("size"))
                return F.struct(
                    (at + size).alias("at"),
                    chars.alias("chars"),
                    F.concat(state["cuts"], F.array(cut)).alias("cuts"),
                )

            size = let(window(at, F.lit(max_chars)), cut_length)
            return F.when(at >= chars, state).otherwise(let(size, advanced))

        def block(state: Column, _: Column) -> Column:
            # a list grows by copying: cuts are gathered in blocks of bounded length
            start = F.struct(
                state["at"].alias("at"),
                state["chars"].alias("chars"),
                F.array().cast("array<struct<start:int,size:int>>").alias("cuts"),
            )
            inner = F.aggregate(F.sequence(F.lit(1), F.lit(_BLOCK)), start, step)

            def joined(done: Column) -> Column:
                return F.struct(
                    done["at"].alias("at"),
                    done["chars"].alias("chars"),
                    F.concat(state["blocks"], F.array(done["cuts"])).alias("blocks"),
                )

            return F.when(state["at"] >= state["chars"], state).otherwise(let(inner, joined))

        start = F.struct(
            F.lit(0).alias("at"),
            F.char_length(text).alias("chars"),
            F.array().cast("array<array<struct<start:int,size:int>>>").alias("blocks"),
        )
        most_blocks = F.ceil(most_windows / F.lit(float(_BLOCK))).cast("int")
        cuts = F.aggregate(
            F.sequence(F.lit(1), most_blocks), start, block, lambda s: F.flatten(s["blocks"])
        )
        return F.transform(cuts, lambda cut: window(cut["start"], cut["size"]))

    return F.when(F.char_length(text) <= max_chars, F.array(text)).otherwise(let(segments, walk))
