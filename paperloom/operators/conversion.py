"""From TeX and page texts to Markdown."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..functions.chunking import chunks
from ..functions.text import strip
from .labeling import ChatModel, ask_model
from .shared import ordered_concat


def chunk_texts(documents: DataFrame, max_chars: int = fixed.HOSTED_CHUNK_CHARS) -> DataFrame:
    """(id, pos, chunk) of (id, text), in order from 0; an empty text is one chunk."""
    return documents.select("id", F.posexplode(chunks(F.col("text"), max_chars)).alias("pos", "chunk"))


def generate_chunks(
    chunked: DataFrame,
    model: ChatModel,
    *,
    instructions: str = fixed.CONVERSION_INSTRUCTIONS,
    in_flight: int = fixed.HOSTED_IN_FLIGHT,
    parallelism: int | None = None,
) -> DataFrame:
    """Model reply per chunk: (id, pos, reply, error).

    With ``parallelism`` the chunks of a long document spread over many tasks.
    """
    prompt = F.concat(F.lit(instructions), F.lit("\n\n"), F.col("chunk"))
    asked = chunked.select("id", "pos", prompt.alias("ask"))
    return ask_model(asked, "ask", model, in_flight=in_flight, parallelism=parallelism)


def reassemble(replies: DataFrame) -> DataFrame:
    """(id, md): stripped non-empty replies in chunk order, a blank line between."""
    text = strip(F.col("reply"))
    return ordered_concat(
        replies, ["id"], "pos", F.when(text != "", text), "\n\n", "md"
    ).select("id", F.coalesce("md", F.lit("")).alias("md"))


def failed_documents(replies: DataFrame) -> DataFrame:
    """Documents with a failed chunk: their conversion counts as failed."""
    return replies.filter("error IS NOT NULL").select("id").distinct()


def join_pages(pages: DataFrame) -> DataFrame:
    """(id, md) of (id, page_no, text): non-empty pages stripped, a blank line between."""
    text = F.when(F.col("text") != "", strip(F.col("text")))
    return ordered_concat(pages, ["id"], "page_no", text, "\n\n", "md").select(
        "id", F.coalesce(strip(F.col("md")), F.lit("")).alias("md")
    )


def newest_files(listing: DataFrame, done: DataFrame) -> DataFrame:
    """Of each id without Markdown the file that came last: (id, batch, path).

    ``listing``: (id, batch, path), the batch in which a file was first seen;
    of several files of one batch the greatest path. ``done``: (id).
    """
    newest = listing.groupBy("id").agg(F.max(F.struct("batch", "path")).alias("_file"))
    chosen = newest.select("id", F.col("_file.batch").alias("batch"), F.col("_file.path").alias("path"))
    return chosen.join(done.select("id"), "id", "left_anti")


def conversion_plan(artifacts: DataFrame) -> DataFrame:
    """What happens to each id: (id, tex_action, pdf_action), NULL without a source.

    ``artifacts``: (id, kind, ok) with kind ``tex``, ``pdf`` or ``md`` (already
    converted); ``ok`` tells whether converting that source works. TeX goes
    first, existing Markdown is kept, and a PDF is converted only if the TeX
    did not produce anything.
    """

    def seen(kind: str) -> Column:
        return F.coalesce(F.max(F.col("kind") == kind), F.lit(False))

    def works(kind: str) -> Column:
        return F.coalesce(F.max((F.col("kind") == kind) & F.col("ok")), F.lit(False))

    ids = artifacts.groupBy("id").agg(
        seen("tex").alias("tex"),
        seen("pdf").alias("pdf"),
        seen("md").alias("md"),
        works("tex").alias("tex_ok"),
        works("pdf").alias("pdf_ok"),
    )

    def action(works: str) -> Column:
        return F.when(F.col("md"), "skip_existing").when(F.col(works), "convert").otherwise("error")

    produced = F.col("tex") & (F.col("md") | F.col("tex_ok"))
    return ids.filter("tex OR pdf").select(
        "id",
        F.when(F.col("tex"), action("tex_ok")).alias("tex_action"),
        F.when(F.col("pdf"), F.when(produced, "covered").otherwise(action("pdf_ok"))).alias("pdf_action"),
    )


def conversion_statistics(plan: DataFrame) -> DataFrame:
    tex, pdf = F.col("tex_action"), F.col("pdf_action")

    def both(action: str) -> Column:
        return F.count_if(tex == action) + F.count_if(pdf == action)

    return plan.agg(
        F.count(tex).alias("tex_found"),
        F.count(pdf).alias("pdf_found"),
        F.count_if(tex == "convert").alias("converted_tex"),
        F.count_if(pdf == "convert").alias("converted_pdf"),
        both("skip_existing").alias("skipped_existing"),
        both("error").alias("errors"),
    )
