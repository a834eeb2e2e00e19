"""Downloads and archives: what is already there, what to fetch, what to unpack."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.text import is_unsafe_member, last_segment
from ..functions.versions import previous_version_id
from .shared import only_for

# candidate order of a download: (rank, which version, kind)
CANDIDATES = ((1, "own", "src"), (2, "own", "pdf"), (3, "previous", "src"), (4, "previous", "pdf"))


def already_downloaded(ids: DataFrame, files: DataFrame, literal_prefix: bool = False) -> DataFrame:
    """Ids with a stored archive.

    ``files`` has a ``path``. By default the id must be the whole file name up
    to an archive suffix. With ``literal_prefix`` any file name that starts
    with the id counts (so ``v10`` also serves ``v1``): a file name is cut to
    those lengths that occur among the ids, which turns the test into an equi-join.
    """
    name = last_segment(F.col("path"))
    if literal_prefix:
        # one array, as long as ids have different lengths
        lengths = ids.agg(F.collect_set(F.char_length("arxiv_id")).alias("lengths")).scalar()
        named = files.select(name.alias("_name"), lengths.alias("_lengths"))
        fitting = F.filter("_lengths", lambda n: n <= F.char_length("_name"))
        prefix = F.transform(fitting, lambda n: F.substring(F.col("_name"), F.lit(1), n))
        known = named.filter("_name <> ''").select(F.explode(prefix).alias("arxiv_id"))
    else:
        known = files.select(archive_id(F.col("path")).alias("arxiv_id"))
    return only_for(ids, known, ["arxiv_id"])


def archive_id(path: Column) -> Column:
    """Id in an archive file name: what comes up to and with the version number."""
    return F.regexp_extract(last_segment(path), r"^(.*?v\d+)(?:\..*)?$", 1)


def resolve_downloads(pending: DataFrame, available: DataFrame, refused: DataFrame | None = None) -> DataFrame:
    """Per pending id the artifact to take and the resulting status.

    ``available``: (artifact_id, kind) with kind ``stored`` (an archive is
    already here), ``src`` or ``pdf``. First hit of :data:`CANDIDATES` wins and
    is filed under the id it was found for. Offers are folded to one row per id
    first, so an id offered very often is no hot spot. ``refused`` (artifact_id,
    kind) names offers that turned out to be of no use: they are passed over, so
    a rejected source falls through to the PDF and then to the previous version.
    """
    if refused is not None:
        useless = refused.select("artifact_id", "kind").distinct()
        available = available.select("artifact_id", "kind").distinct().join(
            useless, ["artifact_id", "kind"], "left_anti"
        )
    offers = available.groupBy("artifact_id").agg(
        *[F.max(F.col("kind") == kind).alias(kind) for kind in ("stored", "src", "pdf")]
    )
    own = offers.select(
        F.col("artifact_id").alias("arxiv_id"), F.struct("stored", "src", "pdf").alias("own")
    )
    previous = offers.select(
        F.col("artifact_id").alias("previous_id"), F.struct("src", "pdf").alias("previous")
    )
    ids = pending.select("arxiv_id", previous_version_id(F.col("arxiv_id")).alias("previous_id"))
    offered = ids.join(own, "arxiv_id", "left").join(previous, "previous_id", "left")

    reused = F.coalesce(F.col("own.stored"), F.lit(False))
    choice = F.when(reused, F.struct(F.lit(0).alias("rank"), F.col("arxiv_id").alias("id"), F.lit("stored").alias("kind")))
    for rank, version, kind in CANDIDATES:
        filed = F.col("arxiv_id") if version == "own" else F.col("previous_id")
        choice = choice.when(
            F.col(f"{version}.{kind}"),
            F.struct(F.lit(rank).alias("rank"), filed.alias("id"), F.lit(kind).alias("kind")),
        )
    return offered.withColumn("_choice", choice).select(
        "arxiv_id",
        F.when(F.col("_choice").isNull(), "FAILED").otherwise("COMPLETED").alias("download_status"),
        F.col("_choice.rank").alias("rank"),
        F.col("_choice.id").alias("artifact_id"),
        F.col("_choice.kind").alias("kind"),
    )


def rejected_choices(choices: DataFrame, rejects: DataFrame) -> DataFrame:
    """(arxiv_id) whose chosen source is an archive that was rejected.

    ``choices``: (arxiv_id, artifact_id, kind). The artifact may be filed under
    another id than the paper's own, as that of its previous version.
    """
    refused = refused_sources(rejects).select(F.col("artifact_id"), F.col("kind")).distinct()
    return choices.join(refused, ["artifact_id", "kind"], "left_semi").select("arxiv_id").distinct()


def resolve_again(choices: DataFrame, available: DataFrame, rejects: DataFrame) -> DataFrame:
    """Next choices after some archives were rejected; what was chosen well stays.

    ``rejects`` (id, reason) are all rejected archives so far. An id that falls
    to another source may be rejected once more, so this is repeated with the
    rejects of the newly unpacked archives until none of the choices is among
    them: twice at most, as there are two versions.
    """
    again = rejected_choices(choices, rejects)
    settled = resolve_downloads(again, available, refused_sources(rejects))
    return choices.join(again, "arxiv_id", "left_anti").unionByName(settled)


def download_statistics(resolved: DataFrame, requested: int) -> DataFrame:
    return resolved.agg(
        F.lit(requested).cast("long").alias("requested"),
        F.count(F.lit(1)).alias("attempted"),
        F.count_if(F.col("download_status") == "COMPLETED").alias("completed"),
        F.count_if(F.col("download_status") == "FAILED").alias("failed"),
    )


def main_file(files: DataFrame) -> DataFrame:
    """Per archive the largest ``.tex`` file (suffix in any case), ties by greatest path.

    Each task first reduces its own rows to one per archive.
    """
    tex = files.filter(F.lower("path").endswith(".tex"))
    return tex.groupBy("id").agg(F.max(F.struct("size", "path")).alias("_best")).select(
        "id", F.col("_best.path").alias("path"), F.col("_best.size").alias("size")
    )


def rejected_archives(members: DataFrame) -> DataFrame:
    """(id, reason): unreadable archives and those with a member outside the target folder.

    ``members``: (id, place, path, size, text, error), one row per entry of an
    archive; only files have a size, only TeX files a text. A row with an
    ``error`` stands for what could not be read.
    """
    escapes = F.when(is_unsafe_member(F.col("path")), F.lit("escaping member"))
    return (
        members.groupBy("id")
        .agg(F.min("error").alias("_error"), F.min(escapes).alias("_escape"))
        .select("id", F.coalesce("_error", "_escape").alias("reason"))
        .filter("reason IS NOT NULL")
    )


def archive_members(members: DataFrame) -> DataFrame:
    """The files of every accepted archive."""
    files = members.filter("size IS NOT NULL")
    return files.join(rejected_archives(members).select("id"), "id", "left_anti")


def main_tex(members: DataFrame) -> DataFrame:
    """(id, path, text) of the main TeX file of every accepted archive that has one.

    The choice is made on sizes, paths and places; only then one text per
    archive is looked up. Of two members with one path, the later counts.
    """
    tex = members.filter(F.lower("path").endswith(".tex") & F.col("size").isNotNull())
    best = (
        tex.groupBy("id")
        .agg(F.max(F.struct("size", "path", "place")).alias("_best"))
        .select("id", F.col("_best.place").alias("place"))
        .join(rejected_archives(members).select("id"), "id", "left_anti")
    )
    return tex.join(best, ["id", "place"], "left_semi").select("id", "path", "text")


def refused_sources(rejects: DataFrame) -> DataFrame:
    """(artifact_id, kind) of sources that count as not on offer: their archive was rejected."""
    return rejects.select(
        F.col("id").alias("artifact_id"), F.explode(F.array(F.lit("stored"), F.lit("src"))).alias("kind")
    )
