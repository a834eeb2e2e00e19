"""Checks of the declared table rules, and the effects of deleting a parent row."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from .. import fixed_values as fixed
from ..schemas import TABLES

# child table, child column, parent table
FOREIGN_KEYS = (
    ("papers", "metadata_id", "metadata"),
    ("questions", "label_id", "labels"),
    ("metadata_labels", "metadata_id", "metadata"),
    ("metadata_labels", "label_id", "labels"),
    ("labeling_queue", "metadata_id", "metadata"),
    ("labeling_queue", "question_id", "questions"),
)
UNIQUE = (("labels", ("name",)), ("questions", ("name", "label_id")))


def integrity_report(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, rule, key, rows): every key that breaks a rule, with its row count.

    Each table is read once. A row names the keys it takes part in, each with the
    rule or the parent table it belongs to; all tables are put together and
    counted by key, side by side and with one shuffle. Copies of a key are
    counted before they are shuffled.
    """
    domains: list[tuple[str, str]] = []  # (table, rule) of own rules, (parent, "") of references
    unique: list[int] = []
    references = [fk for fk in FOREIGN_KEYS if fk[0] in tables and fk[2] in tables]

    def domain(table: str, rule: str) -> Column:
        if (table, rule) not in domains:
            domains.append((table, rule))
        return F.lit(domains.index((table, rule)))

    def entry(where: Column, key: Column, role: int) -> Column:
        return F.struct(where.alias("domain"), key.alias("key"), F.lit(role).alias("role"))

    def entries(table: str, df: DataFrame) -> DataFrame:
        named = []
        for rule, columns, broken in _row_rules(table):
            named.append(entry(domain(table, rule), _key(columns), -1))
            if broken is None:
                unique.append(domains.index((table, rule)))
            else:
                named[-1] = F.when(broken, named[-1])
        if any(parent == table for _, _, parent in references):
            named.append(entry(domain(table, ""), F.col("id").cast("string"), -1))
        for number, (child, column, parent) in enumerate(references):
            if child == table:
                given = F.col(column).cast("string")
                named.append(F.when(given.isNotNull(), entry(domain(parent, ""), given, number)))
        return df.select(F.inline(F.array_compact(F.array(*named))))

    put_together = reduce(DataFrame.unionByName, [entries(name, df) for name, df in tables.items()])
    role = F.col("role")
    counted = put_together.groupBy("domain", "key").agg(
        F.count_if(role == -1).alias("own"),
        F.array(*[F.count_if(role == number) for number in range(len(references))]).alias("children"),
    )
    # a reference is broken where no parent has the key, a uniqueness rule from two rows on
    parents = [number for number, (_, rule) in enumerate(domains) if not rule]
    broken = (F.col("own") > 1) | ~F.col("domain").isin(*unique)
    own = F.when(
        broken & ~F.col("domain").isin(*parents) if parents else broken,
        F.struct(
            F.element_at(F.array(*[F.lit(t) for t, _ in domains]), F.col("domain") + 1).alias("table_name"),
            F.element_at(F.array(*[F.lit(r) for _, r in domains]), F.col("domain") + 1).alias("rule"),
            "key",
            F.col("own").alias("rows"),
        ),
    )
    lost = [
        F.when(
            (F.col("own") == 0) & (F.col("children")[number] > 0),
            F.struct(
                F.lit(child).alias("table_name"), F.lit(f"foreign key {column}").alias("rule"), "key",
                F.col("children")[number].alias("rows"),
            ),
        )
        for number, (child, column, _) in enumerate(references)
    ]
    return counted.select(F.inline(F.array_compact(F.array(own, *lost))))


def _key(columns: Sequence[str]) -> Column:
    texts = [F.coalesce(F.col(c).cast("string"), F.lit("NULL")) for c in columns]
    return F.concat_ws("|", *texts)


def _row_rules(table: str) -> list[tuple[str, Sequence[str], Column | None]]:
    """(rule, key columns, broken): without ``broken`` the rule is that no key occurs twice."""
    schema, key = TABLES[table]
    rules = [(f"primary key {'+'.join(key)}", key, None)]
    rules += [(f"unique {'+'.join(columns)}", columns, None) for t, columns in UNIQUE if t == table]
    rules += [(f"not null {f.name}", key, F.col(f.name).isNull()) for f in schema.fields if not f.nullable]
    if table == "download_queue":
        rules.append(("check download_status", key, ~F.col("download_status").isin(*fixed.QUEUE_STATUSES)))
    if table == "labels":
        rules.append(("length name", key, F.char_length("name") > fixed.LABEL_NAME_MAX_CHARS))
    return rules


def delete_metadata(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Next state after deleting papers' metadata (``ids``: column id).

    Labels and queued jobs of a deleted row go with it; papers stay and lose
    their reference.
    """
    gone = ids.select(F.col("id").alias("metadata_id")).distinct()
    papers = tables["papers"].join(gone.withColumn("_gone", F.lit(True)), "metadata_id", "left")
    return {
        **tables,
        "metadata": tables["metadata"].join(ids.select("id"), "id", "left_anti"),
        "metadata_labels": tables["metadata_labels"].join(gone, "metadata_id", "left_anti"),
        "labeling_queue": tables["labeling_queue"].join(gone, "metadata_id", "left_anti"),
        "papers": papers.select(
            *[
                F.when(F.col("_gone").isNull(), F.col(c)).alias(c) if c == "metadata_id" else F.col(c)
                for c in tables["papers"].columns
            ]
        ),
    }


def removed_with_metadata(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Keys of all rows that go when papers' metadata (``ids``: column id) is deleted, by table.

    Only keys are read; a stored table is cut to them, not written anew.
    """
    gone = ids.select(F.col("id").alias("metadata_id")).distinct()
    keys = {
        name: tables[name].select(TABLES[name][1]).join(gone, "metadata_id", "left_semi")
        for name in ("metadata_labels", "labeling_queue")
    }
    return {"metadata": tables["metadata"].select("id").join(ids.select("id"), "id", "left_semi"), **keys}


def papers_without_metadata(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """The papers that lose their reference when metadata (``ids``: column id) is deleted."""
    gone = ids.select(F.col("id").alias("metadata_id")).distinct()
    return papers.join(gone, "metadata_id", "left_semi").withColumn("metadata_id", F.lit(None).cast("string"))


def removed_with_labels(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Keys of all rows that go when labels (``ids``: column id) are deleted, by table."""
    gone = ids.select(F.col("id").alias("label_id")).distinct()
    questions = tables["questions"].join(gone, "label_id", "left_semi").select("id")
    asked = questions.select(F.col("id").alias("question_id"))
    return {
        "labels": tables["labels"].select("id").join(ids.select("id"), "id", "left_semi"),
        "questions": questions,
        "labeling_queue": tables["labeling_queue"].select(TABLES["labeling_queue"][1]).join(asked, "question_id", "left_semi"),
        "metadata_labels": tables["metadata_labels"].select(TABLES["metadata_labels"][1]).join(gone, "label_id", "left_semi"),
    }


def delete_labels(tables: dict[str, DataFrame], ids: DataFrame) -> dict[str, DataFrame]:
    """Next state after deleting labels (``ids``: column id): their questions, the
    jobs queued for those questions and the labels given to papers go with them."""
    gone = ids.select(F.col("id").alias("label_id"))
    lost_questions = tables["questions"].join(gone, "label_id", "left_semi").select(
        F.col("id").alias("question_id")
    )
    return {
        **tables,
        "labels": tables["labels"].join(ids.select("id"), "id", "left_anti"),
        "questions": tables["questions"].join(gone, "label_id", "left_anti"),
        "labeling_queue": tables["labeling_queue"].join(lost_questions, "question_id", "left_anti"),
        "metadata_labels": tables["metadata_labels"].join(gone, "label_id", "left_anti"),
    }
