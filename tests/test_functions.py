"""Golden tables of the scalar rules."""

from __future__ import annotations

import time
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from paperloom.functions import replies, text as text_rules, versions
from paperloom.functions.chunking import chunks
from paperloom.functions.json_rules import parse_strict


def values(spark, inputs, build, columns="v string"):
    """Results in input order."""
    rows = [(i, *(v if isinstance(v, tuple) else (v,))) for i, v in enumerate(inputs)]
    df = spark.createDataFrame(rows, "i int, " + columns)
    return [r[0] for r in df.orderBy("i").select(build).collect()]


VERSIONS = [
    ('[{"version":"v1"},{"version":"v2"}]', 2, "v2"),
    ('[{"version":"v3"},{"version":"v2"}]', 3, "v2"),
    ("[]", 1, "v1"),
    ("null", 1, "v1"),
    ("bad", 1, "v1"),
    ("", 1, "v1"),
    ("[5]", 1, "v1"),
    ('{"version":"v9"}', 1, "v1"),
    ('[{"version":"2"}]', 2, "v2"),
    ('[{"version":2}]', 2, "v1"),
    ('[{"version":2.9}]', 2, "v1"),
    ('[{"version":true}]', 1, "v1"),
    ('[{"version":-3}]', 1, "v1"),
    ('[{"v":"v4"}]', 1, "v4"),
    ('["v5"]', 1, "v5"),
    ('["5"]', 1, "v5"),
    ('[{"version":"V2"}]', 2, "vV2"),
    ('[{"version":"draft v12 b3"}]', 12, "vdraft v12 b3"),
    ('[{"version":"","v":"v6"}]', 1, "v6"),
    ('[{"version":null,"v":"3"}]', 1, "v3"),
    ('[{"version":0,"v":"v3"}]', 1, "v3"),
    ('[{"version":[],"v":"v3"}]', 1, "v3"),
    ('[{"version":{},"v":"v3"}]', 1, "v3"),
    ('[{"version":[null],"v":"v3"}]', 1, "v1"),
    ('[{"version":false,"v":"v3"}]', 1, "v3"),
    ('[{"version":"v0"}]', 1, "v0"),
    ('[{"version":"v2"},null]', 2, "v1"),
    ('["v5",{"version":7}]', 7, "v1"),
    ('[""]', 1, "v"),
    ('[{"version":"v8"}] x', 1, "v1"),
    ('[{"version":"v8"}]]]', 1, "v1"),
]


def test_max_version(spark):
    got = values(spark, [v for v, _, _ in VERSIONS], versions.max_version(F.col("v")))
    assert got == [n for _, n, _ in VERSIONS]


def test_last_version(spark):
    got = values(spark, [v for v, _, _ in VERSIONS], versions.last_version_id(F.lit("x"), F.col("v")))
    assert got == ["x" + s for _, _, s in VERSIONS]
    assert values(spark, [None], versions.last_version_id(F.lit("x"), F.col("v"))) == ["xv1"]


def test_previous_version(spark):
    pairs = {
        "2510.01576v3": "2510.01576v2", "hep-th/9901001v2": "hep-th/9901001v1", "av10": "av9",
        "avv2": "avv1", "2510.01576v1": None, "av0": None, "x": None,
    }
    assert values(spark, list(pairs), versions.previous_version_id(F.col("v"))) == list(pairs.values())


REPLIES = [
    ('{"answer":true,"confidence":0.9}', True, "0.90"),
    ('{"answer":false,"confidence":85}', False, "0.85"),
    ('{"answer":"Yes ","confidence":"85"}', True, "0.85"),
    ('{"answer":"TRUE","confidence":"85%"}', True, None),
    ('{"answer":"no"}', False, None),
    ('{"answer":1,"confidence":1}', False, "1.00"),
    ('{"answer":null,"confidence":1.5}', False, "0.02"),
    ('{"answer":true,"confidence":100}', True, "1.00"),
    ('{"answer":true,"confidence":101}', True, "1.00"),
    ('{"answer":true,"confidence":-3}', True, "0.00"),
    ('{"answer":true,"confidence":true}', True, "1.00"),
    ('{"answer":true,"confidence":[]}', True, None),
    ('{"answer":true,"confidence":null}', True, None),
    ('{"answer":true,"confidence":"NaN"}', True, "1.00"),
    ('{"answer":true,"confidence":"inf"}', True, "1.00"),
    ('{"answer":true,"confidence":"7d"}', True, None),
    ('{"answer":true,"confidence":"1_0"}', True, "0.10"),
    ('{"answer":true,"confidence":" 0.5 "}', True, "0.50"),
    ("yes", False, None),
    ("[true]", False, None),
    ("", False, None),
    ('```json\n{"answer":true,"confidence":0.5}\n```  \n', True, "0.50"),
    ('```\n\n  {"answer":true}\n\n```', True, None),
    ('Sure: ```\n{"answer":true}\n```', False, None),
    ('```{"answer":true}```', False, None),
    ('{"answer":true} and more', False, None),
    ('{"answer":true}]] x', False, None),
    ('{"answer":true},{"answer":true}', False, None),
    ('{"answer":false,"answer":true}', True, None),
]


def test_parse_reply(spark):
    got = values(spark, [r for r, _, _ in REPLIES], replies.parse_reply(F.col("v")))
    want = [(a, None if c is None else Decimal(c)) for _, a, c in REPLIES]
    assert [(r["answer"], r["confidence"]) for r in got] == want
    missing = values(spark, [None], replies.parse_reply(F.col("v")))[0]
    assert (missing["answer"], missing["confidence"]) == (False, None)


@pytest.mark.parametrize(
    ("value", "valid"),
    [
        ('{"a":1}', True), (' {"a":{"b":[[{}]]}} ', True), ('{"a":1} x', False), ('{"a":1}]]', False),
        ('{"a":1}] ] ,', False), ('{"a":1}],[{"a":1}', False), ('{"a":1},2', False), ("", False),
        ('{"a":[[{"b":1}]]}', True), ('{"a":[[{"b":1}]]}]]', False), ('{"a":"}]]"}', True),
    ],
)
def test_parse_strict(spark, value, valid):
    assert values(spark, [value], parse_strict(F.col("v")).isNotNull()) == [valid]


def test_strip_removes_all_whitespace(spark):
    blanks = "".join(chr(c) for c in range(0x110000) if chr(c).isspace())
    assert values(spark, [blanks + "a b" + blanks], text_rules.strip(F.col("v"))) == ["a b"]


def test_file_stem(spark):
    names = {"a/b/2510.01576v2.tex": "2510.01576v2", "x.pdf": "x", "a.b/c": "c", "a/.tex": ".tex"}
    assert values(spark, list(names), text_rules.file_stem(F.col("v"))) == list(names.values())


def test_unsafe_member(spark):
    paths = {"a/b": False, "../a": True, "a/../../b": True, "a/../b": False, "/etc": True, "./a/..": False, "..": True}
    assert values(spark, list(paths), text_rules.is_unsafe_member(F.col("v"))) == list(paths.values())


def cut_by_hand(text: str, limit: int) -> list[str]:
    """The cutting rule on a list of paragraph borders, stated apart from the SQL."""
    if len(text) <= limit:
        return [text]
    borders = [i for i in range(len(text) - 1) if text[i] == text[i + 1] == "\n"]
    pieces, at = [], 0
    while at < len(text):
        end = min(at + limit, len(text))
        good = [b for b in borders if at + int(limit * 0.85) < b and b + 2 <= end]
        cut = good[-1] if good else end
        pieces.append(text[at:cut])
        at = cut
    return pieces


def test_chunks_match_rule(spark):
    import random

    random.seed(7)
    texts = ["", "a", "\n" * 50, "x" * 18 + "\n\n" + "y" * 10, "x" * 17 + "\n\n" + "y" * 10]
    texts += ["".join(random.choices("ab\n é😀", (4, 2, 6, 1, 1, 1), k=random.randint(0, 400))) for _ in range(400)]
    for limit in (7, 20, 50):
        got = values(spark, texts, chunks(F.col("v"), limit))
        assert got == [cut_by_hand(t, limit) for t in texts]
        assert ["".join(c) for c in got] == texts


def test_chunking_is_linear(spark):
    """Time grows like the text: 2 MB of many small chunks in seconds."""
    seconds = []
    for megabytes in (1, 2, 4):
        df = spark.range(1).select(F.expr(f"repeat('some words of a paragraph\\n\\n', {megabytes * 37_000})").alias("v"))
        start = time.perf_counter()
        total, parts = df.select(chunks(F.col("v"), 100).alias("c")).select(
            F.length(F.array_join("c", "")), F.size("c")
        ).first()
        seconds.append(time.perf_counter() - start)
        assert total == megabytes * 37_000 * 27 and parts > 10_000 * megabytes * 0.9
    assert seconds[2] < 4 * max(seconds[0], 1.0) + 2
