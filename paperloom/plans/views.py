"""The corpus tables as views over the shared parquet tables.

One SQL text per view serves both engines: ``@name`` is a base table, ``@TS`` the
keyword of a timestamp without zone. Everything grows with the base tables.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from .. import fixed_values as fixed

_ID = "lpad(CAST(doc_id AS STRING), 12, '0')"
_ESCAPED = (
    "replace(replace(replace(replace(text, chr(92), chr(92)||chr(92)), chr(34), chr(92)||chr(34)), "
    "chr(10), chr(92)||'n'), chr(9), chr(92)||'t')"
)
_EVENT_ID = "'e' || CAST(event_id AS STRING) || 'v' || CAST(1 + event_id % 3 AS STRING)"
_EVENT_PREVIOUS = "'e' || CAST(event_id AS STRING) || 'v' || CAST(event_id % 3 AS STRING)"

# one data point per document, an unknown one for every tenth
_DATA_POINT = "CASE CAST(doc_id % 10 AS INT) {} ELSE 'OTHER' END".format(
    " ".join(f"WHEN {i} THEN '{p}'" for i, p in enumerate(p for points in fixed.EVIDENCE_THEMES.values() for p in points))
)

VIEWS: dict[str, str] = {
    "pages": "SELECT page_id, url, html FROM @pages",
    "metadata": f"""
        SELECT {_ID} AS id,
          CASE WHEN doc_id % 7 = 0 THEN NULL ELSE source END AS submitter,
          'Author of ' || source AS authors,
          CASE WHEN doc_id % 17 = 0 THEN '' ELSE split_part(text, chr(10), 1) END AS title,
          CAST(NULL AS STRING) AS comments,
          CASE WHEN doc_id % 2 = 0 THEN 'J. ' || lang END AS journal_ref,
          CASE WHEN doc_id % 3 = 0 THEN NULL WHEN doc_id % 3 = 1 THEN ''
            ELSE '10.1/' || CAST(doc_id AS STRING) END AS doi,
          CAST(NULL AS STRING) AS report_no,
          CASE CAST(doc_id % 5 AS INT) WHEN 0 THEN 'cs.AI' WHEN 1 THEN 'cs.SE cs.LG'
            WHEN 2 THEN 'cs.AIx math.CO' WHEN 3 THEN 'stat.ML' ELSE 'cs.CL cs.AI' END AS categories,
          lang AS license,
          text AS abstract,
          CASE CAST(doc_id % 11 AS INT) WHEN 0 THEN '[]'
            WHEN 1 THEN '[{{"version":"v1"}},{{"version":"v2"}}]'
            WHEN 2 THEN '[{{"version":"v12"}},{{"version":"v3"}}]'
            WHEN 3 THEN '["v5",{{"version":7}}]'
            WHEN 4 THEN 'no json'
            WHEN 5 THEN '[{{"version":"' || CAST(1 + doc_id % 40 AS STRING) || '"}}]'
            WHEN 6 THEN '[{{"v":"v4"}}]'
            WHEN 7 THEN '[{{"version":2.9}},{{"version":"draft v' || CAST(doc_id % 30 AS STRING) || ' b3"}}]'
            WHEN 8 THEN '[{{"version":null,"v":"3"}},null]'
            WHEN 9 THEN '[{{"version":"","v":"v6"}}] x'
            ELSE '[{{"version":true}},"6"]' END AS versions,
          DATE '2025-08-01' + CAST(doc_id % 90 AS INT) AS update_date,
          '[["' || source || '","",""]]' AS authors_parsed,
          @TS '2025-10-01 00:00:00' AS created_at,
          @TS '2025-10-01 00:00:00' AS updated_at
        FROM @documents""",
    "papers": f"""
        SELECT {_EVENT_ID} AS arxiv_id,
          CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
            ELSE 'PENDING' END AS download_status,
          CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SRC' WHEN 2 THEN 'HTML'
            ELSE 'PDF' END AS download_type,
          CASE WHEN event_id % 2 = 0 THEN 'PENDING' ELSE 'DONE' END AS llm_check_status,
          ts AS created_at, ts AS updated_at,
          CASE WHEN event_id % 5 > 0
            THEN lpad(CAST(CAST(floor(event_id / 9.5) AS BIGINT) AS STRING), 12, '0') END AS metadata_id
        FROM @events""",
    "raw_papers": f"""
        SELECT {_EVENT_ID} AS arxiv_id,
          CASE CAST(event_id % 5 AS INT) WHEN 0 THEN 'PENDING' WHEN 1 THEN 'SRC' WHEN 2 THEN 'HTML'
            WHEN 3 THEN 'PDF' ELSE 'tar' END AS download_type,
          CASE CAST(event_id % 4 AS INT) WHEN 0 THEN 'PENDING' WHEN 1 THEN 'COMPLETED'
            WHEN 2 THEN 'failed' END AS download_status
        FROM @events""",
    "taxonomy_labels": """
        SELECT DISTINCT CAST(substr(source, 4) AS INT) + 1 AS id, source AS name FROM @documents""",
    "questions": """
        SELECT CAST(item_id + 1 AS INT) AS id, 'q' || CAST(item_id AS STRING) AS name, text AS prompt,
          CAST(item_id % 21 + 1 AS INT) AS label_id, @TS '2025-10-01 00:00:00' AS created_at
        FROM @benchmark""",
    "metadata_labels": f"""
        SELECT {_ID} AS metadata_id, CAST(quality AS INT) AS label_id, CAST(0.90 AS DECIMAL(3,2)) AS confidence_score,
          @TS '2025-10-02 00:00:00' AS created_at, @TS '2025-10-02 00:00:00' AS updated_at
        FROM @labels WHERE quality = 1
        UNION ALL
        SELECT {_ID}, CAST(toxic + 1 AS INT), CAST(0.75 AS DECIMAL(3,2)),
          @TS '2025-10-02 00:00:00', @TS '2025-10-02 00:00:00'
        FROM @labels WHERE toxic = 1""",
    "labeling_queue": f"""
        SELECT CASE WHEN doc_id % 29 = 0 THEN 'gone' || CAST(doc_id AS STRING) ELSE {_ID} END AS metadata_id,
          CASE WHEN doc_id % 31 = 0 THEN NULL WHEN doc_id % 37 = 0 THEN -1
            ELSE CAST(1 + doc_id % 7 AS INT) END AS question_id
        FROM @documents
        UNION ALL
        SELECT {_ID}, CAST(22 + doc_id % 7 AS INT) FROM @documents WHERE doc_id % 3 = 0""",
    "download_queue": f"""
        SELECT {_EVENT_ID} AS arxiv_id,
          CASE event_type WHEN 'purchase' THEN 'COMPLETED' WHEN 'error' THEN 'FAILED'
            ELSE 'PENDING' END AS download_status,
          ts AS created_at, ts AS updated_at
        FROM @events""",
    "label_changes": f"""
        SELECT {_ID} AS metadata_id, CAST(1 + doc_id % 3 AS INT) AS label_id,
          CAST(1 + doc_id % 5 AS INT) AS question_id,
          CASE WHEN doc_id % 4 > 0 THEN CAST(0.55 AS DECIMAL(3,2)) END AS confidence_score
        FROM @documents
        UNION ALL
        SELECT {_ID}, CAST(1 + doc_id % 3 AS INT), 3,
          CASE WHEN doc_id % 6 > 0 THEN CAST(0.33 AS DECIMAL(3,2)) END
        FROM @documents""",
    "status_changes": """
        SELECT 'e' || CAST(event_id - event_id % 4 AS STRING) || 'v'
            || CAST(1 + (event_id - event_id % 4) % 3 AS STRING) AS arxiv_id,
          event_id AS seq,
          CASE event_type WHEN 'click' THEN 'COMPLETED' WHEN 'view' THEN 'FAILED'
            ELSE 'PENDING' END AS download_status,
          CASE WHEN event_id % 3 = 0 THEN 'PDF' ELSE 'SRC' END AS download_type,
          CASE WHEN event_id % 5 = 0 THEN NULL ELSE event_type END AS llm_check_status,
          event_id % 4 < 2 AS sets_status, event_id % 3 < 2 AS sets_type, event_id % 7 < 5 AS sets_llm
        FROM @events""",
    "page_texts": """
        SELECT 'c' || CAST(conv_id AS STRING) AS id, turn AS page_no,
          CASE WHEN turn % 5 = 4 THEN '' WHEN turn % 5 = 3 THEN '   '
            ELSE '  ' || text || ' ' END AS text
        FROM @conversations""",
    "messages": """
        SELECT conv_id, turn, CASE WHEN role = 'assistant' AND conv_id % 2 = 0 THEN 'model'
            WHEN role = 'user' AND conv_id % 5 = 0 AND turn = 1 THEN ' User'
            WHEN role = 'assistant' AND turn % 4 = 3 THEN 'system' ELSE role END AS role, text
        FROM @conversations""",
    "files": """
        SELECT 'p' || CAST(page_id % 50 AS STRING) || 'v1' AS id,
          'a/' || CAST(page_id AS STRING) || CASE CAST(page_id % 3 AS INT) WHEN 0 THEN '.TeX'
            WHEN 1 THEN '.tex' ELSE '.bib' END AS path,
          CAST(length(html) AS BIGINT) AS size
        FROM @pages""",
    "stored_archives": """
        SELECT 'store/e' || CAST(page_id * 3 AS STRING) || 'v' || CAST(1 + page_id % 3 AS STRING)
          || CASE WHEN page_id % 2 = 0 THEN '.tar.gz' ELSE '0.Some_title.tar.gz' END AS path
        FROM @pages""",
    "available": f"""
        SELECT CASE CAST(CAST(floor(event_id / 3.0) AS BIGINT) % 6 AS INT)
            WHEN 0 THEN {_EVENT_ID} WHEN 1 THEN {_EVENT_ID} WHEN 2 THEN {_EVENT_PREVIOUS}
            WHEN 3 THEN {_EVENT_PREVIOUS} WHEN 4 THEN {_EVENT_ID}
            ELSE 'e' || CAST(event_id AS STRING) || 'v99' END AS artifact_id,
          CASE CAST(CAST(floor(event_id / 3.0) AS BIGINT) % 6 AS INT)
            WHEN 0 THEN 'src' WHEN 1 THEN 'pdf' WHEN 2 THEN 'src' WHEN 3 THEN 'pdf'
            WHEN 4 THEN 'stored' ELSE 'src' END AS kind
        FROM @events
        UNION ALL
        SELECT {_EVENT_ID}, 'pdf' FROM @events WHERE event_id % 4 = 0""",
    "sources": f"""
        SELECT {_ID} AS id, 'tex' AS kind, doc_id % 5 > 0 AS ok FROM @documents WHERE doc_id % 2 = 0
        UNION ALL
        SELECT {_ID}, 'pdf', doc_id % 7 > 0 FROM @documents WHERE doc_id % 3 > 0
        UNION ALL
        SELECT {_ID}, 'md', true FROM @documents WHERE doc_id % 11 = 0""",
    "metadata_lines": f"""
        SELECT doc_id AS line_no,
          CASE WHEN doc_id % 50 = 7 THEN '  ' || chr(9)
            ELSE ' ' || CASE CAST(doc_id % 10 AS INT)
              WHEN 9 THEN 'broken {{' || source
              WHEN 8 THEN '["' || {_ID} || '"]'
              ELSE '{{"id": ' || CASE CAST(doc_id % 10 AS INT) WHEN 6 THEN CAST(doc_id AS STRING)
                  WHEN 5 THEN '""' ELSE '"' || {_ID} || '"' END
                || ', "submitter": null, "authors": "Author of ' || source || '"'
                || CASE WHEN doc_id % 10 = 4 THEN '' ELSE ', "title": "T ' || CAST(doc_id AS STRING) || '"' END
                || CASE WHEN doc_id % 3 = 0 THEN ', "doi": null' ELSE ', "doi": "10.1/'
                  || CAST(doc_id AS STRING) || '"' END
                || ', "journal-ref": "J. ' || lang || '", "extra": {{"a": [1]}}'
                || ', "categories": "cs.AI cs.SE", "abstract": '
                || CASE WHEN doc_id % 10 = 3 THEN 'null' ELSE '"' || {_ESCAPED} || '"' END
                || ', "versions": '
                || CASE WHEN doc_id % 10 = 2 THEN '{{"version": "v1"}}'
                  ELSE '[{{"version": "v1"}}, {{"version": "v' || CAST(1 + doc_id % 9 AS STRING) || '"}}]' END
                || ', "update_date": "' || CASE WHEN doc_id % 13 = 0 THEN 'someday' ELSE '2025-09-'
                  || lpad(CAST(1 + doc_id % 30 AS STRING), 2, '0') END || '"'
                || ', "authors_parsed": [["' || source || '", "", ""]]}}'
                || CASE WHEN doc_id % 10 = 7 THEN ' x' ELSE '' END
              END || chr(9) || ' ' END AS value
        FROM @documents
        UNION ALL
        SELECT doc_id + 1000000000000, '{{"id": "' || {_ID} || '", "authors": "B", "title": "again", '
          || '"categories": "cs.SE", "abstract": "' || {_ESCAPED} || '", "versions": [], '
          || '"update_date": "2025-10-01", "authors_parsed": []}}'
        FROM @documents WHERE doc_id % 2 = 0""",
    "seed_documents": """
        SELECT item_id AS seq, '[{"name": "' || CASE WHEN item_id % 9 = 8 THEN ''
            WHEN item_id % 5 = 0 THEN 'src' || CAST(item_id % 25 AS STRING)
            ELSE 'topic' || CAST(item_id % 13 AS STRING) END
          || '", "questions": [{"name": "q' || CAST(item_id % 4 AS STRING) || '", "prompt": "'
          || replace(replace(replace(text, chr(92), ' '), chr(34), ' '), chr(10), ' ') || '"}, {"name": "r'
          || CAST(item_id AS STRING) || '", "prompt": "Is it about item ' || CAST(item_id AS STRING)
          || '?"}]}, {"name": "bare' || CAST(item_id % 3 AS STRING) || '"}, {"name": null}]' AS value
        FROM @benchmark""",
    "replies": """
        SELECT doc_id, CASE CAST(doc_id % 20 AS INT)
          WHEN 0 THEN '{"answer":true,"confidence":0.9}'
          WHEN 1 THEN '```json' || chr(10) || '{"answer": "Yes ", "confidence": "' || CAST(doc_id % 120 AS STRING)
            || '"}' || chr(10) || '```  '
          WHEN 2 THEN '{"answer":"no","confidence":"0.4"}'
          WHEN 3 THEN 'yes'
          WHEN 4 THEN '[true]'
          WHEN 5 THEN '{"answer":1,"confidence":' || CAST(doc_id % 130 AS STRING) || '}'
          WHEN 6 THEN '{"answer":"TRUE","confidence":"85%"}'
          WHEN 7 THEN '{"answer":null,"confidence":1.5}'
          WHEN 8 THEN '{"answer":true,"confidence":-3}'
          WHEN 9 THEN '{"answer":true,"confidence":true}'
          WHEN 10 THEN '{"answer":true,"confidence":[]}'
          WHEN 11 THEN '{"answer":true,"confidence":null}'
          WHEN 12 THEN '{"answer":true,"confidence":"NaN"}'
          WHEN 13 THEN '{"answer":true,"confidence":"inf"}'
          WHEN 14 THEN ''
          WHEN 15 THEN 'Sure: ```' || chr(10) || '{"answer":true}' || chr(10) || '```'
          WHEN 16 THEN '```{"answer":true}```'
          WHEN 17 THEN '{"answer":true,"confidence":0.7} trailing'
          WHEN 18 THEN '```' || chr(10) || '  {"answer":false,"confidence":"7d"}' || chr(10) || '```'
          ELSE '{"answer":"' || source || '","why":"' || lang || '"}' END AS reply
        FROM @documents""",
    "evidence_replies": f"""
        SELECT lpad(CAST(doc_id AS STRING), 12, '0') AS id, CASE CAST(doc_id % 6 AS INT)
          WHEN 0 THEN 'no record'
          WHEN 1 THEN '{{"datapunt_id":"' || {_DATA_POINT} || '","bewijs_gevonden":false}}'
          ELSE '```json' || chr(10) || '{{"datapunt_id":"' || {_DATA_POINT} || '","bewijs_gevonden":true,"type_bewijs":"'
            || CASE CAST(doc_id % 4 AS INT) WHEN 0 THEN 'kwantitatief' WHEN 1 THEN 'kwalitatief'
              WHEN 2 THEN 'anekdotisch' ELSE 'anders' END
            || '","samenvatting_bewijs":"s","specifieke_metrics":[{{"metric_naam":"m","waarde":"15%","context":"c"}}'
            || CASE WHEN doc_id % 2 = 0 THEN ',{{"metric_naam":"n","waarde":"1","context":"d"}}' ELSE '' END
            || '],"direct_citaat":"' || CASE WHEN doc_id % 5 = 0 THEN 'not in the text at all' ELSE
              replace(replace(split_part(text, ' ', 3), chr(34), ''), chr(92), '') END
            || '","bronvermelding":"' || source || '"}}' || chr(10) || '```' END AS reply
        FROM @documents""",
    "quotes": " UNION ALL ".join(
        f"""
        SELECT lpad(CAST(doc_id AS STRING), 12, '0') AS id, {quote} AS direct_citaat FROM @documents"""
        for quote in (
            "split_part(text, ' ', 2) || ' ' || split_part(text, ' ', 3)",
            "split_part(text, ' ', 5)",
            "split_part(text, ' ', 5)",
            "split_part(text, ' ', 3) || ' ' || split_part(text, ' ', 2)",
            "CASE WHEN doc_id % 3 = 0 THEN '' WHEN doc_id % 3 = 1 THEN source ELSE 'not in the text' END",
            "CAST(NULL AS STRING)",
        )
    )
    + """
        UNION ALL
        SELECT '000000000007', split_part(text, ' ', 4) FROM @documents""",
    "evidence_verdicts": f"""
        SELECT lpad(CAST(doc_id AS STRING), 12, '0') AS id, {_DATA_POINT} AS datapunt_id, CASE CAST(doc_id % 11 AS INT)
          WHEN 0 THEN 'no verdict' WHEN 1 THEN '{{"validatie_geslaagd":false,"opmerkingen":"wrong value"}}'
          WHEN 2 THEN '{{"validatie_geslaagd":"true"}}' ELSE '{{"validatie_geslaagd":true,"opmerkingen":"fine"}}' END AS reply
        FROM @documents WHERE doc_id % 13 > 0
        UNION ALL
        SELECT lpad(CAST(doc_id AS STRING), 12, '0'), {_DATA_POINT}, '{{"validatie_geslaagd":false,"opmerkingen":"second look"}}'
        FROM @documents WHERE doc_id % 17 = 0""",
    "member_paths": """
        SELECT page_id, CASE CAST(page_id % 8 AS INT) WHEN 0 THEN '../' || url WHEN 1 THEN '/' || url
          WHEN 2 THEN 'a/../../b' WHEN 3 THEN 'a/../' || url WHEN 4 THEN './x/../y/' || url
          WHEN 5 THEN 'a/b/../../../' || url WHEN 6 THEN url ELSE '..' END AS path
        FROM @pages""",
    "texts": """
        SELECT lpad(CAST(doc_id AS STRING), 12, '0') AS id,
          replace(text, chr(10), chr(10) || chr(10)) AS text FROM @documents""",
}


# Columns of the base tables that the views read; a given schema saves Spark the
# job that looks it up in a file footer.
BASE_TABLES = {
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "labels": "doc_id bigint, quality int, toxic int",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def base_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.schema(BASE_TABLES[name]).parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _tables_of(name: str) -> set[str]:
    return set(re.findall(r"@(\w+)", VIEWS[name])) - {"TS"}


def view(spark: SparkSession, sf_dir: str, name: str, **given: DataFrame) -> DataFrame:
    """A view as a DataFrame over the parquet files in ``sf_dir``.

    ``given`` replaces base tables by DataFrames, e.g. by a stream.
    """
    text = VIEWS[name].replace("@TS", "TIMESTAMP_NTZ").replace("{", "{{").replace("}", "}}")
    frames = {t: given.get(t) or base_table(spark, sf_dir, t) for t in _tables_of(name)}
    return spark.sql(re.sub(r"@(\w+)", r"{\1}", text), **frames)


def ansi_views(*names: str) -> str:
    """``WITH`` clause of the views for the SQL check."""
    texts = {name: re.sub(r"@(\w+)", r"\1", VIEWS[name].replace("@TS", "TIMESTAMP")) for name in names}
    return "WITH RECURSIVE " + ",\n".join(f"{name} AS ({text})" for name, text in texts.items()) + "\n"
