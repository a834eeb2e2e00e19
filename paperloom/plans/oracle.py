"""The same results as :mod:`paperloom.plans.queries`, spelled in ANSI SQL (DuckDB)."""

from __future__ import annotations

from .. import fixed_values as fixed
from .queries import AS_OF, CHUNK_CHARS, LABEL_ID, MANY, QUESTION_ID
from .views import ansi_views


def _quote(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


_SPACES = "' ' || chr(9) || chr(10) || chr(13)"
_STAMP = f"'{AS_OF}'"

# ---- validation ---------------------------------------------------------

_LINES = f"""
lines AS (SELECT line_no, trim(value, {_SPACES}) AS value FROM metadata_lines),
scanned AS (
  SELECT line_no, value, coalesce(json_valid(value) AND json_type(CASE WHEN json_valid(value) THEN value END) = 'OBJECT', false) AS is_object
  FROM lines WHERE value <> ''),
docs AS (SELECT line_no, value, is_object, CASE WHEN is_object THEN CAST(value AS JSON) END AS doc FROM scanned)"""

_JSON_KIND = {"string": "'VARCHAR'", "null": "'NULL'", "array": "'ARRAY'"}


def _checks() -> str:
    checks = []
    for name, kinds in fixed.METADATA_FIELD_TYPES.items():
        found = f"""json_type(doc, '$."{name}"')"""
        if name in fixed.METADATA_REQUIRED:
            checks.append(f"CASE WHEN {found} IS NULL THEN '{name}:required' END")
        allowed = ", ".join(_JSON_KIND[k] for k in kinds)
        checks.append(f"CASE WHEN {found} NOT IN ({allowed}) THEN '{name}:type' END")
    checks.append("CASE WHEN doc ->> '$.id' = '' THEN 'id:empty' END")
    return ", ".join(checks)


_CHECKED = f"""{_LINES},
checked AS (
  SELECT *, CASE WHEN is_object
    THEN list_sort(list_filter([{_checks()}], lambda x: x IS NOT NULL)) ELSE ['record:object'] END AS violations
  FROM docs)"""

_ROWS = f"""{_CHECKED},
accepted AS (
  SELECT line_no, doc ->> '$.id' AS id, doc ->> '$.submitter' AS submitter, doc ->> '$.authors' AS authors,
    doc ->> '$.title' AS title, doc ->> '$.comments' AS comments, doc ->> '$."journal-ref"' AS journal_ref,
    doc ->> '$.doi' AS doi, doc ->> '$."report-no"' AS report_no, doc ->> '$.categories' AS categories,
    doc ->> '$.license' AS license, md5(doc ->> '$.abstract') AS abstract,
    CAST(doc -> '$.versions' AS VARCHAR) AS versions,
    CAST(TRY_CAST(doc ->> '$.update_date' AS DATE) AS VARCHAR) AS update_date,
    CAST(doc -> '$.authors_parsed' AS VARCHAR) AS authors_parsed,
    {_STAMP} AS created_at, {_STAMP} AS updated_at
  FROM checked WHERE len(violations) = 0),
stored AS (SELECT id FROM metadata WHERE id IN (SELECT metadata_id FROM metadata_labels))"""

_ROW_COLUMNS = (
    "id, submitter, authors, title, comments, journal_ref, doi, report_no, categories, license, "
    "abstract, versions, update_date, authors_parsed, created_at, updated_at"
)

_SEED = f"""
listed AS (
  SELECT seq, CAST(i.unnest AS INT) AS label_pos, json_extract(CAST(value AS JSON), '$[' || i.unnest || ']') AS item
  FROM seed_documents, unnest(range(CAST(json_array_length(value) AS BIGINT))) AS i),
named AS (SELECT seq, label_pos, item, item ->> '$.name' AS label FROM listed WHERE coalesce(item ->> '$.name', '') <> ''),
asked AS (
  SELECT seq, label_pos, i.unnest AS question_pos, label,
    json_extract(item, '$.questions[' || i.unnest || ']') ->> '$.name' AS name,
    json_extract(item, '$.questions[' || i.unnest || ']') ->> '$.prompt' AS prompt
  FROM named, unnest(range(CAST(coalesce(json_array_length(item, '$.questions'), 0) AS BIGINT))) AS i),
new_labels AS (
  SELECT CAST((SELECT max(id) FROM taxonomy_labels) + row_number() OVER (ORDER BY md5(label), label) AS INT) AS id, label AS name
  FROM (SELECT DISTINCT label FROM named) WHERE label NOT IN (SELECT name FROM taxonomy_labels)),
all_labels AS (SELECT id, name FROM taxonomy_labels UNION ALL SELECT id, name FROM new_labels),
first_asked AS (
  SELECT name, prompt, label_id FROM (
    SELECT a.name, a.prompt, l.id AS label_id,
      row_number() OVER (PARTITION BY a.name, l.id ORDER BY seq, label_pos, question_pos) AS rn
    FROM asked a JOIN all_labels l ON l.name = a.label)
  WHERE rn = 1),
new_questions AS (
  SELECT CAST((SELECT max(id) FROM questions) + row_number() OVER (
      ORDER BY md5(CAST(label_id AS VARCHAR) || chr(31) || name), name) AS INT) AS id, name, prompt, label_id
  FROM first_asked f
  WHERE NOT EXISTS (SELECT 1 FROM questions q WHERE q.name = f.name AND q.label_id = f.label_id))"""

_ENTRIES = """
entries AS (
  SELECT *, split_part(url, '/', 3) AS host,
    strftime(DATE '2024-01-01' + CAST(page_id % 300 AS INT), '%Y-%m-%dT00:00:00+00:00') AS day
  FROM pages)"""

# ---- labeling -----------------------------------------------------------

_ENRICHED = """
enriched AS (
  SELECT j.metadata_id, j.question_id, q.label_id, q.prompt, m.title, m.abstract,
    CASE WHEN coalesce(j.metadata_id, '') = '' OR j.question_id IS NULL THEN 'key'
      WHEN q.id IS NULL THEN 'question' WHEN m.id IS NULL THEN 'paper' END AS skip_reason
  FROM jobs j LEFT JOIN questions q ON q.id = j.question_id LEFT JOIN metadata m ON m.id = j.metadata_id)"""

_USER_TEXT = "'QUESTION: ' || prompt || chr(10) || chr(10) || 'TITLE: ' || title || chr(10) || chr(10) || 'ABSTRACT: ' || abstract"

_JUDGED = f"""{_ENRICHED},
asked AS (
  SELECT *, CASE WHEN skip_reason IS NULL AND prompt <> '' AND title <> '' AND abstract <> ''
    THEN length({_USER_TEXT}) % 9 END AS k
  FROM enriched),
judged AS (
  SELECT metadata_id, question_id, label_id, skip_reason, coalesce(k = 8, false) AS failed,
    CASE WHEN skip_reason IS NULL THEN coalesce(k IN (0, 1, 4, 7), false) END AS answer,
    CAST(CASE k WHEN 0 THEN 0.90 WHEN 1 THEN 0.85 WHEN 2 THEN 0.40 WHEN 5 THEN 1.00 WHEN 7 THEN 0.02 END AS DECIMAL(3,2)) AS confidence_score
  FROM asked),
label_changes AS (
  SELECT metadata_id, label_id, question_id, confidence_score FROM judged WHERE answer)"""

_UPSERTED = f"""
latest AS (
  SELECT metadata_id, label_id, confidence_score FROM (
    SELECT *, row_number() OVER (PARTITION BY metadata_id, label_id
      ORDER BY question_id DESC, confidence_score DESC NULLS LAST) AS rn FROM label_changes)
  WHERE rn = 1),
upserted AS (
  SELECT coalesce(c.metadata_id, l.metadata_id) AS metadata_id, coalesce(c.label_id, l.label_id) AS label_id,
    CASE WHEN l.metadata_id IS NOT NULL THEN l.confidence_score ELSE c.confidence_score END AS confidence_score,
    coalesce(CAST(c.created_at AS VARCHAR), {_STAMP}) AS created_at,
    CASE WHEN l.metadata_id IS NOT NULL THEN {_STAMP} ELSE CAST(c.updated_at AS VARCHAR) END AS updated_at
  FROM metadata_labels c FULL JOIN latest l ON l.metadata_id = c.metadata_id AND l.label_id = c.label_id)"""

_UPSERT_COLUMNS = "metadata_id, label_id, CAST(confidence_score AS DOUBLE) AS confidence_score, created_at, updated_at"

_JOBS = "jobs AS (SELECT * FROM labeling_queue)"
_LABELING_VIEWS = ("labeling_queue", "questions", "metadata", "metadata_labels")
_TABLE_VIEWS = (
    "metadata", "papers", "taxonomy_labels", "questions", "metadata_labels", "labeling_queue", "download_queue",
)

# ---- versions -----------------------------------------------------------

_VERSIONS = """
lists AS (
  SELECT id, CASE WHEN json_valid(versions) THEN CASE WHEN json_type(CASE WHEN json_valid(versions) THEN versions END) = 'ARRAY'
    THEN CAST(versions AS JSON) END END AS list FROM metadata),
entries AS (
  SELECT id, i.unnest AS pos, json_array_length(list) AS n, json_extract(list, '$[' || i.unnest || ']') AS e
  FROM lists, unnest(range(CAST(json_array_length(list) AS BIGINT))) AS i),
numbers AS (
  SELECT id, CASE WHEN json_type(e, '$.version') = 'VARCHAR'
      THEN TRY_CAST(regexp_extract(e ->> '$.version', '(?i)v?([0-9]+)', 1) AS BIGINT)
    WHEN json_type(e, '$.version') IN ('UBIGINT', 'BIGINT', 'DOUBLE')
      THEN CAST(trunc(CAST(e ->> '$.version' AS DOUBLE)) AS BIGINT) END AS num FROM entries),
highest AS (
  SELECT m.id, greatest(1, coalesce(max(num), 1)) AS version
  FROM metadata m LEFT JOIN numbers n ON n.id = m.id GROUP BY m.id),
last_text AS (
  SELECT id, CASE WHEN json_type(e) = 'VARCHAR' THEN e ->> '$'
    WHEN json_type(e) = 'OBJECT' THEN CASE
      WHEN json_type(e, '$.version') = 'VARCHAR' AND e ->> '$.version' <> '' THEN e ->> '$.version'
      WHEN json_type(e, '$.version') IS NULL OR e ->> '$.version' = '' OR json_type(e, '$.version') = 'NULL'
        OR e ->> '$.version' IN ('false', '0', '[]', '{}')
        THEN CASE WHEN json_type(e, '$.v') = 'VARCHAR' THEN nullif(e ->> '$.v', '') END END END AS t
  FROM entries WHERE pos = n - 1),
paper_ids AS (
  SELECT m.id, m.doi, m.id || CASE WHEN t IS NULL THEN 'v1' WHEN t LIKE 'v%' THEN t ELSE 'v' || t END AS paper_id
  FROM metadata m LEFT JOIN last_text l ON l.id = m.id)"""

# ---- replies ------------------------------------------------------------

_REPLY = f"""
bare AS (SELECT doc_id, trim(reply, {_SPACES}) AS t FROM replies),
bodies AS (
  SELECT doc_id, CASE WHEN regexp_matches(t, '^```[a-zA-Z0-9]*\\s*\\n([\\s\\S]*?)\\n```\\s*$')
    THEN trim(regexp_extract(t, '^```[a-zA-Z0-9]*\\s*\\n([\\s\\S]*?)\\n```\\s*$', 1), {_SPACES}) ELSE t END AS body
  FROM bare),
reply_docs AS (
  SELECT doc_id, CASE WHEN json_valid(body) THEN CASE WHEN json_type(CASE WHEN json_valid(body) THEN body END) = 'OBJECT'
    THEN CAST(body AS JSON) END END AS doc FROM bodies),
answers AS (
  SELECT doc_id, doc, CASE WHEN json_type(doc, '$.answer') = 'BOOLEAN' THEN doc ->> '$.answer' = 'true'
    WHEN json_type(doc, '$.answer') = 'VARCHAR' THEN CASE lower(trim(doc ->> '$.answer'))
      WHEN 'true' THEN true WHEN 'yes' THEN true WHEN 'false' THEN false WHEN 'no' THEN false END END AS answer
  FROM reply_docs),
numbers AS (
  SELECT doc_id, answer, CASE json_type(doc, '$.confidence') WHEN 'BOOLEAN'
      THEN CASE WHEN doc ->> '$.confidence' = 'true' THEN 1.0 ELSE 0.0 END
    WHEN 'ARRAY' THEN NULL WHEN 'OBJECT' THEN NULL
    ELSE TRY_CAST(doc ->> '$.confidence' AS DOUBLE) END AS num FROM answers),
parsed AS (
  SELECT doc_id, answer, CAST(CAST(CASE WHEN num IS NULL THEN NULL WHEN isnan(num) THEN 1.0
    WHEN num > 1 AND num <= 100 THEN num / 100 ELSE greatest(0.0, least(1.0, num)) END AS DECIMAL(3,2)) AS DOUBLE) AS confidence
  FROM numbers)"""


def _chunk_sql(max_chars: int) -> str:
    """Recursive statement of the cutting rule."""
    least = int(max_chars * fixed.CHUNK_CUT_RATIO)
    window = f"substr(text, CAST(done + 1 AS BIGINT), {max_chars})"
    return f"""
walk AS (
  SELECT id, text, length(text) AS n, CAST(0 AS BIGINT) AS done, CAST(-1 AS BIGINT) AS pos, CAST(NULL AS VARCHAR) AS chunk FROM texts
  UNION ALL
  SELECT id, text, n, done + length(piece), pos + 1, piece FROM (
    SELECT id, text, n, done, pos, CASE WHEN n <= {max_chars} THEN text
      WHEN border > {least} THEN substr(w, 1, border) ELSE w END AS piece
    FROM (SELECT *, CASE WHEN strpos(reverse(w), chr(10) || chr(10)) > 0
          THEN length(w) - strpos(reverse(w), chr(10) || chr(10)) - 1 ELSE -1 END AS border
      FROM (SELECT *, {window} AS w FROM walk WHERE done < n OR (n = 0 AND pos = -1))))),
pieces AS (SELECT id, CAST(pos AS INT) AS pos, chunk FROM walk WHERE pos >= 0)"""


_CONVERSION = """
sides AS (
  SELECT id, bool_or(kind = 'tex') AS tex, bool_or(kind = 'pdf') AS pdf, bool_or(kind = 'md') AS md,
    bool_or(kind = 'tex' AND ok) AS tex_ok, bool_or(kind = 'pdf' AND ok) AS pdf_ok FROM sources GROUP BY id),
plan AS (
  SELECT id, CASE WHEN tex THEN CASE WHEN md THEN 'skip_existing' WHEN tex_ok THEN 'convert' ELSE 'error' END END AS tex_action,
    CASE WHEN pdf THEN CASE WHEN tex AND (md OR tex_ok) THEN 'covered' WHEN md THEN 'skip_existing'
      WHEN pdf_ok THEN 'convert' ELSE 'error' END END AS pdf_action
  FROM sides WHERE tex OR pdf)"""

_RESOLVED = """
ids AS (
  SELECT arxiv_id, CASE WHEN CAST(regexp_extract(arxiv_id, '^(.*)v([0-9]+)$', 2) AS BIGINT) > 1
    THEN regexp_extract(arxiv_id, '^(.*)v([0-9]+)$', 1) || 'v' ||
      CAST(CAST(regexp_extract(arxiv_id, '^(.*)v([0-9]+)$', 2) AS BIGINT) - 1 AS VARCHAR) END AS previous_id
  FROM download_queue WHERE download_status = 'PENDING'),
candidates AS (
  SELECT arxiv_id, 0 AS rank, arxiv_id AS candidate, 'stored' AS kind FROM ids
  UNION ALL SELECT arxiv_id, 1, arxiv_id, 'src' FROM ids
  UNION ALL SELECT arxiv_id, 2, arxiv_id, 'pdf' FROM ids
  UNION ALL SELECT arxiv_id, 3, previous_id, 'src' FROM ids
  UNION ALL SELECT arxiv_id, 4, previous_id, 'pdf' FROM ids),
hits AS (
  SELECT arxiv_id, rank, candidate, kind FROM (
    SELECT c.*, row_number() OVER (PARTITION BY arxiv_id ORDER BY rank) AS rn
    FROM candidates c WHERE EXISTS (SELECT 1 FROM available a WHERE a.artifact_id = c.candidate AND a.kind = c.kind
      AND NOT (a.kind = 'src' AND md5(a.artifact_id) < '8')))
  WHERE rn = 1),
resolved AS (
  SELECT i.arxiv_id, CASE WHEN h.arxiv_id IS NULL THEN 'FAILED' ELSE 'COMPLETED' END AS download_status,
    h.rank, h.candidate AS artifact_id, h.kind
  FROM ids i LEFT JOIN hits h ON h.arxiv_id = i.arxiv_id)"""
# no unusable archive at all: what repeated choices end in
_RESOLVED_USABLE = _RESOLVED.replace("a.kind = 'src' AND", "a.kind IN ('stored', 'src') AND")

_ARCHIVES = """
packed AS (
  SELECT page_id AS id, 'main.tex' AS path, octet_length(encode(html)) AS size FROM pages WHERE page_id % 7 > 0
  UNION ALL SELECT page_id, 'sub/appendix.TEX', 2 * octet_length(encode(html)) FROM pages WHERE page_id % 7 > 0
  UNION ALL SELECT page_id, 'refs.bib', octet_length(encode(url)) FROM pages WHERE page_id % 7 > 0)"""

_EVIDENCE = f"""
bodies AS (
  SELECT id, CASE WHEN regexp_matches(trim(reply, {_SPACES}), '^```[a-zA-Z0-9]*\\s*\\n([\\s\\S]*?)\\n```\\s*$')
    THEN regexp_extract(trim(reply, {_SPACES}), '^```[a-zA-Z0-9]*\\s*\\n([\\s\\S]*?)\\n```\\s*$', 1) ELSE reply END AS body
  FROM evidence_replies),
docs AS (SELECT id, CASE WHEN json_valid(body) THEN CAST(CASE WHEN json_valid(body) THEN body END AS JSON) END AS d FROM bodies),
records AS (
  SELECT id, d ->> '$.datapunt_id' AS datapunt_id, CAST(d ->> '$.bewijs_gevonden' AS BOOLEAN) AS bewijs_gevonden,
    d ->> '$.type_bewijs' AS type_bewijs, d ->> '$.samenvatting_bewijs' AS samenvatting_bewijs,
    CAST(d -> '$.specifieke_metrics' AS VARCHAR) AS specifieke_metrics, d ->> '$.direct_citaat' AS direct_citaat,
    d ->> '$.bronvermelding' AS bronvermelding,
    d IS NOT NULL AND (coalesce(d ->> '$.type_bewijs' IN ('kwantitatief', 'kwalitatief', 'anekdotisch'), false)
      OR NOT coalesce(CAST(d ->> '$.bewijs_gevonden' AS BOOLEAN), false)) AS valid,
    coalesce(json_array_length(d, '$.specifieke_metrics'), 0) AS metrics
  FROM docs),
verified AS (
  SELECT r.*, coalesce(direct_citaat, '') <> '' AND coalesce(contains(m.abstract, direct_citaat), false) AS quote_found
  FROM records r LEFT JOIN metadata m ON m.id = r.id)"""

_VERDICTS = """
judged AS (
  SELECT id, datapunt_id, CASE WHEN json_valid(reply) THEN CAST(CASE WHEN json_valid(reply) THEN reply END AS JSON) END AS d
  FROM evidence_verdicts),
verdicts AS (
  SELECT id, datapunt_id,
    bool_and(coalesce(json_type(d, '$.validatie_geslaagd') = 'BOOLEAN' AND d ->> '$.validatie_geslaagd' = 'true', false)) AS passed,
    coalesce(string_agg(DISTINCT d ->> '$.opmerkingen', '|' ORDER BY d ->> '$.opmerkingen'), '') AS remarks
  FROM judged GROUP BY id, datapunt_id)"""

_THEME = " ".join(
    f"WHEN v.datapunt_id IN ({', '.join(map(_quote, points))}) THEN '{theme}'"
    for theme, points in fixed.EVIDENCE_THEMES.items()
)

_COUNTED = f"""
counted AS (
  SELECT v.*, CASE {_THEME} END AS theme FROM verified v
  WHERE valid AND bewijs_gevonden AND quote_found
    AND EXISTS (SELECT 1 FROM verdicts d WHERE d.id = v.id AND d.datapunt_id = v.datapunt_id AND d.passed))"""


def _integrity_sql() -> str:
    names = {"labels": "taxonomy_labels"}
    parts = []

    def add(table: str, rule: str, key: str, where: str, having: str = "") -> None:
        source = names.get(table, table)
        parts.append(
            f"SELECT '{table}' AS table_name, '{rule}' AS rule, {key} AS key, count(*) AS rows "
            f"FROM {source} c WHERE {where} GROUP BY 3 {having}"
        )

    def key_of(*columns: str) -> str:
        return " || '|' || ".join(f"coalesce(CAST(c.{x} AS VARCHAR), 'NULL')" for x in columns)

    from ..schemas import TABLES

    for table, (schema, key) in TABLES.items():
        add(table, f"primary key {'+'.join(key)}", key_of(*key), "true", "HAVING count(*) > 1")
        for field in schema.fields:
            if not field.nullable:
                add(table, f"not null {field.name}", key_of(*key), f"c.{field.name} IS NULL")
    add("labels", "unique name", key_of("name"), "true", "HAVING count(*) > 1")
    add("questions", "unique name+label_id", key_of("name", "label_id"), "true", "HAVING count(*) > 1")
    for child, column, parent in (
        ("papers", "metadata_id", "metadata"),
        ("questions", "label_id", "labels"),
        ("metadata_labels", "metadata_id", "metadata"),
        ("metadata_labels", "label_id", "labels"),
        ("labeling_queue", "metadata_id", "metadata"),
        ("labeling_queue", "question_id", "questions"),
    ):
        add(
            child, f"foreign key {column}", f"CAST(c.{column} AS VARCHAR)",
            f"c.{column} IS NOT NULL AND c.{column} NOT IN (SELECT id FROM {names.get(parent, parent)})",
        )
    add("download_queue", "check download_status", key_of("arxiv_id"),
        "c.download_status NOT IN ('PENDING', 'COMPLETED', 'FAILED')")
    add("labels", "length name", key_of("id"), "length(c.name) > 100")
    return "\nUNION ALL\n".join(parts)


def oracle_sql() -> dict[str, str]:
    views = ansi_views
    changed = "coalesce(u.n, 0) > 0"
    return {
        "jsonl_scan": views("metadata_lines") + f", {_LINES} SELECT line_no, md5(value) AS digest, is_object FROM scanned",
        "record_cap": views("metadata_lines")
        + f", {_LINES} SELECT line_no, md5(value) AS digest FROM scanned ORDER BY line_no LIMIT 100",
        "schema_violations": views("metadata_lines")
        + f", {_CHECKED} SELECT line_no, array_to_string(violations, ';') AS violations FROM checked",
        "metadata_project": views("metadata_lines", "metadata", "metadata_labels")
        + f", {_ROWS} SELECT {_ROW_COLUMNS}, line_no FROM accepted",
        "metadata_append": views("metadata_lines", "metadata", "metadata_labels")
        + f""", {_ROWS} SELECT {_ROW_COLUMNS} FROM (
            SELECT *, row_number() OVER (PARTITION BY id ORDER BY line_no) AS rn FROM accepted WHERE update_date IS NOT NULL)
          WHERE rn = 1 AND id NOT IN (SELECT id FROM stored)""",
        "metadata_insert_conflicts": views("metadata_lines", "metadata", "metadata_labels")
        + f""", {_ROWS} SELECT id, count(*) AS rows,
            CASE WHEN id IN (SELECT id FROM stored) THEN 'stored' ELSE 'repeated' END AS reason
          FROM accepted WHERE update_date IS NOT NULL GROUP BY id
          HAVING count(*) > 1 OR id IN (SELECT id FROM stored)""",
        "strict_insert": views("metadata_lines", "metadata", "metadata_labels") + f""", {_ROWS},
          dated AS (SELECT * FROM accepted WHERE update_date IS NOT NULL)
          SELECT id, title, 'stored' AS outcome FROM metadata WHERE id IN (SELECT id FROM stored)
          UNION ALL SELECT id, title, 'stored' FROM dated
            WHERE line_no < 1000000000000 AND id NOT IN (SELECT id FROM stored)
          UNION ALL SELECT id, CASE WHEN id IN (SELECT id FROM stored) THEN 'stored' ELSE 'repeated' END, 'refused'
            FROM dated GROUP BY id HAVING count(*) > 1 OR id IN (SELECT id FROM stored)""",
        "taxonomy_seed": views("seed_documents", "taxonomy_labels", "questions")
        + f""", {_SEED} SELECT 'question' AS kind, id, name, prompt, label_id FROM new_questions
          UNION ALL SELECT 'label', id, name, NULL, NULL FROM new_labels""",
        "artifact_stem": r"""SELECT page_id,
            regexp_replace(regexp_extract(url, '[^/]*$'), '^(.+)\.[^.]*$', '\1') AS stem FROM pages""",
        "archive_members": f"WITH {_ARCHIVES} SELECT id, path, size FROM packed",
        "archive_rejects": "SELECT page_id AS id, 'escaping member' AS reason FROM pages WHERE page_id % 7 = 0",
        "archive_main_tex": """SELECT page_id AS id, 'sub/appendix.TEX' AS path, md5(html || html) AS digest
          FROM pages WHERE page_id % 7 > 0""",
        "search_normalise": f"""WITH {_ENTRIES} SELECT regexp_extract(url, '[^/]*$') AS arxiv_id, host AS title,
            md5(trim(html, {_SPACES})) AS abstract, host || '|Second Author' AS authors,
            'cs.AI|x.' || CAST(page_id % 5 AS VARCHAR) AS categories, day AS published_date,
            CASE WHEN page_id % 3 > 0 THEN day END AS updated_date, url, url || '.pdf' AS pdf_url,
            CAST(NULL AS VARCHAR) AS doi, CAST(NULL AS VARCHAR) AS journal_ref, CAST(NULL AS VARCHAR) AS comment
          FROM entries""",
        "search_papers": f"""WITH {_ENTRIES} SELECT regexp_extract(url, '[^/]*$') AS arxiv_id, host AS title,
            day AS published_date, CASE WHEN page_id % 3 > 0 THEN day END AS updated_date
          FROM entries ORDER BY updated_date DESC NULLS LAST, arxiv_id, title LIMIT 50""",
        "search_relevance": f"""WITH {_ENTRIES}, landed AS (
            SELECT url, host FROM entries UNION ALL SELECT url, host FROM entries WHERE length(url) % 3 = 0),
          found AS (SELECT regexp_extract(url, '[^/]*$') AS arxiv_id, CAST(length(url) AS DOUBLE) AS relevance
            FROM landed ORDER BY relevance DESC, arxiv_id LIMIT 50)
          SELECT relevance, count(*) AS rows, min(arxiv_id) AS first_id FROM found GROUP BY relevance""",
        "search_by_ids": views("member_paths") + f""", {_ENTRIES}
          SELECT regexp_extract(url, '[^/]*$') AS arxiv_id, host AS title, url FROM entries
          WHERE regexp_extract(url, '[^/]*$') IN (SELECT regexp_extract(path, '[^/]*$') FROM member_paths)""",
        "metadata_exists": views("labeling_queue", "metadata")
        + "SELECT DISTINCT metadata_id AS id FROM labeling_queue WHERE metadata_id IN (SELECT id FROM metadata)",
        "paper_exists": views("status_changes", "papers")
        + "SELECT DISTINCT arxiv_id FROM status_changes WHERE arxiv_id IN (SELECT arxiv_id FROM papers)",
        "metadata_by_id": views("metadata", "metadata_labels")
        + """SELECT id, title, categories, doi, CAST(update_date AS VARCHAR) AS update_date,
            CASE WHEN json_valid(versions) THEN json_extract_string(CASE WHEN json_valid(versions) THEN versions END, '$[0].version') END AS first_version,
            json_extract_string(authors_parsed, '$[0][0]') AS first_author
          FROM metadata WHERE id IN (SELECT metadata_id FROM metadata_labels)""",
        "title_abstract": views("metadata", "metadata_labels")
        + "SELECT id, title, abstract FROM metadata WHERE id IN (SELECT metadata_id FROM metadata_labels)",
        "category_like": views("metadata")
        + "SELECT id, categories, CAST(update_date AS VARCHAR) AS update_date FROM metadata WHERE categories LIKE '%cs.AI%'",
        "category_tokens": views("metadata")
        + """SELECT id, categories, CAST(update_date AS VARCHAR) AS update_date FROM metadata
          WHERE list_has_any(string_split(categories, ' '), ['cs.AI', 'cs.SE']) AND update_date > DATE '2025-09-01'""",
        "papers_by_status": views("papers") + """SELECT arxiv_id, download_status, download_type, llm_check_status,
            CAST(created_at AS VARCHAR) AS created_at, CAST(updated_at AS VARCHAR) AS updated_at, metadata_id
          FROM papers WHERE download_status = 'PENDING' AND download_type = 'SRC'""",
        "paper_by_id": views("papers", "status_changes") + """SELECT arxiv_id, download_status, download_type,
            llm_check_status, CAST(created_at AS VARCHAR) AS created_at, CAST(updated_at AS VARCHAR) AS updated_at, metadata_id
          FROM papers WHERE arxiv_id IN (SELECT arxiv_id FROM status_changes)""",
        "question_by_id": views("questions", "labeling_queue")
        + "SELECT id, prompt, label_id FROM questions WHERE id IN (SELECT question_id FROM labeling_queue)",
        "ids_by_label": views("metadata_labels") + f"SELECT metadata_id FROM metadata_labels WHERE label_id = {LABEL_ID}",
        "list_labels": views("taxonomy_labels") + "SELECT id, name FROM taxonomy_labels",
        "pending_downloads": views("download_queue")
        + f"""SELECT arxiv_id, CAST(created_at AS VARCHAR) AS created_at FROM download_queue
          WHERE download_status = 'PENDING' ORDER BY download_queue.created_at, arxiv_id LIMIT {fixed.DEFAULT_DOWNLOADS}""",
        "pending_downloads_many": views("download_queue")
        + f"""SELECT arxiv_id, CAST(created_at AS VARCHAR) AS created_at FROM download_queue
          WHERE download_status = 'PENDING' ORDER BY download_queue.created_at, arxiv_id LIMIT {MANY}""",
        "failed_downloads": views("download_queue")
        + "SELECT arxiv_id, CAST(created_at AS VARCHAR) AS created_at FROM download_queue WHERE download_status = 'FAILED'",
        "enum_violations": views("raw_papers")
        + """SELECT 'download_type' AS field, arxiv_id AS key, download_type AS value FROM raw_papers
            WHERE coalesce(download_type, '') NOT IN ('PENDING', 'SRC', 'HTML', 'PDF')
          UNION ALL SELECT 'download_status', arxiv_id, download_status FROM raw_papers
            WHERE coalesce(download_status, '') NOT IN ('PENDING', 'COMPLETED', 'FAILED')""",
        "list_questions": views("questions", "taxonomy_labels")
        + """SELECT q.id, q.name, q.label_id, l.name AS label_name
          FROM questions q JOIN taxonomy_labels l ON l.id = q.label_id""",
        "label_versions": views("metadata_labels", "metadata")
        + f"""SELECT l.metadata_id, m.versions FROM metadata_labels l JOIN metadata m ON m.id = l.metadata_id
          WHERE l.label_id = {LABEL_ID}""",
        "enrich_jobs": views(*_LABELING_VIEWS) + f""", {_JOBS}, {_ENRICHED}
          SELECT metadata_id, question_id, label_id, prompt, title, md5(abstract) AS abstract, skip_reason FROM enriched""",
        "derive_metadata_id": views("papers", "metadata")
        + """SELECT p.arxiv_id, coalesce(p.metadata_id, m.id) AS metadata_id
          FROM (SELECT arxiv_id, metadata_id FROM papers UNION ALL SELECT id, NULL FROM metadata) p
          LEFT JOIN metadata m ON m.id = p.arxiv_id""",
        "already_downloaded": views("download_queue", "stored_archives")
        + r""", names AS (SELECT regexp_extract(path, '[^/]*$') AS name FROM stored_archives)
          SELECT arxiv_id, 'exact' AS rule FROM download_queue
          WHERE arxiv_id IN (SELECT regexp_extract(name, '^(.*?v[0-9]+)(?:\..*)?$', 1) FROM names)
          UNION ALL SELECT arxiv_id, 'prefix' FROM download_queue q
          WHERE EXISTS (SELECT 1 FROM names WHERE starts_with(name, q.arxiv_id))""",
        "metadata_stats": views("metadata")
        + """SELECT count(*) AS total_metadata, count(*) FILTER (WHERE doi IS NOT NULL AND doi <> '') AS with_doi,
            count(*) FILTER (WHERE submitter IS NULL) AS null_submitter FROM metadata""",
        "top_categories": views("metadata")
        + 'SELECT categories, count(*) AS "count" FROM metadata GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10',
        "table_counts": views(*_TABLE_VIEWS)
        + " UNION ALL ".join(
            f"SELECT '{'labels' if t == 'taxonomy_labels' else t}' AS table_name, count(*) AS rows FROM {t}"
            for t in _TABLE_VIEWS
        ),
        "queue_summary": views("download_queue")
        + """SELECT s.status AS download_status, count(q.arxiv_id) AS "count"
          FROM (VALUES ('PENDING'), ('COMPLETED'), ('FAILED')) s(status)
          LEFT JOIN download_queue q ON q.download_status = s.status GROUP BY 1""",
        "main_file": views("files")
        + """SELECT id, path, size FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY size DESC, path DESC) AS rn
            FROM files WHERE lower(path) LIKE '%.tex') WHERE rn = 1""",
        "labeling_stats": views(*_LABELING_VIEWS) + f""", {_JOBS}, {_JUDGED}
          SELECT count(*) FILTER (WHERE skip_reason IS NULL) AS processed, count(*) FILTER (WHERE answer) AS labeled,
            count(*) FILTER (WHERE skip_reason IS NOT NULL) AS skipped_missing, count(*) FILTER (WHERE failed) AS model_errors
          FROM judged""",
        "download_stats": views("download_queue", "available") + f""", {_RESOLVED}
          SELECT CAST({fixed.DEFAULT_DOWNLOADS} AS BIGINT) AS requested, count(*) AS attempted,
            count(*) FILTER (WHERE download_status = 'COMPLETED') AS completed,
            count(*) FILTER (WHERE download_status = 'FAILED') AS failed FROM resolved""",
        "conversion_stats": views("sources") + f""", {_CONVERSION}
          SELECT count(tex_action) AS tex_found, count(pdf_action) AS pdf_found,
            count(*) FILTER (WHERE tex_action = 'convert') AS converted_tex,
            count(*) FILTER (WHERE pdf_action = 'convert') AS converted_pdf,
            count(*) FILTER (WHERE tex_action = 'skip_existing') + count(*) FILTER (WHERE pdf_action = 'skip_existing') AS skipped_existing,
            count(*) FILTER (WHERE tex_action = 'error') + count(*) FILTER (WHERE pdf_action = 'error') AS errors
          FROM plan""",
        "label_upsert": views("metadata_labels", "label_changes") + f", {_UPSERTED} SELECT {_UPSERT_COLUMNS} FROM upserted",
        "label_changes": views("metadata_labels", "label_changes") + f""", {_UPSERTED}
          SELECT {_UPSERT_COLUMNS} FROM upserted WHERE (metadata_id, label_id) IN (SELECT (metadata_id, label_id) FROM latest)""",
        "paper_update": views("papers", "status_changes") + f""",
          u AS (SELECT arxiv_id, count(*) AS n,
            arg_max(download_status, seq) FILTER (WHERE sets_status) AS s, bool_or(sets_status) AS has_s,
            arg_max(download_type, seq) FILTER (WHERE sets_type) AS t, bool_or(sets_type) AS has_t,
            arg_max_null(llm_check_status, seq) FILTER (WHERE sets_llm) AS l, bool_or(sets_llm) AS has_l
            FROM status_changes GROUP BY 1)
          SELECT p.arxiv_id, CASE WHEN has_s THEN s ELSE download_status END AS download_status,
            CASE WHEN has_t THEN t ELSE download_type END AS download_type,
            CASE WHEN has_l THEN l ELSE llm_check_status END AS llm_check_status,
            CAST(created_at AS VARCHAR) AS created_at,
            CASE WHEN {changed} THEN {_STAMP} ELSE CAST(updated_at AS VARCHAR) END AS updated_at, metadata_id
          FROM papers p LEFT JOIN u ON u.arxiv_id = p.arxiv_id""",
        "queue_set_status": views("download_queue", "status_changes") + f""",
          u AS (SELECT arxiv_id, count(*) AS n, arg_max(download_status, seq) AS s FROM status_changes WHERE sets_status GROUP BY 1)
          SELECT q.arxiv_id, CASE WHEN {changed} THEN s ELSE download_status END AS download_status,
            CAST(created_at AS VARCHAR) AS created_at,
            CASE WHEN {changed} THEN {_STAMP} ELSE CAST(updated_at AS VARCHAR) END AS updated_at
          FROM download_queue q LEFT JOIN u ON u.arxiv_id = q.arxiv_id""",
        "table_current": views("download_queue", "status_changes") + """,
          newest AS (SELECT arxiv_id, download_status, seq FROM (SELECT *, row_number() OVER (
            PARTITION BY arxiv_id ORDER BY seq DESC, CASE WHEN seq % 3 = 0 THEN 1 ELSE 0 END DESC) AS rn FROM status_changes)
            WHERE rn = 1)
          SELECT arxiv_id, download_status FROM download_queue WHERE arxiv_id NOT IN (SELECT arxiv_id FROM newest)
          UNION ALL SELECT arxiv_id, download_status FROM newest WHERE seq % 3 <> 0""",
        "label_get_or_create": views("metadata", "taxonomy_labels") + """,
          names AS (SELECT license AS name FROM metadata UNION SELECT authors FROM metadata),
          fresh AS (SELECT name FROM names WHERE name NOT IN (SELECT name FROM taxonomy_labels))
          SELECT id, name, false AS created FROM taxonomy_labels WHERE name IN (SELECT name FROM names)
          UNION ALL SELECT CAST((SELECT max(id) FROM taxonomy_labels) + row_number() OVER (ORDER BY md5(name), name) AS INT), name, true
          FROM fresh""",
        "question_get_or_create": views("questions") + """,
          wanted AS (SELECT label_id, CASE WHEN id % 2 = 0 THEN prompt ELSE 'New: ' || prompt END AS prompt, min('n' || name) AS name
            FROM questions GROUP BY 1, 2),
          known AS (SELECT prompt, label_id, min(id) AS id, arg_min(name, id) AS name FROM questions GROUP BY 1, 2),
          found AS (SELECT w.prompt, w.label_id, w.name AS new_name, k.id, k.name
            FROM wanted w LEFT JOIN known k ON k.prompt = w.prompt AND k.label_id = w.label_id)
          SELECT id, name, prompt, label_id, false AS created FROM found WHERE id IS NOT NULL
          UNION ALL SELECT CAST((SELECT max(id) FROM questions) + row_number() OVER (
              ORDER BY md5(CAST(label_id AS VARCHAR) || chr(31) || prompt)) AS INT), new_name, prompt, label_id, true
          FROM found WHERE id IS NULL""",
        "paper_insert": views("papers", "metadata", "status_changes") + f"""
          SELECT arxiv_id, 'PENDING' AS download_status, 'PENDING' AS download_type, 'PENDING' AS llm_check_status,
            {_STAMP} AS created_at, {_STAMP} AS updated_at,
            coalesce(i.metadata_id, (SELECT max(m.id) FROM metadata m WHERE m.id = i.arxiv_id)) AS metadata_id
          FROM (SELECT arxiv_id, min(metadata_id) AS metadata_id FROM (
              SELECT arxiv_id, metadata_id FROM papers UNION ALL SELECT id, NULL FROM metadata) GROUP BY 1) i
          WHERE arxiv_id NOT IN (SELECT p.arxiv_id FROM papers p JOIN status_changes s ON s.arxiv_id = p.arxiv_id)""",
        "integrity_report": views(*_TABLE_VIEWS) + _integrity_sql(),
        "cascade_delete": views(*_TABLE_VIEWS) + """,
          gone AS (SELECT id FROM metadata WHERE doi = ''), lost AS (SELECT id FROM taxonomy_labels WHERE id < 5),
          lost_questions AS (SELECT id FROM questions WHERE label_id IN (SELECT id FROM lost))
          SELECT 'metadata' AS table_name, id AS key FROM metadata WHERE id NOT IN (SELECT id FROM gone)
          UNION ALL SELECT 'papers', arxiv_id || '|' || coalesce(CASE WHEN metadata_id IN (SELECT id FROM gone) THEN NULL ELSE metadata_id END, 'NULL') FROM papers
          UNION ALL SELECT 'labels', CAST(id AS VARCHAR) FROM taxonomy_labels WHERE id NOT IN (SELECT id FROM lost)
          UNION ALL SELECT 'questions', CAST(id AS VARCHAR) FROM questions WHERE label_id NOT IN (SELECT id FROM lost)
          UNION ALL SELECT 'metadata_labels', metadata_id || '|' || CAST(label_id AS VARCHAR) FROM metadata_labels
            WHERE metadata_id NOT IN (SELECT id FROM gone) AND label_id NOT IN (SELECT id FROM lost)
          UNION ALL SELECT 'labeling_queue', metadata_id || '|' || coalesce(CAST(question_id AS VARCHAR), 'NULL') FROM labeling_queue
            WHERE metadata_id NOT IN (SELECT id FROM gone)
              AND (question_id IS NULL OR question_id NOT IN (SELECT id FROM lost_questions))""",
        "stored_delete": views(*_TABLE_VIEWS) + """,
          gone AS (SELECT id FROM metadata WHERE doi = ''), lost AS (SELECT id FROM taxonomy_labels WHERE id < 5),
          lost_questions AS (SELECT id FROM questions WHERE label_id IN (SELECT id FROM lost))
          SELECT 'metadata' AS table_name, id AS key FROM metadata WHERE id NOT IN (SELECT id FROM gone)
          UNION ALL SELECT 'papers', arxiv_id || '|' || coalesce(CASE WHEN metadata_id IN (SELECT id FROM gone) THEN NULL ELSE metadata_id END, 'NULL') FROM papers
          UNION ALL SELECT 'labels', CAST(id AS VARCHAR) FROM taxonomy_labels WHERE id NOT IN (SELECT id FROM lost)
          UNION ALL SELECT 'questions', CAST(id AS VARCHAR) FROM questions WHERE label_id NOT IN (SELECT id FROM lost)
          UNION ALL SELECT 'metadata_labels', metadata_id || '|' || CAST(label_id AS VARCHAR) FROM metadata_labels
            WHERE metadata_id NOT IN (SELECT id FROM gone) AND label_id NOT IN (SELECT id FROM lost)
          UNION ALL SELECT 'labeling_queue', metadata_id || '|' || coalesce(CAST(question_id AS VARCHAR), 'NULL') FROM labeling_queue
            WHERE metadata_id NOT IN (SELECT id FROM gone)
              AND (question_id IS NULL OR question_id NOT IN (SELECT id FROM lost_questions))""",
        "insert_log_current": views("metadata") + """,
          rows AS (SELECT id, md5(abstract) AS digest, CAST(id AS BIGINT) AS n FROM metadata),
          stored AS (SELECT id, digest, 2 AS run FROM rows WHERE n % 3 = 0
            UNION ALL SELECT id, digest, 3 + n % 5 FROM rows WHERE n % 3 = 1
            UNION ALL SELECT id, 'again', 4 + n % 9 FROM rows WHERE n % 8 = 0),
          removed AS (SELECT id, 3 + n % 7 AS run FROM rows WHERE n % 4 = 0)
          SELECT id, digest FROM stored s
          WHERE NOT EXISTS (SELECT 1 FROM removed r WHERE r.id = s.id AND r.run >= s.run)""",
        "files_to_convert": views("files") + """
          SELECT id, batch, path FROM (SELECT id, path, length(path) % 3 AS batch,
              row_number() OVER (PARTITION BY id ORDER BY length(path) % 3 DESC, path DESC) AS rn FROM files)
          WHERE rn = 1 AND id NOT IN (SELECT id FROM files WHERE path LIKE '%7.tex')""",
        "max_version": views("metadata") + f", {_VERSIONS} SELECT id, version FROM highest",
        "last_version_id": views("metadata") + f", {_VERSIONS} SELECT id, paper_id FROM paper_ids",
        "prev_version": views("papers") + """SELECT arxiv_id,
            CASE WHEN CAST(regexp_extract(arxiv_id, '^(.*)v([0-9]+)$', 2) AS BIGINT) > 1
              THEN regexp_extract(arxiv_id, '^(.*)v([0-9]+)$', 1) || 'v' ||
                CAST(CAST(regexp_extract(arxiv_id, '^(.*)v([0-9]+)$', 2) AS BIGINT) - 1 AS VARCHAR) END AS previous_id
          FROM papers""",
        "strip_fence": views("replies") + f", {_REPLY} SELECT doc_id, body FROM bodies",
        "answer_parse": views("replies") + f", {_REPLY} SELECT doc_id, answer FROM answers",
        "confidence_parse": views("replies") + f", {_REPLY} SELECT doc_id, confidence FROM parsed",
        "response_parse": views("replies")
        + f", {_REPLY} SELECT doc_id, coalesce(answer, false) AS answer, confidence FROM parsed",
        "prompt_build": views(*_LABELING_VIEWS) + f""", {_JOBS}, {_ENRICHED}
          SELECT metadata_id, question_id, CAST(0 AS INT) AS pos, 'system' AS role,
            md5({_quote(fixed.CLASSIFIER_SYSTEM_TEXT)}) AS digest FROM enriched WHERE skip_reason IS NULL
          UNION ALL SELECT metadata_id, question_id, 1, 'user', md5({_USER_TEXT}) FROM enriched WHERE skip_reason IS NULL""",
        "merge_system": views("messages") + """,
          tagged AS (SELECT *, lower(trim(coalesce(role, 'user'))) AS r FROM messages),
          kept AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS rn FROM tagged WHERE r IN ('user', 'model')),
          sys AS (SELECT conv_id, string_agg(text, chr(10) || chr(10) ORDER BY turn) || chr(10) || chr(10) AS preamble
            FROM tagged WHERE r = 'system' GROUP BY 1),
          heads AS (SELECT s.conv_id, s.preamble, k.role FROM sys s LEFT JOIN kept k ON k.conv_id = s.conv_id AND k.rn = 1)
          SELECT k.conv_id, k.turn, k.role, CASE WHEN k.rn = 1 AND k.role = 'user' THEN coalesce(s.preamble, '') ELSE '' END || k.text AS text
          FROM kept k LEFT JOIN sys s ON s.conv_id = k.conv_id
          UNION ALL SELECT h.conv_id, (SELECT min(t.turn) FROM tagged t WHERE t.conv_id = h.conv_id) - 1, 'user', h.preamble
          FROM heads h WHERE h.role IS NULL OR h.role <> 'user'""",
        "unsafe_member": views("member_paths") + """,
          segments AS (SELECT page_id, path, i.unnest AS pos, string_split(path, '/')[i.unnest] AS s
            FROM member_paths, unnest(range(1, CAST(len(string_split(path, '/')) AS BIGINT) + 1)) AS i),
          depths AS (SELECT page_id, sum(CASE WHEN s = '..' THEN -1 WHEN s IN ('', '.') THEN 0 ELSE 1 END)
            OVER (PARTITION BY page_id ORDER BY pos) AS depth FROM segments)
          SELECT p.page_id, starts_with(p.path, '/') OR min(d.depth) < 0 AS unsafe
          FROM member_paths p JOIN depths d ON d.page_id = p.page_id GROUP BY p.page_id, p.path""",
        "chunk_text": views("texts") + f""", {_chunk_sql(CHUNK_CHARS)}
          SELECT id, pos, CAST(length(chunk) AS INT) AS chars, md5(chunk) AS digest FROM pieces""",
        "chunk_text_default": views("texts") + f""", {_chunk_sql(fixed.LOCAL_CHUNK_CHARS)}
          SELECT id, pos, CAST(length(chunk) AS INT) AS chars, md5(chunk) AS digest FROM pieces""",
        "chunk_reassemble": views("texts") + f""", {_chunk_sql(CHUNK_CHARS)},
          joined AS (SELECT id, coalesce(string_agg(nullif(trim(chunk, {_SPACES}), ''), chr(10) || chr(10) ORDER BY pos), '') AS md
            FROM pieces GROUP BY id)
          SELECT id, CAST(length(md) AS INT) AS chars, md5(md) AS digest FROM joined""",
        "page_join": views("page_texts") + f"""
          SELECT id, coalesce(trim(string_agg(trim(text, {_SPACES}), chr(10) || chr(10) ORDER BY page_no)
            FILTER (WHERE text <> ''), {_SPACES}), '') AS md FROM page_texts GROUP BY id""",
        "markdown_written": views("page_texts") + f"""
          SELECT id, md5(coalesce(trim(string_agg(trim(text, {_SPACES}), chr(10) || chr(10) ORDER BY page_no)
            FILTER (WHERE text <> ''), {_SPACES}), '')) AS digest, 'pdf' AS source, CAST(1 AS BIGINT) AS run
          FROM page_texts GROUP BY id""",
        "tex_fallback": views("texts") + f""", {_chunk_sql(CHUNK_CHARS)}
          SELECT id, 'converter' AS way, md5('converted: ' || text) AS digest FROM texts WHERE length(text) % 2 = 0
          UNION ALL
          SELECT id, 'model', md5(coalesce(string_agg(nullif(trim(chunk, {_SPACES}), ''), chr(10) || chr(10) ORDER BY pos), ''))
          FROM pieces WHERE id IN (SELECT id FROM texts WHERE length(text) % 2 = 1) GROUP BY id""",
        "conversion_plan": views("sources") + f", {_CONVERSION} SELECT id, tex_action, pdf_action FROM plan",
        "labeling_enqueue": views("metadata", "labeling_queue") + f"""
          SELECT id AS metadata_id, CAST({QUESTION_ID} AS INT) AS question_id, NOT EXISTS (SELECT 1 FROM labeling_queue q
            WHERE q.metadata_id = m.id AND q.question_id = {QUESTION_ID}) AS is_new
          FROM metadata m WHERE list_has_any(string_split(categories, ' '), ['cs.AI', 'cs.SE'])
            AND update_date > DATE '2025-09-01'""",
        "downloads_enqueue": views("metadata", "metadata_labels", "stored_archives") + f""", {_VERSIONS},
          queued AS (SELECT regexp_extract(regexp_extract(path, '[^/]*$'), '^(.*?v[0-9]+)(?:\\..*)?$', 1) AS arxiv_id FROM stored_archives
            UNION SELECT id || 'v2' FROM metadata WHERE doi = ''),
          wanted AS (SELECT DISTINCT l.metadata_id || 'v' || CAST(h.version AS VARCHAR) AS arxiv_id
            FROM metadata_labels l JOIN highest h ON h.id = l.metadata_id WHERE l.label_id = {LABEL_ID})
          SELECT arxiv_id, arxiv_id NOT IN (SELECT arxiv_id FROM queued) AS is_new FROM wanted""",
        "jobs_pop": views("labeling_queue") + f"""SELECT metadata_id, question_id FROM labeling_queue
          ORDER BY metadata_id NULLS FIRST, question_id NULLS FIRST LIMIT {fixed.DEFAULT_LABELING_JOBS}""",
        "jobs_remaining": views("labeling_queue") + f""",
          waiting AS (SELECT metadata_id, question_id FROM labeling_queue
            UNION ALL SELECT DISTINCT metadata_id, CAST(NULL AS INT) FROM labeling_queue),
          popped AS (SELECT metadata_id, question_id FROM waiting
            ORDER BY metadata_id NULLS FIRST, question_id NULLS FIRST LIMIT {fixed.DEFAULT_LABELING_JOBS})
          SELECT metadata_id, question_id FROM waiting q WHERE NOT EXISTS (
            SELECT 1 FROM popped p WHERE p.metadata_id IS NOT DISTINCT FROM q.metadata_id
              AND p.question_id IS NOT DISTINCT FROM q.question_id)""",
        "label_jobs": views(*_LABELING_VIEWS) + f", {_JOBS}, {_JUDGED}, {_UPSERTED} SELECT {_UPSERT_COLUMNS} FROM upserted",
        "label_stream": views(*_LABELING_VIEWS) + f", {_JOBS}, {_JUDGED}, {_UPSERTED} SELECT {_UPSERT_COLUMNS} FROM upserted",
        "resolve_downloads": views("download_queue", "available") + f""", {_RESOLVED}
          SELECT arxiv_id, download_status, CAST(rank AS INT) AS rank, artifact_id, kind FROM resolved""",
        "resolve_rejected": views("download_queue", "available") + f""", {_RESOLVED_USABLE}
          SELECT arxiv_id, download_status, CAST(rank AS INT) AS rank, artifact_id, kind FROM resolved""",
        "papers_prepare": views("metadata") + f""", {_VERSIONS}
          SELECT paper_id AS arxiv_id, 'PENDING' AS download_status, 'PENDING' AS download_type, 'PENDING' AS llm_check_status,
            {_STAMP} AS created_at, {_STAMP} AS updated_at, id AS metadata_id
          FROM paper_ids WHERE paper_id NOT IN (SELECT paper_id FROM paper_ids WHERE doi = '')""",
        "evidence_records": views("evidence_replies", "metadata") + f""", {_EVIDENCE}
          SELECT id, datapunt_id, bewijs_gevonden, type_bewijs, samenvatting_bewijs, specifieke_metrics, direct_citaat,
            bronvermelding, valid FROM records""",
        "quote_check": views("evidence_replies", "metadata")
        + f", {_EVIDENCE} SELECT id, direct_citaat, quote_found FROM verified",
        "quote_check_many": views("quotes", "metadata") + """
          SELECT q.id, direct_citaat, coalesce(direct_citaat <> '' AND contains(m.abstract, direct_citaat), false) AS quote_found
          FROM quotes q LEFT JOIN metadata m ON m.id = q.id""",
        "evidence_verdicts": views("evidence_verdicts") + f""", {_VERDICTS}
          SELECT id, datapunt_id, passed, remarks FROM verdicts""",
        "evidence_summary": views("evidence_replies", "metadata", "evidence_verdicts") + f""", {_EVIDENCE}, {_VERDICTS}, {_COUNTED}
          SELECT theme, datapunt_id, type_bewijs, count(*) AS records, CAST(sum(metrics) AS BIGINT) AS metrics
          FROM counted GROUP BY 1, 2, 3""",
        "evidence_metrics": views("evidence_replies", "metadata", "evidence_verdicts") + f""", {_EVIDENCE}, {_VERDICTS}, {_COUNTED}
          SELECT id, theme, datapunt_id, CAST(i - 1 AS INTEGER) AS place, m[i] ->> '$.metric_naam' AS metric_naam,
            m[i] ->> '$.waarde' AS waarde, m[i] ->> '$.context' AS context
          FROM (SELECT *, CAST(CAST(specifieke_metrics AS JSON) AS JSON[]) AS m FROM counted),
            unnest(generate_series(1, len(m))) AS t(i)""",
        "labeling_flagship": views(*_LABELING_VIEWS) + f""",
          jobs AS (SELECT metadata_id, question_id FROM labeling_queue
            UNION ALL SELECT id AS metadata_id, {QUESTION_ID} AS question_id FROM metadata m
            WHERE list_has_any(string_split(categories, ' '), ['cs.AI', 'cs.SE']) AND update_date > DATE '2025-09-01'
              AND NOT EXISTS (SELECT 1 FROM labeling_queue q WHERE q.metadata_id = m.id AND q.question_id = {QUESTION_ID})),
          {_JUDGED}, {_UPSERTED}
          SELECT label_id, count(*) AS papers, CAST(sum(confidence_score) AS DOUBLE) AS confidence_sum FROM upserted GROUP BY 1""",
    }
