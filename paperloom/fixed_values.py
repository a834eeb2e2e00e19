"""Values fixed by the data model: they must stay exactly as they are.

Everything here is plain data (patterns, enums, defaults, prompt texts, the
record schema). No logic lives in this module.
"""

# --- fixed values: status and type domains -------------------------------
QUEUE_STATUSES = ("PENDING", "COMPLETED", "FAILED")
DOWNLOAD_TYPES = ("PENDING", "SRC", "HTML", "PDF")
DEFAULT_STATUS = "PENDING"
LABEL_NAME_MAX_CHARS = 100

# --- fixed values: selection defaults ------------------------------------
LABELING_CATEGORIES = ("cs.AI", "cs.SE")
DEFAULT_DATE_AFTER = "2025-09-01"
DEFAULT_LABELING_JOBS = 10
DEFAULT_DOWNLOADS = 10
TOP_CATEGORIES = 10
SEARCH_MAX_RESULTS = 50
SEARCH_SORT_KEYS = ("submittedDate", "lastUpdatedDate", "relevance")

# --- fixed values: model call limits -------------------------------------
HOSTED_IN_FLIGHT = 4
LOCAL_IN_FLIGHT = 2
HOSTED_CHUNK_CHARS = 20000
LOCAL_CHUNK_CHARS = 12000
CHUNK_CUT_RATIO = 0.85

# --- fixed values: patterns ----------------------------------------------
FENCE_PATTERN = r"^```[a-zA-Z0-9]*\s*\n([\s\S]*?)\n```\s*$"
VERSION_NUMBER_PATTERN = r"(?i)v?(\d+)"
VERSIONED_ID_PATTERN = r"^(.*)v(\d+)$"
YES_WORDS = ("true", "yes")
NO_WORDS = ("false", "no")

# --- fixed values: characters removed by a full whitespace strip ----------
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)

# --- fixed values: classifier prompt -------------------------------------
CLASSIFIER_SYSTEM_TEXT = (
    "You are an extremely strict and efficient binary classification agent. "
    "Your task is to analyze the provided TEXT to answer the given QUESTION. "
    "You **MUST** respond in strict JSON format. "
    "No extra text, explanation, introduction, or markdown is allowed. "
    'The JSON schema is: {"answer": true|false, "confidence": number}. '
    "The 'confidence' must be a floating-point number between 0.00 and 1.00, "
    "reflecting the certainty of your 'answer'. "
    "**Respond directly and ONLY with the JSON output.**"
)
QUESTION_HEADING = "QUESTION: "
TITLE_HEADING = "\n\nTITLE: "
ABSTRACT_HEADING = "\n\nABSTRACT: "

# --- fixed values: TeX conversion prompt ---------------------------------
CONVERSION_INSTRUCTIONS = """\
You are an expert converter of complex, potentially broken, scientific LaTeX documents into clean, correct Markdown. Your single highest priority is to ensure **ABSOLUTELY ALL TEXTUAL CONTENT IS RETAINED**.
Output Rules:
1. **Markdown ONLY:** Return only the converted Markdown text. No preamble, explanation, title, or YAML metadata.
2. **Math:** Preserve all mathematical formulas **EXACTLY** as they appear in the LaTeX source, enclosed in single dollar signs ($...$) or double dollar signs ($$...$$).
3. **Content Rescue:** For unknown or broken LaTeX environments (e.g., \\begin{wrapfigure}, \\lstlisting, or custom macros), **remove the \\begin and \\end tags** but preserve the **CONTENT** as plain text.
4. **Structure:** Use standard Markdown headings (#, ##, ###) for section hierarchy, and convert lists and tables to their best, cleanest Markdown equivalent.
5. **Content Fusion & Cleanup:** Do not simply delete reviewer comments. You must perform an intelligent merge operation:
    a. **INTEGRATE** the content of corrective commands (e.g., \\correction{...}, \\fix{...}) into the main text, overwriting or replacing the previous text if the command suggests a definitive change.
    b. **REMOVE** purely editorial, housekeeping, or querying commands (e.g., \\todo{}, \\note{}, \\check{}).
    c. Neutralize all other remaining LaTeX commands that do not translate to Markdown or Math.
6. **Code Blocks:** Convert code environments or \\lstlisting-like blocks into correct, fenced Markdown code blocks (e.g., ```language ... ```).
"""

# --- fixed values: metadata record schema --------------------------------
# field -> JSON types allowed; the second tuple lists the required fields.
METADATA_FIELD_TYPES = {
    "id": ("string",),
    "submitter": ("string", "null"),
    "authors": ("string",),
    "title": ("string",),
    "comments": ("string", "null"),
    "journal-ref": ("string", "null"),
    "doi": ("string", "null"),
    "report-no": ("string", "null"),
    "categories": ("string",),
    "license": ("string", "null"),
    "abstract": ("string",),
    "versions": ("array",),
    "update_date": ("string",),
    "authors_parsed": ("array",),
}
METADATA_REQUIRED = (
    "id",
    "authors",
    "title",
    "categories",
    "abstract",
    "versions",
    "update_date",
    "authors_parsed",
)

# --- fixed values: evidence record ---------------------------------------
EVIDENCE_DDL = (
    "datapunt_id string, bewijs_gevonden boolean, type_bewijs string, "
    "samenvatting_bewijs string, "
    "specifieke_metrics array<struct<metric_naam:string,waarde:string,context:string>>, "
    "direct_citaat string, bronvermelding string"
)
EVIDENCE_TYPES = ("kwantitatief", "kwalitatief", "anekdotisch")
#: data points of each theme
EVIDENCE_THEMES = {
    "productivity": ("CODE_CHURN", "TIME_TO_PRODUCTION", "LAB_STUDY_CRITIQUE"),
    "quality": ("BUGS_PER_FEATURE", "CODE_COMPLEXITY", "TEST_COVERAGE"),
    "human_factor": ("COGNITIVE_LOAD", "DEVELOPER_SATISFACTION", "ONBOARDING"),
}
VERDICT_DDL = "validatie_geslaagd boolean, opmerkingen string"
