"""SQL for every registered query that SQL can express."""

from evalspark.functions.prompts import ANSWER_RULES, JUDGE_RULES
from evalspark.functions.text import MAX_SENTENCES, MAX_WORDS, WHITESPACE


def lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


SPLIT = "CASE WHEN lang = 'en' THEN 'validation' ELSE 'test' END"
NUMBER = "CAST(substr(source, 4) AS INTEGER)"
FILE_NAME = f"""CASE WHEN {NUMBER} < 4 THEN '' WHEN {NUMBER} < 8 THEN NULL
    WHEN {NUMBER} < 13 THEN doc_id || '.pdf' WHEN {NUMBER} < 17 THEN doc_id || '.PDF'
    ELSE doc_id || '.tar.gz' END"""
LEVEL = "CASE WHEN n_chars < 1000 THEN 1 WHEN n_chars < 2000 THEN 2 ELSE 3 END"
STEPS = f"CASE WHEN {NUMBER} < 10 THEN 'Read ' || source END"
CREATED = "TIMESTAMP '2024-01-01 00:00:00'"
FEED_STATUS = """CASE WHEN value < 5 THEN 'Correct without Instruction' WHEN value < 10 THEN 'Correct with Instruction'
    WHEN value < 20 THEN 'Incorrect without Instruction' ELSE 'Incorrect with Instruction' END"""

VIEW_SQL = {
    "questions": f"""SELECT CAST(doc_id AS VARCHAR) AS task_id, text AS "Question", {LEVEL} AS "Level",
        lang AS "FinalAnswer", {FILE_NAME} AS file_name, '' AS file_path,
        {STEPS} AS "Annotator_Metadata_Steps", CAST(n_chars AS VARCHAR) AS "Annotator_Metadata_Number_of_steps",
        lang AS "Annotator_Metadata_How_long_did_this_take", source AS "Annotator_Metadata_Tools",
        {NUMBER} AS "Annotator_Metadata_Number_of_tools", 'N/A' AS result_status,
        {CREATED} AS created_date, {SPLIT} AS dataset_split FROM documents""",
    "raw_questions": f"""SELECT CAST(doc_id AS VARCHAR) AS task_id, text AS "Question",
        CASE lang WHEN 'en' THEN CAST({LEVEL} AS VARCHAR) WHEN 'fr' THEN ' 2 ' WHEN 'es' THEN '2.9' ELSE '?' END
            AS "Level",
        CASE lang WHEN 'fr' THEN '?' ELSE lang END AS "Final answer", {FILE_NAME} AS file_name, '' AS file_path,
        {STEPS} AS steps, CAST(n_chars AS VARCHAR) AS number_of_steps, lang AS how_long, source AS tools,
        CASE WHEN lang = 'de' THEN 'inf' ELSE CAST({NUMBER} AS VARCHAR) END AS number_of_tools,
        {SPLIT} AS dataset_split FROM documents""",
    "user_results": f"""SELECT source AS user_id, CAST(l.doc_id AS VARCHAR) AS task_id, {SPLIT} AS dataset_split,
        CASE WHEN quality = 1 AND toxic <> 1 THEN 'Correct without Instruction'
            WHEN quality = 1 THEN 'Correct with Instruction'
            WHEN toxic <> 1 THEN 'Incorrect without Instruction' ELSE 'Incorrect with Instruction' END
            AS user_result_status,
        'Written in ' || lang AS chatgpt_response, {CREATED} AS created_date, CAST(0 AS BIGINT) AS seq
        FROM labels l JOIN documents d ON l.doc_id = d.doc_id""",
    "page_files": """SELECT CASE WHEN contains(url, '/en/') THEN 'validation' ELSE 'test' END AS dataset_split,
        page_id || '.html' AS file_name, CAST(strlen(html) AS BIGINT) AS length, html, page_id FROM pages""",
    "files": f"""SELECT dataset_split, file_name, 'bronze/' || dataset_split || '/' || file_name AS path, length FROM (
        SELECT CASE WHEN lang = 'fr' THEN 'validation' ELSE {SPLIT} END AS dataset_split, {FILE_NAME} AS file_name,
            n_chars AS length FROM documents WHERE coalesce({FILE_NAME}, '') <> ''
        UNION ALL SELECT dataset_split, file_name, length FROM page_files)""",
    "blocks": """SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INTEGER) AS pos,
        CASE WHEN role = 'assistant' THEN 'LINE' ELSE 'WORD' END AS block_type, text,
        CASE WHEN conv_id IN (SELECT conv_id FROM conversations WHERE role = 'system') THEN 'FAILED'
            ELSE 'SUCCEEDED' END AS job_status FROM conversations""",
    "pages_text": """SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(turn AS INTEGER) AS page, text FROM conversations""",
    "silver": f"""SELECT 'pymupdf' AS method, {SPLIT} AS dataset_split, CAST(doc_id AS VARCHAR) AS base_name, text
            FROM documents WHERE lang <> 'fr'
        UNION ALL SELECT 'textract', {SPLIT}, CAST(doc_id AS VARCHAR), text FROM documents WHERE lang <> 'en'""",
    "feed": f"""SELECT CAST(user_id AS VARCHAR) AS user_id, event_type AS task_id, {FEED_STATUS} AS status,
        props AS chatgpt_response,
        CASE WHEN event_type IN ('view', 'click') THEN 'test' ELSE 'validation' END AS dataset_split,
        event_id AS seq FROM events""",
    "updates": "SELECT * FROM feed WHERE task_id <> 'view'",
    "nameless": "SELECT * REPLACE (CASE WHEN seq % 3 <> 0 THEN task_id END AS task_id) FROM updates",
    "stored_results": f"""SELECT user_id, task_id, dataset_split, arg_min(status, seq) AS user_result_status,
        arg_min(chatgpt_response, seq) AS chatgpt_response, {CREATED} AS created_date,
        CASE WHEN task_id = 'click' THEN 1000000000000 ELSE min(seq) END AS seq
        FROM feed WHERE task_id IN ('view', 'click', 'purchase') GROUP BY user_id, task_id, dataset_split""",
    "users": """SELECT CAST(c_custkey AS VARCHAR) AS user_id, c_name AS username,
        CASE WHEN c_mktsegment = 'MACHINERY' THEN 'admin' ELSE 'user' END AS role FROM customer""",
    "user_orders": """SELECT CAST(o_custkey AS VARCHAR) AS user_id, CAST(o_orderkey AS VARCHAR) AS task_id
        FROM orders""",
    "wanted_ids": "SELECT CAST(l_partkey * 2 AS VARCHAR) AS user_id FROM lineitem",
    "wanted_names": "SELECT 'Customer#' || lpad(CAST(l_partkey AS VARCHAR), 9, '0') AS username FROM lineitem",
    "joined": """SELECT q.*, coalesce(r.user_result_status, 'N/A') AS user_result_status,
        coalesce(r.chatgpt_response, 'N/A') AS chatgpt_response FROM questions q LEFT JOIN user_results r
        ON q.task_id IS NOT DISTINCT FROM r.task_id AND q.dataset_split IS NOT DISTINCT FROM r.dataset_split""",
    "matched": """SELECT q.*, f.file_name IS NOT NULL AS found FROM questions q LEFT JOIN files f
        ON q.file_name = f.file_name AND q.dataset_split = f.dataset_split""",
}
NEEDS = {
    "files": ["page_files"], "updates": ["feed"], "nameless": ["feed", "updates"], "stored_results": ["feed"],
    "joined": ["questions", "user_results"], "matched": ["questions", "page_files", "files"],
}



def with_views(query: str, *names: str) -> str:
    """Query preceded by the derived views it names and those they need."""
    wanted = []
    for name in names:
        wanted += [need for need in [*NEEDS.get(name, []), name] if need not in wanted]
    if not wanted:
        return query
    return "WITH " + ",\n".join(f"{name} AS ({VIEW_SQL[name]})" for name in wanted) + "\n" + query


# Expressions

def strip(x: str) -> str:
    return f"trim({x}, {lit(WHITESPACE)})"


def extension(x: str) -> str:
    return f"regexp_extract({x}, {lit('[^/.][^/]*([.][^/.]*)$')}, 1)"


def base_name(x: str) -> str:
    return f"regexp_replace(regexp_extract({x}, '[^/]*$'), '[.]pdf$', '')"


def bucket(x: str) -> str:
    return f"CASE WHEN coalesce({x}, '') = '' THEN 'No File' ELSE {extension(x)} END"


def clean(x: str) -> str:
    return f"CASE WHEN {x} = '?' THEN '' ELSE coalesce(CAST({x} AS VARCHAR), 'None') END"


def to_int(x: str) -> str:
    space = "[ \t-\r]*"
    number = lit(f"^{space}[+-]?([0-9]+[.]?[0-9]*|[.][0-9]+)([eE][+-]?[0-9]+)?{space}$")
    return (f"CAST(coalesce(CASE WHEN regexp_matches({x}, {number}) "
            f"THEN trunc(try_cast({strip(x)} AS DOUBLE)) END, 0) AS INTEGER)")


def truncated(x: str) -> str:
    text = strip(x)
    words = f"regexp_split_to_array({text}, {lit(f'[{WHITESPACE}]+')})"
    pieces = f"string_split({text}, '.')"
    return strip(f"""(CASE WHEN len({words}) > {MAX_WORDS}
        THEN array_to_string(({words})[1:{MAX_WORDS}], ' ') || '...'
        WHEN len({pieces}) > {MAX_SENTENCES}
        THEN array_to_string(({pieces})[1:{MAX_SENTENCES}], '. ') || '.' ELSE {text} END)""")


def prompt(question: str, instructions: str, context: str) -> str:
    def line(label: str, x: str) -> str:
        return f"CASE WHEN coalesce({x}, '') = '' THEN '' ELSE {lit(label)} || {x} || chr(10) END"
    return (f"('Question: ' || coalesce({question}, 'None') || chr(10) || {line('Instructions: ', instructions)} || "
            f"{line('Reference Data: ', context)} || {lit(ANSWER_RULES)})")


def judge_prompt(question: str, answer: str, response: str) -> str:
    def text(x: str) -> str:
        return strip(f"coalesce({x}, 'None')")
    return (f"(chr(10) || 'Question: ' || {text(question)} || chr(10) || chr(10) || 'Original Answer: ' || "
            f"{text(answer)} || chr(10) || chr(10) || 'AI Response: ' || {text(response)} || chr(10) || chr(10) || "
            f"{lit(JUDGE_RULES)})")


def verdict(x: str, instructions: str) -> str:
    suffix = f"CASE WHEN coalesce({instructions}, '') = '' THEN ' without' ELSE ' with' END || ' Instruction'"
    return (f"CASE WHEN contains(lower({strip(x)}), 'yes') THEN 'Correct' || {suffix} "
            f"WHEN contains(lower({strip(x)}), 'no') THEN 'Incorrect' || {suffix} ELSE 'Error' END")


def retry(x: str) -> str:
    return (f"coalesce({x} IN ('Correct with Instruction', 'Incorrect with Instruction', "
            f"'Incorrect without Instruction'), FALSE)")


def route(name: str, context: str) -> str:
    ext = f"lower({extension(f'coalesce({name}, {lit(str())})')})"
    return (f"CASE WHEN {ext} = '' THEN 'send' WHEN {ext} = '.pdf' AND coalesce({context}, '') <> '' THEN 'send' "
            f"WHEN {ext} = '.pdf' THEN 'missing_text' ELSE 'unsupported' END")


def digit(x: str) -> str:
    return f"substr(md5({x}), 1, 1)"


def digest_judge(x: str) -> str:
    """Reply of the stand-in judge to a prompt, null where it fails."""
    return (f"CASE WHEN {digit(x)} <= '6' THEN ' Yes. ' WHEN {digit(x)} <= 'a' THEN 'No' "
            f"WHEN {digit(x)} = 'b' THEN 'unclear' WHEN {digit(x)} <= 'e' THEN 'it does NOT' END")


CLEAN_SELECT = f"""SELECT {clean('task_id')} AS task_id, {clean('"Question"')} AS "Question",
    {to_int('"Level"')} AS "Level", {clean('"Final answer"')} AS "FinalAnswer", {clean('file_name')} AS file_name,
    {clean('file_path')} AS file_path, {clean('steps')} AS "Annotator_Metadata_Steps",
    {clean('number_of_steps')} AS "Annotator_Metadata_Number_of_steps",
    {clean('how_long')} AS "Annotator_Metadata_How_long_did_this_take",
    {clean('tools')} AS "Annotator_Metadata_Tools", {to_int('number_of_tools')} AS "Annotator_Metadata_Number_of_tools",
    'N/A' AS result_status, {CREATED} AS created_date, dataset_split FROM raw_questions"""

RESPONSE_COLUMNS = """task_id, "Question", "Level", "FinalAnswer", file_name, file_path, "Annotator_Metadata_Steps",
    "Annotator_Metadata_Number_of_steps", "Annotator_Metadata_How_long_did_this_take", "Annotator_Metadata_Tools",
    "Annotator_Metadata_Number_of_tools", result_status, created_date"""

URL = "'https://attachments.s3.amazonaws.com/bronze/' || dataset_split || '/' || file_name"

LATEST = """SELECT user_id, task_id, dataset_split, arg_max(status, seq) AS status,
    arg_max(chatgpt_response, seq) AS response, max(seq) AS top FROM updates GROUP BY ALL"""

UPSERT = f"""SELECT coalesce(s.user_id, u.user_id) AS user_id, coalesce(s.task_id, u.task_id) AS task_id,
    coalesce(s.dataset_split, u.dataset_split) AS dataset_split,
    CASE WHEN s.seq >= u.top OR u.top IS NULL THEN s.user_result_status ELSE u.status END AS user_result_status,
    CASE WHEN s.seq >= u.top OR u.top IS NULL THEN s.chatgpt_response ELSE u.response END AS chatgpt_response,
    coalesce(s.created_date, {CREATED}) AS created_date, greatest(coalesce(s.seq, u.top), coalesce(u.top, s.seq)) AS seq
    FROM stored_results s FULL JOIN ({LATEST}) u
    ON s.user_id = u.user_id AND s.task_id = u.task_id AND s.dataset_split = u.dataset_split"""


COUNTED = f"SELECT user_id, dataset_split, user_result_status, count(*) AS n FROM ({UPSERT}) GROUP BY ALL"
UPSERT_NAMELESS = UPSERT.replace("FROM updates", "FROM nameless")


def evaluation(split: str, user: str, keep_errors: bool = False) -> str:
    """Attempts of one user at one split with prompt, answer and error; needs questions, results, silver."""
    asked = (f"SELECT *, CASE WHEN {digit('prompt')} = 'f' THEN 'Error: too many' ELSE {truncated('prompt')} END "
             "AS response FROM prompts" if keep_errors else
             f"SELECT *, {truncated('prompt')} AS response FROM prompts WHERE {digit('prompt')} <> 'f'")
    status = "coalesce(r.user_result_status, 'N/A')"
    is_retry = f"({retry(status)} AND q.dataset_split = 'validation')"
    passes = f"(q.dataset_split = 'test' OR {is_retry} OR {status} LIKE 'Incorrect%')"
    return f"""attempts AS (SELECT q.task_id, q.dataset_split, q."Question", q."FinalAnswer", {is_retry} AS is_retry,
        {route('q.file_name', 't.text')} AS route,
        CASE WHEN {passes} THEN coalesce(q."Annotator_Metadata_Steps", '') END AS instructions, t.text AS context
        FROM questions q
        LEFT JOIN user_results r ON q.task_id = r.task_id AND r.user_id = '{user}' AND r.dataset_split = '{split}'
        LEFT JOIN silver t ON t.method = 'pymupdf' AND t.dataset_split = q.dataset_split
            AND t.base_name = {base_name('q.file_name')} AND lower({extension('q.file_name')}) = '.pdf'
        WHERE q.dataset_split = '{split}'),
    prompts AS (SELECT *, {prompt('"Question"', 'instructions', 'context')} AS prompt
        FROM attempts WHERE is_retry OR route = 'send'),
    answered AS ({asked}),
    judged AS (SELECT *, {judge_prompt('"Question"', '"FinalAnswer"', 'response')} AS judge_prompt FROM answered)"""


def recorded(updates: str, user: str) -> str:
    """Results after an evaluation whose updates are (task_id, dataset_split, status, response)."""
    return f"""SELECT coalesce(s.user_id, '{user}') AS user_id, coalesce(s.task_id, u.task_id) AS task_id,
        coalesce(s.dataset_split, u.dataset_split) AS dataset_split,
        coalesce(u.status, s.user_result_status) AS user_result_status,
        CASE WHEN u.task_id IS NOT NULL THEN u.response ELSE s.chatgpt_response END AS chatgpt_response,
        coalesce(s.created_date, {CREATED}) AS created_date,
        CASE WHEN u.task_id IS NOT NULL THEN CAST(1 AS BIGINT) ELSE s.seq END AS seq
        FROM user_results s FULL JOIN ({updates}) u
        ON s.task_id = u.task_id AND s.dataset_split = u.dataset_split AND s.user_id = '{user}'"""


JUDGED_STATUS = (f"CASE WHEN {digit('judge_prompt')} = 'f' THEN 'Error: OpenAI service is currently unavailable.' "
                 f"ELSE {verdict(digest_judge('judge_prompt'), 'instructions')} END")
EVALUATED = f"SELECT task_id, dataset_split, {JUDGED_STATUS} AS status, response FROM judged"
REVIEWED = """SELECT a.task_id, dataset_split, CASE WHEN quality = 1 THEN 'Correct with Instruction'
    ELSE 'Incorrect with Instruction' END AS status, response
    FROM answered a JOIN labels l ON a.task_id = CAST(l.doc_id AS VARCHAR) WHERE toxic <> 1"""
TEXT_JOINED = """SELECT q.*, coalesce(r.user_result_status, 'N/A') AS user_result_status FROM questions q
    LEFT JOIN user_results r ON q.task_id = r.task_id AND q.dataset_split = r.dataset_split"""

EXTRACTED = """SELECT dataset_split, file_name, CAST(i AS INTEGER) - 1 AS page,
    regexp_replace(parts[i], '<[^>]*>', '', 'g') AS text, CAST(NULL AS VARCHAR) AS error
    FROM (SELECT dataset_split, file_name, string_split(html, '</p>') AS parts FROM page_files),
    LATERAL (SELECT unnest(range(1, len(parts) + 1)) AS i)"""
STATUS_LABELS = """CASE WHEN toxic = 1 THEN 'Undecided' WHEN quality = 1 THEN 'Correct with Instruction'
    ELSE 'Incorrect with Instruction' END"""
# A bucket of the listing that an ingest of the pages finds.
INGESTED = f"""SELECT c.*, f.file_name IS NOT NULL AS found, c.number_of_tools = 'inf' AS bad FROM raw_questions c
    LEFT JOIN (SELECT dataset_split, page_id || '.pdf' AS file_name FROM page_files) f
    ON c.file_name = f.file_name AND c.dataset_split = f.dataset_split"""
DOCUMENT_TEXT = """list_aggregate(list_transform(string_split(html, '</p>'),
    lambda x: regexp_replace(x, '<[^>]*>', '', 'g')), 'string_agg', '')"""

ORACLE = {
    # Scans, sources, sinks
    "load_split": with_views(CLEAN_SELECT, "raw_questions"),
    "scan_questions": with_views("SELECT * FROM questions", "questions"),
    "scan_user_results": with_views(
        """SELECT user_id, task_id, user_result_status, chatgpt_response FROM user_results
        WHERE user_id = 'src3' AND dataset_split = 'validation'""", "user_results"),
    "overwrite_table": with_views("SELECT * FROM questions", "questions"),
    "overwrite_table_earlier": with_views('SELECT task_id, dataset_split, "Level" FROM questions', "questions"),
    "overwrite_table_emptied": with_views(
        "SELECT task_id, dataset_split FROM questions WHERE dataset_split = 'test'", "questions"),
    "bronze_ingest": with_views(
        """SELECT dataset_split, file_name,
        CASE WHEN dataset_split = 'test' THEN length ELSE CAST(strlen(file_name) AS BIGINT) END AS length,
        md5(CASE WHEN dataset_split = 'test' THEN html ELSE file_name END) AS digest FROM page_files""", "page_files"),
    "silver_write": with_views(
        """SELECT method, dataset_split, base_name, CAST(part AS BIGINT) AS part,
        md5(CASE WHEN lang = 'es' THEN 'first' WHEN part = 0 THEN substr(s.text, 1, 1000) ELSE substr(s.text, 1001) END)
        AS digest FROM silver s JOIN documents d ON s.base_name = CAST(d.doc_id AS VARCHAR),
        (VALUES (0), (1)) p(part) WHERE part = 0 OR length(s.text) > 1000 AND lang <> 'es'""", "silver"),
    "silver_lookup": with_views(
        f"""SELECT m.method, q.dataset_split, q.file_name, s.text
        FROM questions q CROSS JOIN (VALUES ('PyMuPDF', 'pymupdf'), ('Amazon Textract', 'textract')) m(method, folder)
        LEFT JOIN silver s ON s.method = m.folder AND s.dataset_split = q.dataset_split
            AND s.base_name = {base_name('q.file_name')}
        WHERE coalesce(q.file_name, '') <> ''""", "questions", "silver"),
    "json_records": with_views(
        """SELECT json_object('task_id', task_id, 'Question', "Question", 'Level', "Level", 'file_name', file_name,
        'dataset_split', dataset_split)::VARCHAR AS record FROM questions""", "questions"),
    # Projections
    "flatten_struct": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS props_k FROM events""",
    "rename_columns": with_views(
        """SELECT task_id, "Final answer" AS "FinalAnswer", number_of_steps AS "Annotator_Metadata_Number_of_steps",
        how_long AS "Annotator_Metadata_How_long_did_this_take",
        number_of_tools AS "Annotator_Metadata_Number_of_tools" FROM raw_questions""", "raw_questions"),
    "default_column": with_views("SELECT task_id, 'N/A' AS result_status FROM raw_questions", "raw_questions"),
    "stamp_created": "SELECT event_id, date_trunc('second', ts) AS created_date FROM events",
    "conform_schema": """SELECT CAST(doc_id AS VARCHAR) AS task_id, text AS "Question",
        CASE WHEN lang <> 'de' THEN CAST(n_chars AS INTEGER) END AS "Level", lang AS "FinalAnswer",
        source AS file_name, '' AS file_path, text AS "Annotator_Metadata_Steps",
        CAST(n_chars AS VARCHAR) AS "Annotator_Metadata_Number_of_steps",
        text AS "Annotator_Metadata_How_long_did_this_take", lang AS "Annotator_Metadata_Tools",
        CASE WHEN lang = 'en' THEN 3 END AS "Annotator_Metadata_Number_of_tools",
        CASE WHEN lang = 'es' THEN repeat(source, 20) ELSE 'N/A' END AS result_status,
        CASE WHEN lang <> 'fr' THEN TIMESTAMP '2024-01-01 00:00:00' END AS created_date, 'test' AS dataset_split,
        nullif(concat_ws('; ', CASE WHEN lang = 'de' THEN 'Level has a wrong type' END,
        CASE WHEN length(text) + length(regexp_replace(text, '[^\\x{10000}-\\x{10FFFF}]', '', 'g')) > 100
            THEN 'Annotator_Metadata_How_long_did_this_take too long' END,
        CASE WHEN lang <> 'en' THEN 'Annotator_Metadata_Number_of_tools has a wrong type' END,
        CASE WHEN lang = 'es' THEN 'result_status too long' END,
        CASE WHEN lang = 'fr' THEN 'created_date has a wrong type' END), '') AS reject_reason FROM documents""",
    "project_response": with_views(f"SELECT {RESPONSE_COLUMNS} FROM questions", "questions"),
    "project_result": with_views(
        "SELECT user_id, task_id, user_result_status, chatgpt_response FROM user_results", "user_results"),
    "project_users": with_views("SELECT user_id, username, role FROM users", "users"),
    "drop_conflicting": with_views(
        "SELECT user_id, task_id, dataset_split, chatgpt_response, created_date, seq FROM user_results",
        "user_results"),
    "question_preview": with_views(
        """SELECT "Question", "Level", substr("Question", 1, 50) || '...' AS label FROM questions""", "questions"),
    # Filters
    "filter_facets": with_views(
        f"""SELECT task_id, "Level", file_name, user_result_status FROM joined WHERE "Level" IN (1, 3)
        AND {bucket('file_name')} IN ('No File', '.pdf') AND user_result_status IN
        ('N/A', 'Correct without Instruction')""", "joined"),
    "filter_answered": with_views(
        "SELECT task_id, user_result_status FROM joined WHERE user_result_status <> 'N/A'", "joined"),
    "lookup_key": with_views("SELECT * FROM users WHERE username = 'Customer#000000007'", "users"),
    "lookup_keys": with_views(
        """SELECT w.username, u.user_id, u.role FROM (SELECT DISTINCT username FROM wanted_names) w
        LEFT JOIN users u ON w.username = u.username""", "wanted_names", "users"),
    "filter_has_file": with_views(
        "SELECT task_id, file_name FROM questions WHERE coalesce(file_name, '') <> ''", "questions"),
    "filter_pdf": with_views("SELECT * FROM files WHERE lower(path) LIKE '%.pdf'", "page_files", "files"),
    "filter_line_blocks": with_views("SELECT * FROM blocks WHERE block_type = 'LINE'", "blocks"),
    "validate_domain": """SELECT conv_id, turn, role, CASE WHEN role NOT IN ('user', 'assistant')
        THEN 'role not accepted' END AS reject_reason FROM conversations""",
    # Joins
    "join_results": with_views(
        """SELECT task_id, dataset_split, "Level", user_result_status, chatgpt_response FROM joined""", "joined"),
    "join_results_text_key": with_views(TEXT_JOINED, "questions", "user_results"),
    "join_empty_default": with_views(
        "SELECT task_id, dataset_split, 'N/A' AS user_result_status, 'N/A' AS chatgpt_response FROM questions",
        "questions"),
    "join_attachments": with_views("SELECT task_id, dataset_split, file_name, found FROM matched", "matched"),
    "join_silver_text": with_views(
        f"""SELECT q.task_id, q.dataset_split, q.file_name, t.text AS context FROM questions q
        LEFT JOIN silver t ON t.method = 'textract' AND t.dataset_split = q.dataset_split
            AND t.base_name = {base_name('q.file_name')} AND lower({extension('q.file_name')}) = '.pdf'""",
        "questions", "silver"),
    "join_silver_text_bounded": with_views(
        f"""SELECT q.task_id, CASE WHEN strlen(t.text) <= 3000 THEN t.text END AS context,
        coalesce(strlen(t.text) > 3000, FALSE) AS too_large FROM questions q
        LEFT JOIN silver t ON t.method = 'pymupdf' AND t.dataset_split = q.dataset_split
            AND t.base_name = {base_name('q.file_name')} AND lower({extension('q.file_name')}) = '.pdf'""",
        "questions", "silver"),
    "merge_match": with_views(
        f"""SELECT coalesce(s.user_id, u.user_id) AS user_id, coalesce(s.task_id, u.task_id) AS task_id,
        coalesce(s.dataset_split, u.dataset_split) AS dataset_split,
        CASE WHEN s.user_id IS NULL THEN 'insert' WHEN u.user_id IS NULL THEN 'keep'
        WHEN s.seq >= u.top THEN 'stale' ELSE 'update' END AS action
        FROM stored_results s FULL JOIN ({LATEST}) u
        ON s.user_id = u.user_id AND s.task_id = u.task_id AND s.dataset_split = u.dataset_split""",
        "feed", "updates", "stored_results"),
    "cascade_anti": with_views(
        "SELECT * FROM user_orders WHERE user_id NOT IN (SELECT user_id FROM wanted_ids)",
        "user_orders", "wanted_ids"),
    # Aggregations
    "status_counts": with_views(
        """SELECT user_result_status, count(*) AS n FROM joined WHERE user_result_status <> 'N/A' GROUP BY ALL""",
        "joined"),
    "status_totals": with_views(
        """SELECT count(*) AS total, count(*) FILTER (user_result_status <> 'N/A') AS answered,
        count(*) FILTER (user_result_status = 'N/A') AS unanswered FROM joined""", "joined"),
    "facet_values": with_views(
        f"""SELECT DISTINCT 'Level' AS facet, CAST("Level" AS VARCHAR) AS value FROM joined
        UNION SELECT 'file_type', {bucket('file_name')} FROM joined
        UNION SELECT 'status', user_result_status FROM joined""", "joined"),
    "ingest_summary": with_views(
        """SELECT q.*, f.files_landed, 'Loaded' AS status, rejected + rows_written = records AS table_written
        FROM (SELECT dataset_split, count(*) AS records, count(*) FILTER ("FinalAnswer" = 'de') AS rejected,
            count(*) FILTER ("FinalAnswer" NOT IN ('de', 'es')) AS rows_written FROM questions GROUP BY 1) q
        JOIN (SELECT dataset_split, count(*) AS files_landed FROM files GROUP BY 1) f
        ON q.dataset_split = f.dataset_split""", "questions", "page_files", "files"),
    "attachment_summary": with_views(
        f"""SELECT dataset_split, count(*) FILTER (coalesce(file_name, '') <> '') AS total_files,
        count(*) FILTER (found) AS files_found, count(*) FILTER (found) AS paths_updated,
        array_to_string(list_sort(list(DISTINCT lower({extension('file_name')})) FILTER (found)), ', ') AS file_types
        FROM matched GROUP BY dataset_split""", "matched"),
    "concat_pages": """SELECT CAST(conv_id AS VARCHAR) AS doc, turn // 1000 AS part,
        string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id, turn // 1000""",
    "concat_pages_parts": """SELECT CAST(conv_id AS VARCHAR) AS doc, turn // 3 AS part,
        string_agg(text, '' ORDER BY turn) AS text FROM conversations GROUP BY conv_id, turn // 3""",
    "concat_pages_bytes": """SELECT doc, part, string_agg(text, '' ORDER BY turn) AS text FROM (
        SELECT CAST(conv_id AS VARCHAR) AS doc, turn, text, CAST(coalesce(sum(CASE WHEN text = '' THEN 0 ELSE strlen(text) + 16 END)
        OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 500 AS BIGINT) AS part
        FROM conversations) GROUP BY doc, part""",
    "concat_lines_bytes": with_views(
        """SELECT doc, part, coalesce(string_agg(line, '' ORDER BY pos), '') AS text FROM (
        SELECT doc, pos, line, CAST(coalesce(sum(CASE WHEN line IS NULL THEN 0 ELSE strlen(line) + 16 END)
        OVER (PARTITION BY doc ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) // 300 AS BIGINT) AS part
        FROM (SELECT doc, pos, CASE WHEN block_type = 'LINE' THEN text || chr(10) END AS line FROM blocks
        WHERE job_status = 'SUCCEEDED')) GROUP BY doc, part""", "blocks"),
    "concat_pages_unnumbered": """SELECT CAST(conv_id AS VARCHAR) AS doc, CAST(sum(strlen(text)) AS BIGINT) AS bytes
        FROM conversations GROUP BY conv_id""",
    "join_parts": """SELECT CAST(conv_id AS VARCHAR) AS doc, string_agg(text, '' ORDER BY turn) AS text,
        CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id""",
    "join_parts_bounded": """SELECT CAST(conv_id AS VARCHAR) AS doc,
        CASE WHEN sum(strlen(text)) <= 2000 THEN string_agg(text, '' ORDER BY turn) END AS text,
        CAST(sum(strlen(text)) AS BIGINT) AS bytes FROM conversations GROUP BY conv_id""",
    "concat_lines": with_views(
        """SELECT doc, CAST(pos // 1000 AS BIGINT) AS part,
        coalesce(string_agg(text || chr(10), '' ORDER BY pos) FILTER (block_type = 'LINE'), '') AS text
        FROM blocks WHERE job_status = 'SUCCEEDED' GROUP BY doc, pos // 1000""", "blocks"),
    "concat_lines_parts": with_views(
        """SELECT doc, CAST(pos // 3 AS BIGINT) AS part,
        coalesce(string_agg(text || chr(10), '' ORDER BY pos) FILTER (block_type = 'LINE'), '') AS text
        FROM blocks WHERE job_status = 'SUCCEEDED' GROUP BY doc, pos // 3""", "blocks"),
    "extract_counts": with_views(
        """SELECT 'textract' AS method, count(*) AS listed, count(*) FILTER (job_status = 'SUCCEEDED') AS processed
        FROM (SELECT DISTINCT doc, job_status FROM blocks)
        UNION ALL SELECT 'pymupdf', count(*), count(*) FILTER (html LIKE '%</html>') FROM page_files""",
        "blocks", "page_files"),
    "prefix_counts": with_views(
        "SELECT dataset_split, count(*) AS objects FROM files GROUP BY dataset_split", "files"),
    # Sorts, limits, pages
    "page_slice": with_views(
        """SELECT task_id, dataset_split, "Level" FROM questions ORDER BY task_id LIMIT 9 OFFSET 27""", "questions"),
    "page_slice_deep": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_quantity LIMIT 9 OFFSET 10800""",
    "page_slice_stored": """SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem
        ORDER BY l_orderkey, l_linenumber, l_quantity LIMIT 9 OFFSET 2700""",
    "page_slice_clashing": with_views(
        "SELECT doc, page, text FROM pages_text ORDER BY doc, page LIMIT 9 OFFSET 27", "pages_text"),
    "page_clamp": """SELECT user_id, count(*) AS rows, greatest(0, least(max(event_id) // 100, (count(*) - 1) // 9))
        ::BIGINT AS page FROM events GROUP BY user_id""",
    "page_assign": with_views(
        """SELECT task_id, dataset_split, position, position // 9 AS page FROM
        (SELECT *, row_number() OVER (ORDER BY task_id) - 1 AS position FROM questions)""", "questions"),
    "page_assign_copies": """SELECT l_returnflag, l_linestatus, l_quantity, position, position // 9 AS page FROM
        (SELECT l_returnflag, l_linestatus, l_quantity,
        row_number() OVER (ORDER BY l_returnflag, l_linestatus, l_quantity) - 1 AS position FROM lineitem)""",
    "sort_facets": with_views(
        f"""SELECT facet, value, CAST(row_number() OVER (PARTITION BY facet ORDER BY value) AS INTEGER) AS place FROM (
        SELECT DISTINCT 'Level' AS facet, CAST("Level" AS VARCHAR) AS value FROM joined
        UNION SELECT 'status', user_result_status FROM joined)""", "joined"),
    "sort_facets_paged": with_views(
        f"""SELECT value, row_number() OVER (ORDER BY value) - 1 AS position, (row_number() OVER (ORDER BY value) - 1) // 9 AS page
        FROM (SELECT DISTINCT {bucket('file_name')} AS value FROM joined)""", "joined"),
    "sort_counts": with_views(
        """SELECT "Level", user_result_status, n, CAST(row_number() OVER
        (PARTITION BY "Level" ORDER BY n DESC, user_result_status) AS INTEGER) AS place
        FROM (SELECT "Level", user_result_status, count(*) AS n FROM joined WHERE user_result_status <> 'N/A'
        GROUP BY ALL)""", "joined"),
    "first_n_listing": with_views("SELECT * FROM files ORDER BY path LIMIT 10", "page_files", "files"),
    # Set operations
    "union_splits": with_views("SELECT * FROM files", "page_files", "files"),
    # Scalars
    "clean_strings": with_views(
        f"""SELECT task_id, {clean('"Final answer"')} AS "FinalAnswer", {clean('steps')} AS steps FROM raw_questions""",
        "raw_questions"),
    "coerce_int": f"""SELECT event_id, {to_int('CAST(value AS VARCHAR)')} AS number, {to_int('props')} AS json_number,
        {to_int("'-' || CAST(user_id AS VARCHAR) || '.9 '")} AS negative FROM events""",
    "file_extension": with_views(
        f"SELECT path, {extension('path')} AS extension, {extension('file_name')} AS name_extension FROM files",
        "page_files", "files"),
    "file_type_bucket": with_views(
        f"SELECT task_id, {bucket('file_name')} AS file_type FROM questions", "questions"),
    "base_name": with_views(f"SELECT path, {base_name('path')} AS base_name FROM files", "page_files", "files"),
    "silver_key": with_views(
        f"""SELECT path, 'silver/pdf/textract/' || {base_name('path')} || '.txt' AS textract_key,
        'silver/pdf/pymupdf/' || {base_name('path')} || '.txt' AS other_key FROM files""", "page_files", "files"),
    "rewrite_path": with_views(
        f"SELECT task_id, CASE WHEN found THEN {URL} ELSE file_path END AS file_path FROM matched", "matched"),
    "build_prompt": with_views(
        f"""SELECT q.task_id, {prompt('q."Question"', 'q."Annotator_Metadata_Steps"', 't.text')} AS prompt
        FROM questions q LEFT JOIN silver t ON t.method = 'pymupdf' AND t.dataset_split = q.dataset_split
        AND t.base_name = {base_name('q.file_name')} AND lower({extension('q.file_name')}) = '.pdf'""",
        "questions", "silver"),
    "build_judge_prompt": with_views(
        f"""SELECT task_id, {judge_prompt('"Question"', 'file_name', '"Annotator_Metadata_Steps"')} AS prompt
        FROM questions""", "questions"),
    "truncate_answer": f"SELECT doc_id, {truncated('text')} AS answer FROM documents",
    "truncate_pages": f"SELECT page_id, {truncated('html')} AS answer FROM pages",
    "parse_verdict": f"SELECT doc_id, {verdict('text', 'source')} AS status, {verdict('lang', 'NULL')} AS bare FROM documents",
    "map_model_error": """SELECT event_id, CASE event_type WHEN 'view' THEN 'Error: ' || props
        WHEN 'click' THEN 'Error: ' || props
        WHEN 'purchase' THEN 'An error occurred while processing the request. Please try again later.'
        WHEN 'signup' THEN 'An unexpected error occurred. Please contact support.' END AS answer_text,
        CASE event_type WHEN 'view' THEN 'Error: OpenAI service is currently unavailable.'
        WHEN 'click' THEN 'Error: OpenAI service is currently unavailable.'
        WHEN 'purchase' THEN 'Error' WHEN 'signup' THEN 'Error' END AS judge_status FROM events""",
    "instruction_policy": with_views(
        f"""SELECT task_id, CASE WHEN dataset_split = 'test' OR user_result_status LIKE 'Incorrect%'
        THEN "Annotator_Metadata_Steps" END AS first_attempt, "Annotator_Metadata_Steps" AS retry FROM joined""",
        "joined"),
    "retry_candidate": with_views(
        f"SELECT task_id, {retry('user_result_status')} AS retry FROM joined", "joined"),
    "prefill_instructions": with_views(
        """SELECT task_id, coalesce("Annotator_Metadata_Steps", '') AS instructions FROM questions""", "questions"),
    "route_eligibility": with_views(
        f"""SELECT q.task_id, {route('q.file_name', 't.text')} AS route FROM questions q
        LEFT JOIN silver t ON t.method = 'pymupdf' AND t.dataset_split = q.dataset_split
        AND t.base_name = {base_name('q.file_name')} AND lower({extension('q.file_name')}) = '.pdf'""",
        "questions", "silver"),
    "is_correct": with_views(
        "SELECT task_id, user_result_status LIKE 'Correct%' AS correct FROM joined", "joined"),
    "fill_na": with_views(
        "SELECT task_id, coalesce(file_name, 'N/A') AS file_name FROM questions", "questions"),
    # Streaming and mutations
    "stream_results": with_views(UPSERT, "updates", "stored_results"),
    "stream_results_rejected": with_views(
        """SELECT user_id, task_id, status, chatgpt_response, 'train' AS dataset_split,
        'dataset_split not accepted' AS reject_reason FROM feed WHERE task_id = 'view'""", "feed"),
    "stream_documents": with_views(
        f"""SELECT 'pymupdf' AS method, dataset_split, file_name AS base_name, CAST(0 AS BIGINT) AS part,
        {DOCUMENT_TEXT} AS text FROM page_files""", "page_files"),
    "stream_documents_once": with_views(
        f"""SELECT 'pymupdf' AS method, dataset_split, prefix || file_name AS base_name, CAST(0 AS BIGINT) AS part,
        {DOCUMENT_TEXT} AS text FROM page_files, (VALUES (''), ('copy-')) p(prefix)""", "page_files"),
    "upsert_results": with_views(UPSERT, "updates", "stored_results"),
    "upsert_results_null_keys": with_views(UPSERT_NAMELESS, "nameless", "stored_results"),
    "merge_match_null_keys": with_views(
        f"""SELECT s.user_id, s.task_id, s.dataset_split, CASE WHEN u.top IS NULL THEN 'keep' ELSE 'stale' END AS action
        FROM ({UPSERT_NAMELESS}) s LEFT JOIN ({LATEST.replace("FROM updates", "FROM nameless")}) u
        ON s.user_id = u.user_id AND s.task_id IS NOT DISTINCT FROM u.task_id AND s.dataset_split = u.dataset_split""",
        "nameless", "stored_results"),
    "upsert_results_store": with_views(UPSERT, "updates", "stored_results"),
    "status_counts_kept": with_views(COUNTED, "updates", "stored_results"),
    "status_counts_kept_user": with_views(
        f"SELECT dataset_split, user_result_status, n FROM ({COUNTED}) WHERE user_id = '7'", "updates", "stored_results"),
    "erase_users_store": with_views(
        f"SELECT * FROM ({UPSERT}) WHERE CAST(user_id AS BIGINT) % 2 <> 0", "updates", "stored_results"),
    "erase_users_store_proof": with_views(
        f"""SELECT user_id, count(*) AS results FROM ({UPSERT}) WHERE CAST(user_id AS BIGINT) % 2 = 0 GROUP BY user_id""",
        "updates", "stored_results"),
    "stream_results_store": with_views(UPSERT, "updates", "stored_results"),
    "stream_results_counts": with_views(COUNTED, "updates", "stored_results"),
    "insert_if_absent": with_views(
        """SELECT username, role FROM users UNION ALL SELECT DISTINCT username, 'user' FROM wanted_names
        WHERE username NOT IN (SELECT username FROM users)""", "users", "wanted_names"),
    "insert_if_absent_rejected": with_views(
        "SELECT DISTINCT username FROM wanted_names WHERE username IN (SELECT username FROM users)",
        "users", "wanted_names"),
    "delete_cascade": with_views(
        "SELECT user_id, task_id FROM user_orders WHERE user_id NOT IN (SELECT user_id FROM wanted_ids)",
        "user_orders", "wanted_ids"),
    "delete_cascade_users": with_views(
        "SELECT * FROM users WHERE user_id NOT IN (SELECT user_id FROM wanted_ids)", "users", "wanted_ids"),
    "delete_cascade_unknown": with_views(
        "SELECT DISTINCT user_id FROM wanted_ids WHERE user_id NOT IN (SELECT user_id FROM users)",
        "users", "wanted_ids"),
    "update_role": with_views(
        """SELECT user_id, username, CASE WHEN user_id IN (SELECT user_id FROM wanted_ids) THEN 'admin'
        ELSE role END AS role FROM users""", "users", "wanted_ids"),
    "update_role_unknown": with_views(
        "SELECT DISTINCT user_id FROM wanted_ids WHERE user_id NOT IN (SELECT user_id FROM users)",
        "users", "wanted_ids"),
    # Jobs
    "batch_infer": with_views(
        f"""SELECT task_id, CASE WHEN {digit('"Question"')} <> 'f' THEN "Question" END AS answer,
        CASE WHEN {digit('"Question"')} = 'f' THEN 'rate_limit' END AS error_kind,
        CASE WHEN {digit('"Question"')} = 'f' THEN 'too many' END AS error_message FROM questions""", "questions"),
    "batch_infer_budget": with_views(
        """SELECT task_id, "Question" AS answer, CAST(NULL AS VARCHAR) AS error_kind, CAST(NULL AS VARCHAR) AS error_message
        FROM questions""", "questions"),
    "batch_judge": with_views(
        f"""SELECT task_id, {digest_judge('"Question"')} AS answer,
        CASE WHEN {digit('"Question"')} = 'f' THEN 'connection' END AS error_kind,
        CASE WHEN {digit('"Question"')} = 'f' THEN '' END AS error_message FROM questions""", "questions"),
    "extract_documents": with_views(EXTRACTED, "page_files"),
    "run_evaluation": with_views("", "questions", "user_results", "silver").rstrip() + ",\n"
        + evaluation("validation", "src3") + "\n" + recorded(EVALUATED, "src3"),
    "run_evaluation_retry": with_views("", "questions", "user_results", "silver").rstrip() + ",\n"
        + evaluation("validation", "src3")
        + f"\nSELECT task_id, {JUDGED_STATUS} AS status, response AS chatgpt_response FROM judged WHERE is_retry",
    "run_evaluation_keep_errors": with_views("", "questions", "user_results", "silver").rstrip() + ",\n"
        + evaluation("validation", "src3", keep_errors=True)
        + f"\nSELECT task_id, {JUDGED_STATUS} AS status, response AS chatgpt_response FROM judged",
    "run_evaluation_attempts": with_views("", "questions", "user_results", "silver").rstrip() + ",\n"
        + evaluation("validation", "src3")
        + f"""\nSELECT task_id, large_route AS route, sent,
        CASE WHEN sent AND {digit('prompt')} <> 'f' THEN {truncated('prompt')} END AS chatgpt_response,
        CASE WHEN sent AND {digit('prompt')} = 'f' THEN 'Error: too many' END AS error_text FROM (
        SELECT *, {prompt('"Question"', 'instructions', 'context')} AS prompt,
        coalesce(strlen(context) > 3000, FALSE) AS large,
        CASE WHEN large THEN 'too_large' ELSE route END AS large_route,
        (is_retry OR route = 'send') AND NOT large AS sent FROM attempts)""",
    "run_extract": with_views(
        f"""SELECT dataset_split, CAST(page_id AS VARCHAR) AS base_name, CAST(0 AS BIGINT) AS part,
        {DOCUMENT_TEXT} AS text, 'pymupdf' AS method FROM page_files WHERE html LIKE '%</html>'
        UNION ALL SELECT 'test', doc, CAST(pos // 1000 AS BIGINT),
        coalesce(string_agg(text || chr(10), '' ORDER BY pos) FILTER (block_type = 'LINE'), ''), 'textract'
        FROM blocks WHERE job_status = 'SUCCEEDED' GROUP BY doc, pos // 1000""", "page_files", "blocks"),
    "run_extract_failed": with_views(
        """SELECT dataset_split, page_id || '.pdf' AS file_name FROM page_files WHERE NOT html LIKE '%</html>'""",
        "page_files"),
    "run_extract_counts": with_views(
        """SELECT 'textract' AS method, count(*) AS listed, count(*) FILTER (job_status = 'SUCCEEDED') AS processed
        FROM (SELECT DISTINCT doc, job_status FROM blocks)
        UNION ALL SELECT 'pymupdf', count(*), count(*) FILTER (html LIKE '%</html>') FROM page_files""",
        "blocks", "page_files"),
    "run_manual_review_rejects": with_views("", "questions", "user_results", "silver").rstrip() + ",\n"
        + evaluation("test", "src3")
        + f"""\nSELECT CAST(l.doc_id AS VARCHAR) AS task_id, {STATUS_LABELS} AS status,
        CASE WHEN a.task_id IS NULL THEN 'no answer' ELSE 'status not accepted' END AS reject_reason
        FROM labels l LEFT JOIN answered a ON a.task_id = CAST(l.doc_id AS VARCHAR)
        WHERE a.task_id IS NULL OR toxic = 1""",
    "run_ingest_rejects": with_views(
        """SELECT task_id, dataset_split, 'Annotator_Metadata_Number_of_tools: number out of range' AS reject_reason
        FROM raw_questions WHERE number_of_tools = 'inf'""", "raw_questions"),
    "run_ingest_attachments": with_views(
        f"""SELECT dataset_split, count(*) FILTER (file_name IS NULL OR file_name <> '') AS total_files,
        count(*) FILTER (found) AS files_found, count(*) FILTER (found) AS paths_updated,
        array_to_string(list_sort(list(DISTINCT lower({extension('file_name')})) FILTER (found)), ', ') AS file_types
        FROM ({INGESTED}) GROUP BY dataset_split""", "raw_questions", "page_files"),
    "run_ingest_summary": with_views(
        f"""SELECT dataset_split, 'Loaded' AS status, count(*) AS records, count(*) FILTER (bad) AS rejected,
        count(DISTINCT file_name) FILTER (found) AS files_landed, count(*) FILTER (NOT bad) AS rows_written,
        TRUE AS table_written FROM ({INGESTED}) GROUP BY dataset_split""", "raw_questions", "page_files"),
    "run_manual_review": with_views("", "questions", "user_results", "silver").rstrip() + ",\n"
        + evaluation("test", "src3") + "\n" + recorded(REVIEWED, "src3"),
    "run_ingest": with_views(
        f"""SELECT c.* REPLACE (CASE WHEN f.file_name IS NOT NULL THEN
            'https://attachments.s3.amazonaws.com/bronze/' || c.dataset_split || '/' || c.file_name
            ELSE c.file_path END AS file_path)
        FROM ({CLEAN_SELECT} WHERE number_of_tools <> 'inf') c
        LEFT JOIN (SELECT dataset_split, page_id || '.pdf' AS file_name FROM page_files) f
        ON c.file_name = f.file_name AND c.dataset_split = f.dataset_split""", "raw_questions", "page_files"),
    "run_summary": with_views(
        """SELECT r.user_result_status, count(*) AS n FROM questions q JOIN user_results r
        ON q.task_id = r.task_id AND r.user_id = 'src3' AND r.dataset_split = 'validation'
        WHERE q.dataset_split = 'validation' GROUP BY ALL""", "questions", "user_results"),
    "run_summary_totals": with_views(
        """SELECT count(*) AS total, count(r.task_id) AS answered, count(*) - count(r.task_id) AS unanswered
        FROM questions q LEFT JOIN user_results r
        ON q.task_id = r.task_id AND r.user_id = 'src3' AND r.dataset_split = 'validation'
        WHERE q.dataset_split = 'validation'""", "questions", "user_results"),
    "run_summary_all": with_views(
        """SELECT user_id, dataset_split, total, answered, total - answered AS unanswered FROM
        (SELECT user_id, dataset_split, count(*) AS answered FROM user_results GROUP BY ALL)
        JOIN (SELECT dataset_split, count(*) AS total FROM questions GROUP BY ALL) USING (dataset_split)""",
        "questions", "user_results"),
    "run_summary_all_counts": with_views(
        """SELECT user_id, dataset_split, user_result_status, count(*) AS n FROM user_results GROUP BY ALL""",
        "user_results"),
    "run_browse": with_views(
        f"""SELECT q.task_id, q."Level", q.file_name, coalesce(r.user_result_status, 'N/A') AS user_result_status,
        q."Question" FROM questions q LEFT JOIN user_results r
        ON q.task_id = r.task_id AND r.user_id = 'src3' AND r.dataset_split = 'validation'
        WHERE q.dataset_split = 'validation' AND "Level" IN (2, 3) AND {bucket('q.file_name')} IN ('No File', '.pdf')
        ORDER BY q.task_id LIMIT 9 OFFSET 9""", "questions", "user_results"),
    "run_browse_facets": with_views(
        f"""SELECT DISTINCT 'Level' AS facet, CAST("Level" AS VARCHAR) AS value FROM questions
        WHERE dataset_split = 'validation'
        UNION SELECT 'file_type', {bucket('file_name')} FROM questions WHERE dataset_split = 'validation'
        UNION SELECT 'status', coalesce(r.user_result_status, 'N/A') FROM questions q LEFT JOIN user_results r
        ON q.task_id = r.task_id AND r.user_id = 'src3' AND r.dataset_split = 'validation'
        WHERE q.dataset_split = 'validation'""", "questions", "user_results"),
    "run_browse_total": with_views(
        f"""SELECT count(*) AS questions, count(*) FILTER (dataset_split = 'validation' AND "Level" IN (2, 3)
        AND {bucket('file_name')} IN ('No File', '.pdf')) AS total,
        least(1, greatest(total - 1, 0) // 9) AS page FROM questions""", "questions"),
}
