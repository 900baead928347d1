"""One query per operator, over whole tables."""

from pyspark.sql import DataFrame, SparkSession, Window, functions as F, types as T

from evalspark import schemas
from evalspark.functions import cleaning, files as names, grading, prompts, text
from evalspark.operators import aggregates, documents, filters, inference, joins, mutations, paging, shaping
from evalspark.plans import evaluate, extract, ingest, report
from evalspark.sources import objects, pages as stored_pages, results as result_store, tables, versions
from evalspark.staging import new_path, stage
from evalspark.streaming import documents as document_stream, results as result_stream
from workload import models, views
from workload.views import created

USER = "src3"
KEY = ("dataset_split", "task_id")


def _joined(spark: SparkSession, sf: str) -> DataFrame:
    return joins.join_results(views.questions(spark, sf), views.user_results(spark, sf), KEY)


def _matched(spark, sf):
    return joins.join_attachments(views.questions(spark, sf), views.files(spark, sf))


def _with_text(spark, sf, method):
    return joins.join_silver_text(views.questions(spark, sf), views.silver(spark, sf), method)


# Scans, sources, sinks

def load_split(spark, sf):
    path = new_path(spark, "raw")
    views.raw_questions(spark, sf).write.json(path)
    loaded = [tables.load_split(spark, path, split, created=created()) for split in schemas.SPLITS]
    return objects.union_splits(loaded).select(*schemas.QUESTIONS.fieldNames())


def scan_questions(spark, sf):
    questions = views.questions(spark, sf)
    return objects.union_splits([tables.scan_questions(questions, split) for split in schemas.SPLITS])


def scan_user_results(spark, sf):
    return tables.scan_user_results(views.user_results(spark, sf), USER, "validation")


def overwrite_table(spark, sf):
    path = new_path(spark, "questions")
    questions = views.questions(spark, sf)
    tables.overwrite_table(questions, path, schemas.SPLITS)
    for split in schemas.SPLITS:
        tables.overwrite_table(tables.scan_questions(questions, split), path, [split])
    return tables.read_table(spark, path, schemas.QUESTIONS)


def overwrite_table_earlier(spark, sf):
    """The table as of its first version, read after two more were published."""
    path = new_path(spark, "questions")
    questions = views.questions(spark, sf)
    first = tables.overwrite_table(questions, path, schemas.SPLITS)
    tables.overwrite_table(questions.limit(0), path, ["validation"])
    tables.overwrite_table(questions.where(F.col("FinalAnswer") == "de"), path, ["test"])
    return tables.read_table(spark, path, schemas.QUESTIONS, first.number).select("task_id", "dataset_split", "Level")


def overwrite_table_emptied(spark, sf):
    """A second load without rows for one split."""
    path = new_path(spark, "questions")
    questions = views.questions(spark, sf)
    tables.overwrite_table(questions, path, schemas.SPLITS)
    tables.overwrite_table(tables.scan_questions(questions, "test"), path, schemas.SPLITS)
    return tables.read_table(spark, path, schemas.QUESTIONS).select("task_id", "dataset_split")


def bronze_ingest(spark, sf):
    """All files, then those of one split with other contents."""
    path, files = new_path(spark, "bronze"), views.page_files(spark, sf)
    objects.bronze_ingest(files.withColumn("content", F.encode("file_name", "UTF-8")), files, path, 0)
    objects.bronze_ingest(files.where(F.col("dataset_split") == "test"), files, path, 1)
    return objects.read_bronze(spark, path).select(
        "dataset_split", "file_name", "length", F.md5("content").alias("digest")
    )


def silver_write(spark, sf):
    """Every document, then one split after the other without the Spanish ones, whose first text stays."""
    path, rows = new_path(spark, "silver"), views.silver(spark, sf)
    method = F.when(F.col("method") == "textract", names.TEXTRACT_METHOD).otherwise(names.PYMUPDF_METHOD)
    spanish = views.table(spark, sf, "documents").where(F.col("lang") == "es").select(F.col("doc_id").cast("string"))
    documents_in = rows.select(
        method.alias("method"), "dataset_split", F.concat("base_name", F.lit(".pdf")).alias("path"), "part", "text",
    )
    later = rows.join(spanish, F.col("base_name") == F.col("doc_id"), "left_anti").select(
        method.alias("method"), "dataset_split", F.concat("base_name", F.lit(".pdf")).alias("path"), "part", "text",
    )
    objects.silver_write(documents_in.where(F.col("part") == 0).withColumn("text", F.lit("first")), path, 0)
    for written, split in enumerate(schemas.SPLITS, 1):
        objects.silver_write(later.where(F.col("dataset_split") == split), path, written)
    return objects.read_silver(spark, path).select(
        "method", "dataset_split", "base_name", "part", F.md5(F.encode("text", "UTF-8")).alias("digest")
    )


def silver_lookup(spark, sf):
    methods = F.array(F.lit(names.PYMUPDF_METHOD), F.lit(names.TEXTRACT_METHOD))
    requests = filters.filter_has_file(views.questions(spark, sf)).select(
        F.explode(methods).alias("method"), "dataset_split", "file_name"
    )
    return objects.silver_lookup(requests, views.silver(spark, sf)).select(
        "method", "dataset_split", "file_name", "text"
    )


def json_records(spark, sf):
    return tables.json_records(
        views.questions(spark, sf).select("task_id", "Question", "Level", "file_name", "dataset_split")
    )


# Projections

def flatten_struct(spark, sf):
    events = views.table(spark, sf, "events").select("event_id", "props")
    return shaping.flatten_struct(events, "props", "props_", T.StructType([T.StructField("k", T.LongType())]))


def rename_columns(spark, sf):
    flat = shaping.flatten_struct(views.raw_questions(spark, sf), schemas.NESTED_COLUMN, schemas.NESTED_PREFIX)
    return shaping.rename_columns(flat, schemas.RAW_RENAMES).select("task_id", *schemas.RAW_RENAMES.values())


def default_column(spark, sf):
    raw = views.raw_questions(spark, sf)
    return shaping.default_column(raw, "result_status", "N/A").select("task_id", "result_status")


def stamp_created(spark, sf):
    events = views.table(spark, sf, "events")
    return tables.stamp_created(events, F.col("ts")).select("event_id", "created_date")


def conform_schema(spark, sf):
    lang = F.col("lang")
    given = views.table(spark, sf, "documents").select(
        F.col("doc_id").alias("TASK_ID"), F.col("text").alias("question"),
        F.when(lang == "de", "many").otherwise(F.col("n_chars").cast("string")).alias("Level"),
        lang.alias("FinalAnswer"), F.col("source").alias("file_name"), F.lit("").alias("file_path"),
        F.col("text").alias("Annotator_Metadata_Steps"), F.col("n_chars").alias("Annotator_Metadata_Number_of_steps"),
        F.col("text").alias("Annotator_Metadata_How_long_did_this_take"), lang.alias("Annotator_Metadata_Tools"),
        F.when(lang == "en", "3").otherwise(F.col("source")).alias("Annotator_Metadata_Number_of_tools"),
        F.when(lang == "es", F.repeat("source", 20)).otherwise("N/A").alias("result_status"),
        F.when(lang == "fr", "someday").otherwise("2024-01-01 00:00:00").alias("created_date"),
        F.lit("test").alias("dataset_split"),
    )
    return shaping.conform_schema(given, schemas.QUESTIONS, schemas.QUESTION_LIMITS)


def project_response(spark, sf):
    return shaping.project_response(views.questions(spark, sf))


def project_result(spark, sf):
    return shaping.project_result(views.user_results(spark, sf))


def project_users(spark, sf):
    return shaping.project_users(views.users(spark, sf))


def drop_conflicting(spark, sf):
    return shaping.drop_conflicting(views.user_results(spark, sf))


def question_preview(spark, sf):
    return shaping.question_preview(views.questions(spark, sf))


# Filters

def filter_facets(spark, sf):
    kept = filters.filter_facets(
        _joined(spark, sf), [1, 3], ["No File", ".pdf"], ["N/A", "Correct without Instruction"]
    )
    return kept.select("task_id", "Level", "file_name", "user_result_status")


def filter_answered(spark, sf):
    return filters.filter_answered(_joined(spark, sf)).select("task_id", "user_result_status")


def lookup_key(spark, sf):
    return filters.lookup_key(views.users(spark, sf), "username", "Customer#000000007")


def lookup_keys(spark, sf):
    return filters.lookup_keys(views.users(spark, sf), "username", views.wanted_names(spark, sf))


def filter_has_file(spark, sf):
    return filters.filter_has_file(views.questions(spark, sf)).select("task_id", "file_name")


def filter_pdf(spark, sf):
    return objects.filter_pdf(views.files(spark, sf), case_sensitive=False)


def filter_line_blocks(spark, sf):
    return filters.filter_line_blocks(views.blocks(spark, sf))


def validate_domain(spark, sf):
    turns = views.table(spark, sf, "conversations").select("conv_id", "turn", "role")
    return filters.validate_domain(turns, {"role": ["user", "assistant"]})


# Joins

def join_results(spark, sf):
    return _joined(spark, sf).select("task_id", "dataset_split", "Level", "user_result_status", "chatgpt_response")


def join_results_text_key(spark, sf):
    return joins.join_results_text_key(views.questions(spark, sf), views.user_results(spark, sf), KEY)


def join_empty_default(spark, sf):
    none = views.user_results(spark, sf).where(F.col("user_id").isNull())
    joined = joins.join_results(views.questions(spark, sf), none, KEY)
    return joined.select("task_id", "dataset_split", "user_result_status", "chatgpt_response")


def join_attachments(spark, sf):
    return _matched(spark, sf).select("task_id", "dataset_split", "file_name", "found")


def join_silver_text(spark, sf):
    return _with_text(spark, sf, names.TEXTRACT_METHOD).select("task_id", "dataset_split", "file_name", "context")


def join_silver_text_bounded(spark, sf):
    """Texts of more than 3,000 bytes are not brought together."""
    joined = joins.join_silver_text(views.questions(spark, sf), views.silver(spark, sf), names.PYMUPDF_METHOD, 3000)
    return joined.select("task_id", "context", "too_large")


def merge_match(spark, sf):
    return mutations.merge_match(views.stored_results(spark, sf), views.updates(spark, sf))


def cascade_anti(spark, sf):
    return mutations.cascade_anti(views.user_orders(spark, sf), views.wanted_ids(spark, sf))


# Aggregations

def _statuses(spark, sf):
    return joins.join_statuses(views.questions(spark, sf), views.user_results(spark, sf), KEY)


def status_counts(spark, sf):
    return aggregates.status_counts(_statuses(spark, sf), weight="n")


def status_totals(spark, sf):
    return aggregates.status_totals(_statuses(spark, sf), weight="n")


def facet_values(spark, sf):
    return aggregates.facet_values(_statuses(spark, sf))


def ingest_summary(spark, sf):
    """German rows are rejected; Spanish ones are missing from the table, which the report must notice."""
    questions = views.questions(spark, sf)
    rejected = questions.where(F.col("FinalAnswer") == "de")
    written = questions.where(~F.col("FinalAnswer").isin("de", "es"))
    return aggregates.ingest_summary(questions, rejected, views.files(spark, sf), written)


def attachment_summary(spark, sf):
    return aggregates.attachment_summary(_matched(spark, sf))


def concat_pages(spark, sf):
    return aggregates.concat_pages(views.pages_text(spark, sf))


def concat_pages_parts(spark, sf):
    return aggregates.concat_pages(views.pages_text(spark, sf), pieces=3)


def concat_pages_bytes(spark, sf):
    return aggregates.concat_pages(views.pages_text(spark, sf), pieces=3, part_bytes=500)


def concat_lines_bytes(spark, sf):
    return aggregates.concat_lines(views.blocks(spark, sf), pieces=2, part_bytes=300)


def concat_pages_unnumbered(spark, sf):
    """Every second page without a number: what all parts of a document hold together."""
    odd = F.when(F.col("page") % 2 == 0, F.col("page"))
    parts = aggregates.concat_pages(views.pages_text(spark, sf).withColumn("page", odd), pieces=2, part_bytes=200)
    return parts.groupBy("doc").agg(F.sum(F.octet_length("text")).alias("bytes"))


def join_parts(spark, sf):
    return joins.join_parts(aggregates.concat_pages(views.pages_text(spark, sf), pieces=3))


def join_parts_bounded(spark, sf):
    """Documents of more than 2,000 bytes keep their size only."""
    return joins.join_parts(aggregates.concat_pages(views.pages_text(spark, sf), pieces=3), largest=2000)


def concat_lines(spark, sf):
    return aggregates.concat_lines(views.blocks(spark, sf))


def concat_lines_parts(spark, sf):
    return aggregates.concat_lines(views.blocks(spark, sf), pieces=3)


def extract_counts(spark, sf):
    blocks = views.blocks(spark, sf).select("doc", "job_status").distinct()
    whole = F.decode("content", "UTF-8").endswith("</html>")
    pages = views.page_files(spark, sf).select(F.when(whole, "SUCCEEDED").otherwise("FAILED").alias("job_status"))
    return aggregates.extract_counts(
        blocks.select(F.lit("textract").alias("method"), "job_status")
        .unionByName(pages.select(F.lit("pymupdf").alias("method"), "job_status"))
    )


def prefix_counts(spark, sf):
    return objects.prefix_counts(views.files(spark, sf))


# Sorts, limits, pages

def page_slice(spark, sf):
    return paging.page_slice(views.questions(spark, sf), 3).select("task_id", "dataset_split", "Level")


def page_slice_deep(spark, sf):
    items = views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    return paging.numbered_page(paging.page_assign(items, items.columns), 1200)


def page_slice_stored(spark, sf):
    """A page far down, from the one part of a stored table that holds it."""
    path, items = new_path(spark, "pages"), views.table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity")
    stored_pages.write_pages(items, path, items.columns, pages_per_part=50)
    return stored_pages.read_page(spark, path, 300).rows


def page_slice_clashing(spark, sf):
    """A page of a table that has a column named page."""
    turns = views.pages_text(spark, sf)
    own = ("row_place", "row_page")
    return paging.numbered_page(paging.page_assign(turns, ["doc", "page"], names=own), 3, own)


def page_clamp(spark, sf):
    requested = F.floor(F.max("event_id") / 100)
    per_user = views.table(spark, sf, "events").groupBy("user_id").agg(
        F.count("*").alias("rows"), requested.alias("requested")
    )
    return per_user.select("user_id", "rows", paging.page_clamp(F.col("requested"), F.col("rows")).alias("page"))


def page_assign(spark, sf):
    questions = views.questions(spark, sf).select("task_id", "dataset_split")
    return paging.page_assign(questions)


def page_assign_copies(spark, sf):
    items = views.table(spark, sf, "lineitem").select("l_returnflag", "l_linestatus", "l_quantity")
    return paging.page_assign(items, items.columns, unique=False)


def sort_facets(spark, sf):
    """Levels and statuses, which are few, with their place."""
    place = F.row_number().over(Window.partitionBy("facet").orderBy("value"))
    bounded = aggregates.facet_values(_statuses(spark, sf)).where(F.col("facet").isin("Level", "status"))
    return bounded.withColumn("place", place)


def sort_facets_paged(spark, sf):
    """File types, of which there may be many, with their place: numbered without a window over all of them."""
    facets = aggregates.facet_values(_statuses(spark, sf)).where(F.col("facet") == "file_type").select("value")
    return paging.page_assign(facets, ["value"])


def sort_counts(spark, sf):
    place = F.row_number().over(Window.partitionBy("Level").orderBy(F.desc("n"), "user_result_status"))
    return aggregates.status_counts(_statuses(spark, sf), ["Level"], "n").withColumn("place", place)


def first_n_listing(spark, sf):
    return objects.first_n_listing(views.files(spark, sf))


# Set operations

def union_splits(spark, sf):
    listing = views.files(spark, sf)
    return objects.union_splits([listing.where(F.col("dataset_split") == split) for split in schemas.SPLITS])


# Scalars

def clean_strings(spark, sf):
    return views.raw_questions(spark, sf).select(
        "task_id", cleaning.clean_string(F.col("`Final answer`")).alias("FinalAnswer"),
        cleaning.clean_string(F.col("`Annotator Metadata`.Steps")).alias("steps"),
    )


def coerce_int(spark, sf):
    negative = F.concat(F.lit("-"), F.col("user_id").cast("string"), F.lit(".9 "))
    return views.table(spark, sf, "events").select(
        "event_id", cleaning.coerce_int(F.col("value")).alias("number"),
        cleaning.coerce_int(F.col("props")).alias("json_number"), cleaning.coerce_int(negative).alias("negative"),
    )


def file_extension(spark, sf):
    return views.files(spark, sf).select(
        "path", names.file_extension(F.col("path")).alias("extension"),
        names.file_extension(F.col("file_name")).alias("name_extension"),
    )


def file_type_bucket(spark, sf):
    return views.questions(spark, sf).select(
        "task_id", names.file_type_bucket(F.col("file_name")).alias("file_type")
    )


def base_name(spark, sf):
    return views.files(spark, sf).select("path", names.base_name(F.col("path")).alias("base_name"))


def silver_key(spark, sf):
    return views.files(spark, sf).select(
        "path", names.silver_key(F.lit(names.TEXTRACT_METHOD), F.col("path")).alias("textract_key"),
        names.silver_key(F.lit("any other"), F.col("path")).alias("other_key"),
    )


def rewrite_path(spark, sf):
    key = names.bronze_key(F.col("dataset_split"), F.col("file_name"))
    url = names.rewrite_path(F.col("found"), "attachments", key, F.col("file_path"))
    return _matched(spark, sf).select("task_id", url.alias("file_path"))


def build_prompt(spark, sf):
    prompt = prompts.build_prompt(F.col("Question"), F.col("Annotator_Metadata_Steps"), F.col("context"))
    return _with_text(spark, sf, names.PYMUPDF_METHOD).select("task_id", prompt.alias("prompt"))


def build_judge_prompt(spark, sf):
    prompt = prompts.build_judge_prompt(F.col("Question"), F.col("file_name"), F.col("Annotator_Metadata_Steps"))
    return views.questions(spark, sf).select("task_id", prompt.alias("prompt"))


def truncate_answer(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", text.truncate_answer(F.col("text")).alias("answer"))


def truncate_pages(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.truncate_answer(F.col("html")).alias("answer"))


def parse_verdict(spark, sf):
    return views.table(spark, sf, "documents").select(
        "doc_id", grading.parse_verdict(F.col("text"), F.col("source")).alias("status"),
        grading.parse_verdict(F.col("lang"), F.lit(None).cast("string")).alias("bare"),
    )


def map_model_error(spark, sf):
    kinds = {"view": "rate_limit", "click": "connection", "purchase": "service", "signup": "unexpected"}
    kind = F.lit(None).cast("string")
    for event, name in kinds.items():
        kind = F.when(F.col("event_type") == event, name).otherwise(kind)
    return views.table(spark, sf, "events").select(
        "event_id", grading.answer_error_text(kind, F.col("props")).alias("answer_text"),
        grading.judge_error_status(kind).alias("judge_status"),
    )


def instruction_policy(spark, sf):
    split, status = F.col("dataset_split"), F.col("user_result_status")
    steps = F.col("Annotator_Metadata_Steps")
    return _joined(spark, sf).select(
        "task_id", grading.instruction_policy(split, status, F.lit(False), steps).alias("first_attempt"),
        grading.instruction_policy(split, status, F.lit(True), steps).alias("retry"),
    )


def retry_candidate(spark, sf):
    return _joined(spark, sf).select("task_id", grading.retry_candidate(F.col("user_result_status")).alias("retry"))


def prefill_instructions(spark, sf):
    steps = grading.prefill_instructions(F.col("Annotator_Metadata_Steps"))
    return views.questions(spark, sf).select("task_id", steps.alias("instructions"))


def route_eligibility(spark, sf):
    route = grading.route_eligibility(F.col("file_name"), F.col("context"))
    return _with_text(spark, sf, names.PYMUPDF_METHOD).select("task_id", route.alias("route"))


def is_correct(spark, sf):
    return _joined(spark, sf).select("task_id", grading.is_correct(F.col("user_result_status")).alias("correct"))


def fill_na(spark, sf):
    return views.questions(spark, sf).select("task_id", grading.fill_na(F.col("file_name")).alias("file_name"))


# Streaming

def _streamed(spark, sf):
    """The log of a feed in which the views name a split that is not accepted."""
    feed, log, checkpoint = (new_path(spark, name) for name in ("feed", "log", "checkpoint"))
    views.feed_with_unknown_split(spark, sf).write.parquet(feed)
    updates = result_stream.read_updates(spark, feed)
    result_stream.stream_results(updates, log, checkpoint).awaitTermination()
    return log


def stream_results(spark, sf):
    log = result_stream.read_log(spark, _streamed(spark, sf))
    return result_stream.current_results(views.stored_results(spark, sf), log, created())


def stream_results_rejected(spark, sf):
    return result_stream.read_rejected(spark, _streamed(spark, sf)).drop("seq")


def _streamed_store(spark, sf):
    root, feed, checkpoint = (new_path(spark, name) for name in ("store", "feed", "checkpoint"))
    result_store.create_results(views.stored_results(spark, sf), root, (8, 2))
    views.feed_with_unknown_split(spark, sf).write.parquet(feed)
    updates = result_stream.read_updates(spark, feed)
    result_stream.stream_store(updates, root, checkpoint, created=created()).awaitTermination()
    return root


def stream_results_store(spark, sf):
    return result_store.read_results(spark, _streamed_store(spark, sf))


def stream_results_counts(spark, sf):
    return result_store.read_counts(spark, _streamed_store(spark, sf))


def stream_documents(spark, sf):
    """Three landings: every file with old contents, then one split after the other."""
    bronze, log, checkpoint = (new_path(spark, name) for name in ("bronze", "log", "checkpoint"))
    files = views.page_files(spark, sf)
    landings = [files.withColumn("content", F.encode("file_name", "UTF-8"))]
    landings += [files.where(F.col("dataset_split") == split) for split in schemas.SPLITS]
    for written, landing in enumerate(landings):
        objects.bronze_ingest(landing, files, bronze, written)
        arriving = document_stream.read_landed(spark, bronze)
        document_stream.stream_documents(
            arriving, models.html_pages, log, checkpoint, pdf_only=False
        ).awaitTermination()
    return objects.read_silver(spark, log)


def stream_documents_once(spark, sf):
    """Three landings, the second with the contents of the first under other names, all read again by a new checkpoint."""
    bronze, log = new_path(spark, "bronze"), new_path(spark, "log")
    files = views.page_files(spark, sf)
    landings = [files, files.withColumn("file_name", F.concat(F.lit("copy-"), "file_name")), files.where(F.col("dataset_split") == "test")]
    for run in range(2):
        for written, landing in enumerate(landings if run == 0 else []):
            objects.bronze_ingest(landing, landing, bronze, written)
        document_stream.stream_documents(
            document_stream.read_landed(spark, bronze), models.html_pages, log, new_path(spark, "checkpoint"), pdf_only=False,
            run=run, once_per_content=True,
        ).awaitTermination()
    return objects.read_silver(spark, log)


# Mutations

def upsert_results(spark, sf):
    return mutations.upsert_results(views.stored_results(spark, sf), views.updates(spark, sf), created())


def upsert_results_null_keys(spark, sf):
    """Updates of which a third names no task, applied twice."""
    nameless = F.when(F.col("seq") % 3 != 0, F.col("task_id"))
    given = views.updates(spark, sf).withColumn("task_id", nameless)
    once = mutations.upsert_results(views.stored_results(spark, sf), given, created())
    return mutations.upsert_results(stage(once, name="once"), given, created())


def merge_match_null_keys(spark, sf):
    nameless = F.when(F.col("seq") % 3 != 0, F.col("task_id"))
    given = views.updates(spark, sf).withColumn("task_id", nameless)
    once = stage(mutations.upsert_results(views.stored_results(spark, sf), given, created()), name="once")
    return mutations.merge_match(once, given)


def _store_after_feed(spark, sf):
    """A store of the results after three batches of updates, the last of which is older and the second comes twice."""
    root = new_path(spark, "store")
    result_store.create_results(views.stored_results(spark, sf), root, (8, 2))
    feed = views.updates(spark, sf)
    # The median of the order numbers parts the feed; rows below it come last.
    middle = feed.agg(F.percentile_approx("seq", 0.5)).first()[0]
    batches = [feed.where((F.col("seq") >= middle) & (F.col("seq") % 2 == i)) for i in range(2)]
    for number, batch in ((0, batches[0]), (1, batches[1]), (1, batches[1]), (2, feed.where(F.col("seq") < middle))):
        result_store.apply_updates(spark, root, batch, created(), "feed", number)
    return root


def upsert_results_store(spark, sf):
    return result_store.read_results(spark, _store_after_feed(spark, sf))


def status_counts_kept(spark, sf):
    return result_store.read_counts(spark, _store_after_feed(spark, sf))


def status_counts_kept_user(spark, sf):
    """Counts per status of one user, from the parts of one bucket."""
    found = result_store.read_user(spark, _store_after_feed(spark, sf), "7")[1]
    return aggregates.status_counts(found, ["dataset_split"], "n")


def erase_users_store(spark, sf):
    """Results after every second user of the feed has been erased, and the files of older versions with them."""
    root = _store_after_feed(spark, sf)
    ids = views.table(spark, sf, "events").where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("user_id"))
    result_store.erase_users(spark, root, ids)
    versions.remove_unused(spark, root, 1)
    return result_store.read_results(spark, root)


def erase_users_store_proof(spark, sf):
    """How many results each erased user had."""
    root = _store_after_feed(spark, sf)
    ids = views.table(spark, sf, "events").where("user_id % 2 = 0").select(F.col("user_id").cast("string").alias("user_id"))
    return result_store.erase_users(spark, root, ids).removed


def _registered(spark, sf):
    return mutations.insert_if_absent(views.users(spark, sf), views.wanted_names(spark, sf))


def insert_if_absent(spark, sf):
    return _registered(spark, sf).users.select("username", "role")


def insert_if_absent_rejected(spark, sf):
    return _registered(spark, sf).rejected


def _erased(spark, sf):
    return mutations.delete_cascade(
        views.users(spark, sf), views.user_orders(spark, sf), views.wanted_ids(spark, sf)
    )


def delete_cascade(spark, sf):
    return _erased(spark, sf).results


def delete_cascade_users(spark, sf):
    return _erased(spark, sf).users


def delete_cascade_unknown(spark, sf):
    return _erased(spark, sf).unknown


def update_role(spark, sf):
    return mutations.update_role(views.users(spark, sf), views.wanted_ids(spark, sf)).users


def update_role_unknown(spark, sf):
    return mutations.update_role(views.users(spark, sf), views.wanted_ids(spark, sf)).unknown


# Jobs

def _answers(spark, sf, settings, ask):
    questions = views.questions(spark, sf).select("task_id", "Question")
    answers = stage(ask(questions, "Question"), name="answers")
    return inference.attach_answers(questions, "Question", answers, settings)


def batch_infer(spark, sf):
    def ask(df, prompt):
        return inference.batch_infer(df, prompt, models.echo_model)
    return _answers(spark, sf, inference.ANSWER_SETTINGS, ask)


def batch_infer_budget(spark, sf):
    """A model that refuses every third call answers all within one run."""
    budget = inference.Budget(prompts_per_second=50_000, retries=8, first_wait=0.001)

    def ask(df, prompt):
        return inference.batch_infer(df, prompt, models.refusing_model, requests=4, budget=budget)
    return _answers(spark, sf, inference.ANSWER_SETTINGS, ask)


def batch_judge(spark, sf):
    def ask(df, prompt):
        return inference.batch_judge(df, prompt, models.digest_judge)
    return _answers(spark, sf, inference.JUDGE_SETTINGS, ask)


def extract_documents(spark, sf):
    return documents.extract_documents(views.page_files(spark, sf), models.html_pages)


def run_evaluation(spark, sf):
    done = evaluate.run_evaluation(
        views.questions(spark, sf), views.user_results(spark, sf), views.silver(spark, sf), USER,
        models.echo_model, models.digest_judge, seq=1, created=created(),
    )
    return done.results


def run_evaluation_keep_errors(spark, sf):
    """Every question sent, those with a failed call by their error text."""
    done = evaluate.run_evaluation(
        views.questions(spark, sf), views.user_results(spark, sf), views.silver(spark, sf), USER,
        models.echo_model, models.digest_judge, seq=1, keep_errors=True, created=created(),
    )
    return done.updates.select("task_id", "status", "chatgpt_response")


def run_evaluation_attempts(spark, sf):
    """The route of every question, with attachments of more than 3,000 bytes held back."""
    done = evaluate.run_evaluation(
        views.questions(spark, sf), views.user_results(spark, sf), views.silver(spark, sf), USER,
        models.echo_model, models.digest_judge, seq=1, largest_context=3000, created=created(),
    )
    return done.attempts.select("task_id", "route", "sent", "chatgpt_response", "error_text")


def _reviewed(spark, sf):
    """Reviews of all labelled documents; those of toxic ones have a status that is not accepted."""
    status = (
        F.when(F.col("toxic") == 1, "Undecided").when(F.col("quality") == 1, "Correct with Instruction")
        .otherwise("Incorrect with Instruction")
    )
    reviews = views.table(spark, sf, "labels").select(
        F.col("doc_id").cast("string").alias("task_id"), status.alias("status")
    )
    return evaluate.run_manual_review(
        views.questions(spark, sf), views.user_results(spark, sf), views.silver(spark, sf), USER,
        models.echo_model, reviews, seq=1, created=created(),
    )


def run_manual_review(spark, sf):
    return _reviewed(spark, sf).results


def run_manual_review_rejects(spark, sf):
    return _reviewed(spark, sf).rejects


def _ingested(spark, sf):
    files = views.page_files(spark, sf, ".pdf")
    path = F.concat(F.lit("repo/"), "dataset_split", F.lit("/"), "file_name")
    return ingest.run_ingest(
        spark, views.raw_questions(spark, sf), files.withColumn("path", path), "attachments",
        new_path(spark, "questions"), new_path(spark, "bronze"), 0, created(),
    )


def run_ingest(spark, sf):
    return _ingested(spark, sf).questions


def run_ingest_rejects(spark, sf):
    return _ingested(spark, sf).rejects.select("task_id", "dataset_split", "reject_reason")


def run_ingest_attachments(spark, sf):
    return _ingested(spark, sf).attachments


def run_ingest_summary(spark, sf):
    return _ingested(spark, sf).summary


def _extracted(spark, sf):
    """Pages without an end are broken: their bytes are no UTF-8."""
    path = new_path(spark, "silver")
    blocks = views.blocks(spark, sf).select(
        F.lit("test").alias("dataset_split"), F.concat("doc", F.lit(".pdf")).alias("file_name"),
        "pos", "block_type", "text", "job_status",
    )
    whole = F.decode("content", "UTF-8").endswith("</html>")
    files = views.page_files(spark, sf, ".pdf").withColumn(
        "content", F.when(whole, F.col("content")).otherwise(F.unhex(F.lit("ff")))
    )
    return path, extract.run_extract(files, blocks, models.html_pages, path, 0)


def run_extract(spark, sf):
    return objects.read_silver(spark, _extracted(spark, sf)[0])


def run_extract_failed(spark, sf):
    return _extracted(spark, sf)[1].failed.select("dataset_split", "file_name")


def run_extract_counts(spark, sf):
    return _extracted(spark, sf)[1].counts


def run_evaluation_retry(spark, sf):
    questions, silver = views.questions(spark, sf), views.silver(spark, sf)
    done = evaluate.run_evaluation(
        questions, views.user_results(spark, sf), silver, USER, models.echo_model, models.digest_judge, seq=1,
        retries_only=True, created=created(),
    )
    return done.updates.select("task_id", "status", "chatgpt_response")


def run_summary(spark, sf):
    return report.run_summary(views.questions(spark, sf), views.user_results(spark, sf), USER, "validation").counts


def run_summary_totals(spark, sf):
    return report.run_summary(views.questions(spark, sf), views.user_results(spark, sf), USER, "validation").totals


def run_summary_all(spark, sf):
    return report.run_summary_all(views.questions(spark, sf), views.user_results(spark, sf)).totals


def run_summary_all_counts(spark, sf):
    return report.run_summary_all(views.questions(spark, sf), views.user_results(spark, sf)).counts


def _browsed(spark, sf):
    return report.run_browse(
        views.questions(spark, sf), views.user_results(spark, sf), USER, "validation",
        [2, 3], ["No File", ".pdf"], page=1,
    )


def run_browse(spark, sf):
    return _browsed(spark, sf).rows.select("task_id", "Level", "file_name", "user_result_status", "Question")


def run_browse_facets(spark, sf):
    return _browsed(spark, sf).facets


def run_browse_total(spark, sf):
    """The row count and the page shown, beside the rows of the table the view was taken from."""
    view = _browsed(spark, sf)
    rows = views.questions(spark, sf).agg(F.count("*").alias("questions"))
    return rows.withColumns({"total": F.lit(view.total).cast("long"), "page": F.lit(view.page).cast("long")})


QUERIES = {
    query.__name__: query for query in (
        load_split, scan_questions, scan_user_results, overwrite_table, overwrite_table_earlier, overwrite_table_emptied,
        bronze_ingest,
        silver_write, silver_lookup, json_records,
        flatten_struct, rename_columns, default_column, stamp_created, conform_schema, project_response,
        project_result, project_users, drop_conflicting, question_preview,
        filter_facets, filter_answered, lookup_key, lookup_keys, filter_has_file, filter_pdf, filter_line_blocks,
        validate_domain,
        join_results, join_results_text_key, join_empty_default, join_attachments, join_silver_text,
        join_silver_text_bounded, merge_match, cascade_anti,
        status_counts, status_totals, facet_values, ingest_summary, attachment_summary, concat_pages,
        concat_pages_parts, concat_pages_bytes, concat_lines_bytes, concat_pages_unnumbered, join_parts, join_parts_bounded, concat_lines, concat_lines_parts, extract_counts,
        prefix_counts,
        page_slice, page_slice_deep, page_slice_stored, page_slice_clashing, page_clamp, page_assign, page_assign_copies, sort_facets,
        sort_facets_paged, sort_counts,
        first_n_listing, union_splits,
        clean_strings, coerce_int, file_extension, file_type_bucket, base_name, silver_key, rewrite_path,
        build_prompt, build_judge_prompt, truncate_answer, truncate_pages, parse_verdict, map_model_error,
        instruction_policy, retry_candidate, prefill_instructions, route_eligibility, is_correct, fill_na,
        stream_results, stream_results_rejected, stream_results_store, stream_results_counts, stream_documents,
        stream_documents_once,
        upsert_results, upsert_results_null_keys, merge_match_null_keys, upsert_results_store, status_counts_kept,
        status_counts_kept_user, erase_users_store, erase_users_store_proof, insert_if_absent, insert_if_absent_rejected, delete_cascade, delete_cascade_users,
        delete_cascade_unknown, update_role, update_role_unknown,
        batch_infer, batch_infer_budget, batch_judge, extract_documents, run_evaluation, run_evaluation_retry,
        run_evaluation_keep_errors, run_evaluation_attempts, run_manual_review, run_manual_review_rejects,
        run_ingest, run_ingest_rejects, run_ingest_attachments, run_ingest_summary,
        run_extract, run_extract_failed, run_extract_counts, run_summary, run_summary_totals,
        run_summary_all, run_summary_all_counts, run_browse, run_browse_facets, run_browse_total,
    )
}
