"""The engine's tables derived from the given ones. ``VIEW_SQL`` in oracle.py says the same in SQL."""

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from evalspark.operators.joins import key_join


def created() -> Column:
    return F.to_timestamp(F.lit("2024-01-01 00:00:00"))


SCHEMAS = {
    "benchmark": "item_id long, text string",
    "conversations": "conv_id long, turn long, role string, text string",
    "customer": "c_custkey long, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id long, text string, lang string, source string, n_chars long",
    "events": "event_id long, ts timestamp_ntz, user_id long, event_type string, value double, props string",
    "labels": "doc_id long, quality int, toxic int",
    "lineitem": "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, l_linestatus string, "
                "l_shipdate timestamp_ntz",
    "orders": "o_orderkey long, o_custkey long, o_orderstatus string, o_totalprice double, o_orderdate timestamp_ntz, "
              "o_orderpriority string",
    "pages": "page_id long, url string, html string",
}


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    """A given table under its declared schema."""
    return spark.read.schema(SCHEMAS[name]).parquet(f"{sf}/{name}.parquet")


def _split(lang):
    return F.when(lang == "en", "validation").otherwise("test")


def _source_number():
    return F.substring_index("source", "src", -1).cast("int")


def _file_name():
    number, doc = _source_number(), F.col("doc_id").cast("string")
    return (
        F.when(number < 4, "").when(number < 8, F.lit(None))
        .when(number < 13, F.concat(doc, F.lit(".pdf"))).when(number < 17, F.concat(doc, F.lit(".PDF")))
        .otherwise(F.concat(doc, F.lit(".tar.gz")))
    )


def _level():
    return F.when(F.col("n_chars") < 1000, 1).when(F.col("n_chars") < 2000, 2).otherwise(3)


def _steps():
    return F.when(_source_number() < 10, F.concat(F.lit("Read "), "source"))


def questions(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"),
        F.col("text").alias("Question"),
        _level().alias("Level"),
        F.col("lang").alias("FinalAnswer"),
        _file_name().alias("file_name"),
        F.lit("").alias("file_path"),
        _steps().alias("Annotator_Metadata_Steps"),
        F.col("n_chars").cast("string").alias("Annotator_Metadata_Number_of_steps"),
        F.col("lang").alias("Annotator_Metadata_How_long_did_this_take"),
        F.col("source").alias("Annotator_Metadata_Tools"),
        _source_number().alias("Annotator_Metadata_Number_of_tools"),
        F.lit("N/A").alias("result_status"),
        created().alias("created_date"),
        _split(F.col("lang")).alias("dataset_split"),
    )


def raw_questions(spark: SparkSession, sf: str) -> DataFrame:
    """Questions as they arrive: nested metadata, numbers as text of several kinds."""
    level = (
        F.when(F.col("lang") == "en", _level().cast("string")).when(F.col("lang") == "fr", " 2 ")
        .when(F.col("lang") == "es", "2.9").otherwise("?")
    )
    number_of_tools = F.when(F.col("lang") == "de", "inf").otherwise(_source_number().cast("string"))
    return table(spark, sf, "documents").select(
        F.col("doc_id").cast("string").alias("task_id"),
        F.col("text").alias("Question"),
        level.alias("Level"),
        F.when(F.col("lang") == "fr", "?").otherwise(F.col("lang")).alias("Final answer"),
        _file_name().alias("file_name"),
        F.lit("").alias("file_path"),
        F.struct(
            _steps().alias("Steps"),
            F.col("n_chars").cast("string").alias("Number of steps"),
            F.col("lang").alias("How long did this take?"),
            F.col("source").alias("Tools"),
            number_of_tools.alias("Number of tools"),
        ).alias("Annotator Metadata"),
        _split(F.col("lang")).alias("dataset_split"),
    )


def user_results(spark: SparkSession, sf: str) -> DataFrame:
    """One result per label; the source of a document stands for the user."""
    documents = table(spark, sf, "documents").select("doc_id", "lang", "source")
    good, toxic = F.col("quality") == 1, F.col("toxic") == 1
    status = (
        F.when(good & ~toxic, "Correct without Instruction").when(good, "Correct with Instruction")
        .when(~toxic, "Incorrect without Instruction").otherwise("Incorrect with Instruction")
    )
    return table(spark, sf, "labels").join(documents, "doc_id").select(
        F.col("source").alias("user_id"),
        F.col("doc_id").cast("string").alias("task_id"),
        _split(F.col("lang")).alias("dataset_split"),
        status.alias("user_result_status"),
        F.concat(F.lit("Written in "), "lang").alias("chatgpt_response"),
        created().alias("created_date"),
        F.lit(0).cast("long").alias("seq"),
    )


def files(spark: SparkSession, sf: str) -> DataFrame:
    """Listing of attachments: those of all documents, and every page as a file of its own.

    Attachments of French documents lie in the other split, where their questions do not find them.
    """
    listed = F.when(F.col("lang") == "fr", "validation").otherwise(_split(F.col("lang")))
    documents = table(spark, sf, "documents").select(
        listed.alias("dataset_split"), _file_name().alias("file_name"),
        F.col("n_chars").alias("length"),
    ).where(F.coalesce("file_name", F.lit("")) != "")
    pages = page_files(spark, sf).select("dataset_split", "file_name", "length")
    listed = documents.unionByName(pages)
    path = F.concat(F.lit("bronze/"), "dataset_split", F.lit("/"), "file_name")
    return listed.select("dataset_split", "file_name", path.alias("path"), "length")


def page_files(spark: SparkSession, sf: str, suffix: str = ".html") -> DataFrame:
    """Every page as a stored file with its bytes."""
    english = F.col("url").contains("/en/")
    content = F.encode("html", "UTF-8")
    return table(spark, sf, "pages").select(
        F.when(english, "validation").otherwise("test").alias("dataset_split"),
        F.concat(F.col("page_id").cast("string"), F.lit(suffix)).alias("file_name"),
        F.octet_length(content).cast("long").alias("length"),
        content.alias("content"),
    )


def blocks(spark: SparkSession, sf: str) -> DataFrame:
    """Recognised blocks: assistant turns are lines; a conversation with a system turn failed."""
    turns = table(spark, sf, "conversations")
    failed = turns.where(F.col("role") == "system").select("conv_id").distinct().withColumn("failed", F.lit(True))
    return key_join(turns, failed, ["conv_id"], "left").select(
        F.col("conv_id").cast("string").alias("doc"),
        F.col("turn").cast("int").alias("pos"),
        F.when(F.col("role") == "assistant", "LINE").otherwise("WORD").alias("block_type"),
        "text",
        F.when(F.col("failed"), "FAILED").otherwise("SUCCEEDED").alias("job_status"),
    )


def pages_text(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of documents in long form."""
    return table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("doc"), F.col("turn").cast("int").alias("page"), "text"
    )


def silver(spark: SparkSession, sf: str) -> DataFrame:
    """Extracted texts: those of documents, but French ones by one method and English ones by the other.

    A text of more than 1,000 signs has a second part.
    """
    documents = table(spark, sf, "documents")
    methods = F.array_compact(F.array(
        F.when(F.col("lang") != "fr", "pymupdf"), F.when(F.col("lang") != "en", "textract")
    ))
    parts = F.array_compact(F.array(
        F.struct(F.lit(0).cast("long").alias("part"), F.substring("text", 1, 1000).alias("text")),
        F.when(F.length("text") > 1000, F.struct(
            F.lit(1).cast("long").alias("part"), F.expr("substring(text, 1001)").alias("text")
        )),
    ))
    return documents.select(
        F.explode(methods).alias("method"), _split(F.col("lang")).alias("dataset_split"),
        F.col("doc_id").cast("string").alias("base_name"), parts.alias("parts"),
    ).select("method", "dataset_split", "base_name", F.inline("parts"))


def _feed(spark: SparkSession, sf: str) -> DataFrame:
    value = F.col("value")
    status = (
        F.when(value < 5, "Correct without Instruction").when(value < 10, "Correct with Instruction")
        .when(value < 20, "Incorrect without Instruction").otherwise("Incorrect with Instruction")
    )
    return table(spark, sf, "events").select(
        F.col("user_id").cast("string").alias("user_id"),
        F.col("event_type").alias("task_id"),
        status.alias("status"),
        F.col("props").alias("chatgpt_response"),
        F.when(F.col("event_type").isin("view", "click"), "test").otherwise("validation").alias("dataset_split"),
        F.col("event_id").alias("seq"),
    )


def updates(spark: SparkSession, sf: str) -> DataFrame:
    """Feed of updates: every event but views."""
    return _feed(spark, sf).where(F.col("task_id") != "view")


def feed_with_unknown_split(spark: SparkSession, sf: str) -> DataFrame:
    """All events; the views name a split that is not accepted."""
    views_of_train = F.when(F.col("task_id") == "view", "train").otherwise(F.col("dataset_split"))
    return _feed(spark, sf).withColumn("dataset_split", views_of_train)


def stored_results(spark: SparkSession, sf: str) -> DataFrame:
    """Results before the feed: the first view, click and purchase of a user. Clicks are newer than the feed."""
    stored = _feed(spark, sf).where(F.col("task_id").isin("view", "click", "purchase"))
    first = F.min_by(F.struct("status", "chatgpt_response"), "seq")
    seq = F.when(F.col("task_id") == "click", F.lit(10**12)).otherwise(F.min("seq"))
    return stored.groupBy("user_id", "task_id", "dataset_split").agg(first.alias("f"), seq.alias("seq")).select(
        "user_id", "task_id", "dataset_split", F.col("f.status").alias("user_result_status"),
        "f.chatgpt_response", created().alias("created_date"), F.col("seq").cast("long").alias("seq"),
    )


def users(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "customer").select(
        F.col("c_custkey").cast("string").alias("user_id"), F.col("c_name").alias("username"),
        F.when(F.col("c_mktsegment") == "MACHINERY", "admin").otherwise("user").alias("role"),
    )


def user_orders(spark: SparkSession, sf: str) -> DataFrame:
    """Child rows of the users."""
    return table(spark, sf, "orders").select(
        F.col("o_custkey").cast("string").alias("user_id"), F.col("o_orderkey").cast("string").alias("task_id")
    )


def wanted_ids(spark: SparkSession, sf: str) -> DataFrame:
    """Ids to change, many of them repeated and some of no user."""
    return table(spark, sf, "lineitem").select((F.col("l_partkey") * 2).cast("string").alias("user_id"))


def wanted_names(spark: SparkSession, sf: str) -> DataFrame:
    """Usernames to register, many of them repeated or taken."""
    number = F.lpad(F.col("l_partkey").cast("string"), 9, "0")
    return table(spark, sf, "lineitem").select(F.concat(F.lit("Customer#"), number).alias("username"))
