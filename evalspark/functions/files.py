"""File names, object keys and paths."""

from pyspark.sql import Column, functions as F

from evalspark.functions.text import is_blank

# The extraction methods and their folder names.
TEXTRACT_METHOD = "Amazon Textract"
PYMUPDF_METHOD = "PyMuPDF"
TEXTRACT = "textract"
PYMUPDF = "pymupdf"
NO_FILE = "No File"

_EXTENSION = r"[^/.][^/]*(\.[^/.]*)\z"


def file_extension(name: Column) -> Column:
    """Last extension with its dot, as written; empty when there is none."""
    return F.regexp_extract(name, _EXTENSION, 1)


def file_type_bucket(name: Column) -> Column:
    return F.when(is_blank(name), F.lit(NO_FILE)).otherwise(file_extension(name))


def file_name(path: Column) -> Column:
    return F.element_at(F.split(path, "/"), -1)


def base_name(path: Column) -> Column:
    """File name without its directory and without a final '.pdf'; writer and reader share it."""
    return F.regexp_replace(file_name(path), r"\.pdf\z", "")


def is_pdf(path: Column, case_sensitive: bool = True) -> Column:
    return (path if case_sensitive else F.lower(path)).endswith(".pdf")


def method_folder(method: Column) -> Column:
    return F.when(method == TEXTRACT_METHOD, F.lit(TEXTRACT)).otherwise(F.lit(PYMUPDF))


def silver_key(method: Column, path: Column) -> Column:
    return F.concat(F.lit("silver/pdf/"), method_folder(method), F.lit("/"), base_name(path), F.lit(".txt"))


def bronze_key(split: Column, name: Column) -> Column:
    return F.concat(F.lit("bronze/"), split, F.lit("/"), name)


def rewrite_path(found: Column, bucket: str, key: Column, old_path: Column) -> Column:
    """URL of a landed object; rows whose file was not found keep their path."""
    url = F.concat(F.lit(f"https://{bucket}.s3.amazonaws.com/"), key)
    return F.when(found, url).otherwise(old_path)
