"""Column expressions against hand-written edge rows."""

import pytest
from pyspark.sql import functions as F

from evalspark.functions import cleaning, files, grading, prompts, text

A = F.col


def test_whitespace_is_that_of_python():
    assert set(text.WHITESPACE) == {chr(i) for i in range(0x110000) if chr(i).isspace()}


def test_whitespace_pattern_is_the_same_set(column):
    chars = [chr(i) for i in range(0x3100) if i] + ["\ufeff", "\U0001F600"]
    found = column(chars, A("a").rlike(text.WHITESPACE_RUN))
    assert [char for char, hit in zip(chars, found) if hit] == sorted(text.WHITESPACE)
    assert column(["a" + char + "b" for char in text.WHITESPACE], F.size(F.split("a", text.WHITESPACE_RUN))) == \
        [2] * len(text.WHITESPACE)


def test_file_extension(column):
    cases = {
        "a.pdf": ".pdf", "a.PDF": ".PDF", "a.tar.gz": ".gz", "a.": ".", "..a.b": ".b",
        "a": "", "": "", ".x": "", "...b": "", "d.e/f": "", "d/.x": "", "d/e.f": ".f",
    }
    assert column(list(cases), files.file_extension(A("a"))) == list(cases.values())


def test_file_type_bucket(column):
    assert column([None, "", "a.pdf", "a"], files.file_type_bucket(A("a"))) == ["No File", "No File", ".pdf", ""]


def test_base_name(column):
    cases = {"a.pdf": "a", "a.PDF": "a.PDF", "a.pdf.pdf": "a.pdf", "a": "a", "x/y/a.pdf": "a", "a.pdf.b": "a.pdf.b"}
    assert column(list(cases), files.base_name(A("a"))) == list(cases.values())


def test_silver_key(column):
    methods = ["Amazon Textract", "PyMuPDF", "amazon textract"]
    assert column(methods, files.silver_key(A("a"), F.lit("d/x.pdf"))) == [
        "silver/pdf/textract/x.txt", "silver/pdf/pymupdf/x.txt", "silver/pdf/pymupdf/x.txt"
    ]


def test_rewrite_path(column):
    key = files.bronze_key(F.lit("test"), F.lit("x.pdf"))
    url = files.rewrite_path(A("a") == "yes", "bucket", key, F.lit("old"))
    assert column(["yes", "no"], url) == ["https://bucket.s3.amazonaws.com/bronze/test/x.pdf", "old"]


def test_clean_string(column):
    assert column([None, "?", "a?b", "x", "??"], cleaning.clean_string(A("a"))) == ["None", "", "a?b", "x", "??"]
    assert column([None, "?"], cleaning.clean_string(A("a"), "")) == ["", ""]


def test_coerce_int(column):
    cases = {
        "1": 1, "2.9": 2, "-2.9": -2, " 5 ": 5, "1e3": 1000, "+7": 7, ".5": 0, "5.": 5, " 8\t": 8, "\xa08": 0, "8\u2028": 0,
        "?": 0, "": 0, "abc": 0, "nan": 0, "1d": 0, "1f": 0, "0x10": 0, "1,000": 0, "True": 0, "inf": 0,
        "-Infinity": 0, "3000000000": 0, "1e999": 0,
    }
    assert column(list(cases), cleaning.coerce_int(A("a"))) == list(cases.values())
    assert column([None], cleaning.coerce_int(A("a"))) == [0]


def test_coerce_int_reject(column):
    bad = ["inf", "-inf", " Infinity ", "1e999", "3000000000"]
    good = ["1", "abc", "", None, "nan", "2147483647", "information"]
    assert all(column(bad, cleaning.coerce_int_reject(A("a"))))
    assert column(good, cleaning.coerce_int_reject(A("a"))) == [None] * len(good)


@pytest.mark.parametrize("verdict, status", [
    ("YES", "Correct"), (" yes. ", "Correct"), ("yes, not no", "Correct"), ("\xa0Yes", "Correct"),
    ("NO", "Incorrect"), ("cannot tell", "Incorrect"), ("unknown", "Incorrect"),
])
def test_parse_verdict(column, verdict, status):
    rows = [(verdict, None), (verdict, ""), (verdict, "do this")]
    assert column(rows, grading.parse_verdict(A("a"), A("b"))) == [
        f"{status} without Instruction", f"{status} without Instruction", f"{status} with Instruction"
    ]


def test_parse_verdict_without_answer(column):
    assert column(["", "maybe", None], grading.parse_verdict(A("a"), F.lit("x"))) == ["Error"] * 3


def test_parse_verdict_strict(column):
    strict = grading.parse_verdict(A("a"), F.lit(None).cast("string"), strict=True)
    assert column(["Yes.", "not known", "No!", "eyes"], strict) == [
        "Correct without Instruction", "Error", "Incorrect without Instruction", "Error"
    ]


def test_truncate_answer_by_sentence(column):
    ten = " ".join(f"S{i}." for i in range(10))
    twelve = " ".join(f"S{i}." for i in range(12))
    rebuilt = "S0.  S1.  S2.  S3.  S4.  S5.  S6.  S7.  S8.  S9."
    nine = " ".join(f"S{i}." for i in range(9))
    assert column([ten, twelve, nine], text.truncate_answer(A("a"))) == [rebuilt, rebuilt, nine]


def test_truncate_answer_by_word(column):
    many = ". ".join(" ".join(f"w{i}x{j}" for j in range(20)) for i in range(12))
    kept = many.split()[:200]
    exact = " ".join(["w"] * 200)
    assert column([many, exact, exact + "\xa0x"], text.truncate_answer(A("a"))) == [
        " ".join(kept) + "...", exact, exact + "..."
    ]


def test_truncate_answer_edges(column):
    assert column(["", "   ", None, "\xa0a\u2003", "1.2.3"], text.truncate_answer(A("a"))) == [
        "", "", None, "a", "1.2.3"
    ]


def test_preview_always_has_dots(column):
    assert column(["short", "x" * 60], text.preview(A("a"))) == ["short...", "x" * 50 + "..."]


def test_utf16_length(column):
    assert column(["abc", "", "é", "\U0001F600", None], text.utf16_length(A("a"))) == [3, 0, 1, 2, None]


def test_build_prompt_skips_empty_lines(column):
    rows = [("Q", None, None), ("Q", "", ""), ("Q", "step", None), ("Q", None, "doc"), ("Q", "step", "doc")]
    heads = ["", "", "Instructions: step\n", "Reference Data: doc\n", "Instructions: step\nReference Data: doc\n"]
    built = column(rows, prompts.build_prompt(A("a"), A("b"), F.col("c")))
    assert built == [f"Question: Q\n{head}{prompts.ANSWER_RULES}" for head in heads]
    assert "10 sentences or 200 words" in prompts.ANSWER_RULES and prompts.ANSWER_RULES.endswith("source.\n")


def test_build_judge_prompt(column):
    built = column([(" Q ", None, "\xa0r\n")], prompts.build_judge_prompt(A("a"), A("b"), F.col("c")))[0]
    assert built.startswith("\nQuestion: Q\n\nOriginal Answer: None\n\nAI Response: r\n\nInstructions:\n1. ")
    assert built.endswith("Respond with only 'YES' or 'NO'.\n")


def test_instruction_policy(column):
    rows = [
        ("validation", "Incorrect with Instruction"), ("validation", "Incorrect without Instruction"),
        ("validation", "N/A"), ("validation", "Correct with Instruction"), ("validation", None), ("test", "N/A"),
    ]
    first = grading.instruction_policy(A("a"), A("b"), F.lit(False), F.lit("steps"))
    assert column(rows, first) == ["steps", "steps", None, None, None, "steps"]
    retry = grading.instruction_policy(A("a"), A("b"), F.lit(True), F.lit("steps"))
    assert column(rows, retry) == ["steps"] * 6


def test_retry_candidate(column):
    statuses = [
        "Correct with Instruction", "Incorrect with Instruction", "Incorrect without Instruction",
        "Correct without Instruction", "N/A", "Error", None,
    ]
    assert column(statuses, grading.retry_candidate(A("a"))) == [True] * 3 + [False] * 4


def test_route_eligibility(column):
    rows = [
        (None, None), ("", "x"), ("noext", None), ("a.PDF", "text"), ("a.pdf", None), ("a.pdf", ""),
        ("a.xlsx", None), ("a.xlsx", "text"),
    ]
    assert column(rows, grading.route_eligibility(A("a"), A("b"))) == [
        "send", "send", "send", "send", "missing_text", "missing_text", "unsupported", "unsupported"
    ]


def test_is_correct_and_fills(column):
    assert column([" correct x", "CORRECT", "Incorrect", "N/A"], grading.is_correct(A("a"))) == [
        True, True, False, False
    ]
    assert column([None, "x"], grading.fill_na(A("a"))) == ["N/A", "x"]
    assert column([None, "x"], grading.prefill_instructions(A("a"))) == ["", "x"]


def test_model_errors(column):
    rows = [("authentication", "key"), ("rate_limit", "slow"), ("connection", None), ("service", "x"),
            ("other", "x"), (None, None)]
    assert column(rows, grading.answer_error_text(A("a"), A("b"))) == [
        "Error: key", "Error: slow", "Error: None", grading.SERVICE_ERROR_TEXT, grading.UNEXPECTED_ERROR_TEXT, None
    ]
    unavailable = grading.JUDGE_UNAVAILABLE_TEXT
    assert column(rows, grading.judge_error_status(A("a"))) == [unavailable] * 3 + ["Error", "Error", None]
