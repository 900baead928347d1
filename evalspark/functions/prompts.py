"""Prompts as column expressions."""

from pyspark.sql import Column, functions as F

from evalspark.functions.text import MAX_SENTENCES, MAX_WORDS, is_blank, strip

# Prompt texts sent to the model.
SYSTEM_PROMPT = (
    "You are an AI assistant specialized in providing concise, accurate answers. "
    "Focus on the key information requested without adding unnecessary context. "
    "Use any provided instructions or reference data to inform your answer."
)
ANSWER_RULES = (
    "Please provide a concise answer that directly addresses the question. Your response should:\n"
    f"1. Be no longer than {MAX_SENTENCES} sentences or {MAX_WORDS} words, whichever is shorter.\n"
    "2. Include only essential information relevant to the question.\n"
    "3. Use precise language and avoid unnecessary elaboration.\n"
    "4. If using reference data, integrate it seamlessly without mentioning the source.\n"
)
JUDGE_RULES = (
    "Instructions:\n"
    "1. Analyze if the AI's response contains the key information present in the original answer.\n"
    "2. Focus on factual accuracy and relevance to the question.\n"
    "3. Ignore minor differences in phrasing or additional context.\n"
    "4. Respond with 'YES' if the core information matches, 'NO' if it doesn't.\n"
    "\n"
    "Does the AI's response match the key information in the original answer? "
    "Respond with only 'YES' or 'NO'.\n"
)


def _text(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit("None"))


def _optional_line(label: str, value: Column) -> Column:
    return F.when(is_blank(value), F.lit("")).otherwise(F.concat(F.lit(label), value, F.lit("\n")))


def build_prompt(question: Column, instructions: Column, context: Column) -> Column:
    """Question, then instructions and reference data where there are any, then the answer rules."""
    return F.concat(
        F.lit("Question: "), _text(question), F.lit("\n"),
        _optional_line("Instructions: ", instructions),
        _optional_line("Reference Data: ", context),
        F.lit(ANSWER_RULES),
    )


def build_judge_prompt(question: Column, final_answer: Column, response: Column) -> Column:
    """Prompt that asks whether a response carries the expected answer; a null answer reads 'None'."""
    return F.concat(
        F.lit("\nQuestion: "), strip(_text(question)),
        F.lit("\n\nOriginal Answer: "), strip(_text(final_answer)),
        F.lit("\n\nAI Response: "), strip(_text(response)),
        F.lit("\n\n" + JUDGE_RULES),
    )
