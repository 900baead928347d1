"""Stand-ins for the model and the document parser, simple enough to say in SQL."""

import hashlib
import re

from evalspark.operators.inference import ModelError

_TAG = re.compile(r"<[^>]*>")


def _digit(prompt: str) -> str:
    return hashlib.md5(prompt.encode()).hexdigest()[0]


def echo_model(prompts: list[str], settings: dict) -> list:
    """Answers with the prompt; fails for one in sixteen, by the first digit of its hash."""
    return [ModelError("rate_limit", "too many") if _digit(prompt) == "f" else prompt for prompt in prompts]


def refusing_model(prompts: list[str], settings: dict, calls: list = []) -> list:
    """Answers with the prompt, but refuses every third call of a worker."""
    calls.append(1)
    if len(calls) % 3 == 0:
        raise ModelError("rate_limit", "too many")
    return prompts


def digest_judge(prompts: list[str], settings: dict) -> list:
    """Verdict by the first digit of the prompt's hash."""
    def verdict(prompt: str):
        digit = _digit(prompt)
        if digit in "0123456":
            return " Yes. "
        if digit in "789a":
            return "No"
        if digit == "b":
            return "unclear"
        return "it does NOT" if digit in "cde" else ModelError("connection", "")
    return [verdict(prompt) for prompt in prompts]


def html_pages(content: bytes) -> list[str]:
    """The paragraphs of a page stand for the pages of a document."""
    return [_TAG.sub("", part) for part in content.decode("utf-8").split("</p>")]
