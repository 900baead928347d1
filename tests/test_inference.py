"""Batched model calls and document extraction."""

import time
from collections import Counter

import pyarrow as pa
import pytest
from helpers import rows
from pyspark import TaskContext
from pyspark.sql import functions as F

from evalspark.operators import documents, inference
from evalspark.staging import new_path, stage


def _asked(spark, prompts):
    return spark.createDataFrame([(i, prompt) for i, prompt in enumerate(prompts)], "i int, prompt string")


def shout(prompts, settings):
    return [prompt.upper() for prompt in prompts]


def recording(path):
    """A model that writes down what it was asked."""
    def model(prompts, settings):
        with open(path, "a") as log:
            log.writelines(prompt + "\n" for prompt in prompts)
        return shout(prompts, settings)
    return model


def test_equal_prompts_are_asked_once(spark, tmp_path):
    log = tmp_path / "log"
    asked = _asked(spark, ["a", "b", "a", None, "a", "b"])
    answers = inference.ask_once(asked, "prompt", recording(str(log)))
    joined = inference.attach_answers(asked, "prompt", answers)
    assert rows(joined.select("i", "answer")) == [(0, "A"), (1, "B"), (2, "A"), (3, None), (4, "A"), (5, "B")]
    joined.count()
    assert sorted(log.read_text().split()) == ["a", "b"]


def test_settings_reach_the_model(spark):
    def model(prompts, settings):
        return [f"{settings['temperature']} {settings.get('max_tokens')}" for _ in prompts]
    asked = _asked(spark, ["a"])
    assert inference.batch_infer(asked, "prompt", model).first().answer == "0.2 300"
    assert inference.batch_judge(asked, "prompt", model).first().answer == "0 None"


def test_same_prompt_under_other_settings_is_another_request(spark):
    df = _asked(spark, ["a"])
    keys = [inference.prompt_key(F.col("prompt"), s) for s in (inference.ANSWER_SETTINGS, inference.JUDGE_SETTINGS)]
    first, second = df.select(*[key.alias(str(i)) for i, key in enumerate(keys)]).first()
    assert first != second


def test_a_rerun_asks_only_what_failed_or_is_new(spark, tmp_path):
    log, path = tmp_path / "log", new_path(spark, "answers")

    def flaky(prompts, settings):
        return [inference.ModelError("connection", "down") if p == "b" else p.upper() for p in prompts]

    inference.ask_once(_asked(spark, ["a", "b"]), "prompt", flaky, path=path)
    answers = inference.ask_once(_asked(spark, ["a", "b", "c"]), "prompt", recording(str(log)), path=path)
    assert sorted(log.read_text().split()) == ["b", "c"]
    assert rows(answers.select("answer", "error_kind")) == [("A", None), ("B", None), ("C", None)]


def test_one_bad_prompt_does_not_fail_its_batch(spark):
    def strict(prompts, settings):
        if "bad" in prompts:
            raise ValueError("no")
        if "limit" in prompts:
            raise inference.ModelError("service", "slow")
        return shout(prompts, settings)

    asked = _asked(spark, ["a", "bad", "c", "limit"])
    answers = inference.batch_infer(asked, "prompt", strict, requests=1)
    joined = inference.attach_answers(asked, "prompt", answers).orderBy("i")
    assert [tuple(row)[1:] for row in joined.collect()] == [
        ("A", None, None), (None, "unexpected", "no"), ("C", None, None), (None, "service", "slow")
    ]


def test_a_reply_is_expected_for_every_prompt(spark):
    def forgetful(prompts, settings):
        return shout(prompts, settings)[:1] if len(prompts) > 1 else shout(prompts, settings)
    answers = inference.batch_infer(_asked(spark, ["a", "b", "c"]), "prompt", forgetful, requests=1)
    assert rows(answers.select("answer")) == [("A",), ("B",), ("C",)]


def test_batches_are_bounded(spark):
    def model(prompts, settings):
        return [str(len(prompts))] * len(prompts)
    asked = _asked(spark, [str(i) for i in range(10)])
    sizes = inference.batch_infer(asked, "prompt", model, requests=1, batch_size=4).select("answer")
    assert sorted(row.answer for row in sizes.collect()) == ["2"] * 2 + ["4"] * 8


def test_an_outage_is_not_asked_again_prompt_by_prompt(spark, tmp_path):
    log = tmp_path / "log"

    def down(prompts, settings):
        with open(log, "a") as file:
            file.write("call\n")
        raise inference.ModelError("connection", "down")

    asked = _asked(spark, [str(i) for i in range(100)])
    answers = stage(inference.batch_infer(asked, "prompt", down, requests=1, batch_size=50))
    assert {row.error_kind for row in answers.collect()} == {"connection"} and answers.count() == 100
    assert log.read_text().count("call") == 2


def test_a_bad_prompt_is_found_by_halves(spark, tmp_path):
    log = tmp_path / "log"

    def strict(prompts, settings):
        with open(log, "a") as file:
            file.write("call\n")
        if "7" in prompts:
            raise ValueError("no")
        return shout(prompts, settings)

    answers = stage(inference.batch_infer(_asked(spark, [str(i) for i in range(64)]), "prompt", strict, requests=1))
    assert answers.where("error_kind is not null").count() == 1
    assert log.read_text().count("call") == 13


def test_replies_that_are_no_text_are_errors_and_asked_again(spark, tmp_path):
    path = new_path(spark, "answers")

    def odd(prompts, settings):
        return [None if prompt == "a" else 5 if prompt == "b" else prompt for prompt in prompts]

    asked = _asked(spark, ["a", "b", "c"])
    first = inference.ask_once(asked, "prompt", odd, path=path)
    assert rows(first.select("answer", "error_kind")) == [("c", None), (None, "unexpected"), (None, "unexpected")]
    again = inference.ask_once(asked, "prompt", shout, path=path)
    assert rows(again.select("answer", "error_kind")) == [("A", None), ("B", None), ("c", None)]


def _tasks(spark, **options):
    """Partitions in which the model was called for many small prompts."""
    def where(prompts, settings):
        from pyspark import TaskContext
        return [str(TaskContext.get().partitionId())] * len(prompts)

    asked = _asked(spark, [f"prompt {i}" for i in range(400)])
    return len({row.answer for row in inference.batch_infer(asked, "prompt", where, **options).collect()})


def test_the_model_is_called_in_as_many_tasks_as_asked(spark, conf):
    conf({"spark.sql.shuffle.partitions": "8"})
    assert _tasks(spark) == inference.REQUESTS
    assert [_tasks(spark, requests=n) for n in (1, 5, 8, 20)] == [1, 5, 8, 20]


def test_a_run_that_dies_keeps_its_slices(spark, tmp_path):
    path, log = new_path(spark, "answers"), tmp_path / "log"

    def dies(prompts, settings):
        with open(log, "a") as file:
            file.writelines(prompt + "\n" for prompt in prompts)
        if len(log.read_text().split()) > 60:
            import os
            os._exit(1)
        return shout(prompts, settings)

    asked = _asked(spark, [f"p{i}" for i in range(100)])
    with pytest.raises(Exception):
        inference.ask_once(asked, "prompt", dies, path=path, requests=1, slices=10)
    stored = spark.read.schema(inference.ANSWER_SCHEMA).parquet(path).count()
    assert 40 <= stored <= 60
    asked_before = len(log.read_text().split())
    answers = inference.ask_once(asked, "prompt", recording(str(log)), path=path, requests=1, slices=10)
    assert answers.where("answer is not null").count() == 100
    assert len(log.read_text().split()) - asked_before == 100 - stored


def test_many_prompts_are_asked_in_rounds_of_bounded_tasks(spark, tmp_path, monkeypatch):
    """No task is given much more than its bytes, each prompt is asked once, and what an action repeats asks nobody."""
    monkeypatch.setattr(inference, "TASK_BYTES", 4000)
    log = tmp_path / "log"

    def model(prompts, settings):
        context = TaskContext.get()
        with open(log, "a") as file:
            file.writelines(f"{context.stageId()} {context.partitionId()} {prompt}\n" for prompt in prompts)
        return shout(prompts, settings)

    asked = _asked(spark, [f"p{i}" for i in range(600)] * 2 + [None, ""])
    answers = inference.batch_infer(asked, "prompt", model, requests=2, batch_size=7)
    assert sorted(row.answer for row in answers.collect()) == sorted(["", *(f"P{i}" for i in range(600))])
    answers.count()
    calls = [line.split(" ") for line in log.read_text().splitlines()]
    assert len(calls) == 601
    tasks = Counter((stage, part) for stage, part, _ in calls)
    assert {part for _, part in tasks} == {"0", "1"} and max(tasks.values()) <= 60


def _files(spark):
    data = [("test", "a.pdf", bytearray(b"one|two")), ("test", "b.pdf", bytearray(b"!")), ("test", "c.pdf", bytearray())]
    return spark.createDataFrame(data, "dataset_split string, file_name string, content binary")


def pages(content):
    if content == b"!":
        raise ValueError("broken")
    return content.decode().split("|") if content else []


def test_extract_documents(spark):
    out = documents.extract_documents(_files(spark), pages).drop("dataset_split")
    assert rows(out) == [
        ("a.pdf", 0, "one", None), ("a.pdf", 1, "two", None), ("b.pdf", None, None, "ValueError: broken"),
        ("c.pdf", 0, "", None),
    ]


def test_extract_texts(spark, plan):
    out = documents.extract_texts(_files(spark), pages).drop("dataset_split")
    assert rows(out) == [("a.pdf", "onetwo", None), ("b.pdf", None, "ValueError: broken"), ("c.pdf", "", None)]
    assert "Exchange" not in plan(out)


class _Frame:
    """A table that hands over the function that its rows are mapped with."""
    def __init__(self, schema):
        self.schema = schema

    def select(self, *names):
        return self

    def mapInArrow(self, run, schema):
        return run


@pytest.mark.parametrize("operator", [documents.extract_texts, documents.extract_documents])
def test_texts_of_a_batch_are_handed_over_in_bounded_slices(spark, monkeypatch, operator):
    """However many documents Spark sends at once, the texts of few are held; a null, an empty and a large one are all there."""
    monkeypatch.setattr(documents, "SLICE_BYTES", 1000)
    contents = [b"x" * 100] * 95 + [None, b"", b"!"] + [b"y" * 5000] * 2
    batch = pa.RecordBatch.from_arrays([
        pa.array(["test"] * 100), pa.array([f"{i}.pdf" for i in range(100)]), pa.array(contents, pa.binary()),
    ], names=["dataset_split", "file_name", "content"])
    out = list(operator(_Frame(_files(spark).schema), pages)(iter([batch])))
    sizes = [sum(len(text or "") for text in part.column(part.schema.names.index("text")).to_pylist()) for part in out]
    assert len(out) > 10 and max(sizes) == 5000 and sorted(sizes)[-3] <= 1000
    got = {row["file_name"]: (row["text"], row["error"]) for part in out for row in part.to_pylist()}
    assert [got[f"{i}.pdf"][0] for i in range(100)] == ["x" * 100] * 95 + ["", "", None] + ["y" * 5000] * 2
    assert [bool(got[f"{i}.pdf"][1]) for i in range(95, 98)] == [False, False, True]


def refusing(log, every=3):
    """A model that refuses every third call, as a whole or one prompt of it, and writes down when it was called."""
    calls = []

    def model(prompts, settings):
        calls.append(1)
        with open(log, "a") as file:
            file.write(f"{time.monotonic()} {len(prompts)}\n")
        if len(calls) % every == 0:
            raise inference.ModelError("rate_limit", "slow down")
        if len(calls) % every == 1:
            return [inference.ModelError("rate_limit", "slow down"), *shout(prompts[1:], settings)]
        return shout(prompts, settings)

    return model


def _times(log):
    return sorted(tuple(map(float, line.split())) for line in log.read_text().split("\n")[:-1])


def test_a_refused_call_is_answered_within_the_run(spark, tmp_path):
    asked, log = _asked(spark, [f"p{i}" for i in range(60)]), tmp_path / "log"
    budget = inference.Budget(retries=4, first_wait=0.01)
    answers = inference.batch_infer(asked, "prompt", refusing(str(log)), requests=2, batch_size=5, budget=budget)
    assert sorted(row.answer for row in answers.collect()) == sorted(f"P{i}" for i in range(60))


def test_retries_end_and_their_waits_grow(spark, tmp_path):
    log = tmp_path / "log"

    def down(prompts, settings):
        with open(log, "a") as file:
            file.write(f"{time.monotonic()} {len(prompts)}\n")
        raise inference.ModelError("connection", "down")

    budget = inference.Budget(retries=3, first_wait=0.2, longest_wait=0.4)
    answers = inference.batch_infer(_asked(spark, ["a", "b"]), "prompt", down, requests=1, budget=budget)
    assert [row.error_kind for row in answers.collect()] == ["connection"] * 2
    times = [at for at, _ in _times(log)]
    gaps = [b - a for a, b in zip(times, times[1:])]
    assert len(gaps) == 3 and 0.1 <= gaps[0] < 0.35 and 0.2 <= gaps[1] < 0.6 and 0.2 <= gaps[2] < 0.6
    assert budget.wait(0, 0) < budget.wait(0, 1) <= 0.2 and budget.wait(9, 1) == 0.4


def test_errors_that_do_not_pass_are_not_asked_again(spark, tmp_path):
    log = tmp_path / "log"

    def barred(prompts, settings):
        with open(log, "a") as file:
            file.write(f"{time.monotonic()} {len(prompts)}\n")
        raise inference.ModelError("authentication", "no")

    inference.batch_infer(_asked(spark, ["a"]), "prompt", barred, requests=1, budget=inference.Budget(retries=3)).collect()
    assert len(_times(log)) == 1


def test_prompts_per_second_hold_over_all_tasks(spark, tmp_path):
    log = tmp_path / "log"
    budget = inference.Budget(prompts_per_second=40, retries=3, first_wait=0.01)
    asked = _asked(spark, [f"p{i}" for i in range(60)])
    inference.batch_infer(asked, "prompt", refusing(str(log)), requests=2, batch_size=2, budget=budget).collect()
    times = _times(log)
    prompts = sum(n for _, n in times)
    # Each task may make its first call at once.
    assert times[-1][0] - times[0][0] >= (prompts - 2 * 2 - 2) / 40 - 0.1
