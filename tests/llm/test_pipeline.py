"""The pipeline stage by stage against brute force, each on its own input."""

import public_tokenizers
import pytest
from pyspark.sql import functions as F
from test_decontamination import _brute as leaks
from test_repeats import _brute as repeated
from test_simhash import _bits, _classes
from tokenizers import Tokenizer

import corpus_pipeline
from evalspark.llm.decontamination import question_and_answer
from evalspark.staging import stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def written(spark):
    """What each stage gets and returns; extra rows carry nulls and empty texts."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    odd = spark.createDataFrame([(10**6, None, None, None, None), (10**6 + 1, "", "en", "s", 0), (None, "A text without a key.", None, None, 21)], docs.schema)
    docs = stage(docs.unionByName(odd))
    tables = {"documents": docs}
    for name, step in corpus_pipeline.STAGES:
        docs = stage(step(spark, docs, SF))
        tables[name] = docs
    return tables


def _rows(df):
    return [(row.doc_id, row.text) for row in df.select("doc_id", "text").collect()]


def test_stages_keep_the_columns(written):
    wanted = written["documents"].columns
    assert [name for name, _ in corpus_pipeline.STAGES] == list(written)[1:]
    assert all(written[name].columns == wanted for name in list(written)[1:-1])


@pytest.mark.parametrize("name", [name for name, _ in corpus_pipeline.STAGES])
def test_stages_stand_columns_with_names_of_their_own(spark, name):
    """Extra columns with the names that operators use inside, a very long text, and rows that are alike."""
    names = ["mark", "mark_2", "kept_mark", "leaking", "row", "root", "tie", "places", "key", "score", "fingerprint", "found", "of_doc"]
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(40)
    long = spark.createDataFrame([(10**6, "word by word and so on " * 40_000, "en", "s", 0)] * 2, docs.schema)
    wide = docs.unionByName(long).select("*", *[F.lit(i).alias(extra) for i, extra in enumerate(names)])
    result = dict(corpus_pipeline.STAGES)[name](spark, wide, SF)
    if name == corpus_pipeline.STAGES[-1][0]:
        assert result.count() >= 42
        return
    assert result.columns == wide.columns
    rows = result.select(*names).distinct().collect()
    assert [tuple(row) for row in rows] == [tuple(range(len(names)))]


def test_quality_keeps_the_good_ones(spark, written):
    labels = {row.doc_id: row.quality for row in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    kept = {key for key, _ in _rows(written["quality"])}
    good = [key in kept for key, mark in labels.items() if mark == 1]
    junk = [key in kept for key, mark in labels.items() if mark == 0]
    assert sum(good) / len(good) > 0.9 and sum(junk) / len(junk) < 0.3


def test_one_of_each_group_stays(written):
    before = _rows(written["quality"])
    prints = [_bits(text or "") for _, text in before]
    classes = _classes(sorted(set(prints)), 2)
    least = {}
    for (key, _), p in zip(before, prints):
        root = classes[p]
        least[root] = key if root not in least or least[root] is None else least[root] if key is None else min(key, least[root])
    assert sorted((key for key, _ in _rows(written["near_duplicates"])), key=repr) == sorted(least.values(), key=repr)


def test_repeats_are_cut(written):
    before, after = _rows(written["near_duplicates"]), dict(_rows(written["repeats"]))
    marks = repeated(before, 100)
    assert len(after) == len(before)
    for i, (key, text) in enumerate(before):
        kept = None if text is None else bytes(b for b, gone in zip(text.encode(), marks[i]) if not gone).decode(errors="ignore")
        assert after[key] == kept
    assert written["repeats"].filter(F.length("text") != F.col("n_chars")).count() == 0


def test_test_items_are_gone(spark, written):
    q, a = question_and_answer(F.col("text"))
    items = [tuple(row) for row in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", q, a).collect()]
    before = _rows(written["repeats"])
    leaking = {key for key, _ in leaks(before, items)}
    assert leaking
    assert sorted((key for key, _ in _rows(written["decontamination"])), key=repr) == sorted((key for key, _ in before if key not in leaking), key=repr)


def test_all_tokens_are_packed(written):
    model = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    sizes = {}
    for row in written["packing"].collect():
        sizes[row.doc_id] = sizes.get(row.doc_id, 0) + row.length
    expected = {key: len(model.encode(text or "", add_special_tokens=False).ids) + 1 for key, text in _rows(written["decontamination"])}
    assert sizes == expected


def test_run_gives_the_pieces(spark):
    assert corpus_pipeline.run(spark, SF).count() > 100
