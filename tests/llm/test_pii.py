"""Personal information: held-out patterns, skips, training and tables."""
import re

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tests.llm.pii_patterns import HELD_OUT, HELD_OUT_PLAIN

from strandloom.llm import pii, pii_tokens, pii_training


@pytest.fixture(scope="module")
def field():
    return pii_training.weights()


def accuracy(field, test, **how):
    right = wrong = missed = 0
    for (_, gold), found in zip(test, pii.spans(field, [t for t, _ in test], **how)):
        right += len(set(gold) & set(found))
        wrong += len(set(found) - set(gold))
        missed += len(set(gold) - set(found))
    return right / max(1, right + wrong), right / max(1, right + missed)


def test_patterns_absent_from_training(field):
    literals = {x.strip().lower() for p in pii_training.CONTEXTS + pii_training.PLAIN for x in re.split(r"\{\w\d?\}|\\n|\\t", p) if len(x.split()) > 2}
    mine = {x.strip().lower() for p in HELD_OUT + HELD_OUT_PLAIN for x in re.split(r"\{\w\d?\}|\\n|\\t", p) if len(x.split()) > 2}
    assert not literals & mine
    precision, recall = accuracy(field, pii_training.labelled(1500, 4711, HELD_OUT, HELD_OUT_PLAIN))
    assert precision > 0.9 and recall > 0.9, (precision, recall)


def test_no_wording_of_the_tables_in_training(data):
    """No run of three words of a pattern stands in the texts the operator is measured on, but for words every text has."""
    text = " ".join(x for t in ("documents", "eval_items") for x in pq.read_table(f"{data}/{t}.parquet", columns=["text"]).column("text").to_pylist() if x).lower()
    text = " " + " ".join(re.findall(r"\w+", text)) + " "
    for p in pii_training.CONTEXTS + pii_training.PLAIN + pii_training.WEAK + pii_training.INTRODUCED:
        for literal in re.split(r"\{\w\d?\}|\\n|\\t", p):
            ws = re.findall(r"\w+", literal.lower())
            for i in range(len(ws) - 2):
                assert f" {' '.join(ws[i: i + 3])} " not in text, p


def test_skips_change_labels(field):
    test = pii_training.labelled(600, 99)
    with_, without = (pii.spans(field, [t for t, _ in test], use_skips=s) for s in (True, False))
    assert sum(a != b for a, b in zip(with_, without)) > 10
    assert sum(accuracy(field, test)) > sum(accuracy(field, test, use_skips=False))
    assert np.abs(field.skip).max() > 0.5  # learned, from nothing


def test_training_learns():
    made = pii_training.labelled(2500, 5)
    small = pii_training.train(2500, 2, made=made)
    precision, recall = accuracy(small, pii_training.labelled(300, 6))
    assert precision > 0.8 and recall > 0.6, (precision, recall)
    again = pii_training.train(2500, 2, made=made)
    assert (again.unary == small.unary).all() and (again.skip == small.skip).all()


def test_settled_tokens_change_nothing(field, monkeypatch):
    texts = [t for t, _ in pii_training.labelled(200, 12)]
    quick = pii.spans(field, texts)
    monkeypatch.setattr(pii, "SETTLED", 40.0)
    assert pii.spans(field, texts) == quick


def test_texts_do_not_touch_each_other(field):
    texts = [t for t, _ in pii_training.labelled(60, 13)] + ["", " ", "\n", "x", "\ud800 broken", "😀 Dr. Rossi said so", "a" * 50_000]
    assert pii.spans(field, texts) == [pii.spans(field, [t])[0] for t in texts]
    assert pii.spans(field, []) == []


def test_tokens_cover_the_text():
    text = "Ab1-cd ÄÖ\n\n(x)  9"
    _, at, t = pii_tokens.tokenize([text, text])
    assert [text[a - at[0]: b - at[0]] for a, b, d in zip(t.start, t.end, t.doc) if d == 0 and a >= at[0]][:10] == ["Ab", "1", "-", "cd", "ÄÖ", "\n\n", "(", "x", ")", "9"]
    assert int(t.word[pii_tokens.GAP]) == pii_tokens.word_hash("ab")


def test_table_of_odd_rows(spark, field):
    rows = [(1, "Dear Dr. Rossi,"), (2, None), (3, ""), (4, "The rain fell on the roof. " * 5000 + "Dear Dr. Rossi,"), (1, "Dear Dr. Rossi,"), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("kind", F.lit("x")).withColumn("found_text", F.lit(1))
    found = sorted((r.doc_id, r.kind, r.found_text) for r in pii.find(df, "doc_id", "text", field).collect())
    assert found == [(1, "name", "Rossi")] * 2 + [(4, "name", "Rossi")]
    assert {r.doc_id: r.n_found for r in pii.redacted(df, "doc_id", "text", field).collect()} == {1: 1, 3: 0, 4: 1}
