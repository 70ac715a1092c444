import random

import pyarrow as pa
import pytest

from bibweave.llm import queries, token_counts

PATH = queries.tokenizer_path("word_bpe_49k.json")
ODD = [
    "", " ", "\t\n", "Hello, World's 123 times", "don't'S ''s I'LL 'Tis", "<|endoftext|> x<|startoftext|>y <|ENDOFTEXT|>", "a\x1cb\x00c \x85\xa0z", "É é Éé é É x́y", "Ünïcode...!!! a_b c-d",
    "≥≤日本語 한국어 ﬁ ſ İ ΣΑΣ ς", "×÷ 3×4 a÷b ÀÖØÞßÿ", "½²³ ٣ x²", "x" * 5000, "ab1" * 900, "!" * 3000, "😀😀 a😀b", "www.example.org/a?b=c&d=1'2", "​ a​b ﻿", "<|endoftext|><|endoftext|>", "CAFÉ Über-Straße ça l'été",
]


def plain(texts):
    tokenizer = token_counts.load(PATH)
    return [len(tokenizer.encode(t or "", add_special_tokens=False).ids) for t in texts]


@pytest.mark.parametrize("size", [16, 1 << 20])
def test_against_the_library(monkeypatch, size):
    """Odd texts and random mixtures of their characters, in slices of any size."""
    monkeypatch.setattr(token_counts, "SLICE", size)
    rng = random.Random(3)
    letters = "abcéÉÀz ZQ  .,!'s12\n-́ß<|>×日_"
    texts = ODD + [None] + ["".join(rng.choices(letters, k=rng.randrange(60))) for _ in range(1500)]
    counter = token_counts.Counter(PATH, token_counts.whole_tokens(PATH))
    assert counter.count(pa.array(texts)).tolist() == plain(texts)
    assert counter.count(pa.array(["lead", *texts]).slice(1)).tolist() == plain(texts)


def test_forgetting_changes_nothing(monkeypatch):
    monkeypatch.setattr(token_counts, "KNOWN", 3)
    counter = token_counts.Counter(PATH, [])  # without proof all is merged
    assert counter.count(pa.array(ODD)).tolist() == plain(ODD)


def test_proof_holds_for_its_strings():
    """Every proved string is one token; common words are proved, parts of words and special tokens are not."""
    whole = token_counts.whole_tokens(PATH)
    assert len(whole) > 20_000 and plain(whole) == [1] * len(whole)
    assert {"the", "and", "."} <= set(whole) and not {"<|endoftext|>", ""} & set(whole)


def test_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "x " * 3000)], "doc_id long, text string").selectExpr("*", "1 AS n_tokens", "2 AS n_bytes")
    rows = sorted(map(tuple, token_counts.count_tokens(docs, PATH).collect()), key=str)
    assert rows == sorted([(1, 3, 2, False), (1, 3, 2, False), (None, 0, 0, False), (2, 6000, 3000, True)], key=str)
    assert token_counts.count_tokens(docs.where("false"), PATH).collect() == []


def test_query_against_the_library(spark, sf_dir):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = queries.op13_token_counts(spark, sf_dir).collect()
    assert {r.doc_id: r.n_tokens for r in rows} == dict(zip(texts, plain(texts.values()), strict=True))
    assert all(r.n_bytes == len((texts[r.doc_id] or "").encode()) and r.over_limit == (r.n_tokens > 2048) for r in rows) and len(rows) == len(texts)
