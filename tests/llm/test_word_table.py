import random

import pyarrow as pa
import pytest

pytest.importorskip("public_tokenizers")

from tessera.llm import packing
from tessera.llm.queries import tokenizer
from tessera.llm.token_counts import token_counts

PARTS = [*"abzAZ'.,;:!?|<>  \t\n\x00\x1c\x85éÉİßſḰあ🙂09_", "<|endoftext|>", "<|", "'s", "'RE", "verylongwordwithmanyletters", "hello", "World", "the"]


@pytest.mark.parametrize(("remembered", "slots"), [(1 << 19, 1 << 20), (40, 64), (1, 4)])
def test_ids_equal_the_library(monkeypatch, remembered, slots):
    monkeypatch.setattr(packing, "REMEMBERED", remembered)
    monkeypatch.setattr(packing, "SLOTS", slots)
    rng = random.Random(remembered)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randrange(50))) for _ in range(1500)] + [None, "", "x" * 5000, "the " * 9000]
    words = packing.WordIds(tokenizer("word_bpe_49k.json"))
    for _ in range(2):  # the second time from the table
        for a in range(0, len(texts), 400):
            part = texts[a : a + 400]
            for t, ids in zip(part, words.encode_all(pa.array(part, pa.string())), strict=True):
                assert ids.tolist() == words.library.encode(t or "", add_special_tokens=False).ids, t
    assert words.words <= remembered


def test_columns_of_the_results_may_be_in_the_input(spark):
    rows = [(1, "hello world", 5, 6, 7.5), (None, None, None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int, length int, start double")
    assert sorted((r.doc_id or 0, r.n_tokens) for r in token_counts(docs, tokenizer("byte_bpe_50k.json")).collect()) == [(0, 0), (1, 2)]
    pieces = packing.pack_documents(docs, tokenizer("word_bpe_49k.json")).collect()
    assert {r.doc_id: r.doc_tokens for r in pieces} == {None: 1, 1: 3} and sum(r.length for r in pieces) == 4 and min(r.start for r in pieces) == 0
