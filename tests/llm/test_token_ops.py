import zlib
from collections import defaultdict

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer

from tessera.llm.packing import pack_documents, place
from tessera.llm.queries import tokenizer
from tessera.llm.token_counts import token_counts

TEXTS = [
    None, "", " ", "\n\n  \t", "hello world", "Hello,  world!!  \n\n it's  we'll I'D", "a<|endoftext|>b <|endoftext|>", "<|endoftext|>", "naïve café ÉÀ ß ﬁ Å Å",
    "日本語のテキスト", "🙂🙂 x🙂y", "١٢٣ 4567 ²", "a b c　 d", "x" * 3000, "ab " * 20000, "tab\tsep\x0bvt\x0cff\r\ncr", "don't 'tis 's 'S", "\x1c\x1d a\x85b", "é ä", "İstanbul ΣΊΣΥΦΟΣ", "It's, they'LL. e.g.x!'s A.'m", "<|ENDOFTEXT|> A<|endoftext|>,b", "a.́ b,‍c K.",
]
SCHEMA = "doc_id long, text string, source string"


def rows(texts):
    return [(i, t, None) for i, t in enumerate(texts)] + [(None, "null id", "s"), (3, "again", "s"), (3, "again", "s")]


def test_counts_equal_the_library(spark):
    library = Tokenizer.from_file(tokenizer("byte_bpe_50k.json"))
    data = rows(TEXTS)
    got = sorted(map(tuple, token_counts(spark.createDataFrame(data, SCHEMA), tokenizer("byte_bpe_50k.json")).collect()), key=str)
    want = []
    for i, t, _ in data:
        n = len(library.encode(t or "", add_special_tokens=False).ids)
        want.append((i, len((t or "").encode()), n, n > 512))
    assert got == sorted(want, key=str)


def test_counts_of_an_empty_table(spark):
    assert token_counts(spark.createDataFrame([], SCHEMA), tokenizer("byte_bpe_50k.json")).count() == 0


@pytest.mark.parametrize("pack", [64, 5000, 1 << 18])
def test_pieces_hold_every_id_once(spark, pack):
    library = Tokenizer.from_file(tokenizer("word_bpe_49k.json"))
    data = [(i, t, None) for i, t in enumerate(TEXTS)]
    got = pack_documents(spark.createDataFrame(data, SCHEMA), tokenizer("word_bpe_49k.json"), pack=pack).collect()
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in got:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    for i, t, _ in data:
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        at = 0
        for r in sorted(pieces[i], key=lambda r: r.start):
            assert r.start == at and r.length > 0 and r.doc_tokens == len(ids)
            assert r.ids_crc32 == zlib.crc32(ids[at : at + r.length].tobytes())
            at += r.length
        assert at == len(ids)
    for own in sequences.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at == own[0].sequence_length <= 4096
        assert at & (at - 1) == 0  # whole sequences and powers of two need no padding


def test_packing_of_nulls_and_nothing(spark):
    v = tokenizer("word_bpe_49k.json")
    assert pack_documents(spark.createDataFrame([], SCHEMA), v).count() == 0
    r = pack_documents(spark.createDataFrame([(None, None, None), (1, "", None), (1, "", None)], SCHEMA), v).collect()
    assert sorted((x.doc_id is None, x.doc_tokens) for x in r) == [(False, 1), (False, 1), (True, 1)]


def test_costs_are_balanced():
    lengths = [int(x) for x in np.random.default_rng(1).integers(1, 3000, 300)]
    filled, cost = defaultdict(int), defaultdict(float)
    for _, _, k, s, _ in place(lengths, 4096):
        filled[s] += k
        cost[s] += k + k * k / 2048
    whole = [cost[s] for s in filled if filled[s] == 4096]
    assert sum(filled.values()) == sum(lengths)
    assert np.std(whole) / np.mean(whole) < 0.25
