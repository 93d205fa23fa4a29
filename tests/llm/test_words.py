"""Words of repeating structure, which a polynomial hash modulo 2**64 cannot tell apart."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from test_maxent import check
from tokenizers import Tokenizer

from isobar.llm import words as W
from isobar.llm.maxent import lm_scores
from isobar.llm.minhash import near_duplicates
from isobar.llm.queries import tokenizer_spec
from isobar.llm.token_files import token_files


def thue_morse(letters, steps=11):
    word = "a"
    for _ in range(steps):
        word += word.translate(str.maketrans("ab", "ba"))
    return word.translate(str.maketrans("ab", letters))


PAIR = [(1, thue_morse("ab")), (2, thue_morse("ba"))]


def test_hashes_differ_and_fold():
    data, offsets = W.flat(pa.array([PAIR[0][1], PAIR[1][1], PAIR[0][1].upper(), "x" * 70_000, "x" * 70_001, "x" * 69_999 + "y"]))
    values, first = W.hashes(data, offsets)
    assert first.tolist() == list(range(7))
    assert values[0] == values[2] and len(np.unique(values)) == 5


def test_a_word_hashes_alike_wherever_it_stands():
    texts = ["one", " one", "two one", "x" * W.PIECE + " one"]
    data, offsets = W.flat(pa.array(texts))
    values, first = W.hashes(data, offsets)
    assert len({values[i - 1] for i in first[1:]}) == 1


def test_token_files_keep_them_apart(docs):
    tokenizer = Tokenizer.from_str(tokenizer_spec())
    result = {r.doc_id: r.ids_crc32 for r in token_files(docs(PAIR), tokenizer_spec()).collect()}
    for i, text in PAIR:
        ids = [*tokenizer.encode(text, add_special_tokens=False).ids, 1]
        assert result[i] == zlib.crc32(np.array(ids, "<u4").tobytes())


def test_near_duplicates_does_not_link_them(docs):
    assert all(r.kept for r in near_duplicates(docs(PAIR)).collect())


def test_language_model_counts_them_apart(docs):
    rows = [*PAIR, (4, PAIR[0][1] + " " + PAIR[0][1])]
    check(rows, lm_scores(docs(rows)).collect())
    assert lm_scores(docs(rows)).first().train_tokens == pytest.approx(sum(len(t.split()) + 1 for i, t in rows if zlib.crc32(str(i).encode()) % 7 != 2))
