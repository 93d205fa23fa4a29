import zlib

import numpy as np
import pytest
from odd_rows import NASTY
from hypothesis import given, settings, strategies as st
from pyspark.errors import PythonException
from tokenizers import Tokenizer

from isobar.llm.queries import tokenizer_spec
from isobar.llm.token_files import BLOCK, decode_block, encode_block, read_token_files, token_files


@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 300), st.integers(0, 2**32 - 1)), min_size=1, max_size=400))
def test_blocks_keep_their_ids(ids):
    ids = np.array(ids, np.uint32)
    assert (decode_block(encode_block(ids)) == ids).all()


def test_outliers_are_exceptions():
    ids = np.full(BLOCK, 1000, np.uint32)
    ids[::2] += np.arange(BLOCK // 2, dtype=np.uint32) % 16
    ids[5] = 2**32 - 1
    data = encode_block(ids)
    assert len(data) < BLOCK * 4 / 8 + 100 and (decode_block(data) == ids).all()


def expected(rows):
    tokenizer, at, out = Tokenizer.from_str(tokenizer_spec()), 0, []
    for doc_id, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]
        out.append((doc_id, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_round_trip_by_the_tokenizer(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    rows = sorted((r.doc_id, r.text) for r in table.collect())
    result = token_files(table.repartition(5), tokenizer_spec()).collect()
    assert sorted(map(tuple, result), key=lambda r: r[1]) == expected(rows)


def test_odd_rows(docs):
    odd = [
        (20, "It's <|endoftext|> a<|startoftext|>b"), (21, "É́    x\x1cy ΣΑΣ ŞİI 10,000.50 ***a,b... '' 's"),
        (22, "tabs\tand\r\nlines"), (23, "ﬁ ½ ª º µ"),
    ]
    rows = [r for r in NASTY if r[0] is not None] + odd
    result = [tuple(r) for r in token_files(docs(NASTY + odd), tokenizer_spec()).collect()]
    nulls = sorted((r for r in result if r[0] is None), key=lambda r: r[1])
    assert nulls[0][1] == 0 and len(nulls) == 2  # null ids come first
    begin = nulls[1][1] + nulls[1][2]
    ours = sorted((r for r in result if r[0] is not None), key=lambda r: r[1])
    assert [(i, s - begin, n, c) for i, s, n, c in ours] == expected(sorted(rows, key=lambda r: r[0]))


def test_an_empty_table(docs):
    assert token_files(docs([]), tokenizer_spec()).collect() == []


def test_other_files_are_refused(spark, tmp_path):
    (tmp_path / "part-00000").write_bytes(b"0123456789abcdef0")
    with pytest.raises(PythonException, match="not a token file"):
        read_token_files(spark, str(tmp_path)).collect()
