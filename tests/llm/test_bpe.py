import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from bibweave.llm.bpe import Encoder

P = pytest.importorskip("public_tokenizers")
E = Encoder(P.path("byte_bpe_50k.json"))


def same(texts):
    flat, at = E.encode(pa.array(texts, pa.string()))
    got = [flat[a:b].tolist() for a, b in zip(at, at[1:], strict=False)]
    assert got == [x.tolist() for x in E.whole([t or "" for t in texts])]


PARTS = [*"ab Z1.,'!s\n\t\r\x1c\x85\xa0 “éß中", "'re", " \n", "<|endoftext|>"]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.lists(st.sampled_from(PARTS), max_size=30).map("".join), max_size=6))
def test_chunks_equal_whole_texts(texts):
    same(texts)


def test_real_texts_and_nulls():
    same([None, "", "a", "\n", "\nb", " c\n", *pq.read_table("/root/testdata/sf0.001/documents.parquet").column("text").to_pylist()])


def test_repeated_batches_agree():
    t = pa.array(["the same text, again.\nAnd again"] * 3)
    a, b = E.encode(t), E.encode(t)
    assert all(np.array_equal(x, y) for x, y in zip(a, b, strict=True))
