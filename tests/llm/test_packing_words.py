"""The packing tokenizer sees each word of an array of texts once."""

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from sparklog.llm import packing

WORDS = public_tokenizers.path("word_bpe_49k.json")


class Counted(dict):
    """A memo that counts its lookups."""

    lookups = 0

    def get(self, *a):
        self.lookups += 1
        return super().get(*a)


@pytest.mark.parametrize("kind", [pa.string(), pa.large_string()])
def test_words_are_looked_up_once_whatever_their_case_and_marks(kind):
    texts = ["before the slice", *["Word, word WORD! Über über; 漢字 it's word... \x1cword", None, "", " word  ", "a<|endoftext|>b"] * 200]
    encoder = packing.ChunkTokenizer(WORDS)
    encoder.memo = Counted()
    found = encoder.encode_texts(pa.array(texts[:1] + [t and t.replace("\x1c", "") for t in texts[1:]], kind)[1:])
    assert encoder.memo.lookups <= 10  # word, über, four kinds of marks, none, 漢字, it's and the empty string
    oracle = Tokenizer.from_file(WORDS)
    for t, ids in zip(texts[1:], found, strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == oracle.encode((t or "").replace("\x1c", ""), add_special_tokens=False).ids
    # texts with separators that only Python takes as white space are encoded whole, here beside others and in a slice
    for t, ids in zip(texts[1:], encoder.encode_texts(pa.array(texts, kind)[1:]), strict=True):
        assert np.frombuffer(ids, np.int32).tolist() == oracle.encode(t or "", add_special_tokens=False).ids


def test_slices_hold_all_rows_in_order():
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(7)), "text": ["abc", None, "", "x" * 50, "de", "fg", "h" * 9]})
    parts = list(packing._slices(batch.slice(1), 5))
    assert [i for p in parts for i in p.column(0).to_pylist()] == [1, 2, 3, 4, 5, 6]
    assert [p.num_rows for p in parts] == [2, 1, 2, 1]
    assert list(packing._slices(batch.slice(0, 0))) == []
