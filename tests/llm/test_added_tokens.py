"""The literal of an added token is one token, as the named tokenizer file has it."""

import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer

from siltstone.llm import packing


@pytest.mark.parametrize("text", ["x <|endoftext|> y", "<|endoftext|>", "<|endoftext|><|endoftext|>é 漢", "x <|endoftext| > y", "x <|endof", "plain words"])
def test_added_tokens(text):
    plain = Tokenizer.from_file(packing.tokenizer_path())
    assert np.frombuffer(packing.encoder(packing.tokenizer_path())(text), "<u4").tolist() == plain.encode(text, add_special_tokens=False).ids


def test_packed_documents_with_added_tokens(spark):
    row = packing.pack(spark.createDataFrame([(7, "x <|endoftext|> y")], "doc_id long, text string")).first()
    ids = [*Tokenizer.from_file(packing.tokenizer_path()).encode("x <|endoftext|> y", add_special_tokens=False).ids, packing.END_ID]
    assert 50256 in ids and row.doc_tokens == len(ids) and row.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
