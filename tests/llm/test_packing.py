"""Ids are the tokenizer's own, whichever its file is."""

import json
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing

TEXTS = ["It's A test of THE ids, 12 times", "a  b\n\nc", "Ünïcode x_y <|endoftext|> z", "", " lead"]


@pytest.fixture(scope="module")
def cased(tmp_path_factory):
    path = tmp_path_factory.mktemp("tokenizer") / "cased.json"
    vocabulary = {"[UNK]": 0, "A": 1, "a": 2, "b": 3, "c": 4}
    described = {"version": "1.0", "truncation": None, "padding": None, "added_tokens": [], "normalizer": None, "pre_tokenizer": {"type": "WhitespaceSplit"}, "post_processor": None, "decoder": None, "model": {"type": "WordLevel", "vocab": vocabulary, "unk_token": "[UNK]"}}
    path.write_text(json.dumps(described))
    return str(path)


def check(spark, path):
    t = Tokenizer.from_file(path)
    rows = packing.pack(spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string"), path).collect()
    for k, text in enumerate(TEXTS):
        ids = [*t.encode(text, add_special_tokens=False).ids, 1]
        own = sorted((r for r in rows if r.doc_id == k), key=lambda r: r.start)
        assert [r.ids_crc32 for r in own] == [zlib.crc32(np.array(ids, "<u4").tobytes())] and own[0].doc_tokens == len(ids)


def test_cased(spark, cased):
    check(spark, cased)
    assert not packing.Ids(cased).by_words


@pytest.mark.parametrize("name, by_words", [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_public(spark, name, by_words):
    check(spark, str(public_tokenizers.path(name)))
    assert packing.Ids(str(public_tokenizers.path(name))).by_words == by_words
