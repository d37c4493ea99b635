"""Ids from chunks against the library's ids of whole texts."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from groundloom.llm.tokens import ChunkEncoder

ODD = ["", "a   b", "a\n  b", " \n x", "a\t b", "a\t  b  ", "x ' s 's  ", "é  \n\n é", "1 23  4\n5 \n", "Σ ΣΑΣ. İ ", "<|endoftext|> a", "a\x1c !\x1c b", "  ", "\n", " á b ́c", "don't, DON'T. 's", "a.̸ b", "Te. Te, \n.x \nÄß! ½ ǅ ﬁ ²x x² a_b _", "\nx\ny", "x" * 500, "ª. º", "İ İi. ıI"]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_ids(spark, name):
    rng = random.Random(7)
    pool = "aBé ß.,!'\n\t 12ñÜ##  İ漢́"
    texts = ODD + ["".join(rng.choice(pool) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    whole = Tokenizer.from_file(public_tokenizers.path(name))
    encoder = ChunkEncoder(public_tokenizers.path(name), 1)
    for text, got in zip(texts, encoder.encode(texts), strict=True):
        assert np.frombuffer(got, encoder.dtype).tolist() == [*whole.encode(text, add_special_tokens=False).ids, 1], repr(text)
