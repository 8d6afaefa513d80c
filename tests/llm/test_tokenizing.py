import random

import numpy as np
import pytest
from mnemo.llm.tokenizing import PieceCache, tokenizer_file
from tokenizers import Tokenizer

ATOMS = ["<|ENDOFTEXT|>", "<|endoftext|>", "<|EndOfText|>", "<|startoftext|>", "<|", "|>", "İ", "İ:", "Bİ", "ı", "ǅ", "é", "é", "́", "̇", "i̇", "a.", "B!", "É", "ß", "ﬁ", "Ω", "Ω", "日本",
         "1", "23", "'s", "'S", "don't", "DON'T", "\x00", "\x07", "\x1c", "\x1f", "​", "﻿", " ", "\x85", "\xa0", "\n", "\r\n", "\t", " ", "  ", ".", ",", "?", "…", "_", "$", "ÀB", "ſ", "K", "Å", "😀", "İ́.", "σς.", "ŉ."]


@pytest.mark.parametrize(("name", "drops"), [("word_bpe_49k.json", True), ("byte_bpe_50k.json", False)])
def test_ids_equal_the_tokenizer(name, drops):
    path = tokenizer_file(name)
    whole, cache, rng = Tokenizer.from_file(path), PieceCache(path, drops), random.Random(5)
    texts = ["".join(rng.choice(ATOMS) + rng.choice([" ", "", "", ""]) for _ in range(rng.randrange(10))) for _ in range(6000)]
    texts += ["say <|ENDOFTEXT|> now", "Bİ: x"]
    for text, got in zip(texts, cache.encode(texts), strict=True):
        ids = np.frombuffer(got, {2: "<u2", 4: "<u4"}[cache.width]).tolist()
        assert ids == whole.encode(text, add_special_tokens=False).ids, ascii(text)
