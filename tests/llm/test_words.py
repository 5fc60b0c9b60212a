"""Word ids: plain words go by the model alone, and all ids are those of the whole text."""

import numpy as np
from tokenizers import Tokenizer

from tidemark.llm import packing

TEXT = "Êréè, ÀÉ! ÿ. ß? Word word, K Å İx ªº µ don't 12a, ab|| ,. naı̈ve été Straße; ÑANDÚ: ×÷ ſ ̀a b́, a­b ÆØÅ."


def test_plain_words_bypass_the_tokenizer():
    w = packing.WordIds(packing.tokenizer_path())
    asked, whole = [], Tokenizer.from_file(packing.tokenizer_path())

    class Spy:
        def encode_batch_fast(self, words, **how):
            asked.extend(words)
            return whole.encode_batch_fast(words, **how)

    w.tokenizer = Spy()
    assert w.encode(TEXT) == np.array(whole.encode(TEXT, add_special_tokens=False).ids, "<u4").tobytes()
    assert w.encode("Ñandú, straße. Any: word") == np.array(whole.encode("Ñandú, straße. Any: word", add_special_tokens=False).ids, "<u4").tobytes()
    assert "don't" in asked and not {"Êréè,", "word,", "Straße;", "Ñandú,", "word", "Any:"} & set(asked)
