"""Which texts the encoder holds against the library."""

import random
import zlib

import pandas as pd

from lumenlint.llm import pieces


def test_long_texts_and_long_units_are_checked(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(pieces.Encoder, "check", lambda self, text, ids, decoded: seen.append(text))
    encode = pieces.encoder_udf(pieces.model_bytes(), False, False).func
    long_unit = "".join(random.Random(8).choice("etaoinshr") for _ in range(pieces.STEP_CHARS + 400))
    texts = ["some words"] * 300 + [f"a text with {long_unit} in it"]
    list(encode(iter([pd.Series(texts)])))
    assert texts[-1] in seen
    seen.clear()
    long_text = "many more words " * 4000
    list(encode(iter([pd.Series([long_text])])))
    assert seen == [long_text]
    seen.clear()
    plain = [f"words and number {i}" for i in range(600)]
    list(encode(iter([pd.Series(plain)])))
    assert seen == [min(plain, key=lambda t: zlib.crc32(t.encode()))]
