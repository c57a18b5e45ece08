import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

#: Nulls, empty and odd texts, repeated rows, a long text, and columns whose names clash.
ODD = [
    (1, None), (2, ""), (3, " \n\t "), (4, "one"), (5, "one"), (6, "Ärger ÉTÉ ﬂ  x"), (7, "a b " * 4000),
    (8, 'TOKEN = "abcdefgh1" tokeN:short token=secret=abcdefghij AKIAABCDEFGHIJKL12 AKIA12 é deadbeefdeadbeefdeadbeefdeadbeef'),
    (9, "x x\nx x\n\ny\nx x\r\n#*$|<>"), (10, "Released under the MIT License. cc-by Apache\nLicense GNU general public license; mit mit license"),
    (11, "ſecret=abcdefghijk toKen='q1w2e3r4t5' Kenken passwd : zzzzzzzz"), (12, "kx9Qz7Lw2Vb8Rt5Yp3Nm6Jd4Hs1Gf0" + "é"), (None, "no id"), (13, "same text here"), (13, "same text here"),
]


@pytest.fixture(scope="session")
def odd(spark):
    rows = [(i, t, "en", "src0" if k % 3 else None, 7, "clash") for k, (i, t) in enumerate(ODD)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


@pytest.fixture(scope="session")
def small(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
