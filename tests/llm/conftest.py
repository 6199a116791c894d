"""A small corpus with every awkward case: nulls, empty and long texts, copies, near copies,
repeated rows, shared passages, and further columns named like the operators' own."""

import random

import pytest
from pyspark.sql import Row

SCHEMA = (
    "doc_id long, text string, lang string, source string, n_chars long, "
    "k1 string, k2 string, spans string, fp string, block string, row string, root string, count string, kept string"
)


def texts() -> list[tuple]:
    rng = random.Random(5)
    parts = ["the", "of", "ti", "on", "er", "and", "ea", "st", "ble", "in", "ó", "é", "wh"]

    def sentence(n):
        words = ["".join(rng.choice(parts) for _ in range(rng.choice((1, 1, 2, 3)))) for _ in range(n)]
        return " ".join(words).capitalize() + "."

    plain = ["\n".join(sentence(rng.randint(8, 30)) for _ in range(rng.randint(1, 6))) for _ in range(30)]
    passage = " ".join(sentence(20) for _ in range(4))
    near = plain[0] + " " + passage
    out = [(i, t, "en" if i % 3 else "fr") for i, t in enumerate(plain)]
    out += [
        (100, plain[3], "en"),
        (101, plain[3], "en"),
        (101, plain[3], "en"),  # a repeated row
        (102, plain[4] + " " + passage, "en"),
        (103, passage + " " + plain[5], "fr"),
        (104, near, "en"),
        (105, near.replace("and", "or", 1), "en"),
        (106, near + " tail", "en"),
        (107, None, "en"),
        (108, "", "en"),
        (109, " \n\t ", None),
        (None, plain[6], "en"),
        (None, None, None),
        (110, "x" * 3000, "en"),
        (111, "And " * 400, "en"),
        (112, "ab" * 700 + plain[1], "de"),
        (113, " ".join(sentence(25) for _ in range(400)), "en"),
        (114, plain[7] * 2, "en"),
        (115, "That it.", "en"),
        (116, "A <|endoftext|>b c d don't \U0001f642́ İ ÉTÉ", "fr"),
        (117, "mail a.b@c.de x@y or q@@r.st, 1.2.3.4.5.6.7.8 and 999.1.1.1 host 10.0.0.256", "en"),
        (118, "card 4111 1111 1111 1111 or 4111-1111-1111-1112 call +1 (386) 555-3733 +12", "en"),
        (119, "konto DE89 3704 0044 0532 0130 00 and DE88370400440532013000 ssn 123-45-6789; 123-45-6789", "en"),
        (120, "Text.\nLicensed under the Apache License, Version 2.0.\nMore.\nAll rights reserved.", "en"),
        (121, plain[8] + "\nLicensed under the Apache License, Version 2.0", "en"),
        (122, "A license to sing is not given here, nor any copyright.", "en"),
    ]
    return out


@pytest.fixture(scope="session")
def rows():
    return [r[:2] for r in texts()]


@pytest.fixture(scope="session")
def docs(spark):
    made = [Row(i, t, lang, None if i == 3 else "s", None if t is None else len(t), *["?"] * 9) for i, t, lang in texts()]
    return spark.createDataFrame(made, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
