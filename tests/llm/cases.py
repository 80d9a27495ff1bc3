"""Hand-made tables with the odd cases every operator must stand."""

from __future__ import annotations

import random

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint,"
    " k1 string, row string, size int, taken string, score string, recorded string, turn int"
)


def prose(seed: int, n: int) -> str:
    draw = random.Random(seed)
    letters = "abcdefghijklmnopqrstuvwxyz"
    return " ".join(
        "".join(draw.choice(letters) for _ in range(draw.randint(2, 9))) for _ in range(n)
    )


SHARED = prose(99, 80)


def rows():
    plain = prose(1, 120)
    near = plain.split()
    near[60] = "changed"
    texts = [
        (1, plain),
        (2, plain),
        (2, plain),
        (3, " ".join(near)),
        (4, prose(4, 30) + " " + SHARED + " " + prose(5, 30)),
        (5, prose(6, 10) + "\n" + SHARED + "\n" + prose(7, 50)),
        (6, None),
        (None, None),
        (7, ""),
        (8, "   \n\t "),
        (9, "héé ñandú ß 漢字 " * 3),
        (10, prose(8, 30_000)),
        (11, "a" * 5000),
        (12, "one"),
        (None, prose(9, 40)),
        (13, 'see token = "0123456789abcdef0123456789abcdef01234567" here'),
        (14, "Released under the MIT License. Licensed under the Apache License, Version 2.0"),
        (15, "THIS IS ALL UPPER!! $$$ ### %%% " * 30),
    ]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        source = None if i % 5 == 4 else f"src{i % 3}"
        length = None if text is None or i % 4 == 3 else len(text)
        out.append((doc_id, text, None if i % 6 == 0 else "en", source, length) + _EXTRA)
    return out


_EXTRA = ("x", None, 3, "t", "s", "r", 9)


def documents(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


def none(spark):
    return spark.createDataFrame([], SCHEMA)
