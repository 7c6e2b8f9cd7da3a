"""A small corpus with every awkward row."""

from __future__ import annotations

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, did long, tk int, kept boolean, shard string, z binary, size string, label int"


def texts() -> list[tuple[int | None, str | None]]:
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdefghij") for _ in range(rnd.randint(2, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    base, passage, other = prose(150), prose(80), prose(120)
    edited = base.split()
    edited[70] = "changed"
    rows = [(1, base), (2, base), (3, " ".join(edited)), (4, other + "\n" + passage), (5, passage + "\t" + prose(90)), (6, prose(40) + " " + passage + " " + prose(40))]
    rows += [(7, None), (8, ""), (9, " \n\t "), (10, "one"), (11, "Ünïcödé wörds é £ 日本 " * 40), (12, ("again " * 500).strip()), (13, prose(3000)), (14, base.upper())]
    rows += [(None, passage), (None, prose(30)), (15, other), (15, other), (16, "x" * 1200), (16, "y" * 900 + "x" * 500), (17, prose(60) + " trash"), (18, "THE!! END!! OF!! IT!!")]
    return rows


def frame(spark, rows=None, parts=3):
    rows = texts() if rows is None else rows
    data = [(i, t, None if k % 4 == 0 else "en", None if k % 5 == 0 else f"s{k % 3}", None if k % 6 == 0 else len(t or ""), 7, None, True, "x", None, "big", k) for k, (i, t) in enumerate(rows)]
    df = spark.createDataFrame(data, SCHEMA)
    return df.repartition(parts) if rows else df


def empty(spark):
    return frame(spark, [])
