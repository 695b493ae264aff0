import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from seriesloom.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")


def plain_fim(ident, text, unit="word"):
    """(n, form, prefix, middle, suffix, output) by the rule, one text at a time."""
    text = text or ""
    h = hashlib.sha256(f"42:{'' if ident is None else ident}".encode()).hexdigest()
    h = [int(h[8 * i : 8 * i + 8], 16) for i in range(4)]
    units = UNIT.findall(text) if unit == "word" else list(text)
    n = len(units)
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(x in text for x in fim.SENTINELS) or h[2] % 100 >= 50:
        return n, "plain", None, None, None, text
    if h[3] % 100 < 80:
        return n, "spm", p, m, s, f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", p, m, s, f"<P>{p}<S>{s}<M>{m}"


def texts():
    rng = random.Random(5)
    pieces = ["a", "wörd", " ", "  ", "\t", "\x0b", "\n", "日本", "🙂", "<P", "<", ">", "S>", " ", "\x85", "x" * 70]
    made = ["".join(rng.choices(pieces, k=rng.randrange(0, 30))) for _ in range(300)]
    return [None, "", " ", "\n\n", "<P>", "a <S> b", "tail <M>", "é" * 50_000 + " end", "🙂", *made]


@pytest.mark.parametrize("unit", ["word", "char"])
def test_equals_the_rule(spark, unit):
    rows = [(i, t, "x", 1) for i, t in enumerate(texts())] + [(None, "one two three", "x", 2), (7, "the same id twice", "x", 3), (7, "the same id twice", "x", 3)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, form string, n int").repartition(3)
    made = fim.transform(docs, unit=unit).withColumn("back", fim.restored(F.col("output"), F.col("form")))
    got = sorted(((r.doc_id, r.n, r.form, r.output, r.prefix_chars, r.middle_chars, r.prefix_bytes, r.middle_bytes, r.back) for r in made.collect()), key=str)
    want = []
    for i, t, *_ in rows:
        n, form, p, m, _s, out = plain_fim(i, t, unit)
        sizes = (None,) * 4 if p is None else (len(p), len(m), len(p.encode()), len(m.encode()))
        want.append((i, n, form, out, *sizes, t or ""))
    assert got == sorted(want, key=str)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_index_converts_both_ways():
    text = "aé日🙂b́ß" * 40 + "plain ascii"
    data = np.frombuffer(text.encode(), np.uint8)
    index = fim.ExceptionIndex(data)
    places = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert (index.points(places) == np.arange(len(text) + 1)).all()
    assert (index.bytes(np.arange(len(text) + 1)) == places).all()
    assert len(index.bytes_at) == sum(ord(c) > 127 for c in text)


def test_other_sentinels_and_empty_table(spark):
    marks = ("<|prefix|>", "<|suffix|>", "<|middle|>")
    docs = spark.createDataFrame([(i, f"word {i} <|pre and <P> more <") for i in range(50)], "doc_id long, text string")
    made = fim.transform(docs, rate=100, sentinels=marks).withColumn("back", fim.restored(F.col("output"), F.col("form"), marks))
    rows = made.collect()
    assert {r.form for r in rows} == {"psm", "spm"} and all(r.back == f"word {r.doc_id} <|pre and <P> more <" for r in rows)
    assert fim.transform(docs.limit(0)).count() == 0
    for bad in (("<a", "a>", "x"), ("a", "a", "b"), ("", "b", "c"), ("ab", "abc", "d")):
        with pytest.raises(ValueError):
            fim.transform(docs, sentinels=bad)
