"""Operator 13 against its oracle, a plain version and exact round trips."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from tests.parity import compare, connect
from weftline.llm import fim


def test_rows_match_the_oracle(spark, sf_dir, documents):
    assert compare(fim.fill_and_restore(documents), connect(sf_dir), fim.FIM_SQL) > 0


def texts():
    rng = random.Random(1)
    pieces = ["a", "\n", "\n\n", "\r\n", "日本", "é", "<", "<S", "<P", "<M", ">", "P>", "line of words", "\x00", " ", "\x0b", "<P>", "<S>", "<M>", "𝄞"]
    return ["", "\n", "no end", "x\n", *("".join(rng.choice(pieces[:-4] + pieces[-1:] if k % 4 else pieces) for _ in range(rng.randrange(20))) for k in range(800))]


def test_cuts_and_round_trips():
    forms = set()
    for doc_id, text in enumerate(texts()):
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = hashlib.sha256(f"7:{doc_id}".encode()).hexdigest()
        h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
        n, form, a, b, output = fim.cut(text, fim.seed_numbers(str(doc_id), 7), 100, 50)
        lo, hi = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = "".join(units[:lo]), "".join(units[lo:hi]), "".join(units[hi:])
        plain = not text or any(x in text for x in ("<P>", "<S>", "<M>"))
        want = (len(units), "plain", None, None, text) if plain else (len(units), "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 50 else (len(units), "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}")
        assert (n, form, a, b, output) == want and fim.rebuild(output, form) == text
        forms.add(form)
    assert forms == {"plain", "spm", "psm"}


def test_operator_keeps_columns_and_gives_texts(spark, odd_docs, make_docs):
    docs = odd_docs.withColumn("output", F.lit("old")).withColumn("extra", F.lit(1))
    rows = fim.restore(fim.fill_in_middle(docs)).collect()
    assert len(rows) == odd_docs.count() and set(rows[0].asDict()) >= {"text", "extra", "output", "restored"}
    for r in rows:
        assert r["restored"] == (r["text"] or "") and r["restored_sha256"] == hashlib.sha256(r["restored"].encode()).hexdigest()
        assert r["output_sha256"] == hashlib.sha256(r["output"].encode()).hexdigest() and (r["form"] == "plain") == (not r["text"])
    assert fim.restore(fim.fill_in_middle(make_docs())).collect() == []
    pairs = [(r["output"], r["form"]) for r in rows if r["doc_id"] == 4]
    assert len(pairs) == 2 and pairs[0] == pairs[1]


@pytest.mark.parametrize("rate, spm, want", [(0, 50, {"plain"}), (100, 0, {"psm"}), (100, 100, {"spm"})])
def test_rates(spark, make_docs, rate, spm, want):
    made = fim.fill_in_middle(make_docs(*((k, f"a\nb\n{k}") for k in range(60))), rate, spm)
    assert {r["form"] for r in made.collect()} == want


def test_long_texts(spark, make_docs):
    docs = make_docs((1, "\n" * 300_000), (2, "x" * 2_000_000), (3, "ab\n" * 400_000))
    rows = fim.restore(fim.fill_in_middle(docs)).select("doc_id", "n", (F.col("restored") == F.col("text")).alias("same")).orderBy("doc_id").collect()
    assert [tuple(r) for r in rows] == [(1, 300_000, True), (2, 1, True), (3, 400_000, True)]
