"""Fill-in-middle: cut each text at two line borders and move the middle to the end.

Scalar pandas UDFs over Arrow batches. finditer of the regex library walks the units of a text once and leaves only their end
offsets, in a compact array; two look-ups in it slice the text. hashlib gives the seeds, from the document's id alone, so a
document is cut alike wherever and however often it is processed, and the digests.

Units are lines with their line ends. Of the four numbers of a document's seed, the first two place the cuts (0 to n units
before either), the third decides whether it stays plain and the fourth its order: prefix, suffix, middle (psm) or suffix,
prefix, middle (spm), each part after its mark.

Defined cases: a null text counts as empty, and an empty text stays plain; so does a text that holds one of the marks, since it
could not be restored; a null doc_id has a seed of its own, that of the word ``null``; rows that repeat give equal results; an
empty part is written as such; an empty table gives an empty result; other columns stay, whatever their names, unless they
bear the name of a result, which replaces them. A text of any length costs its length and 8 bytes a line. No shuffle.
"""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_rows

# The unit pattern and the marks of the contract.
UNIT = regex.compile(r"[^\n]*\n|[^\n]+")
MARKS = PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"

CUT = "n long, form string, prefix_chars long, middle_chars long, output string, output_sha256 string"
WHOLE = "restored string, restored_sha256 string"


def unit_ends(text: str) -> array:
    """End offsets of the units of ``text``, in code points."""
    return array("q", (m.end() for m in UNIT.finditer(text)))


def seed_numbers(doc_id: str, seed: int) -> list[int]:
    """Four unsigned 32-bit numbers."""
    digest = hashlib.sha256(f"{seed}:{doc_id}".encode()).hexdigest()
    return [int(digest[k : k + 8], 16) for k in range(0, 32, 8)]


def cut(text: str, numbers: list[int], rate: int, spm: int) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, characters of the prefix, of the middle, output)."""
    ends = unit_ends(text)
    n = len(ends)
    if not n or numbers[2] % 100 >= rate or any(mark in text for mark in MARKS):
        return n, "plain", None, None, text
    few, many = sorted((numbers[0] % (n + 1), numbers[1] % (n + 1)))
    a, b = (ends[k - 1] if k else 0 for k in (few, many))
    prefix, middle, suffix = text[:a], text[a:b], text[b:]
    if numbers[3] % 100 < spm:
        return n, "spm", a, b - a, f"{SUFFIX}{suffix}{PREFIX}{prefix}{MIDDLE}{middle}"
    return n, "psm", a, b - a, f"{PREFIX}{prefix}{SUFFIX}{suffix}{MIDDLE}{middle}"


def rebuild(output: str, form: str) -> str:
    """The text that ``output`` was made of. No mark can arise across the border of a part, as all begin with the same sign
    and hold it once."""
    if form == "plain":
        return output
    first, second = (PREFIX, SUFFIX) if form == "psm" else (SUFFIX, PREFIX)
    at = output.index(second, len(first))
    end = output.index(MIDDLE, at + len(second))
    one, two, middle = output[len(first) : at], output[at + len(second) : end], output[end + len(MIDDLE) :]
    return one + middle + two if form == "psm" else two + middle + one


def sha256(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def fill_in_middle(docs: DataFrame, rate: int = 100, spm: int = 50, seed: int = 7) -> DataFrame:
    """``docs`` (doc_id, text, ...) with ``n`` (units), ``form``, ``prefix_chars``, ``middle_chars``, ``output`` and
    ``output_sha256``. ``rate`` percent of the documents are cut, ``spm`` percent of them in suffix-first order."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for ids, texts in batches:
            rows = [cut(t, seed_numbers(i, seed), rate, spm) for i, t in zip(ids, texts, strict=True)]
            yield pd.DataFrame([(*r, sha256(r[4])) for r in rows], columns=["n", "form", "prefix_chars", "middle_chars", "output", "output_sha256"]).astype({"prefix_chars": "Int64", "middle_chars": "Int64"})

    whole = [F.coalesce(F.col(c).cast("string"), F.lit(instead)) for c, instead in (("doc_id", "null"), ("text", ""))]
    return _with(docs, F.pandas_udf(run, CUT)(*whole), CUT)


def restore(cut_docs: DataFrame) -> DataFrame:
    """``cut_docs`` (output, form, ...) with ``restored``, the text rebuilt from these two alone, and ``restored_sha256``."""

    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for outputs, forms in batches:
            texts = [rebuild(o, f) for o, f in zip(outputs, forms, strict=True)]
            yield pd.DataFrame({"restored": texts, "restored_sha256": [sha256(t) for t in texts]})

    return _with(cut_docs, F.pandas_udf(run, WHOLE)("output", "form"), WHOLE)


def _with(df: DataFrame, made, schema: str) -> DataFrame:
    """The columns of the struct ``made`` beside those of ``df``."""
    arrow_rows(df.sparkSession)
    names, own = [part.split()[0] for part in schema.split(", ")], "weftline_made"
    kept = [F.col(f"`{c}`") for c in df.columns if c.lower() not in names]
    return df.withColumn(own, made).select(*kept, *[F.col(f"{own}.{n}") for n in names])


def fill_and_restore(docs: DataFrame) -> DataFrame:
    """The query's digest columns: (doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256)."""
    made = restore(fill_in_middle(docs.select("doc_id", "text")))
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


FIM_SQL = r"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('7:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS s FROM documents),
 u AS (SELECT doc_id, t, regexp_extract_all(t, '[^\n]*\n|[^\n]+') AS u, CAST('0x' || s[1:8] AS BIGINT) AS h1, CAST('0x' || s[9:16] AS BIGINT) AS h2, CAST('0x' || s[17:24] AS BIGINT) AS h3, CAST('0x' || s[25:32] AS BIGINT) AS h4 FROM d),
 c AS (SELECT *, CAST(len(u) AS BIGINT) AS n, least(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS a, greatest(h1 % (len(u) + 1), h2 % (len(u) + 1)) AS b FROM u),
 f AS (SELECT *, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR h3 % 100 >= 100 THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:], '') AS x FROM c)
 SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
 sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '<P>' || p || '<S>' || x || '<M>' || m ELSE '<S>' || x || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(t) AS restored_sha256 FROM f"""
