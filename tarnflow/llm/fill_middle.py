"""Fill-in-middle texts: a delimiter escaped and injected after every unit, parts taken by their rank.

A text is escaped so that ``MARK`` does not occur in it, ``regexp_replace`` appends ``MARK`` to every unit (code points, or
words or lines with the blanks that follow them), counting the marks gives the number of units, and ``substring_index``
extracts the units up to, between and after two ranks.  The parts lose their marks, are unescaped, and are put together:
``<P>`` prefix ``<S>`` suffix ``<M>`` middle (psm), ``<S>`` suffix ``<P>`` prefix ``<M>`` middle (spm), or the text alone (plain).
Where to cut and which form to take are drawn from the sha256 of seed and doc_id, so a rerun gives the same rows.  All of
it is column expressions on one pass over the rows: no shuffle, no Python.

Edge cases: a null text is an empty one; an empty text and one that contains a marker stay plain; parts may be empty; texts
may contain the delimiter and its escape; very long texts are whole; repeated ids are cut alike where their texts have as many
units (ties); a null doc_id draws as an empty one; an empty table gives an empty result; further columns are not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The delimiter and the escape character.
MARK, ESCAPE = "\x01", "\x02"
#: A unit of an escaped text; an escaped character is one code point.
UNITS = {"char": f"(?s){ESCAPE}.|.", "word": r"[^\x20\x09-\x0D]+[\x20\x09-\x0D]*|[\x20\x09-\x0D]+", "line": r"[^\n]*\n|[^\n]+"}
#: Prefix, suffix and middle markers.
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit(ESCAPE), F.lit(ESCAPE + "e")), F.lit(MARK), F.lit(ESCAPE + "d"))


def unescaped(text: Column) -> Column:
    """A part of a marked text, without its marks and escapes."""
    plain = F.replace(text, F.lit(MARK), F.lit(""))
    return F.replace(F.replace(plain, F.lit(ESCAPE + "d"), F.lit(MARK)), F.lit(ESCAPE + "e"), F.lit(ESCAPE))


def part(marked: Column, count: Column) -> Column:
    """``substring_index`` at a count that differs by row: the first ``count`` units, or with a negative one the last."""
    return F.call_function("substring_index", marked, F.lit(MARK), count)


def draws(seed: int, doc_id: Column) -> list[Column]:
    """Four unsigned numbers of 32 bits."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))).cast("binary"), 256)
    return [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long") for i in range(4)]


def fill_in_middle(docs: DataFrame, unit: str = "char", rate: int = 90, spm: int = 20, seed: int = 1) -> DataFrame:
    """doc_id, n (units), form, prefix, middle, suffix (null if plain), output.

    ``rate`` of 100 documents are rearranged, ``spm`` of 100 of these with the suffix first.
    """
    h1, h2, h3, h4 = draws(seed, F.col("doc_id"))
    rows = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.select("doc_id", "text", F.regexp_replace(escaped(F.col("text")), UNITS[unit], "$0" + MARK).alias("marked"))
    rows = rows.select("doc_id", "text", "marked", (F.length("marked") - F.length(F.replace("marked", F.lit(MARK), F.lit("")))).cast("long").alias("n"))
    held = [F.contains("text", F.lit(m)) for m in (PREFIX, SUFFIX, MIDDLE)]
    form = F.when((F.col("text") == "") | held[0] | held[1] | held[2] | (h3 % 100 >= rate), "plain").when(h4 % 100 < spm, "spm").otherwise("psm")
    a, b = h1 % (F.col("n") + 1), h2 % (F.col("n") + 1)
    rows = rows.select("doc_id", "text", "marked", "n", form.alias("form"), F.least(a, b).cast("int").alias("lo"), F.greatest(a, b).cast("int").alias("hi"))
    moved, marked = F.col("form") != "plain", F.col("marked")
    rows = rows.select(
        "doc_id", "text", "n", "form", F.when(moved, unescaped(part(marked, F.col("lo")))).alias("prefix"),
        F.when(moved, unescaped(part(part(marked, F.col("hi")), F.col("lo") - F.col("hi")))).alias("middle"),
        # the text ends with a mark, and what follows it counts as a part
        F.when(moved, unescaped(part(marked, F.col("hi") - F.col("n").cast("int") - 1))).alias("suffix"),
    )
    prefix, suffix = F.concat(F.lit(PREFIX), F.col("prefix")), F.concat(F.lit(SUFFIX), F.col("suffix"))
    output = F.when(F.col("form") == "psm", F.concat(prefix, suffix, F.lit(MIDDLE), "middle")).when(F.col("form") == "spm", F.concat(suffix, prefix, F.lit(MIDDLE), "middle"))
    return rows.select("doc_id", "n", "form", "prefix", "middle", "suffix", F.coalesce(output, F.col("text")).alias("output"))


def restored(output: Column, form: Column) -> Column:
    """The text that an output was made of: no part contains a marker."""
    after = lambda text, marker: F.substring_index(text, marker, -1)
    before = lambda text, marker: F.substring_index(text, marker, 1)
    head, middle = before(output, MIDDLE), after(output, MIDDLE)
    psm = F.concat(after(before(head, SUFFIX), PREFIX), middle, after(head, SUFFIX))
    spm = F.concat(after(head, PREFIX), middle, after(before(head, PREFIX), SUFFIX))
    return F.when(form == "psm", psm).when(form == "spm", spm).otherwise(output)


def op12_fill_in_middle(spark, sf_dir: str) -> DataFrame:
    made = fill_in_middle(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return made.select(
        "doc_id", "n", "form", F.length("prefix").cast("long").alias("prefix_chars"), F.length("middle").cast("long").alias("middle_chars"),
        sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"),
    )


OP12_SQL = """
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, length(coalesce(text, '')) AS n, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM documents),
r AS (SELECT doc_id, text, n, CAST('0x' || h[1:8] AS BIGINT) % (n + 1) AS c1, CAST('0x' || h[9:16] AS BIGINT) % (n + 1) AS c2,
      CAST('0x' || h[17:24] AS BIGINT) % 100 AS h3, CAST('0x' || h[25:32] AS BIGINT) % 100 AS h4 FROM d),
f AS (SELECT doc_id, text, n, least(c1, c2) AS lo, greatest(c1, c2) AS hi,
      CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 >= 90 THEN 'plain' WHEN h4 < 20 THEN 'spm' ELSE 'psm' END AS form FROM r),
p AS (SELECT doc_id, text, n, form, lo, hi, substr(text, 1, lo) AS pre, substr(text, lo + 1, hi - lo) AS mid, substr(text, hi + 1) AS suf FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN lo END AS prefix_chars, CASE WHEN form <> 'plain' THEN hi - lo END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || pre || '<S>' || suf || '<M>' || mid ELSE '<S>' || suf || '<P>' || pre || '<M>' || mid END) AS output_sha256,
       sha256(text) AS restored_sha256
FROM p
"""
