"""Cross-site boilerplate lines: HyperLogLog spread per line, exact counts near the threshold.

Only DataFrame functions.  The plan:

1. Lines are hashed (two 64-bit hashes) and counted.  A line that occurs fewer
   than ``min_sites`` times cannot stand on ``min_sites`` sites, so the
   occurrences of all others drop out exactly and before any sketch is built.
2. The remaining occurrences are written once; per line the sites go into one
   HyperLogLog sketch, merged by the aggregation (so a line on every page costs
   one sketch a task).
3. Lines whose estimate lies within ``margin`` of the threshold get an exact
   distinct count; the rest are decided by the sketch.
4. A boilerplate line stays in the document with the smallest doc_id that holds
   it and goes from all others.

Edge cases: a null text is an empty one; a null site counts as the site ``''``;
lines are compared without blanks, tabs, carriage returns, form feeds and vertical tabs at their ends, and lines of these only are never boilerplate;
rows that repeat a doc_id count as one document; a null doc_id sorts first, like
a smallest id; of equal ids (ties) the first place of the line stays; very long texts and lines are whole; an empty table gives an empty result; further columns stay as
they are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

MIN_SITES = 5
#: log2 of the sketch's registers; its relative error is about 1.04 / sqrt(2**12) = 1.6 %.
LG_K = 12
#: Estimates within 10 % of the threshold, six standard errors, are counted exactly.
MARGIN = 0.1


#: What lines are compared without at their ends: a line of these only is blank.
BLANKS = " \t\r\f\x0b"


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with the key of a document: ``__ld_doc``, and ``__ld_sub``, which tells rows that repeat a doc_id apart by text."""
    return docs.withColumns({"__ld_doc": F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63))), "__ld_sub": F.xxhash64(F.coalesce("text", F.lit("")))})


def boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", margin: float = MARGIN) -> tuple[DataFrame, DataFrame]:
    """(occurrences, lines): candidate occurrences, and the boilerplate lines with their first document."""
    # with a character before it: sketches pass over empty strings
    site_ = F.concat(F.lit("/"), F.coalesce(F.col(site).cast("string"), F.lit("")))
    every = _keyed(docs).select(F.col("__ld_doc").alias("doc"), F.col("__ld_sub").alias("sub"), site_.alias("site"), F.posexplode(_lines(F.col("text"))).alias("pos", "line"))
    bare = F.btrim("line", F.lit(BLANKS))
    # a line's key: two 64-bit hashes of the line without blanks at its ends
    lines = every.filter(bare != "").select("doc", "sub", "site", "pos", F.xxhash64(bare).alias("h1"), F.xxhash64(F.lit("line"), bare).alias("h2"))
    often = lines.groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("doc").alias("first_doc")).filter(F.col("n") >= min_sites).drop("n")
    # written first, so that the join deals out both of its sides itself and can split a common line's rows
    often = materialize(often, "line-counts")
    seen = materialize(lines.join(often, ["h1", "h2"]), "line-occurrences")
    spread = seen.groupBy("h1", "h2", "first_doc").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", LG_K)).alias("sites"))
    spread = materialize(spread.filter(F.col("sites") >= min_sites * (1 - margin)), "line-spread")
    near = spread.filter(F.col("sites") <= min_sites * (1 + margin))
    exact = seen.join(near.drop("sites"), ["h1", "h2", "first_doc"]).groupBy("h1", "h2", "first_doc").agg(F.countDistinct("site").alias("n")).filter(F.col("n") >= min_sites)
    sure = spread.filter(F.col("sites") > min_sites * (1 + margin))
    return seen, sure.drop("sites").unionByName(exact.drop("n"))


def drop_boilerplate(docs: DataFrame, min_sites: int = MIN_SITES, site: str = "source", margin: float = MARGIN) -> DataFrame:
    """``docs`` with ``text`` cut, plus ``ld_lines``, ``ld_removed`` (counts of lines)."""
    seen, lines = boilerplate(docs, min_sites, site, margin)
    gone = (
        seen.join(materialize(lines.drop("first_doc"), "boilerplate"), ["h1", "h2"])
        .filter("doc <> first_doc")
        .groupBy(F.col("doc").alias("__ld_doc"), F.col("sub").alias("__ld_sub"))
        .agg(F.sort_array(F.collect_set("pos")).alias("__ld_gone"))
    )
    joined = _keyed(docs).join(gone, ["__ld_doc", "__ld_sub"], "left")
    all_lines = _lines(F.col("text"))
    # the stretches between lines that go: one pass over a document's lines, however many of them go
    bounds = F.arrays_zip(F.concat(F.array(F.lit(0)), F.transform("__ld_gone", lambda p: p + 1)).alias("a"), F.concat(F.col("__ld_gone"), F.array(F.size("__ld_all"))).alias("b"))
    stay = F.flatten(F.transform(bounds, lambda x: F.slice("__ld_all", x["a"] + 1, x["b"] - x["a"])))
    out = joined.withColumn("__ld_all", all_lines)
    out = out.withColumn("__ld_kept", F.when(F.col("__ld_gone").isNull(), F.col("__ld_all")).otherwise(stay)).withColumn("__ld_all", F.size("__ld_all").cast("long"))
    text = F.when(F.col("text").isNotNull(), F.array_join("__ld_kept", "\n"))
    cols = [c for c in docs.columns if c not in ("text", "ld_lines", "ld_removed")]
    return out.select(*cols, text.alias("text"), F.col("__ld_all").alias("ld_lines"), (F.col("__ld_all") - F.size("__ld_kept")).alias("ld_removed"))


def op10_line_dedup(spark, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_lines, n_removed, kept_sha256 of the text that stays."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    out = drop_boilerplate(docs)
    return out.select("doc_id", F.col("ld_lines").alias("n_lines"), F.col("ld_removed").alias("n_removed"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("kept_sha256"))


_SQL_BLANKS = " || ".join(f"chr({ord(c)})" for c in BLANKS)
OP10_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') t, coalesce(source, '') s FROM documents),
l AS (SELECT doc_id, s, unnest(string_split(t, chr(10))) line, generate_subscripts(string_split(t, chr(10)), 1) k FROM d),
b AS (SELECT trim(line, {_SQL_BLANKS}) bare, min(doc_id) first_doc FROM l WHERE trim(line, {_SQL_BLANKS}) <> ''
      GROUP BY 1 HAVING count(DISTINCT s) >= {MIN_SITES}),
m AS (SELECT l.*, b.bare IS NOT NULL AND l.doc_id <> b.first_doc gone FROM l LEFT JOIN b ON trim(l.line, {_SQL_BLANKS}) = b.bare)
SELECT doc_id, count(*) n_lines, CAST(count(*) FILTER (gone) AS BIGINT) n_removed,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY k) FILTER (NOT gone), '')) kept_sha256
FROM m GROUP BY doc_id
"""
