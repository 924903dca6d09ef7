"""Mixing sources by temperature: weights from token shares, realised as block permutations.

``q_i ~ p_i ** a`` for token shares ``p_i``; the exponent ``a`` in [0, 1] is
found by bisection: the smallest one whose weights keep every source within
``max_repeat`` passes, or the largest one whose weights reach
``target_entropy`` (a share of ``ln(number of sources)``).  The token budget is
given, or covers: the least with which no source falls below one whole pass.

Each pass over a source is a permutation: documents take the place that a hash
of (seed, pass, doc_id) gives them, cut into blocks of equal hash ranges.  A
source's quota is so many whole passes and the leading part of one more.  That
part ends where a running sum of block sums, and then of the documents of one
block, meets the quota, so nothing but one block of a source is ever ordered,
and the rows themselves are selected without a shuffle.

Edge cases: null text: no tokens; null source: the source ``''``; rows that
repeat a doc_id share a place and are taken together; a source without tokens
is taken once whole; very long texts count all their tokens; documents of one place (ties) are taken together; an empty table gives an empty result; further columns stay.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ._store import materialize

MAX_REPEAT = 2.0
SEED = 7
STEPS = 60
#: Sources up to which their quotas are worked out on the driver and sent along; more of them stay a table.
MAX_LOCAL = 20_000
#: Tokens a block aims at, and blocks of a source at most: neither blocks nor the documents of one are ever many to order.
BLOCK_TOKENS = 100_000
MAX_BLOCKS = 100_000
_SPAN = 2**52


def place(seed: int, epoch: Column, doc: Column) -> Column:
    """The document's place in a pass: 52 bits of a hash."""
    text = F.concat_ws("|", F.lit(str(seed)), epoch.cast("string"), F.coalesce(doc.cast("string"), F.lit("null")))
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long")


@dataclass(frozen=True)
class Shares:
    """What the exponent is found from: numbers of all sources with tokens, and ``moments(a)``, the sums of p**a and of p**a ln p over their shares p."""

    sources: int
    total: int
    least: float
    most: float
    moments: Callable[[float], tuple[float, float]]


def exponent(s: Shares, budget: int | None = None, target_entropy: float | None = None, max_repeat: float | None = MAX_REPEAT) -> tuple[float, float]:
    """(exponent a, tokens per unit of p**a): a source's quota is the second times its share to the power a."""

    def scale(a: float) -> float:
        # the budget that covers gives the source with the fewest passes, the largest one, a single pass
        return budget / s.moments(a)[0] if budget is not None else s.total * s.most ** (1 - a)

    def too_flat(a: float) -> bool:
        if target_entropy is not None:
            norm, logs = s.moments(a)
            return math.log(norm) - a * logs / norm > target_entropy * math.log(max(2, s.sources))
        # the smallest source has the most passes
        return max_repeat is not None and scale(a) * s.least**a / (s.total * s.least) > max_repeat

    lo, hi = 0.0, 1.0
    if not too_flat(lo):
        hi = lo
    for _ in range(STEPS if hi > lo else 0):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if too_flat(mid) else (lo, mid)
    return hi, scale(hi)


def weights(tokens: dict[str, int], budget: int | None = None, target_entropy: float | None = None, max_repeat: float | None = MAX_REPEAT) -> tuple[float, dict[str, int]]:
    """(exponent, quota of tokens by source)."""
    have = {s: n for s, n in sorted(tokens.items()) if n > 0}
    if not have:
        return 1.0, {}
    total = sum(have.values())
    share = {s: n / total for s, n in have.items()}
    moments = lambda a: (sum(p**a for p in share.values()), sum(p**a * math.log(p) for p in share.values()))
    a, scale = exponent(Shares(len(have), total, min(share.values()), max(share.values()), moments), budget, target_entropy, max_repeat)
    # a millionth of a token: rounding of the covering budget must not open another pass
    return a, {s: math.floor(scale * share[s] ** a + 1e-6) for s in have}


def _plan(sources: DataFrame, block_tokens: int, **aims) -> DataFrame:
    """src, full, rest, blocks of each source: its whole passes, the tokens of the one only begun, and its blocks.

    Up to ``MAX_LOCAL`` sources this is worked out on the driver and sent to the executors; beyond, it stays a table, and only sums over it are fetched.
    """
    spark = sources.sparkSession
    blocks_of = lambda n: min(MAX_BLOCKS, max(1, math.ceil(n / block_tokens)))
    found = sources.limit(MAX_LOCAL + 1).collect()
    if len(found) <= MAX_LOCAL:
        have = {r.src: r.tok for r in found}
        quota = weights(have, **aims)[1]
        rows = [(s, *(divmod(quota[s], n) if n else (1, 0)), blocks_of(n)) for s, n in sorted(have.items())]
        return F.broadcast(spark.createDataFrame(rows, "src string, full long, rest long, blocks long"))
    sources = materialize(sources, "sources")
    some = sources.filter("tok > 0")
    t = some.agg(F.count("*").alias("n"), F.sum("tok").alias("total"), F.min("tok").alias("least"), F.max("tok").alias("most")).first()
    if not t.n:
        return sources.select("src", F.lit(1).cast("long").alias("full"), F.lit(0).cast("long").alias("rest"), F.lit(1).cast("long").alias("blocks"))
    share = F.col("tok") / F.lit(float(t.total))

    def moments(a: float) -> tuple[float, float]:
        return tuple(some.agg(F.sum(F.pow(share, F.lit(a))), F.sum(F.pow(share, F.lit(a)) * F.log(share))).first())

    a, scale = exponent(Shares(t.n, t.total, t.least / t.total, t.most / t.total, moments), **aims)
    quota = F.floor(F.lit(scale) * F.pow(share, F.lit(a)) + 1e-6).cast("long")
    blocks = F.least(F.lit(MAX_BLOCKS), F.greatest(F.lit(1), F.ceil(F.col("tok") / block_tokens))).cast("long")
    empty = F.col("tok") <= 0
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    return sources.select("src", F.when(empty, one).otherwise((quota / F.col("tok")).cast("long")).alias("full"), F.when(empty, none).otherwise(quota % F.col("tok")).alias("rest"), blocks.alias("blocks"))


def mix(docs: DataFrame, budget: int | None = None, target_entropy: float | None = None, max_repeat: float | None = MAX_REPEAT, seed: int = SEED, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """``docs``, a row for each time a document is taken, plus ``mix_epoch`` and ``mix_place``.

    Read in order of (mix_epoch, mix_place), the rows are the mixed corpus.
    """
    source = F.coalesce(F.col("source").cast("string"), F.lit(""))
    tokens = F.regexp_count(F.coalesce(F.col("text"), F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")
    # three numbers a document, read three times below and let go at the end; lost parts are computed again
    counted = docs.select(F.col("doc_id").alias("doc"), source.alias("src"), tokens.alias("tok")).persist()
    plan = _plan(counted.groupBy("src").agg(F.sum("tok").alias("tok")), block_tokens, budget=budget, target_entropy=target_entropy, max_repeat=max_repeat)

    # the pass that is only begun: its block where the quota ends, then the place within that block
    last = counted.join(plan, "src").filter("rest > 0").withColumn("place", place(seed, F.col("full"), F.col("doc")))
    last = last.withColumn("block", F.floor(F.col("place") / (F.lit(_SPAN) / F.col("blocks"))).cast("long"))
    sums = last.groupBy("src", "rest", "block").agg(F.sum("tok").alias("tok"))
    upto = F.sum("tok").over(Window.partitionBy("src").orderBy("block"))
    ends = sums.withColumn("upto", upto).filter("upto > rest").groupBy("src").agg(F.min(F.struct("block", (F.col("upto") - F.col("tok")).alias("before"))).alias("end")).select("src", "end.*")
    ends = ends.withColumnRenamed("block", "end_block")
    inside = last.join(ends, "src").filter("block = end_block").groupBy("src", "rest", "before", "place").agg(F.sum("tok").alias("tok"))
    running = F.sum("tok").over(Window.partitionBy("src").orderBy("place")) + F.col("before")
    # the first place that is over the quota; where none is, the whole pass fits
    cut = inside.withColumn("upto", running).filter("upto > rest").groupBy("src").agg(F.min("place").alias("cut"))
    chosen = plan.join(cut, "src", "left").select(F.col("src").alias("__mix_src"), F.col("full").alias("__mix_full"), F.when(F.col("rest") > 0, F.coalesce("cut", F.lit(_SPAN))).otherwise(0).alias("__mix_cut"))
    chosen = materialize(chosen, "quotas")
    counted.unpersist()
    # a row a source, sent along where there are few
    few = chosen.count() <= MAX_LOCAL
    held = docs.withColumn("__mix_src", source).join(F.broadcast(chosen) if few else chosen, "__mix_src")
    copies = F.col("__mix_full") + (place(seed, F.col("__mix_full"), F.col("doc_id")) < F.col("__mix_cut")).cast("long")
    taken = held.withColumn("__mix_n", copies).filter("__mix_n > 0").withColumn("__mix_e", F.explode(F.sequence(F.lit(0).cast("long"), F.col("__mix_n") - 1)))
    cols = [c for c in docs.columns if c not in ("mix_epoch", "mix_place")]
    return taken.select(*cols, F.col("__mix_e").alias("mix_epoch"), place(seed, F.col("__mix_e"), F.col("doc_id")).alias("mix_place"))


def op5_source_mixing(spark, sf_dir: str) -> DataFrame:
    """Each time a document is taken: doc_id, source, mix_epoch, mix_place."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    return mix(docs).select("doc_id", "source", "mix_epoch", "mix_place")


def _sql_place(epoch: str, doc: str) -> str:
    return f"CAST('0x' || substr(md5('{SEED}|' || CAST({epoch} AS VARCHAR) || '|' || coalesce(CAST({doc} AS VARCHAR), 'null')), 1, 13) AS BIGINT)"


#: The largest number of passes over the smallest source is max_repeat when the budget covers, whence the exponent in closed form.
OP5_SQL = f"""
WITH c AS (SELECT doc_id, coalesce(source, '') src, source,
                  CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) tok FROM documents),
t AS (SELECT src, CAST(sum(tok) AS BIGINT) tok FROM c GROUP BY src),
p AS (SELECT src, tok, tok / sum(tok) OVER () AS share FROM t WHERE tok > 0),
a AS (SELECT greatest(0, 1 - ln({MAX_REPEAT}) / nullif(ln(max(share) / min(share)), 0)) a FROM p),
q AS (SELECT src, tok, pow(share, coalesce(a, 0)) / sum(pow(share, coalesce(a, 0))) OVER () q FROM p, a),
z AS (SELECT src, tok, CAST(floor(q * max(tok / q) OVER () + 1e-6) AS BIGINT) quota FROM q),
w AS (SELECT src, quota // tok AS full_, quota % tok AS rest FROM z UNION ALL SELECT src, 1, 0 FROM t WHERE tok = 0),
l AS (SELECT c.*, full_, rest, {_sql_place("full_", "doc_id")} AS place FROM c JOIN w USING (src)),
r AS (SELECT *, sum(tok) OVER (PARTITION BY src ORDER BY place) upto FROM l),
k AS (SELECT src, min(place) cut FROM r WHERE upto > rest GROUP BY src),
n AS (SELECT l.*, full_ + CASE WHEN rest > 0 AND place < coalesce(cut, {_SPAN}) THEN 1 ELSE 0 END AS copies FROM l LEFT JOIN k USING (src)),
e AS (SELECT doc_id, source, unnest(range(CAST(copies AS BIGINT))) AS mix_epoch FROM n)
SELECT doc_id, source, mix_epoch, {_sql_place("mix_epoch", "doc_id")} AS mix_place FROM e
"""
