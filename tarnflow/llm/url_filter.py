"""URL filter: host and path rules, and gradient-boosted trees on lexical features for the rest.

Trees are trained on a bounded sample (``MAX_TRAIN`` distinct URLs, the smallest by hash) of labelled URLs, and
they judge the URLs that no rule fits.  No table labels URLs, so the query's labels are the rules' verdicts; :func:`train` takes any.

The rules' verdicts name domains (in the query's rules nothing outside ``com`` is ever allowed), and the trees judge other domains.
So no feature tells the top-level domain: lengths, depth, digit and vowel ratios, mean letter, character entropy and parameter counts are those of the
URL without scheme and last label of the host, and suffix statistics are relative to the top-level domain: how frequent the host is among its
hosts, which share of its suffix (the last two labels) the host has, and which share of the top-level domain the suffix has.  They
are counts of all URLs; no feature is made from labels.  The two labels weigh alike in the sample as a whole, so that a score of 0.5 means: as likely as at the labels' base rate.

Edge cases: null URL or none with ``://``: host and path are empty, no rule
fits, the trees judge; where the sample lacks one of the two labels, the method
allows; repeated rows are answered one by one, repeated URLs count once in statistics and sample; an empty table gives an empty
result; very long URLs are whole; equal scores get equal verdicts, one of just 0.5 (a tie) blocks; further columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._store import materialize

#: Fixed values: (host, path prefix, verdict).
RULES = [
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
]
MAX_TRAIN = 20_000
#: Rows of a statistics table up to which it is broadcast.
MAX_LOCAL = 20_000
#: Suffix statistics.
SHARES = ["f_host_frequency", "f_host_share", "f_suffix_share"]
LEXICAL = [
    "f_len", "f_host_len", "f_path_len", "f_labels", "f_first_label", "f_depth", "f_digits", "f_path_digits", "f_vowels", "f_path_vowels", "f_letter", "f_path_letter", "f_entropy", "f_path_entropy",
    "f_params", "f_query_len", "f_fragment", "f_https", "f_dash", "f_dots",
]
FEATURES = [*LEXICAL, *SHARES]
#: Trees, their depth, and the share of each tree that counts.
TREES, DEPTH, RATE = 10, 4, 0.4


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.when(F.instr(url, "://") > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    host = F.translate(F.regexp_extract(rest, "^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, "^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def _fits(host: str, path: str) -> Column:
    return ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(path)


def with_rule(pages: DataFrame) -> DataFrame:
    """page_id, url, host, path, rule (longest that fits, or null)."""
    host, path = host_and_path(F.col("url"))
    longest = sorted(RULES, key=lambda r: -len(r[0] + r[1]))
    rule = F.coalesce(*[F.when(_fits(h, p), F.lit(h + p)) for h, p, _ in longest])
    return pages.withColumn("host", host).withColumn("path", path).withColumn("rule", rule)


def entropy(text: Column) -> Column:
    """Entropy of a text's characters in bits: each is counted by what goes with it."""
    n = F.length(text)
    distinct = F.array_distinct(F.filter(F.split(text, ""), lambda c: c != ""))
    return F.aggregate(distinct, F.lit(0.0), lambda acc, c: acc - (n - F.length(F.replace(text, c))) / n * F.log2((n - F.length(F.replace(text, c))) / n))


def mean_letter(text: Column) -> Column:
    """The mean place in the alphabet of a text's letters; 0 without any."""
    letters = F.filter(F.split(F.lower(F.regexp_replace(text, "[^A-Za-z]", "")), ""), lambda c: c != "")
    return F.aggregate(letters, F.lit(0), lambda acc, c: acc + F.ascii(c) - 96) / F.greatest(F.size(letters), F.lit(1))


def with_features(df: DataFrame) -> DataFrame:
    """The lexical features of ``url``, and the keys of its statistics; all built-in functions."""
    url = F.coalesce(F.col("url"), F.lit(""))
    share = lambda text, pattern: F.regexp_count(text, F.lit(pattern)) / F.greatest(F.length(text), F.lit(1))
    # labels without the last one, and what follows the host
    df = df.withColumn("__own", F.regexp_replace("host", r"\.[^.]*$", "")).withColumn("__bare", F.concat("__own", F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "^.*?://[^/?#]*", "")).otherwise(url)))
    query = F.regexp_extract("__bare", "\\?([^#]*)", 1)
    own, bare, path = F.col("__own"), F.col("__bare"), F.col("path")
    of = {
        "f_len": F.length(bare), "f_host_len": F.length(own), "f_path_len": F.length(path),
        "f_labels": F.size(F.split("host", "\\.")), "f_first_label": F.length(F.substring_index(own, ".", 1)), "f_depth": F.regexp_count(path, F.lit("/")),
        "f_digits": share(bare, "[0-9]"), "f_path_digits": share(path, "[0-9]"), "f_vowels": share(bare, "[aeiouAEIOU]"), "f_path_vowels": share(path, "[aeiouAEIOU]"),
        "f_letter": mean_letter(own), "f_path_letter": mean_letter(path), "f_entropy": entropy(bare), "f_path_entropy": entropy(path),
        "f_params": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))), "f_query_len": F.length(query),
        "f_fragment": bare.contains("#").cast("int"), "f_https": url.startswith("https").cast("int"), "f_dash": F.regexp_count(own, F.lit("-")), "f_dots": F.regexp_count(path, F.lit("\\.")),
    }
    return df.withColumns({k: v.cast("double") for k, v in of.items()}).drop("__own", "__bare")


def suffix_statistics(urls: DataFrame) -> DataFrame:
    """host and its ``SHARES``, from all distinct URLs; ``urls``: url, host."""
    of = {"__suffix": F.substring_index("host", ".", -2), "__top": F.substring_index("host", ".", -1)}
    counted = materialize(urls.groupBy("host").agg(F.countDistinct("url").alias("n")).withColumns(of), "hosts")
    suffixes = materialize(counted.groupBy("__suffix", "__top").agg(F.sum("n").alias("n_suffix"), F.count("*").alias("hosts")), "suffixes")
    tops = small_or_whole(materialize(suffixes.groupBy("__top").agg(F.sum("n_suffix").alias("n_top"), F.sum("hosts").alias("hosts_top")), "tops"))
    joined = counted.join(small_or_whole(suffixes.drop("hosts")), ["__suffix", "__top"]).join(tops, "__top")
    frequency, share, of_top = F.log(F.col("n") * F.col("hosts_top") / F.col("n_top")), F.log(F.col("n") / F.col("n_suffix")), F.log(F.col("n_suffix") / F.col("n_top"))
    return small_or_whole(materialize(joined.select("host", *[c.alias(n) for n, c in zip(SHARES, (frequency, share, of_top), strict=True)]), "statistics"))


def small_or_whole(table: DataFrame) -> DataFrame:
    """A statistics table: broadcast as a local relation up to ``MAX_LOCAL`` rows, else joined by shuffle."""
    rows = [tuple(r) for r in table.limit(MAX_LOCAL + 1).collect()]
    return table if len(rows) > MAX_LOCAL else F.broadcast(table.sparkSession.createDataFrame(rows, table.schema))


def with_shares(df: DataFrame, shares: DataFrame) -> DataFrame:
    """Features of the statistics; a host that was not counted has none of them."""
    return df.join(shares, "host", "left").fillna(dict.fromkeys(SHARES, 0.0))


def sample_of(labelled: DataFrame, max_train: int) -> DataFrame:
    """At most ``max_train`` distinct URLs, the least by hash."""
    return labelled.dropDuplicates(["url"]).orderBy(F.xxhash64("url"), "url").limit(max_train)


def train(labelled: DataFrame, shares: DataFrame, max_train: int = MAX_TRAIN):
    """The trees, or None where the sample has one label only; ``labelled``: url, host, path, label (1: block)."""
    sample = with_shares(with_features(sample_of(labelled, max_train)), shares).coalesce(1).persist()
    seen = sample.agg(F.avg("label"), F.count("*")).first()
    model = None
    if seen[1] and seen[0] not in (0.0, 1.0):
        weight = F.when(F.col("label") == 1, 0.5 / seen[0]).otherwise(0.5 / (1 - seen[0]))
        assembled = VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(sample.withColumn("__weight", weight)).select("__features", "label", "__weight").persist()
        model = GBTClassifier(
            featuresCol="__features", labelCol="label", weightCol="__weight", maxDepth=DEPTH, maxIter=TREES, stepSize=RATE, maxBins=32, minInstancesPerNode=5, seed=3, checkpointInterval=-1
        ).fit(assembled)
        assembled.unpersist()
    sample.unpersist()
    return model


def block_score(model, urls: DataFrame, shares: DataFrame) -> DataFrame:
    """``urls`` (url, host, path and more) plus ``score``, the trees' probability of block."""
    scored = model.transform(VectorAssembler(inputCols=FEATURES, outputCol="__features").transform(with_shares(with_features(urls), shares)))
    return scored.select(*urls.columns, vector_to_array("probability")[1].alias("score"))


def by_rules(ruled: DataFrame) -> DataFrame:
    """The URLs that a rule judges, with its verdict as ``label``."""
    blocks = [h + p for h, p, v in RULES if v == "block"]
    return ruled.filter("rule is not null").select("url", "host", "path", F.col("rule").isin(blocks).cast("double").alias("label"))


def held_out_report(pages: DataFrame, max_train: int = MAX_TRAIN) -> dict:
    """Trees fitted without a quarter of the labelled URLs (by hash), judged on it: n, accuracy, share of the more frequent label, importances; and of the URLs that no rule fits, how many they block."""
    ruled = with_rule(pages.select("url"))
    shares = suffix_statistics(ruled.select("url", "host"))
    labelled = by_rules(ruled).withColumn("__out", F.crc32(F.col("url").cast("binary")) % 4 == 2)
    model = train(labelled.filter("not __out").drop("__out"), shares, max_train)
    judged = block_score(model, labelled.filter("__out").select("url", "host", "path", "label").dropDuplicates(["url"]), shares)
    seen = judged.agg(F.count("*").alias("n"), F.avg((F.col("label") == (F.col("score") >= 0.5).cast("double")).cast("double")).alias("accuracy"), F.avg("label").alias("blocked")).first()
    others = block_score(model, ruled.filter("rule is null").select("url", "host", "path").dropDuplicates(["url"]), shares)
    unruled = others.agg(F.count("*").alias("n"), F.avg((F.col("score") >= 0.5).cast("double")).alias("blocked")).first()
    return {"unruled": unruled.n, "unruled_blocked": unruled.blocked, "n": seen.n, "accuracy": seen.accuracy, "majority": max(seen.blocked, 1 - seen.blocked), "importances": dict(zip(FEATURES, model.featureImportances.toArray().tolist(), strict=True))}


def filter_urls(pages: DataFrame) -> DataFrame:
    """Per page: page_id, host, path, rule, verdict, score (the trees' probability of block; null where a rule judges)."""
    ruled = with_rule(pages.select("page_id", "url"))
    verdicts = F.create_map(*[F.lit(x) for h, p, v in RULES for x in (h + p, v)])
    shares = suffix_statistics(ruled.select("url", "host"))
    model = train(by_rules(ruled), shares)
    cols = ["page_id", "host", "path", "rule"]
    of_rule = F.try_element_at(verdicts, F.col("rule"))
    if model is None:
        return ruled.select(*cols, F.coalesce(of_rule, F.lit("allow")).alias("verdict"), F.lit(None).cast("double").alias("score"))
    by_rule = ruled.filter("rule is not null").select(*cols, of_rule.alias("verdict"), F.lit(None).cast("double").alias("score"))
    scored = block_score(model, ruled.filter("rule is null").select("page_id", "url", "host", "path", "rule"), shares)
    return by_rule.unionByName(scored.select(*cols, F.when(F.col("score") >= 0.5, "block").otherwise("allow").alias("verdict"), "score"))


def op8_url_filter(spark, sf_dir: str) -> DataFrame:
    return filter_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


#: What SQL can express of the query: page_id, host, path, rule, and the verdicts of rules.
OP8_RULES_SQL = f"""
WITH r AS (SELECT page_id, CASE WHEN contains(coalesce(url, ''), '://') THEN substr(url, strpos(url, '://') + 3) ELSE '' END rest FROM pages),
p AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
rules(h, start, verdict) AS (VALUES {", ".join(f"('{h}', '{p}', '{v}')" for h, p, v in RULES)}),
f AS (SELECT page_id, host, path, arg_max(h || start, len(h || start)) AS rule, arg_max(verdict, len(h || start)) verdict
      FROM (SELECT DISTINCT * FROM p) JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, start) GROUP BY ALL)
SELECT page_id, host, path, rule, verdict FROM p LEFT JOIN f USING (page_id, host, path)
"""
