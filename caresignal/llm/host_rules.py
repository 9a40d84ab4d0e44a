"""Quality rules (operator 7): host-level rules. DataFrame functions only.

Per document, base counts decide whether the document itself fails. Failures are
aggregated by host, every host's failure rate is shrunk by a beta prior fitted to all
hosts (method of moments), and the verdict of the host is joined back.

Defined cases: null text counts as no words; a null host belongs to no host, so such
documents are judged by their own rules only; repeated rows count once each; an empty
table gives an empty result.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpointed, maybe_broadcast

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
#: A host is rejected when its shrunk failure rate reaches this.
HOST_REJECT_RATE = 0.5
#: Rejected hosts are broadcast up to this many rows (about 5 MB), joined by a shuffle beyond.
BROADCAST_HOSTS = 100_000
SPACE = r"[\x20\x09-\x0D]+"
SPACE_CHARS = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _size(c: Column) -> Column:
    return F.size(c).cast("long")


def base_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """`docs` plus n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words (long) and base_failed.

    Staged projections: each stage reads the arrays of the one before several times, so
    Spark keeps them as columns. Windows repeated inside a text are found by sorting
    (hash, position) pairs, n log n in the length of one text; texts without a repeat
    skip the sort.
    """
    keep = [F.col(f"`{c}`") for c in docs.columns]
    t = F.coalesce(F.col(f"`{text}`"), F.lit(""))
    d = docs.select(*keep, t.alias("__t"))
    d = d.select(*keep, "__t", F.btrim("__t", F.lit(SPACE_CHARS)).alias("__b"))
    d = d.select(*keep, "__t", F.when(F.col("__b") == "", F.array().cast("array<string>")).otherwise(F.split("__b", SPACE)).alias("__w"))
    lines = F.filter(F.split("__t", "\n"), lambda x: F.btrim(x, F.lit(SPACE_CHARS)) != "")
    d = d.select(*keep, "__t", "__w", _size(F.col("__w")).alias("n_words"), lines.alias("__l"),
                 F.transform("__w", lambda x: F.xxhash64(x)).alias("__x"))
    n = F.col("n_words").cast("int")
    k = F.greatest(n - 2, F.lit(0))
    windows = F.when(n >= 3, F.transform(
        F.arrays_zip(F.slice("__x", 1, k).alias("a"), F.slice("__x", 2, k).alias("b"), F.slice("__x", 3, k).alias("c")),
        lambda z: F.xxhash64(z["a"], z["b"], z["c"]))).otherwise(F.array().cast("array<bigint>"))
    d = d.select(*keep, "n_words",
                 F.length(F.array_join("__w", "")).cast("long").alias("word_chars"),
                 (F.length("__t") - F.length(F.translate("__t", SYMBOLS, ""))).cast("long").alias("n_symbols"),
                 (_size(F.col("__l")) - _size(F.array_distinct("__l"))).alias("n_dup_lines"),
                 windows.alias("__h"))
    # (hash, position) pairs in hash order, only where some window occurs twice
    d = d.select(*keep, *BASE[:4], F.when(F.size(F.array_distinct("__h")) < F.size("__h"), F.sort_array(
        F.transform("__h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(
        F.array().cast("array<struct<h:bigint,i:int>>")).alias("__s"))
    s, m = F.col("__s"), F.size("__s")
    k = F.greatest(m - 1, F.lit(0))
    twice = F.when(m > 0, F.filter(
        F.arrays_zip(s.alias("x"), F.concat(F.array(F.lit(None).cast("bigint")), F.slice(s["h"], 1, k)).alias("p"),
                     F.concat(F.slice(s["h"], 2, k), F.array(F.lit(None).cast("bigint"))).alias("q")),
        lambda z: (z["x"]["h"].eqNullSafe(z["p"])) | (z["x"]["h"].eqNullSafe(z["q"]))))
    d = d.select(*keep, *BASE[:4], F.sort_array(F.transform(twice, lambda z: z["x"]["i"])).alias("__p"))
    # every repeated window covers three words; overlaps count once
    p = F.col("__p")
    k = F.greatest(F.coalesce(F.size("__p"), F.lit(0)) - 1, F.lit(0))
    gaps = F.zip_with(F.slice(p, 2, k), F.slice(p, 1, k), lambda a, b: F.least(a - b, F.lit(3)))
    covered = F.when(F.coalesce(F.size("__p"), F.lit(0)) <= 0, F.lit(0)).otherwise(
        F.lit(3) + F.aggregate(gaps, F.lit(0), lambda acc, g: acc + g))
    d = d.select(*keep, *BASE[:4], covered.cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    return d.select("*", failed.alias("base_failed"))


def host_rates(scored: DataFrame, host: str = "source") -> DataFrame:
    """(host, n_docs, n_failed, rate, shrunk_rate): failure rates with an empirical beta prior.

    Prior by moments over all hosts: mean m = failures / documents, v = variance of the
    hosts' rates weighted by documents, less the binomial part m(1-m)/n the hosts' sizes
    explain; strength s = m(1-m)/v - 1. Without extra variance the prior pools all hosts
    (strength = all documents). One row per host after a partially aggregated grouping;
    a hot host is one row per map task.
    """
    by = (scored.filter(F.col(f"`{host}`").isNotNull()).groupBy(F.col(f"`{host}`").alias("host"))
          .agg(F.count(F.lit(1)).alias("n_docs"), F.sum(F.col("base_failed").cast("long")).alias("n_failed")))
    n, f = F.col("n_docs").cast("double"), F.col("n_failed").cast("double")
    tot = by.agg(F.sum(n).alias("tn"), F.sum(f).alias("tf"), F.count(F.lit(1)).cast("double").alias("th"),
                 F.sum(f * f / n).alias("tr"))
    m = F.col("tf") / F.col("tn")
    tot = tot.select("tn", m.alias("m"), (F.col("tr") / F.col("tn") - m * m - m * (1 - m) * F.col("th") / F.col("tn")).alias("v"))
    tot = tot.select("m", F.when(F.col("v") > 1e-12, F.least(F.greatest(F.col("m") * (1 - F.col("m")) / F.col("v") - 1, F.lit(1.0)), F.col("tn")))
                     .otherwise(F.col("tn")).alias("s"))
    return (by.join(F.broadcast(tot))  # one row: the prior
            .select("host", "n_docs", "n_failed", (f / n).alias("rate"),
                    ((f + F.col("m") * F.col("s")) / (n + F.col("s"))).alias("shrunk_rate")))


def with_verdict(scored: DataFrame, rejected: DataFrame, host: str = "source") -> DataFrame:
    """`scored` plus kept: false when the document failed or its host is in `rejected` (host)."""
    bad = maybe_broadcast(rejected, BROADCAST_HOSTS).select(F.col("host").alias("__host"), F.lit(True).alias("__bad"))
    return (scored.join(bad, F.col(f"`{host}`") == F.col("__host"), "left")
            .withColumn("kept", ~F.col("base_failed") & F.col("__bad").isNull()).drop("__host", "__bad"))


def host_quality(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source",
                 reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """One row per document: doc_id, host, the base counts, base_failed, kept. Texts are read once."""
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{host}`").alias("source"), F.col(f"`{text}`").alias("text"))
    scored = checkpointed(base_counts(narrow).drop("text"))
    rejected = checkpointed(host_rates(scored).filter(F.col("shrunk_rate") >= reject_rate).select("host"))
    return with_verdict(scored, rejected)


def keep_documents(docs: DataFrame, reject_rate: float = HOST_REJECT_RATE) -> DataFrame:
    """The rows of `docs` (doc_id, text, source, ...) that the rules keep, with the same columns.

    Two passes over the texts (rates, then the filter) instead of shuffling them."""
    rates = host_rates(base_counts(docs.select("source", "text")).select("source", "base_failed"))
    rejected = maybe_broadcast(checkpointed(rates.filter(F.col("shrunk_rate") >= reject_rate).select("host")), BROADCAST_HOSTS)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__row")
    good = docs.join(rejected.select(F.col("host").alias("__host")), F.col("source") == F.col("__host"), "left_anti")
    scored = base_counts(good.select(row, "source", "text"))
    # a filter would be pushed down through the staged projections, which writes every stage's expression out
    # again wherever it is read; exploding one element or none drops the same rows where they are
    one = F.when(F.col("base_failed"), F.array().cast("array<boolean>")).otherwise(F.array(F.lit(True)))
    return scored.select("__row", F.explode(one)).select("__row.*")
