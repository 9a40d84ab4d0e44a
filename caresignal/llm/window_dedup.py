"""Line dedup (operator 10): overlapping three-line windows. DataFrame functions only.

Lines without a word are passed over when windows are formed. Each window of three
consecutive worded lines is hashed (two 64-bit hashes of the trimmed lines); windows
found more than once in the whole table keep their first occurrence in (doc_id, text
hash, position) order; the lines that later occurrences cover are merged and removed.

Defined cases: null text stays null with zero lines; texts of fewer than three worded
lines have no window and stay as they are; rows equal in id and text are one document
and get the same result; rows of one id with different texts are documents of their own;
null ids come first.
"""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPACE_CHARS = " \t\n\x0b\x0c\r"
WINDOW = 3


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, th (text hash), ln: [(line index, trimmed line)] of the worded lines."""
    split = F.transform(F.split("text", "\n"), lambda x, i: F.struct(i.alias("i"), F.btrim(x, F.lit(SPACE_CHARS)).alias("x")))
    return docs.filter("text IS NOT NULL").select(
        "doc_id", F.xxhash64("text").alias("th"), F.filter(split, lambda z: z["x"] != "").alias("ln"))


def windows(docs: DataFrame) -> DataFrame:
    """One row per window: doc_id, th, p0, p1, p2 (line indexes), h1, h2."""
    n = F.size("ln") - (WINDOW - 1)
    zipped = F.arrays_zip(F.slice("ln", 1, n).alias("a"), F.slice("ln", 2, n).alias("b"), F.slice("ln", 3, n).alias("c"))
    d = _lines(docs).filter(F.size("ln") >= WINDOW).select("doc_id", "th", F.explode(F.transform(zipped, lambda z: F.struct(
        z["a"]["i"].alias("p0"), z["b"]["i"].alias("p1"), z["c"]["i"].alias("p2"),
        F.xxhash64(z["a"]["x"], z["b"]["x"], z["c"]["x"]).alias("h1"),
        F.xxhash64(F.lit(7), z["c"]["x"], z["a"]["x"], z["b"]["x"]).alias("h2")))).alias("w"))
    return d.select("doc_id", "th", "w.*")


def covered_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, gone): the merged line indexes of each document that later occurrences cover.

    The grouping keeps one row per distinct window and task before its shuffle, so a
    window in a third of all documents costs a row per task; the join back to the
    repeated windows has one row per window on one side, so its hot partitions split.
    """
    w = windows(docs)
    repeated = (w.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("doc_id", "th", "p0")).alias("first"))
                .filter("n > 1").select("h1", "h2", "first"))
    later = w.join(repeated, ["h1", "h2"]).filter(~F.struct("doc_id", "th", "p0").eqNullSafe(F.col("first")))
    return (later.select("doc_id", "th", F.explode(F.array("p0", "p1", "p2")).alias("p"))
            .groupBy("doc_id", "th").agg(F.collect_set("p").alias("gone")))


def remove_repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text",
                   counts: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """All rows and columns of `docs` with the text cleaned, plus the numbers of lines and of removed lines (long)
    under the names in `counts`, which replace columns of that name."""
    cols = [c for c in docs.columns if c not in counts]
    narrow = docs.select(F.col(f"`{doc_id}`").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    g = covered_lines(narrow).select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.col("gone").alias("__gone"))
    d = docs.select(*[F.col(f"`{c}`") for c in cols], F.xxhash64(f"`{text}`").alias("__h"))
    j = d.join(g, F.col(f"`{doc_id}`").eqNullSafe(F.col("__id")) & (F.col("__h") == F.col("__th")), "left")
    j = j.withColumn("__l", F.split(f"`{text}`", "\n"))
    stay = F.array_except(F.sequence(F.lit(0), F.size("__l") - 1), F.col("__gone"))
    left = F.transform(stay, lambda i: F.get(F.col("__l"), i))
    cleaned = F.when(F.col("__gone").isNull(), F.col(f"`{text}`")).otherwise(F.array_join(left, "\n"))
    return j.select(*[(cleaned.alias(text) if c == text else F.col(f"`{c}`")) for c in cols],
                    F.coalesce(F.size("__l"), F.lit(0)).cast("long").alias(counts[0]),
                    F.coalesce(F.size("__gone"), F.lit(0)).cast("long").alias(counts[1]))
