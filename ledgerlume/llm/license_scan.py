"""License scans in DataFrame functions only.

Licence templates are cut into shingles of five words. Windows as long as a template slide over a
text wherever one of the templates' marker words stands; MinHash bands of a window's shingles
retrieve templates from a small table, and exact shingle containment decides. Every shingle of every
template holds a marker word, so a window without one shares no shingle with any template and is
left out without loss; the marker words are computed from the templates, not chosen by hand.

With BANDS bands of one row each, a window and a template with Jaccard similarity s meet with
probability 1 - (1 - s) ** BANDS: above 1 - 1e-14 at s = 0.8.

A match needs THRESHOLD of a piece's shingles within the window, and THRESHOLD of a template's pieces. For a
document and template the best windows count, of equal ones the first.

Defined results: words are lower-case runs of letters and digits (dots between digits stay), so case
and punctuation don't matter; null and empty texts have no matches; texts shorter than a template
are compared as they are; whole texts are scanned; rows repeated with id and text count once;
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .licenses import TEMPLATES

WORDS, THRESHOLD, BANDS = 5, 0.8, 20
#: Templates of more words than LONGEST_WINDOW are cut into pieces of PIECE words, so few lengths of windows are needed.
LONGEST_WINDOW, PIECE = 48, 32

# Frequent English words, the last choice as marker words.
COMMON = set("a an and any are as at be by can do for from if in is it may no not of on one or so that the this to was which with you".split())

#: What separates words: anything but letters, digits and dots between digits.
GAP = r"(?:[^\p{L}\p{N}.]|(?<!\p{N})\.|\.(?!\p{N}))+"


def python_words(text: str) -> list[str]:
    """The words of a template, as the Spark expression finds them in texts."""
    return [w for w in re.split(r"(?:[^\w.]|_|(?<!\d)\.|\.(?!\d))+", text.lower()) if w]


def template_pieces(templates: dict[str, str]) -> list[tuple[str, int, list[str]]]:
    """(template, piece number, words): long templates are cut so that windows stay short; the last piece ends with its template."""
    out = []
    for name, text in sorted(templates.items()):
        words = python_words(text)
        if len(words) < WORDS:
            raise ValueError(f"{name} has fewer than {WORDS} words")
        starts = [0] if len(words) <= LONGEST_WINDOW else [*range(0, len(words) - PIECE, PIECE), len(words) - PIECE]
        out += [(name, i, words[a : a + (PIECE if len(starts) > 1 else len(words))]) for i, a in enumerate(starts)]
    return out


def marker_words(pieces: list[tuple[str, int, list[str]]]) -> list[str]:
    """Words such that every shingle of every piece holds at least one.

    Words that are frequent in any English text come only where a shingle has no other.
    """
    left = {tuple(words[i : i + WORDS]) for _, _, words in pieces for i in range(max(1, len(words) - WORDS + 1))}
    found = []
    while left:
        counts = Counter(w for s in left for w in set(s))
        best = max(counts, key=lambda w: (w not in COMMON, counts[w] * min(len(w), 8), w))
        found.append(best)
        left = {s for s in left if best not in s}
    return sorted(found)


def words_of(text: Column) -> Column:
    return F.filter(F.split(F.lower(text), GAP), lambda w: w != "")


def shingles_of(words: Column) -> Column:
    """Distinct shingles of an array of words, as 64-bit hashes; fewer words than five make one shingle."""
    last = F.greatest(F.size(words) - F.lit(WORDS), F.lit(0))
    return F.array_distinct(F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(F.slice(words, i + 1, WORDS))))


def bands_of(shingles: Column) -> Column:
    """One MinHash value per band, with the band's number."""
    one = lambda b: F.struct(F.lit(b).alias("band"), F.array_min(F.transform(shingles, lambda s: F.xxhash64(s, F.lit(b)))).alias("low"))
    return F.array(*[one(b) for b in range(BANDS)])


def template_table(spark: SparkSession, templates: dict[str, str]) -> DataFrame:
    """template, piece, pieces, n_words, t_shingles: a few rows, whatever the corpus."""
    pieces = template_pieces(templates)
    count = Counter(name for name, _, _ in pieces)
    rows = [(name, i, count[name], len(words), words) for name, i, words in pieces]
    table = spark.createDataFrame(rows, "template string, piece int, pieces int, n_words int, words array<string>")
    return table.select("template", "piece", "pieces", "n_words", shingles_of(F.col("words")).alias("t_shingles"))


def windows(docs: DataFrame, templates: dict[str, str]) -> DataFrame:
    """doc_id, at, n_words, shingles: windows around marker words, one length for each template length."""
    pieces = template_pieces(templates)
    lengths = sorted({len(words) for _, _, words in pieces})
    markers = marker_words(pieces)
    near = r"(?i)(?<![\p{L}\p{N}])(?:" + "|".join(map(re.escape, markers)) + r")(?![\p{L}\p{N}])"
    rows = docs.select("doc_id", "text").filter(F.col("text").rlike(near))
    rows = rows.select("doc_id", words_of(F.col("text")).alias("words"))
    marked = F.filter(
        F.transform("words", lambda w, i: F.when(w.isin(*markers), i)), lambda i: i.isNotNull()
    )
    rows = rows.withColumn("marked", marked)
    start = lambda n: F.array_distinct(  # noqa: E731  all starts whose window of n words holds a marker word
        F.flatten(
            F.transform(
                "marked",
                lambda i: F.sequence(
                    F.greatest(F.lit(0), F.least(i - n + 1, F.size("words") - n)), F.greatest(F.lit(0), F.least(i, F.size("words") - n))
                ),
            )
        )
    )
    cut = lambda n: F.transform(start(n), lambda a: F.struct(a.alias("at"), F.lit(n).alias("n_words"), F.slice("words", a + 1, n).alias("window")))
    some = rows.select("doc_id", F.explode(F.flatten(F.array(*[cut(n) for n in lengths]))).alias("w"))
    return some.select("doc_id", "w.at", "w.n_words", shingles_of(F.col("w.window")).alias("shingles"))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES) -> DataFrame:
    """doc_id, template, at (word offset), containment: the best window of each document and template."""
    known = template_table(docs.sparkSession, templates)
    keys = known.select("template", "piece", "pieces", "n_words", "t_shingles", F.inline(bands_of(F.col("t_shingles"))))
    cut = windows(docs, templates)
    # all bands of a window are probed in one row; a window meets a template once however many bands agree
    probes = cut.select("doc_id", "at", "n_words", "shingles", F.explode(bands_of(F.col("shingles"))).alias("key"))
    met = probes.join(
        F.broadcast(keys), (probes["key.band"] == keys["band"]) & (probes["key.low"] == keys["low"]) & (probes["n_words"] == keys["n_words"])
    )
    share = F.size(F.array_intersect("shingles", "t_shingles")) / F.size("t_shingles")
    hits = met.select("doc_id", "template", "piece", "pieces", "at", share.alias("share")).filter(F.col("share") >= THRESHOLD)
    best = hits.groupBy("doc_id", "template", "piece", "pieces").agg(F.max_by(F.struct("share", "at"), F.struct("share", -F.col("at"))).alias("best"))
    whole = best.groupBy("doc_id", "template", "pieces").agg(
        F.count(F.lit(1)).alias("found"), F.min("best.at").alias("at"), F.sum("best.share").alias("shares")
    )
    done = whole.filter(F.col("found") >= F.ceil(THRESHOLD * F.col("pieces")))
    return done.select("doc_id", "template", "at", F.round(F.least(F.lit(1.0), F.col("shares") / F.col("pieces")), 9).alias("containment"))


def op5_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, template, at, containment of every licence notice found in `documents`."""
    return scan(spark.read.parquet(f"{sf_dir}/documents.parquet"))
