"""URL filter: rules first, then host word segmentation and naive Bayes.

Concatenated names are split into words by a Viterbi search under a unigram
model, then multinomial naive Bayes weighs the words of host and path. Both
learn from all urls of a table: names are counted, names that other words spell
leave the unigrams, every distinct name is split, and the classes are counted
over the split words. No url carries a label, so the blocked class starts from
the seed words below: a url is of it if one of its split words is a seed, and
the words that stand beside the seeds get their weights from there.

Scale: each distinct name is split once. Its substrings look up their costs in
a join, so no process holds the vocabulary; a name's own edges, bounded by its
length, are all that a search sees. Weights are whole millionths, so that sums
agree in any order. Names that stand in a third of the urls are combined
map-side when counted, and joined as the many-row side that AQE may split.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, ascii_lower

#: Letters of a word at most. Longer names are split like any other, and are no word themselves.
MAX_WORD_CHARS = 32
SMOOTHING = 0.5
MICRO = 1_000_000

# Seed words of the two classes.
BLOCK_WORDS = "casino poker bet bets betting jackpot slots roulette lottery pills viagra cialis pharma adult porn xxx sex escort nude spam scam phishing malware warez crack keygen torrent cheap replica payday loans ads tracker clickbait".split()
ALLOW_WORDS = "news school university library museum science research health weather travel recipe garden music history sport book art blog forum wiki docs help support about contact".split()


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


@dataclass(frozen=True)
class Model:
    words: DataFrame  # word, cost (null: not for the search), weight in millionths
    prior: float
    unknown: float


def host_of(url: Column) -> Column:
    return ascii_lower(F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://([^/?#]*)", 1))


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), "(?s)://[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The index of the longest rule that fits, the first of equals; null if none does."""
    order = sorted(range(len(rules)), key=lambda i: (-len(rules[i].name), i))
    fits = [F.when(((host == rules[i].host) | host.endswith("." + rules[i].host)) & path.startswith(rules[i].path), F.lit(i)) for i in order]
    return F.coalesce(*fits) if fits else F.lit(None).cast("int")


def split_words(name: str, cost: dict[tuple[int, int], float], unknown: float) -> list[str]:
    """Viterbi over the known pieces (at, end) -> cost; an unknown piece costs ``unknown`` and a third as much again for each letter beyond the first."""
    n = len(name)
    best, back = [0.0] + [math.inf] * n, [0] * (n + 1)
    for end in range(1, n + 1):
        for at in range(max(0, end - MAX_WORD_CHARS), end):
            c = cost.get((at, end))
            c = best[at] + (c if c is not None else unknown * (1 + 0.35 * (end - at - 1)))
            if c < best[end]:
                best[end], back[end] = c, at
    out = []
    while n:
        out.append(name[back[n] : n])
        n = back[n]
    return out[::-1]


def names_of(host: Column, path: Column) -> Column:
    return F.regexp_extract_all(F.concat_ws(" ", host, ascii_lower(path)), F.lit("[a-z]+"), F.lit(0))


def segmented(names: DataFrame, words: DataFrame, unknown: float, itself: bool = True) -> DataFrame:
    """(name, words) of every name; words has word, cost. Without ``itself`` a name is not taken as one of its own words."""
    n = F.length("name")
    ends = lambda at: F.sequence(at + 1, F.least(n, at + MAX_WORD_CHARS))
    pieces = F.flatten(F.transform(F.sequence(F.lit(0), n - 1), lambda at: F.transform(ends(at), lambda end: F.struct(at.alias("at"), end.alias("end")))))
    rows = names.select("name", F.explode(pieces).alias("p")).select("name", "p.at", "p.end", F.expr("substring(name, p.at + 1, p.end - p.at)").alias("word"))
    known = rows.join(words.where("cost is not null").select("word", "cost"), "word")
    if not itself:
        known = known.where("word <> name")
    edges = known.groupBy("name").agg(F.collect_list(F.struct("at", "end", "cost")).alias("edges"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            got = [split_words(x.as_py(), {(e["at"], e["end"]): e["cost"] for e in own.as_py() or ()}, unknown) for x, own in zip(b.column(0), b.column(1), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(got, pa.list_(pa.string()))], names=["name", "words"])

    return names.select("name").join(edges, "name", "left").select("name", "edges").mapInArrow(run, "name string, words array<string>")


def _strings(values: Sequence[str]) -> Column:
    return F.array(*[F.lit(v) for v in values])


def train(pages: DataFrame, url_col: str = "url") -> Model:
    """Learns from all urls of ``pages``; only sums reach the driver.

    A null url, or one without ``://``, has no name. Repeated rows count each.
    An empty table leaves the seed words alone. Other columns are not read.
    """
    spark, scratch = pages.sparkSession, Scratch(pages.sparkSession, "urls")
    own = pages.select(F.monotonically_increasing_id().alias("rid"), names_of(host_of(F.col(url_col)), path_of(F.col(url_col))).alias("names"))
    rows = scratch.write(own, "rows")
    tokens = rows.select("rid", F.explode("names").alias("name"))
    names = scratch.write(tokens.groupBy("name").agg(F.count("*").alias("n")), "names")
    total = names.agg(F.sum("n")).first()[0] or 0
    floor, seeds = max(2, total // 2000), [*BLOCK_WORDS, *ALLOW_WORDS]
    planted = spark.createDataFrame([(w, floor) for w in seeds], "name string, n bigint")
    counts = names.union(planted).groupBy("name").agg(F.sum("n").alias("n")).where(F.length("name") <= MAX_WORD_CHARS)
    total, unknown = total + floor * len(seeds), math.log(total + floor * len(seeds)) + 3
    first = scratch.write(counts.select(F.col("name").alias("word"), (-F.log(F.col("n") / float(total))).alias("cost")), "first")
    # A name that words of three letters or more spell, a seed among them, is no word itself.
    spelt = segmented(names.where((F.length("name") >= 6) & ~F.col("name").isin(seeds)), first, unknown, itself=False)
    parts = spelt.where((F.size("words") > 1) & F.forall("words", lambda w: F.length(w) >= 3) & F.arrays_overlap("words", _strings(seeds)))
    parts = parts.select("name", "words", F.explode("words").alias("word")).join(first.select("word"), "word", "left_semi").groupBy("name", "words").agg(F.count("*").alias("known"))
    compound = scratch.write(parts.where(F.col("known") == F.size("words")).select(F.col("name").alias("word")), "compound")
    unigrams = scratch.write(first.join(compound, "word", "left_anti"), "unigrams")
    split = scratch.write(segmented(names, unigrams, unknown), "split")
    seeded = split.where(F.arrays_overlap("words", _strings(BLOCK_WORDS))).select("name")
    bad = scratch.write(tokens.join(seeded, "name", "left_semi").select("rid").distinct(), "bad")
    beside = tokens.join(bad, "rid", "left_semi").groupBy("name").agg(F.count("*").alias("bad"))
    by_name = names.join(beside, "name", "left").select("name", F.coalesce("bad", F.lit(0)).alias("bad"), (F.col("n") - F.coalesce("bad", F.lit(0))).alias("good"))
    by_word = by_name.join(split, "name").select(F.explode("words").alias("word"), "bad", "good")
    given = spark.createDataFrame([(w, floor * (w in BLOCK_WORDS), floor * (w not in BLOCK_WORDS)) for w in seeds], "word string, bad bigint, good bigint")
    classes = scratch.write(by_word.union(given).groupBy("word").agg(F.sum("bad").alias("bad"), F.sum("good").alias("good")), "classes")
    sums = classes.agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"), F.count("*").alias("kinds")).first()
    log = lambda c: F.log((F.col(c) + SMOOTHING) / float(sums[c] + SMOOTHING * sums["kinds"]))
    weights = classes.select("word", F.round((log("bad") - log("good")) * MICRO).cast("bigint").alias("weight"))
    words = scratch.write(weights.join(unigrams, "word", "full_outer").select("word", "cost", F.coalesce("weight", F.lit(0)).alias("weight")), "words")
    share = min(0.5, max(0.01, bad.count() / max(1, rows.count())))
    return Model(words, math.log(share / (1 - share)), unknown)


def judge(pages: DataFrame, rules: Sequence[Rule], model: Model, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row for each row of ``pages``: page_id, host, path, rule, verdict, score.

    A rule's verdict holds where one fits; elsewhere the score (probability of
    the blocked class, given for all) decides at one half. A null url, or one
    without ``://``, has empty host and path and so gets the prior: allow. Names
    of any length are split whole. Repeated rows give repeated rows, an empty
    table an empty result; other columns are not read.
    """
    scratch = Scratch(pages.sparkSession, "judge")
    rows = pages.select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("page_id"), host_of(F.col(url_col)).alias("host"), path_of(F.col(url_col)).alias("path"))
    rows = scratch.write(rows, "rows")
    tokens = rows.select("rid", F.explode(names_of(F.col("host"), F.col("path"))).alias("name"))
    split = segmented(tokens.select("name").distinct(), model.words, model.unknown)
    weighed = split.select("name", F.explode("words").alias("word")).join(model.words.select("word", "weight"), "word").groupBy("name").agg(F.sum("weight").alias("weight"))
    weighed = scratch.write(weighed, "weighed")
    sums = tokens.join(weighed, "name").groupBy("rid").agg(F.sum("weight").alias("weight"))
    z = F.coalesce(F.col("weight"), F.lit(0)) / float(MICRO) + model.prior
    score = 1 / (1 + F.exp(-F.least(F.lit(30.0), F.greatest(F.lit(-30.0), z))))
    scored = rows.join(sums, "rid", "left").withColumn("score", score).withColumn("at", rule_of(F.col("host"), F.col("path"), rules))
    pick = lambda values: F.coalesce(*[F.when(F.col("at") == i, F.lit(v)) for i, v in enumerate(values)], F.lit(None).cast("string"))
    method = F.when(F.col("score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", pick([r.name for r in rules]).alias("rule"), F.coalesce(pick([r.verdict for r in rules]), method).alias("verdict"), "score")
