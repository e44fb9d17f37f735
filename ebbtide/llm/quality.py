"""Quality by weak supervision (operator 6), in DataFrame functions only.

Each rule looks at a document's counts and votes for (1) or against (-1) it, or abstains (0). How far each
vote can be trusted is estimated without labels: expectation-maximisation over the table of vote patterns (at
most 3 ** rules rows whatever the corpus) finds the share of good documents, and how often good and bad ones
draw each vote, under which the observed votes are likeliest. A document's verdict is its posterior
probability of being good.

Counts are taken over whole texts. Words are runs of anything but ASCII white space; a word counts as
repeated if it lies in a window of five words that the text holds twice or more (windows are compared by a
64-bit hash within one text).

Defined results: a null or blank text has no words and fails the base rule; a null ``doc_id`` is kept;
repeated rows give repeated rows; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ebbtide.llm.store import stored

WINDOW = 5
EM_ROUNDS = 15
PRIOR_RANGE = (0.05, 0.95)
START_PRIOR = 0.8
START_FAULTS = (0.005, 0.2)  # first guess: a rule's share of -1 among its votes on good and on bad documents
MAX_FAULTS_OF_GOOD, MIN_FAULTS_OF_BAD = 0.01, 0.05  # what makes the two classes good and bad ones
SMOOTHING = 0.005  # weight of the first guess in every round, as a share of all documents
_SPACE = "[\\x20\\x09-\\x0D]+"
_WORD = "[^\\x20\\x09-\\x0D]"


def _occurrences(text: Column, symbols: str) -> Column:
    return F.size(F.split(text, symbols, -1)) - 1


def counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and the counts that the rules use. Each step is a projection of its own, so that an array used
    several times is made once."""
    none = F.array().cast("array<struct<h: bigint, i: int>>")
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    d = d.select("doc_id", "text", F.array_remove(F.split("text", _SPACE, -1), "").alias("words"),
                 F.filter(F.split("text", "\n", -1), lambda line: line.rlike(_WORD)).alias("lines"))
    d = d.select(
        "doc_id", F.size("words").cast("long").alias("n_words"), F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        _occurrences(F.col("text"), "[#*$%&|<>]").cast("long").alias("n_symbols"),
        F.size("lines").cast("long").alias("n_lines"), (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _occurrences(F.col("text"), "[0-9]").cast("long").alias("n_digits"), _occurrences(F.col("text"), "[A-Z]").cast("long").alias("n_capitals"),
        F.size(F.array_distinct("words")).cast("long").alias("n_distinct"), F.transform("words", lambda w: F.xxhash64(w)).alias("h"))
    numbers = [c for c in d.columns if c != "h"]
    n = F.size("h") - (WINDOW - 1)
    shifted = [F.slice("h", i + 1, F.greatest(n, F.lit(0))).alias(f"w{i}") for i in range(WINDOW)]
    d = d.select(*numbers, F.transform(F.arrays_zip(*shifted), lambda x: F.xxhash64(*[x[f"w{i}"] for i in range(WINDOW)])).alias("windows"))
    # texts without a repeated window (most of them) skip the sort
    d = d.select(*numbers, F.when(F.size(F.array_distinct("windows")) < F.size("windows"), F.sort_array(
        F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).otherwise(none).alias("s"))
    d = d.select(*numbers, F.col("s.h").alias("h"), F.col("s.i").alias("i"))
    nothing = F.array(F.lit(None).cast("bigint"))
    last = F.greatest(F.size("h") - 1, F.lit(0))
    d = d.select(*numbers, F.arrays_zip(F.col("h").alias("h"), F.col("i").alias("i"), F.concat(nothing, F.slice("h", 1, last)).alias("before"),
                                        F.concat(F.slice("h", 2, last), nothing).alias("after")).alias("z"))
    d = d.select(*numbers, F.sort_array(F.transform(F.filter("z", lambda x: (x["h"] == x["before"]) | (x["h"] == x["after"])), lambda x: x["i"])).alias("p"))
    rest = F.greatest(F.size("p") - 1, F.lit(0))
    gaps = F.zip_with(F.slice("p", 2, rest), F.slice("p", 1, rest), lambda b, a: F.least(b - a, F.lit(WINDOW)))
    covered = F.aggregate(gaps, F.lit(0).cast("long"), lambda t, g: t + g) + WINDOW
    return d.select(*numbers, F.when(F.size("p") > 0, covered).otherwise(F.lit(0)).cast("long").alias("n_repeat_words"))


def votes() -> dict[str, Column]:
    """The rules over the counts: 1 speaks for the document, -1 against it, 0 abstains."""
    words, chars = F.col("n_words"), F.greatest(F.col("word_chars"), F.lit(1))
    mean = F.col("word_chars") / F.greatest(words, F.lit(1))

    def vote(good: Column, bad: Column) -> Column:
        return F.when(bad, -1).when(good, 1).otherwise(0).cast("tinyint")

    def share(count: str, of: Column, good: float, bad: float) -> Column:
        return vote(F.col(count) <= of * good, F.col(count) > of * bad)

    def where(enough: Column, then: Column) -> Column:
        return F.when(enough, then).otherwise(F.lit(0).cast("tinyint"))

    return {
        "vote_words": vote(words >= 50, words < 10),
        "vote_word_length": where(words >= 10, vote(mean.between(3, 15), (mean < 2) | (mean > 40))),
        "vote_symbols": share("n_symbols", words, 0.05, 0.3),
        "vote_lines": where(F.col("n_lines") >= 4, share("n_dup_lines", F.col("n_lines"), 0.1, 0.5)),
        "vote_repeats": where(words >= 10, share("n_repeat_words", words, 0.1, 0.2)),
        "vote_digits": where(chars >= 100, share("n_digits", chars, 0.1, 0.4)),
        "vote_capitals": where(chars >= 100, share("n_capitals", chars, 0.15, 0.5)),
        "vote_variety": where(words >= 20, vote(F.col("n_distinct") >= words * 0.3, F.col("n_distinct") < words * 0.05)),
    }


Model = tuple[dict[str, tuple[float, float]], float]  # per rule: share of -1 among its votes on good and on bad ones; prior


def posterior(model: Model) -> Column:
    """Probability that a document is good, given its votes (columns). An abstention says nothing."""
    faults, prior = model
    total = F.lit(math.log(prior / (1 - prior)))
    for name, (good, bad) in faults.items():
        total = total + F.when(F.col(name) == -1, math.log(good / bad)).when(F.col(name) == 1, math.log((1 - good) / (1 - bad))).otherwise(0.0)
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-total))


def estimate(voted: DataFrame, names: list[str], rounds: int = EM_ROUNDS) -> Model:
    """How often each rule faults good and bad documents, and the share of good ones, by
    expectation-maximisation.

    The corpus enters as its vote patterns with their counts; each round is one aggregation over that table
    and brings back four numbers per rule.
    """
    patterns = stored(voted.groupBy(*names).agg(F.count(F.lit(1)).alias("n")).coalesce(1), "vote-patterns")
    model: Model = {c: START_FAULTS for c in names}, START_PRIOR
    for _ in range(rounds):
        p = patterns.withColumn("good", F.col("n") * posterior(model)).withColumn("bad", F.col("n") - F.col("good"))
        sums = [F.sum(F.when(F.col(c) == -1, F.col(k)).otherwise(0.0)).alias(f"{k}_fault_{c}") for c in names for k in ("good", "bad")]
        cast = [F.sum(F.when(F.col(c) != 0, F.col(k)).otherwise(0.0)).alias(f"{k}_{c}") for c in names for k in ("good", "bad")]
        row = p.agg(F.sum("good").alias("good"), F.sum("bad").alias("bad"), *sums, *cast).first()
        if row["good"] is None:
            break
        weight = SMOOTHING * (row["good"] + row["bad"]) + 1e-9  # the first guess counts as so many documents
        found = {}
        for c in names:
            good, bad = ((row[f"{k}_fault_{c}"] + weight * first) / (row[f"{k}_{c}"] + weight) for k, first in zip(("good", "bad"), START_FAULTS))
            found[c] = min(good, MAX_FAULTS_OF_GOOD), max(bad, MIN_FAULTS_OF_BAD)
        prior = min(PRIOR_RANGE[1], max(PRIOR_RANGE[0], row["good"] / (row["good"] + row["bad"])))
        moved = max(abs(found[c][k] - model[0][c][k]) for c in names for k in (0, 1))
        model = found, prior
        if moved < 1e-4:
            break
    return model


def judged(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Counts, votes, base rule, posterior and verdict of every row."""
    rules = votes()
    voted = stored(counts(docs, id_col, text_col).withColumns(rules), "quality-votes")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    model = estimate(voted.where(~failed), list(rules))  # the base rule has decided on the others
    scored = voted.withColumn("posterior", posterior(model)).withColumn("base_failed", failed)
    return scored.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))


def verdicts(docs: DataFrame) -> DataFrame:
    """Query form."""
    return judged(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "posterior")
