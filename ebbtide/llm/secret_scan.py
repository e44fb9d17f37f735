"""Secrets with a random forest for false positives (operator 10), in DataFrame functions only.

Candidates are cut out of each whole text by one pattern: unbroken runs that hold a digit and are long enough
for a key, and values of six or more characters behind a password-like name (quotes, spaces, colons, equals signs
or arrows between them). Each is described by its length, the runs and
transitions of its characters, how much of it dictionary words cover, its path and the words next to it. A
random forest, fitted on labelled findings, gives the probability that a candidate is a secret.

Labelled findings may be given; else they are derived from the candidates: keys in a provider's own format and
random-looking values behind a password-like name are secrets; plain numbers, dates, word-like and placeholder
values are not; the rest has no label. Fitting takes at most ``FIT_PER_LABEL`` findings of each label in
expectation (by hash), equal ones once.

Defined results: a null or blank text has no candidates; a null ``doc_id`` or path is kept; repeated rows
repeat their findings; an empty table gives no rows; where findings of one label only are known there is
nothing to fit, and the label rule decides; other columns are not read.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ebbtide.llm import tokens
from ebbtide.llm.store import stored

FIT_PER_LABEL = 20_000
TREES, DEPTH, SEED = 20, 6, 7
WORD_MIN = 4
CONTEXT = 60
_NAMES = "password|passwd|pwd|secret|token|api[_-]?key|access[_-]?key|auth"
_LINK = "[\\s\"'`:=>]"  # between a name and its value: up to six of them
CANDIDATE = ("(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*+[0-9])[A-Za-z0-9+/_-]{16,}={0,2}"
             f"|(?<={_LINK})(?<=(?i:{_NAMES}){_LINK}{{1,6}})[^\\s\"'`:=>][^\\s\"']{{5,}}")
_PROVIDER = "^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36,}|sk_live_[A-Za-z0-9]{16,}|xox[abp]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35})$"
_PLACEHOLDER = "(?i)(example|sample|changeme|placeholder|dummy|your[_-]|xxxx|test123|123456|abcdef123)"

FEATURES = ("length", "digit_share", "upper_share", "symbol_share", "distinct_share", "run_share", "transition", "coverage", "longest_letters",
            "is_hex", "named", "quoted", "hint_against", "path_test")


def dictionary(spark: SparkSession, vocab: str = tokens.VOCAB_FILE) -> DataFrame:
    """Whole words of a public vocabulary (at most as many as it has entries)."""
    from tokenizers import Tokenizer
    names = Tokenizer.from_file(tokens.vocab_path(vocab)).get_vocab()
    words = sorted({n.removesuffix("</w>") for n in names if n.endswith("</w>")})
    return spark.createDataFrame([(w,) for w in words if len(w) >= WORD_MIN and w.isascii() and w.isalpha()], "word string")


def transitions(words: DataFrame) -> DataFrame:
    """Log-probability of the second letter after the first, in the dictionary (at most 26 x 26 rows)."""
    pairs = words.select(F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1), lambda i: F.substr("word", i, F.lit(2)))).alias("pair"))
    count = pairs.groupBy("pair").agg(F.count(F.lit(1)).alias("n"))
    first = count.groupBy(F.substring("pair", 1, 1).alias("c")).agg(F.sum("n").alias("t"))
    return count.join(F.broadcast(first), F.substring("pair", 1, 1) == F.col("c")).select("pair", F.log(F.col("n") / F.col("t")).alias("logp"))


def candidates(docs: DataFrame, id_col: str, text_col: str, path_col: str) -> DataFrame:
    """doc_id, path, ordinal, value, before and after (text next to it), in the order of the text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    d = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(path_col).cast("string").alias("path"), text.alias("text"))
    d = d.withColumn("values", F.regexp_extract_all("text", F.lit(CANDIDATE), F.lit(0))).where(F.size("values") > 0)
    d = d.withColumn("rest", F.split("text", CANDIDATE, -1)).drop("text")
    d = d.withColumn("before", F.slice("rest", 1, F.size("values"))).withColumn("after", F.slice("rest", 2, F.size("values")))
    found = d.select("doc_id", "path", F.posexplode(F.arrays_zip("values", "before", "after")).alias("ordinal", "x"))
    return found.select("doc_id", "path", F.col("ordinal").cast("long").alias("ordinal"), F.col("x.values").alias("value"),
                        F.right(F.col("x.before"), F.lit(CONTEXT)).alias("before"), F.left(F.col("x.after"), F.lit(CONTEXT)).alias("after"))


def _runs(value: Column) -> Column:
    """Number of runs of lower-case letters, capitals, digits and others."""
    for pattern, to in (("[^a-zA-Z0-9]+", "-"), ("[a-z]+", "a"), ("[A-Z]+", "A"), ("[0-9]+", "0")):
        value = F.regexp_replace(value, pattern, to)
    return F.length(value)


def _share(value: Column, pattern: str) -> Column:
    return F.length(F.regexp_replace(value, pattern, "")) / F.length(value)


def value_features(values: DataFrame, words: DataFrame) -> DataFrame:
    """Features of distinct values: what does not depend on the place where a value stands."""
    spot = F.col("value")
    v = values.select("value", F.length(spot).cast("double").alias("length"), _share(spot, "[^0-9]").alias("digit_share"), _share(spot, "[^A-Z]").alias("upper_share"),
                      _share(spot, "[A-Za-z0-9]").alias("symbol_share"), (F.size(F.array_distinct(F.split(spot, ""))) / F.length(spot)).alias("distinct_share"),
                      (_runs(spot) / F.length(spot)).alias("run_share"), spot.rlike("^[0-9a-f]+$").cast("double").alias("is_hex"),
                      F.array_remove(F.split(F.lower(spot), "[^a-z]+", -1), "").alias("letters"))
    v = v.withColumn("longest_letters", F.coalesce(F.array_max(F.transform("letters", lambda x: F.length(x))), F.lit(0)).cast("double"))
    parts = v.select("value", F.explode("letters").alias("word"))
    # both tables on the right are bounded by the vocabulary, whatever the corpus
    covered = parts.join(F.broadcast(words), "word").groupBy("value").agg(F.sum(F.length("word")).alias("in_words"))
    pairs = parts.where(F.length("word") > 1).select("value", F.explode(F.transform(F.sequence(F.lit(1), F.length("word") - 1),
                                                                                   lambda i: F.substr("word", i, F.lit(2)))).alias("pair"))
    steps = pairs.join(F.broadcast(transitions(words)), "pair", "left").groupBy("value").agg(F.avg(F.coalesce("logp", F.lit(-10.0))).alias("transition"))
    v = v.drop("letters").join(covered, "value", "left").join(steps, "value", "left")
    return v.withColumn("coverage", F.coalesce(F.col("in_words") / F.col("length"), F.lit(0.0))).withColumn("transition", F.coalesce("transition", F.lit(-10.0))).drop("in_words")


def described(found: DataFrame, values: DataFrame) -> DataFrame:
    """Findings with all features. A value that very many documents share is split by the skewed-join rule."""
    return found.join(values, "value").withColumns({
        "named": F.col("before").rlike(f"(?i)({_NAMES})\\W{{0,6}}$").cast("double"), "quoted": F.col("before").rlike("[\"']$").cast("double"),
        "hint_against": (F.col("before").rlike("(?i)\\b(sha1|sha256|md5|commit|checksum|uuid|isbn|order|invoice|id|phone|card)\\W{0,3}$")
                         | F.col("value").rlike(_PLACEHOLDER)).cast("double"),
        "path_test": F.coalesce(F.col("path"), F.lit("")).rlike("(?i)(test|example|sample|fixture|doc)").cast("double")})


def label() -> Column:
    """1 for findings that are surely secrets, 0 for surely not, else null."""
    value = F.col("value")
    random = (F.col("coverage") < 0.3) & (F.col("digit_share") > 0.1) & (F.col("distinct_share") > 0.2)
    return (F.when(value.rlike(_PLACEHOLDER), 0).when(value.rlike(_PROVIDER), 1).when((F.col("named") == 1) & random, 1)
            .when(F.col("digit_share") + F.col("symbol_share") >= 0.999, 0).when(F.col("coverage") >= 0.6, 0)
            .when((F.col("longest_letters") >= 12) & (F.col("digit_share") < 0.2), 0).cast("double"))


def fit(labelled: DataFrame, per_label: int = FIT_PER_LABEL):
    """Random forest over labelled findings (``label`` and the features), or None where a label is missing."""
    distinct = labelled.where("label is not null").groupBy("label", *FEATURES).agg(F.min("value").alias("value"))
    n = {r["label"]: r["count"] for r in distinct.groupBy("label").count().collect()}  # two numbers
    if len(n) < 2:
        return None
    rate = F.when(F.col("label") == 1, per_label / n[1.0]).otherwise(per_label / n[0.0])
    sample = distinct.where(F.pmod(F.xxhash64("value"), F.lit(1 << 20)) < rate * (1 << 20))
    total = sum(min(per_label, x) for x in n.values())
    weight = F.when(F.col("label") == 1, total / (2.0 * min(per_label, n[1.0]))).otherwise(total / (2.0 * min(per_label, n[0.0])))
    rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(sample.withColumn("weight", weight))
    forest = RandomForestClassifier(numTrees=TREES, maxDepth=DEPTH, seed=SEED, weightCol="weight", labelCol="label", featuresCol="features")
    return forest.fit(stored(rows.select("label", "weight", "features"), "secret-fit"))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path_col: str = "source", labelled: DataFrame | None = None,
         threshold: float = 0.5) -> DataFrame:
    """One row per finding: doc_id, ordinal, path, value, before, after, features, probability, secret."""
    spark = docs.sparkSession
    found = stored(candidates(docs, id_col, text_col, path_col), "secret-candidates")
    values = stored(value_features(found.select("value").distinct(), dictionary(spark)), "secret-values")
    rows = described(found, values).withColumn("label", label())
    model = fit(rows if labelled is None else labelled)
    if model is None:
        scored = rows.withColumn("probability", F.coalesce("label", F.lit(0.0)))  # only what the rule calls a secret is one
    else:
        rows = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows)
        scored = model.transform(rows).withColumn("chance", vector_to_array("probability")[1]).drop("features", "rawPrediction", "probability", "prediction")
        scored = scored.withColumnRenamed("chance", "probability")
    return scored.withColumn("secret", F.col("probability") >= threshold)


def findings(docs: DataFrame) -> DataFrame:
    """Query form: every candidate with its verdict; the value itself as a digest only."""
    return scan(docs).select("doc_id", "ordinal", F.sha2("value", 256).alias("value_sha256"), F.length("value").cast("long").alias("length"),
                             F.round("probability", 6).alias("probability"), "secret")
