"""Quality classifier (operator 4): tree paths as conjunctive rules over text statistics, lasso logistic weights, column expressions."""

from __future__ import annotations

import functools
import math
import operator
import re
from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paymatch.plans.runtime import stage

#: Characters and word shapes that are counted.
UPPER, DIGITS, SHOUT, SYMBOLS, STOPS = "[A-Z]", "[0-9]", "[!?]", r"[#$%&*|<>{}\[\]^~=+_\\/@]", "[.,;:]"
LONG, MARKED = r"[^\x20\x09-\x0D]{21,}", r"[!-+\-/<-@\[-`{-~](?=[\x20\x09-\x0D]|\z)"
PREFIX = "_stat_"


def held_out(doc_id: str = "doc_id") -> Column:
    """Rows whose labels are never learnt from."""
    return F.coalesce(F.crc32(F.encode(F.col(doc_id).cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


def with_statistics(docs: DataFrame, text: str = "text") -> tuple[DataFrame, list[str]]:
    """Rows `doc`, a struct of the columns of `docs` whatever their names, with statistics of the text alone, as doubles without nulls; the names of these."""
    t = F.col("_text")
    count = lambda pattern: F.regexp_count(t, F.lit(pattern))
    df = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("doc"), F.coalesce(F.col(text), F.lit("")).alias("_text"))
    df = df.withColumns({"_words": F.filter(F.split(t, r"[\x20\x09-\x0D]+"), lambda w: w != ""), "_lines": F.filter(F.split(t, "\n"), lambda x: x != "")})
    words, lines = F.size("_words"), F.size("_lines")
    over = lambda a, b: a / F.greatest(b, F.lit(1))
    stats = {
        "chars": F.log1p(F.length(t)), "words": F.log1p(words), "word_chars": over(F.length(t), words), "line_words": over(words, lines),
        "upper": over(count(UPPER), F.length(t)), "digits": over(count(DIGITS), F.length(t)), "shout": over(count(SHOUT), words),
        "symbols": over(count(SYMBOLS), F.length(t)), "stops": over(count(STOPS), words),
        "distinct_words": over(F.size(F.array_distinct("_words")), words), "distinct_lines": over(F.size(F.array_distinct("_lines")), lines),
        "long_words": over(count(LONG), words),
        "short_words": over(F.size(F.filter("_words", lambda w: F.length(w) <= 3)), words),
        "marked_words": over(count(MARKED), words),
    }
    return df.withColumns({PREFIX + k: v.cast("double") for k, v in stats.items()}).drop("_text", "_words", "_lines"), [PREFIX + k for k in stats]


_STEP = re.compile(r"^( *)(If|Else) \(feature (\d+) (<=|>) (\S+)\)")


def tree_rules(description: str) -> list[frozenset]:
    """All paths of a described tree, to leaves and to inner nodes, as sets of (feature, comparison, threshold)."""
    rules, path = [], []
    for line in description.splitlines():
        step = _STEP.match(line)
        if step:
            depth = len(step[1])
            path = [p for p in path if p[0] < depth] + [(depth, (int(step[3]), step[4], float(step[5])))]
            rules.append(frozenset(p[1] for p in path))
    return rules


@dataclass(frozen=True)
class RuleEnsemble:
    """Weighted conjunctions over statistics; the score is the logistic function of bias plus the weights of the rules that hold."""

    bias: float
    rules: tuple[tuple[float, tuple[tuple[str, str, float], ...]], ...]

    def score(self) -> Column:
        held = [F.when(conjunction(rule), F.lit(weight)).otherwise(F.lit(0.0)) for weight, rule in self.rules]
        return 1.0 / (1.0 + F.exp(-functools.reduce(operator.add, held, F.lit(self.bias))))


def conjunction(rule) -> Column:
    return functools.reduce(operator.and_, (F.col(c) <= F.lit(v) if op == "<=" else F.col(c) > F.lit(v) for c, op, v in rule))


def fit(docs: DataFrame, labels: DataFrame, sample_rows: int = 20_000, trees: int = 24, depth: int = 3, lasso: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """Learns from at most `sample_rows` labelled rows (the smallest by hash of the id, so the bound is proven and the choice
    repeatable) that are not held out.  Without both labels the score is their common value, without any it is one half."""
    known = (labels.where("quality is not null and doc_id is not null").where(~held_out()).groupBy("doc_id").agg(F.max("quality").alias("_label"))
             .orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_rows))
    rows = docs.select("doc_id", "text").join(F.broadcast(known.withColumnRenamed("doc_id", "_id")), F.col("doc_id") == F.col("_id"))
    rows, names = with_statistics(rows)
    rows = stage(rows.select(F.col("doc._label").cast("double").alias("_label"), *names))
    shares = {r[0]: r[1] for r in rows.groupBy("_label").count().collect()}
    if len(shares) < 2:
        share = next(iter(shares), 0.5)
        return RuleEnsemble(math.log((share + 1e-6) / (1 - share + 1e-6)), ())
    assembled = VectorAssembler(inputCols=names, outputCol="_x").transform(rows)
    forest = RandomForestClassifier(labelCol="_label", featuresCol="_x", numTrees=trees, maxDepth=depth, seed=seed).fit(assembled)
    found = dict.fromkeys(rule for tree in forest.trees for rule in tree_rules(tree.toDebugString))
    rules = [tuple(sorted((names[f], op, v) for f, op, v in rule)) for rule in found]
    held = rows.select("_label", *(F.when(conjunction(rule), 1.0).otherwise(0.0).alias(f"r{i}") for i, rule in enumerate(rules)))
    held = stage(VectorAssembler(inputCols=[f"r{i}" for i in range(len(rules))], outputCol="_x").transform(held).select("_label", "_x"))
    model = LogisticRegression(labelCol="_label", featuresCol="_x", elasticNetParam=1.0, regParam=lasso, maxIter=60, standardization=False).fit(held)
    return RuleEnsemble(float(model.intercept), tuple((float(w), rules[i]) for i, w in enumerate(model.coefficients.toArray()) if w))


def classify(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """Rows (doc_id, held_out, score, predicted), one for each row of `docs` (doc_id, text).

    `labels` (doc_id, quality) teaches: rows whose crc32(doc_id as text) mod 3 is 1 are held out and never learnt from; other
    columns than the text are no inputs.  A null text is scored as the empty text; a null doc_id is not held out; repeated rows
    get a row each; labels without a document, and several for one (the larger holds), do no harm; an empty table gives no rows.
    """
    scored = with_statistics(docs.select("doc_id", "text"))[0].withColumn("score", fit(docs, labels, **settings).score())
    return scored.select("doc.doc_id", held_out("doc.doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, **settings) -> DataFrame:
    """The rows of `docs` whose predicted quality is 1, all columns kept."""
    scored = with_statistics(docs)[0].where(fit(docs, labels, **settings).score() >= 0.5)
    return scored.select(*(F.col(f"doc.`{c}`") for c in docs.columns))
