"""URL filter (operator 3): allow and block rules, and for the URLs that no
rule fits, logistic regression on hashed character n-grams of host and path.

Both parts are DataFrame expressions and MLlib.  The labelled URL table is
small: URLs whose verdict is known (here: those that a rule fits), about
``SAMPLE`` of them by a hash of the URL.

Null URLs and those without ``://`` have empty host and path, which fit no
rule and go to the model like any other.  Without any labelled URL the model
cannot be fitted and the remaining verdicts are "allow" with score 0.5; with
one class only, that class is the verdict.  Repeated rows are judged each.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendlens.sources.tables import materialize

GRAMS = (3, 4, 5)
BINS = 1 << 14
SAMPLE = 20_000
BLOCK, ALLOW = "block", "allow"


@dataclass(frozen=True)
class Rule:
    """``text`` is a host and the beginning of a path: "example.net/en/"."""

    text: str
    verdict: str

    def fits(self, host: Column, path: Column) -> Column:
        name, _, rest = self.text.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (lower case) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def longest_rule(rules: list[Rule], host: Column, path: Column) -> tuple[Column, Column]:
    """Text and verdict of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: (-len(r.text), r.text))
    pick = lambda what: F.coalesce(*[F.when(r.fits(host, path), F.lit(what(r))) for r in ordered], F.lit(None).cast("string"))
    return pick(lambda r: r.text), pick(lambda r: r.verdict)


def _runs(text: Column, n: int, mark: str) -> Column:
    starts = F.sequence(F.lit(1), F.length(text) - (n - 1))
    # one argument: a second one would get the place in the array
    cut = F.transform(starts, lambda i: F.concat(F.lit(mark), F.substr(text, i, F.lit(n))))
    return F.when(F.length(text) >= n, cut).otherwise(F.array().cast("array<string>"))


def _grams(text: Column, mark: str) -> Column:
    text = F.concat(F.lit("^"), text, F.lit("$"))
    return F.concat(*[_runs(text, n, mark) for n in GRAMS])


def with_features(urls: DataFrame, host: str = "host", path: str = "path") -> DataFrame:
    """Adds ``_features``: counts of hashed n-grams of host and path."""
    grams = F.concat(_grams(F.col(host), "h"), _grams(F.col(path), "p"))
    tf = HashingTF(numFeatures=BINS, inputCol="_grams", outputCol="_features")
    return tf.transform(urls.withColumn("_grams", grams)).drop("_grams")


def fit(labelled: DataFrame, sample: int = SAMPLE) -> LogisticRegressionModel | None:
    """Model of P(block) from (host, path, verdict) rows; None without rows.

    Learned from about ``sample`` distinct URLs, each with its number of rows
    as its weight.  If a verdict is not among them: from at most ``sample`` of
    each verdict, those whose hashes come first."""
    keys = ["host", "path", "verdict"]
    found = {r["verdict"]: r["count"] for r in labelled.select(*keys).distinct().groupBy("verdict").count().collect()}
    if not found:
        return None
    chance = F.pmod(F.xxhash64("host", "path"), F.lit(1 << 20))
    rows = labelled.where(chance < -(-sample * (1 << 20) // sum(found.values()))).groupBy(*keys).count()
    drawn = {r["verdict"] for r in rows.select("verdict").distinct().collect()}
    if drawn != set(found):
        every = labelled.groupBy(*keys).count()
        each = [every.where(F.col("verdict") == v).orderBy(chance, *keys).limit(sample) for v in sorted(found)]
        rows = reduce(DataFrame.union, each)
    rows = rows.select("host", "path", (F.col("verdict") == BLOCK).cast("double").alias("label"),
                       F.col("count").cast("double").alias("weight"))
    train = materialize(with_features(rows).select("_features", "label", "weight"), "labelled-urls")
    return LogisticRegression(featuresCol="_features", labelCol="label", weightCol="weight", maxIter=50, regParam=1e-3).fit(train)


def judge(urls: DataFrame, rules: list[Rule], id_col: str, url_col: str = "url", sample: int = SAMPLE) -> DataFrame:
    """(id, host, path, rule, verdict, score) of every URL; score is the
    model's P(block), also where a rule decides."""
    host, path = split_url(F.col(url_col))
    parts = urls.select(F.col(id_col).alias("id"), host.alias("host"), path.alias("path"))
    rule, verdict = longest_rule(rules, F.col("host"), F.col("path"))
    ruled = parts.select("*", rule.alias("rule"), verdict.alias("ruled"))
    model = fit(ruled.where("rule is not null").withColumnRenamed("ruled", "verdict"), sample)
    if model is None:
        scored = ruled.withColumn("score", F.lit(0.5))
    else:
        model.setProbabilityCol("_p").setRawPredictionCol("").setPredictionCol("")
        scored = model.transform(with_features(ruled)).withColumn(
            "score", F.element_at(vector_to_array("_p"), 2) if model.numClasses == 2 else F.lit(0.0))
    said = F.when(F.col("score") > 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(F.col("id").alias(id_col), "host", "path", "rule", F.coalesce("ruled", said).alias("verdict"), "score")
