"""Document quality by hierarchical empirical Bayes.

1. Evidence: shape features of each text go into a logistic regression on the labelled training documents.
2. Sites: labelled counts are aggregated by host and by path below it. Beta priors are fitted by moments: hosts vary
   around the global rate, paths around their host. Sparse hosts shrink to the global rate, sparse paths to their host.
3. The log-odds of a document are its evidence plus what its path's posterior adds to the global log-odds.

Only aggregates (one row a path, with map-side combine) meet the documents again, in a join that Spark broadcasts when
they are few and whose skewed partitions it splits otherwise.
"""

from __future__ import annotations

import math
from operator import eq

import numpy as np
import pandas as pd
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import ArrayType, DoubleType

from demandloom.llm.shared import binary_labels, broadcast_if_small, held_out, stage

FOLDS = 4
THRESHOLD = 0.5
FEATURES = ("log_words", "capitals", "digits", "marks", "rare_marks", "repeats", "top_word", "line_repeats", "word_length", "glued_marks")
_RARE = np.zeros(256, bool)
_RARE[list(b"|%&$*#=<>{}\\^~@_+[]/!")] = True
_MARKS = np.array([33 <= b < 127 and not chr(b).isalnum() for b in range(256)])


def describe_text(text: str) -> list[float]:
    """Shares between 0 and 1 of what junk has too much of, each as log(0.01 + share); plain values for sizes."""
    raw = text.encode()
    words = raw.split()
    if not words:
        return [0.0] * len(FEATURES)
    counts = np.bincount(np.frombuffer(raw, np.uint8), minlength=256)
    letters = max(1, int(counts[65:91].sum() + counts[97:123].sum()))
    seen: dict[bytes, int] = {}
    for w in words:
        seen[w] = seen.get(w, 0) + 1
    lines = [line for line in raw.splitlines() if line.strip()]
    shares = (
        counts[65:91].sum() / letters, counts[48:58].sum() / len(raw), counts[_MARKS].sum() / len(raw), counts[_RARE].sum() / len(raw),
        sum(map(eq, words, words[1:])) / len(words), max(0.0, max(seen.values()) - 3) / len(words), 1 - len(set(lines)) / max(1, len(lines)),
    )
    glued = sum(not w[-1:].isalnum() and w[-1] < 128 and w[-1:] not in b".,;:?)\"'" for w in words) / len(words)
    logs = [math.log(0.01 + float(s)) for s in shares]
    return [math.log(len(words)), *logs, len(raw) / len(words), math.log(0.01 + glued)]


@pandas_udf(ArrayType(DoubleType()))
def features(texts: pd.Series) -> pd.Series:
    return texts.map(lambda text: describe_text(text or ""))


def fit_evidence(labelled: DataFrame, regularisation: float = 1e-3) -> tuple[list[float], float]:
    """Coefficients and intercept; all zero unless both labels occur."""
    if labelled.select("label").distinct().count() < 2:
        return [0.0] * len(FEATURES), 0.0
    rows = labelled.select(F.col("label").cast("double").alias("label"), array_to_vector("features").alias("features"))
    model = LogisticRegression(maxIter=60, regParam=regularisation).fit(rows)
    return [float(c) for c in model.coefficients], float(model.intercept)


def _strength(groups: DataFrame, expected: Column) -> float:
    """Pseudo-counts of a Beta prior by moments: what groups of (n, good) scatter beyond binomial noise around ``expected``."""
    rate = F.col("good") / F.col("n")
    noise = expected * (1 - expected)
    sums = groups.where("n > 1").agg(F.sum(F.col("n") * (rate - expected) ** 2).alias("scatter"), F.sum(noise).alias("noise"), F.sum(F.col("n") * noise).alias("mass"), F.count("*").alias("groups")).first()
    if not sums["groups"] or not sums["noise"]:
        return 10.0
    # E[n (rate - m)^2] = m (1 - m) (1 + (n - 1) / (strength + 1))
    excess, mass = sums["scatter"] - sums["noise"], sums["mass"] - sums["noise"]
    share = min(max(excess / max(mass, 1e-9), 1e-4), 0.5)  # a prior is worth at least one document
    return 1 / share - 1


def site_posteriors(labelled: DataFrame) -> tuple[DataFrame, float]:
    """Rows (host, path, posterior) and the global rate. Paths without labels are not listed."""
    paths = stage(labelled.groupBy("host", "path").agg(F.count("*").alias("n"), F.sum("label").alias("good")))
    total = paths.agg(F.sum("n").alias("n"), F.sum("good").alias("good")).first()
    rate = ((total["good"] or 0) + 1) / ((total["n"] or 0) + 2)
    hosts = stage(paths.groupBy("host").agg(F.sum("n").alias("n"), F.sum("good").alias("good")))
    host_strength = _strength(hosts, F.lit(rate))
    host_rates = hosts.select("host", ((F.col("good") + rate * host_strength) / (F.col("n") + host_strength)).alias("host_rate"))
    below = stage(paths.join(host_rates, "host"))
    path_strength = _strength(below, F.col("host_rate"))
    posterior = (F.col("good") + F.col("host_rate") * path_strength) / (F.col("n") + path_strength)
    listed = below.select("host", "path", posterior.alias("posterior"))
    whole = host_rates.select("host", F.lit(None).cast("string").alias("path"), F.col("host_rate").alias("posterior"))
    return stage(listed.union(whole)), rate


def _logit(p: Column) -> Column:
    return F.log(p / (1 - p))


def score_quality(docs: DataFrame, labels: DataFrame, host: Column, path: Column, label: str = "quality", folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, score (that the label is 1), predicted, kept (score at least 0.5).

    ``host`` and ``path`` are columns of ``docs``; nulls count as the empty string. An unknown path takes its host's
    posterior, an unknown host the global rate. Null and empty texts have neutral features. Without labels every document
    scores 0.5. Repeated rows are scored alike, other columns are ignored, and an empty table gives no rows.
    """
    shaped = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(host.cast("string"), F.lit("")).alias("host"),
                         F.coalesce(path.cast("string"), F.lit("")).alias("path"), features(F.coalesce(F.col("text"), F.lit(""))).alias("features"))
    shaped = stage(shaped)
    known = binary_labels(labels, label).where(~held_out(F.col("doc_id"), folds))
    labelled = shaped.join(broadcast_if_small(stage(known)), "doc_id")
    coefficients, intercept = fit_evidence(labelled)
    sites, rate = site_posteriors(labelled)
    evidence = F.aggregate(F.zip_with("features", F.array(*[F.lit(c) for c in coefficients]), lambda x, c: x * c), F.lit(intercept), lambda a, b: a + b)
    of_path = sites.where("path IS NOT NULL")
    of_host = sites.where("path IS NULL").select("host", F.col("posterior").alias("host_posterior"))
    placed = shaped.join(of_path, ["host", "path"], "left").join(of_host, "host", "left")
    site = F.coalesce("posterior", "host_posterior", F.lit(rate))
    odds = evidence + _logit(site) - _logit(F.lit(rate))
    score = 1 / (1 + F.exp(-odds))
    scored = placed.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), score.alias("score"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), (F.col("score") >= THRESHOLD).alias("kept"))
