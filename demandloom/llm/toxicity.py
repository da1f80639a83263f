"""Toxic passages as maximal scoring segments of token log-odds.

1. Document counts of each token in the toxic and the clean labelled documents give log-odds with an informative Dirichlet prior
   (the prior of a token is its overall frequency), kept where the z-score is large.
2. A document is a sequence of token scores; every maximal scoring segment is found in one linear scan
   (all segments whose sum no extension or shortening improves).
3. Log-odds scores have the extreme-value parameter 1, so a segment of sum S in n tokens has an expected number
   K * n * exp(-S) of better ones by chance. K comes from the clean training documents. The segments of a document
   are summed up as one surprise, and a logistic curve over it gives the probability of the label.

Counts run over all labelled training documents. The model holds at most ``max_terms`` tokens, so it is small
enough to travel with the tasks.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from demandloom.llm.shared import binary_labels, broadcast_if_small, documents, fresh_name, give_back, held_out, stage

FOLDS = 4
THRESHOLD = 0.3
#: Tokens are runs of letters, digits and bytes beyond ASCII; ASCII capitals are lowered.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
SEGMENTS = "struct<n_tokens:int,best:double,surprise_sum:double,segments:array<struct<first:int,last:int,score:double>>>"


def tokens(text: str) -> list[bytes]:
    return text.encode().translate(_TABLE).split()


@dataclass(frozen=True)
class ToxicityModel:
    scores: dict[bytes, float]
    neutral: float
    log_k: float = 0.0
    intercept: float = 0.0
    slope: float = 1.0


def token_counts(labelled: DataFrame) -> DataFrame:
    """Rows (token, toxic, clean): in how many toxic and clean documents each token stands.

    Counting documents keeps one text that repeats a word from teaching it.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen = (Counter(), Counter())

        def drain():
            words = list(seen[0].keys() | seen[1].keys())
            frame = pd.DataFrame({"token": words, "toxic": [seen[1][w] for w in words], "clean": [seen[0][w] for w in words]})
            seen[0].clear(), seen[1].clear()
            return frame

        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                seen[label].update(set(tokens(text)))
                if len(seen[0]) + len(seen[1]) > 300_000:
                    yield drain()
        yield drain()
        give_back()

    partial = labelled.select("text", "label").mapInPandas(count, "token binary, toxic long, clean long")
    return partial.groupBy("token").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))


def contexts(labelled: DataFrame, candidates: set[bytes]) -> DataFrame:
    """Rows (token, contexts): after how many different tokens a candidate stands in toxic documents."""

    def pairs(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[tuple[bytes, bytes]] = set()
        for batch in batches:
            for text in batch["text"]:
                words = tokens(text)
                seen.update((w, before) for before, w in zip([b"", *words], words) if w in candidates)
            if len(seen) > 200_000:
                yield pd.DataFrame(list(seen), columns=["token", "before"])
                seen.clear()
        yield pd.DataFrame(list(seen), columns=["token", "before"])

    toxic = labelled.where("label = 1").select("text").mapInPandas(pairs, "token binary, before binary")
    return toxic.distinct().groupBy("token").agg(F.count("*").alias("contexts"))


def log_odds(labelled: DataFrame, prior_share: float, min_z: float, min_log_odds: float, max_terms: int) -> tuple[dict[bytes, float], float]:
    """Scores of the telling tokens, and the score that all other tokens share.

    Copies of one toxic text would teach its every word. So a token counts in toxic documents at most once for
    each different token before it, which copies share.
    """
    counts = stage(token_counts(labelled))
    total = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).first()
    n_toxic, n_clean = float(total["toxic"] or 0), float(total["clean"] or 0)
    if not n_toxic or not n_clean:
        return {}, -0.1
    weight = prior_share * (n_toxic + n_clean)

    def telling(frame: DataFrame) -> list:
        prior = weight * (F.col("toxic") + F.col("clean")) / (n_toxic + n_clean)
        in_toxic, in_clean = F.col("toxic") + prior, F.col("clean") + prior
        delta = F.log(in_toxic / (n_toxic + weight - in_toxic)) - F.log(in_clean / (n_clean + weight - in_clean))
        z = delta / F.sqrt(1 / in_toxic + 1 / in_clean)
        scored = frame.select("token", "toxic", "clean", delta.alias("delta"), z.alias("z")).where((F.col("z") >= min_z) & (F.col("delta") >= min_log_odds))
        return scored.orderBy(F.desc("z"), "token").limit(max_terms).collect()

    candidates = telling(counts)
    spread = contexts(labelled, {bytes(r["token"]) for r in candidates})
    schema = "token binary, toxic long, clean long"
    rows = labelled.sparkSession.createDataFrame([(r["token"], r["toxic"], r["clean"]) for r in candidates], schema)
    top = telling(rows.join(spread, "token").select("token", F.least("toxic", "contexts").alias("toxic"), "clean"))
    rest_toxic = n_toxic - sum(r["toxic"] for r in top)
    rest_clean = n_clean - sum(r["clean"] for r in top)
    neutral = math.log(max(rest_toxic, 1.0) / n_toxic) - math.log(max(rest_clean, 1.0) / n_clean)
    return {bytes(r["token"]): float(r["delta"]) for r in top}, min(neutral, -0.02)


def maximal_segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (first, last, sum), by the linear-time list of candidate segments."""
    found: list[list] = []  # first, last, total before the first, total after the last, left neighbour with a smaller start
    totals = np.concatenate(([0.0], np.cumsum(scores)))
    for at in np.flatnonzero(scores > 0):
        piece = [int(at), int(at), totals[at], totals[at + 1], -1]
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= piece[2]:
                j = found[j][4]
            piece[4] = j
            if j < 0 or found[j][3] >= piece[3]:
                found.append(piece)
                break
            piece[0], piece[2] = found[j][0], found[j][2]
            del found[j:]
    return [(first, last, float(after - before)) for first, last, before, after, _ in found]


def segments_udf(model: ToxicityModel):
    """Column function: maximal segments of a text and what they sum up to."""

    @pandas_udf(SEGMENTS)
    def scan(texts: pd.Series) -> pd.DataFrame:
        get, neutral, rows = model.scores.get, model.neutral, []
        for text in texts:
            words = tokens(text or "")
            scores = np.array([get(w, neutral) for w in words]) if words else np.zeros(0)
            segments = maximal_segments(scores)
            best = max((s for _, _, s in segments), default=0.0)
            surprise = sum(s - model.log_k - math.log(len(words)) for _, _, s in segments if s > model.log_k + math.log(len(words)))
            significant = [{"first": a, "last": b, "score": s} for a, b, s in segments if s > model.log_k + math.log(len(words))]
            rows.append((len(words), best, surprise, significant))
        return pd.DataFrame(rows, columns=["n_tokens", "best", "surprise_sum", "segments"])

    return scan


def _chance_constant(rows: DataFrame) -> float:
    """ln K: by the mean of the extreme-value law, best - ln(n) averages ln K + 0.5772 over clean documents."""
    clean = rows.where("label = 0 AND n_tokens > 0").agg(F.avg(F.col("best") - F.log(F.col("n_tokens").cast("double"))).alias("mean"))
    mean = clean.first()["mean"]
    return max(-20.0, (mean if mean is not None else 0.0) - 0.5772156649015329)


def _logistic(histogram: list, iterations: int = 60) -> tuple[float, float]:
    """Intercept and slope over (value, label, n) by damped Newton steps with a slight ridge."""
    if not histogram:
        return -10.0, 0.0
    x = np.array([r["value"] for r in histogram])
    y = np.array([float(r["label"]) for r in histogram])
    n = np.array([float(r["n"]) for r in histogram])
    weights = np.zeros(2)
    design = np.stack([np.ones_like(x), x], axis=1)
    for _ in range(iterations):
        p = 1 / (1 + np.exp(-np.clip(design @ weights, -30, 30)))
        gradient = design.T @ (n * (y - p)) - 0.1 * weights
        hessian = (design * (n * p * (1 - p))[:, None]).T @ design + 0.1 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        weights = weights + step * min(1.0, 2.0 / max(np.abs(step).max(), 1e-12))
        if np.abs(step).max() < 1e-9:
            break
    return float(weights[0]), float(weights[1])


def fit_toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", prior_share: float = 0.1, min_z: float = 3.0, min_log_odds: float = 1.0,
                 max_terms: int = 20_000,
                 folds: int = FOLDS) -> ToxicityModel:
    """Learn from the labelled documents outside the held-out fold. Without labels every text gets a low score."""
    known = binary_labels(labels, label).where(~held_out(F.col("doc_id"), folds))
    labelled = documents(docs).join(broadcast_if_small(stage(known)), "doc_id")
    scores, neutral = log_odds(labelled, prior_share, min_z, min_log_odds, max_terms)
    model = ToxicityModel(scores, neutral)
    scanned = stage(labelled.select("label", segments_udf(model)("text").alias("s")).select("label", "s.n_tokens", "s.best", F.col("s.segments.score").alias("sums")))
    log_k = _chance_constant(scanned)
    line = F.lit(log_k) + F.log(F.greatest(F.col("n_tokens"), F.lit(1)).cast("double"))
    surprise = F.aggregate("sums", F.lit(0.0), lambda total, s: total + F.when(s > line, s - line).otherwise(0.0))
    binned = scanned.groupBy(_bin(surprise).alias("value"), "label").agg(F.count("*").alias("n"))
    intercept, slope = _logistic(binned.collect())
    return ToxicityModel(scores, neutral, log_k, intercept, slope)


def _bin(surprise: Column) -> Column:
    """Surprise beyond 20 says no more; bins of 0.05 bound what the fit looks at to 401 values a class."""
    return F.round(F.least(surprise, F.lit(20.0)) * 20) / 20


def probability(model: ToxicityModel, surprise: Column) -> Column:
    return 1 / (1 + F.exp(-(F.lit(model.intercept) + F.lit(model.slope) * _bin(surprise))))


def score_toxicity(docs: DataFrame, model: ToxicityModel, folds: int = FOLDS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted and its significant passages (token positions).

    Null text counts as empty; an empty text scores what a text without any toxic passage scores. Rows are
    scored one by one, so repeated rows, null ids and other columns have no influence.
    """
    scanned = documents(docs).select("doc_id", segments_udf(model)("text").alias("s"))
    scored = scanned.select("doc_id", held_out(F.col("doc_id"), folds).alias("held_out"), probability(model, F.col("s.surprise_sum")).alias("score"), F.col("s.segments").alias("passages"))
    return scored.select("doc_id", "held_out", "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "passages")


def drop_toxic(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """The documents below the threshold, with all their columns, whatever their names.

    Null text counts as empty, texts of any length are scanned whole, repeated rows are judged alike.
    """
    surprise = segments_udf(model)(F.coalesce(F.col("text"), F.lit("")))["surprise_sum"]
    own = fresh_name(docs, "score")
    return docs.withColumn(own, probability(model, surprise)).where(F.col(own) < THRESHOLD).select(docs.columns)
