"""Mixing sources to target weights by soft membership, with DataFrame functions only.

A labelled table (doc_id, domain) trains a naive Bayes classifier of hashed words; it gives every document a posterior over the domains.
The evidence of n words counts as that of sqrt(n) * SOFT, which keeps the memberships of long texts soft. Document rates r >= 0 are then fitted so that the expected domain token totals sum(r * tokens * posterior)
match the targets: the minimum of the squared differences plus a small pull of all rates to 1, found to the end by Newton steps on its
dual, which has one unknown a domain, so that rare domains settle as fast as others. Only sums over K domains and their pairs reach the driver.

The classifier learns from at most FIT_ROWS labelled documents of each domain, those with the smallest hash of doc_id.
"""

from __future__ import annotations

import json
import math
import warnings

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

FIT_ROWS = 1_500
BUCKETS = 4096
SOFT = 2.0
PULL = 1e-4
#: Steps of the fit end where totals and residuals agree to CLOSE.
CLOSE = 1e-8
#: Totals that miss their targets by more are warned of.
MISSED = 1e-3
#: The registered query's domains: rows labelled as low quality, else their language.
TARGETS = {"en": 0.58, "de": 0.15, "fr": 0.15, "es": 0.11, "low": 0.01}


def _words(text: Column) -> Column:
    return F.split(F.coalesce(text.cast("string"), F.lit("")), r"[ \t\n\x0B\f\r]+")


def _bucket(word: Column) -> Column:
    return F.pmod(F.xxhash64(word), F.lit(BUCKETS)).cast("int")


def _constant(value: list, kind: str) -> Column:
    """A literal in one expression, folded once."""
    return F.from_json(F.lit(json.dumps(value)), kind)


def labelled_domains(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, domain of labelled documents: 'low' for quality 0, else the language; rows without either are left out."""
    quality = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    language = docs.where("doc_id is not null").groupBy("doc_id").agg(F.min("lang").alias("lang"))
    domain = F.when(F.col("quality") == 0, F.lit("low")).otherwise(F.col("lang"))
    return quality.join(language, "doc_id").select("doc_id", domain.alias("domain")).where("domain is not null")


def word_weights(docs: DataFrame, labelled: DataFrame, domains: list[str], fit_rows: int = FIT_ROWS) -> tuple[list[list[float]], list[float]]:
    """Log chances of each word bucket in each domain, and of the domains, smoothed."""
    labelled = labelled.where(F.col("domain").isin(domains))
    sizes = {r[0]: r[1] for r in labelled.groupBy("domain").agg(F.count(F.lit(1))).collect()}
    chosen = None
    for domain in domains:
        part = labelled.where(F.col("domain") == domain).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
        chosen = part if chosen is None else chosen.union(part)
    # at most fit_rows * len(domains) rows of an id and a domain
    words = docs.select("doc_id", "text").join(F.broadcast(chosen.select("doc_id", "domain")), "doc_id").select("domain", F.explode(_words(F.col("text"))).alias("word")).where("word <> ''")
    counts = {d: [1.0] * BUCKETS for d in domains}
    for domain, bucket, n in words.groupBy("domain", _bucket(F.col("word")).alias("bucket")).agg(F.count(F.lit(1)).alias("n")).collect():
        counts[domain][bucket] += n
    weights = [[math.log(c / total) for c in counts[d]] for d in domains for total in [sum(counts[d])]]
    everything = sum(sizes.values()) + len(domains)
    return weights, [math.log((sizes.get(d, 0) + 1) / everything) for d in domains]


def posteriors(docs: DataFrame, weights: list[list[float]], prior: list[float]) -> DataFrame:
    """doc_id, n_tokens, m (array of posteriors) of each distinct doc_id; rows that share one, or have none, are one unit."""
    k = len(prior)
    words = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.explode(_words(F.col("text"))).alias("word"))
    words = words.select("doc_id", (F.col("word") != "").alias("real"), _bucket(F.col("word")).alias("b"))
    sums = words.groupBy("doc_id").agg(F.count_if("real").alias("n_tokens"), *(F.sum(F.when(F.col("real"), _constant(w, "array<double>")[F.col("b")])).alias(f"s{i}") for i, w in enumerate(weights)))
    scale = F.least(F.lit(1.0), F.lit(SOFT) / F.sqrt(F.greatest(F.lit(1.0), F.col("n_tokens"))))
    logits = [F.coalesce(F.col(f"s{i}"), F.lit(0.0)) * scale + F.lit(prior[i]) for i in range(k)]
    top = F.greatest(*logits) if k > 1 else logits[0]
    sums = sums.select("doc_id", "n_tokens", F.array(*(F.exp(x - top) for x in logits)).alias("e"))
    whole = F.aggregate("e", F.lit(0.0), lambda a, x: a + x)
    return sums.select("doc_id", "n_tokens", F.transform("e", lambda x: x / whole).alias("m"))


def _rate(pulls: list[float], least: float) -> Column:
    """The rate of a row with shares m at the point where residuals, by domain, are pulls: where the slope of the rate is 0, or at the bound."""
    slope = F.aggregate(F.zip_with("m", _constant(pulls, "array<double>"), lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
    return F.greatest(F.lit(float(least)), F.lit(1.0) - slope / F.lit(PULL))


def fit_rates(groups: DataFrame, targets: list[float], least: float = 0.0) -> tuple[list[float], list[float]]:
    """Residuals at the optimum, which give all rates, and the totals reached as shares of all tokens. groups: m (posterior shares), n_tokens; targets: shares of all tokens.

    The best rates follow from K residuals z by _rate(), with totals(z) - targets = z. That is the minimum of a convex function of z
    (the dual), found by Newton steps with halving, whose value, slope and curvature the cluster adds up. Steps lower the value until
    the optimum is reached or, which only rounding can bring about, none of them does; the result is then the best found, with a warning.
    """
    k = len(targets)
    everything = groups.agg(F.sum("n_tokens")).first()[0] or 0
    if not everything:
        return [0.0] * k, [0.0] * k
    wanted, room = np.array(targets), 1.0 - least
    upper = [(i, j) for i in range(k) for j in range(i, k)]

    def at(z: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        """Value, slope and curvature of the dual, and the totals."""
        pull = F.aggregate(F.zip_with("m", _constant(z.tolist(), "array<double>"), lambda p, x: p * x), F.lit(0.0), lambda s, x: s + x)
        rows = groups.select("m", (F.col("n_tokens") / F.lit(float(everything))).alias("w"), pull.alias("u"), _rate(z.tolist(), least).alias("rate"))
        free = F.col("u") < F.lit(PULL * room)
        value = F.when(free, F.col("u") * F.col("u") / F.lit(2 * PULL) - F.col("u")).otherwise(F.lit(-PULL * room * room / 2) - F.lit(float(least)) * F.col("u"))
        sums = [F.sum(F.col("w") * value)] + [F.sum(F.col("w") * F.col("rate") * F.col("m")[i]) for i in range(k)] + [F.sum(F.when(free, F.col("w") * F.col("m")[i] * F.col("m")[j]).otherwise(0.0)) for i, j in upper]
        row = [float(x or 0.0) for x in rows.agg(*(x.alias(f"s{n}") for n, x in enumerate(sums))).first()]
        totals, curve = np.array(row[1 : k + 1]), np.eye(k)
        for (i, j), x in zip(upper, row[k + 1 :], strict=True):
            curve[i, j] += x / PULL
            if i != j:
                curve[j, i] += x / PULL
        return row[0] + float(z @ z) / 2 + float(wanted @ z), z + wanted - totals, curve, totals

    z = np.zeros(k)
    value, slope, curve, totals = at(z)
    while np.abs(slope).max() >= CLOSE:
        move, size = -np.linalg.solve(curve, slope), 1.0
        new = at(z + move)
        while new[0] > value + 1e-4 * size * float(slope @ move) and np.abs(new[1]).max() >= CLOSE and size > 1e-9:
            size /= 2
            new = at(z + size * move)
        if new[0] >= value and np.abs(new[1]).max() >= np.abs(slope).max():
            warnings.warn(f"mixing rates settle no further: totals and residuals differ by {np.abs(slope).max():.3g}", stacklevel=2)
            break
        z = z + size * move
        value, slope, curve, totals = new
    return z.tolist(), totals.tolist()


def mix(docs: DataFrame, labelled: DataFrame, targets: dict[str, float], grow: list[str] | None = None, least: float = 0.0) -> tuple[DataFrame, dict[str, tuple[float, float, float]]]:
    """Rates of documents, and for each domain the natural, target and reached tokens as shares of all natural tokens.

    The first result has doc_id, n_tokens, domain (the likeliest), posterior (its), rate for each distinct doc_id of docs(doc_id, text); rows
    that share a doc_id, or have none, are one unit. Targets are weights of the mixture, whose size is the natural one, or with `grow`
    the smallest in which none of these domains has to shrink; no rate falls below `least`, which is 0 or more. Null and empty texts have no tokens and the prior as posterior. With no rows
    the results are empty. Domains of the labelled table without a target are left out of training. Other columns are ignored.
    """
    domains = sorted(targets)
    weights, prior = word_weights(docs, labelled, domains)
    table = common.written(posteriors(docs, weights, prior), "posteriors")
    row = table.agg(F.sum("n_tokens"), *(F.sum(F.col("n_tokens") * F.col("m")[i]) for i in range(len(domains)))).first()
    everything = float(row[0] or 0)
    natural = [float(x or 0) / max(1.0, everything) for x in row[1:]]
    weight = sum(targets.values())
    size = max([1.0 if not grow else 0.0, *(n * weight / targets[d] for d, n in zip(domains, natural, strict=True) if d in (grow or []) and targets[d] > 0)]) or 1.0
    wanted = [targets[d] / weight * size for d in domains]
    pulls, reached = fit_rates(table, wanted, least)
    missed = {d: (t, r) for d, t, r in zip(domains, wanted, reached, strict=True) if everything and abs(t - r) > MISSED}
    if missed:
        warnings.warn("mixing targets not met (domain: target, reached): " + ", ".join(f"{d}: {t:.4f}, {r:.4f}" for d, (t, r) in missed.items()), stacklevel=2)
    best = F.array_position("m", F.array_max("m")).cast("int")
    out = table.select("doc_id", "n_tokens", F.element_at(_constant(domains, "array<string>"), best).alias("domain"), F.array_max("m").alias("posterior"), _rate(pulls, least).alias("rate"))
    return out, {d: (n, t, r) for d, n, t, r in zip(domains, natural, wanted, reached, strict=True)}


def resample(docs: DataFrame, rates: DataFrame) -> DataFrame:
    """Each row of docs floor(rate + u) times, u in [0, 1) from the hash of doc_id, so that the expected number is the rate; columns as they are."""
    u = F.pmod(F.xxhash64(F.coalesce(F.col("doc_id").cast("long"), F.lit(-1)), F.lit("copies")), F.lit(1 << 20)) / F.lit(float(1 << 20))
    copies = rates.select(F.col("doc_id").alias("_doc_id"), F.floor(F.col("rate") + u).cast("int").alias("_copies")).where("_copies > 0")
    # packed, so that no column of docs can clash
    packed = docs.select(F.struct("*").alias("row"))
    joined = packed.join(copies.hint("merge"), F.col("row.doc_id").cast("long").eqNullSafe(F.col("_doc_id")))
    return joined.select("row", F.explode(F.sequence(F.lit(1), F.col("_copies")))).select("row.*")


def op6_mixing(spark, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return mix(docs, labelled_domains(docs, common.table(spark, sf_dir, "labels")), TARGETS)[0]
