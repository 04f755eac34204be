"""Operator 6: document rates that bring the expected tokens of domains to targets.

A table of labelled documents gives the classifier. A hashed word tells a domain if it stands in more (or fewer)
of its documents than in those of the first domain, by a test that compares documents of one stratum
(the language, say) only, as languages are no domains; its weight is the logarithm of that ratio. The
weights of the distinct telling words of a text, summed, and their sum per hundred words, are the evidence; a softmax
regression on it gives the probability of each domain. Rates w >= 0, all 1 at first, are then moved by
projected gradient steps on the squared distance between sum(w * tokens * probability) and the
target of each domain; steps are scaled by the inverse Gram matrix of the active
documents, so a few suffice. Each step is one aggregation that returns a matrix of the number of
domains; rates are an expression of the probabilities and the steps taken, so nothing is
joined or stored per step. Only built-in functions are used over documents; the driver gets telling words (at most
BUCKETS) and the evidence of at most MAX_LABELLED labelled rows.

Defined results: a NULL or empty text has no tokens, the probabilities of a text without a telling word and a rate like
other documents; a NULL id is never labelled; labels that are NULL are ignored; of several labels of an id the
smallest domain name counts; rows that repeat a labelled id are all learnt from; without labels all domains are equally
likely, and a domain without labelled documents has next to no probability; targets that cannot be reached (a domain
without tokens, say) are missed by what `unmet` says; documents without the column of strata are one stratum.
Other columns are passed through by `thinned` and otherwise ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import bound, empty_text, stored

#: At most this many labelled documents are learnt from (chosen by hash).
MAX_LABELLED = 20_000
BUCKETS = 1 << 16
#: Standard errors that a word's documents must be off those of the first domain.
LEAST_Z = 6.0
RIDGE = 1.0
IMPOSSIBLE = -1e6
STEPS = 25
CLOSE = 1e-3


def quality_domains(labels: DataFrame) -> DataFrame:
    """(doc_id, domain): toxic, else low for quality 0, else clean."""
    domain = F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low")
    domain = domain.when(F.col("quality") == 1, "clean")
    return labels.select("doc_id", domain.alias("domain")).where("doc_id is not null and domain is not null")


def _slots(text: Column) -> Column:
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    return F.transform(words, lambda w: F.pmod(F.xxhash64(w), F.lit(BUCKETS)).cast("int"))


class Domains:
    """Weights of telling words by slot, one table for each domain but the first, and of the evidence they give."""

    def __init__(self, names: list[str], tables: np.ndarray, weights: np.ndarray):
        self.names, self.tables, self.weights = names, tables, weights

    def evidence(self, slots: Column, n: Column) -> Column:
        """For each domain but the first: the sum of the weights of distinct slots, and that of a hundred words."""
        used = np.flatnonzero(self.tables.any(axis=0))
        if not len(used):
            return F.array_repeat(F.lit(0.0), 2 * len(self.tables))
        known = F.split(F.lit(",".join(map(str, used))), ",").cast("array<int>")
        tables = [
            F.split(F.lit(",".join(f"{v:.6g}" for v in row)), ",").cast("array<double>")
            for row in self.tables[:, used]
        ]

        def total(places: Column, table: Column) -> Column:
            return F.aggregate(places, F.lit(0.0), lambda x, at: x + F.element_at(table, at))

        def both(sums: Column) -> Column:
            return F.concat(sums, F.transform(sums, lambda v: 100 * v / F.greatest(n, F.lit(1))))

        place_of = np.zeros(BUCKETS, int)
        place_of[used] = np.arange(1, len(used) + 1)
        place = F.split(F.lit(",".join(map(str, place_of))), ",").cast("array<int>")
        places = F.transform(F.array_intersect(slots, known), lambda slot: F.get(place, slot))
        return bound(places, lambda at: bound(F.array(*(total(at, table) for table in tables)), both))

    def posterior(self, evidence: Column) -> Column:
        def softmax(logs: Column) -> Column:
            top = F.array_max(logs)
            powers = F.transform(logs, lambda v: F.exp(v - top))
            return bound(
                powers,
                lambda e: F.transform(e, lambda v: v / F.aggregate(e, F.lit(0.0), lambda x, y: x + y)),
            )

        def of(x: Column) -> Column:
            logs = []
            for first, *others in self.weights.T.tolist():
                log = F.lit(first)
                for i, weight in enumerate(others):
                    log = log + F.lit(weight) * F.asinh(x[i])
                logs.append(log)
            return bound(F.array(*logs), softmax)

        return bound(evidence, of)

    def scored(self, text: Column) -> Column:
        """A struct of `n` (words) and `p` (probabilities in the order of the names)."""

        def both(slots: Column) -> Column:
            n = F.size(slots)
            return F.struct(n.cast("bigint").alias("n"), self.posterior(self.evidence(slots, n)).alias("p"))

        return bound(_slots(text), both)


def telling_words(rows: DataFrame, names: list[str]) -> DataFrame:
    """(slot, w1, w2, ...): weights for each domain but the first; rows have domain, stratum and distinct slots.

    Within a stratum a word is expected in the domain's documents as often as in those of both domains together. A
    weight is 0 where the sum over strata is within LEAST_Z standard errors of that (Mantel and Haenszel's test), else
    the logarithm of the documents that have it to those that would, were the domain like the first.
    """
    of = [F.count_if(F.col("domain") == name) for name in names]
    sizes = rows.groupBy("stratum").agg(*(c.alias(f"t{i}") for i, c in enumerate(of)))
    seen = rows.select("domain", "stratum", F.explode("slots").alias("slot")).groupBy("stratum", "slot")
    seen = seen.agg(*(c.alias(f"c{i}") for i, c in enumerate(of))).join(sizes, "stratum")
    t0, c0 = F.col("t0"), F.col("c0")
    sums, weights = [], []
    for d in range(1, len(names)):
        t, c = F.col(f"t{d}"), F.col(f"c{d}")
        pooled = (c + c0) / (t + t0)
        parts = {
            "o": c,
            "e": t * pooled,
            "v": pooled * (1 - pooled) * t * t0 / (t + t0),
            "f": t * c0 / t0,
        }
        sums += [
            F.sum(F.when((t > 0) & (t0 > 0), v).otherwise(0.0)).alias(f"{k}{d}") for k, v in parts.items()
        ]
        o, e, v, first = (F.col(f"{k}{d}") for k in parts)
        tells = (v > 1e-9) & (F.abs(o - e) >= LEAST_Z * F.sqrt(v))
        weights.append(F.when(tells, F.log((o + 0.5) / (first + 0.5))).otherwise(0.0).alias(f"w{d}"))
    found = seen.groupBy("slot").agg(*sums).select("slot", *weights)
    return found.where(" or ".join(f"w{d} <> 0" for d in range(1, len(names))))


def softmax_regression(x: np.ndarray, domain: np.ndarray, size: int) -> np.ndarray:
    """Weights (one column for each domain) by Newton's steps on the ridge-penalised likelihood."""
    wanted, width = np.eye(size)[domain], x.shape[1]
    weights = np.zeros((width, size))

    def loss(w):
        logs = x @ w
        top = logs.max(axis=1, keepdims=True)
        total = top[:, 0] + np.log(np.exp(logs - top).sum(axis=1))
        return (total - (logs * wanted).sum(axis=1)).sum() + RIDGE / 2 * (w**2).sum()

    for _ in range(100 if len(x) else 0):
        logs = x @ weights
        p = np.exp(logs - logs.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        slope = x.T @ (p - wanted) + RIDGE * weights
        curve = RIDGE * np.eye(width * size)
        for i in range(size):
            for j in range(size):
                part = x.T @ ((p[:, i] * ((i == j) - p[:, j]))[:, None] * x)
                curve[i * width : (i + 1) * width, j * width : (j + 1) * width] += part
        step = np.linalg.solve(curve, slope.T.ravel()).reshape(size, width).T
        now, pace = loss(weights), 1.0
        while pace > 1e-6 and loss(weights - pace * step) > now:
            pace /= 2
        weights = weights - pace * step
        if np.abs(pace * step).max() < 1e-8:
            break
    return weights


def fit_domains(
    docs: DataFrame, labelled: DataFrame, names: list[str], within: str | None = "lang"
) -> Domains:
    """Learn from at most MAX_LABELLED labelled documents; their ids are broadcast."""
    chosen = (
        labelled.where(F.col("domain").isin(names))
        .groupBy("doc_id")
        .agg(F.min("domain").alias("domain"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(MAX_LABELLED)
    )
    within = within if within in docs.columns else None
    stratum = F.coalesce(F.col(within).cast("string"), F.lit("")) if within else F.lit("")
    rows = docs.select("doc_id", stratum.alias("stratum"), empty_text().alias("text"))
    slots = bound(
        _slots(F.col("text")),
        lambda all_of: F.struct(F.size(all_of).alias("n"), F.array_distinct(all_of).alias("slots")),
    )
    rows = rows.join(F.broadcast(chosen), "doc_id").select("doc_id", "domain", "stratum", slots.alias("s"))
    rows = stored(rows.select("doc_id", "domain", "stratum", "s.n", "s.slots"), "mixing_labelled")
    tables = np.zeros((len(names) - 1, BUCKETS))
    for row in telling_words(rows, names).collect() if len(names) > 1 else []:
        tables[:, row["slot"]] = row[1:]
    model = Domains(names, tables, np.zeros((1, len(names))))
    shown = rows.select("doc_id", "domain", model.evidence(F.col("slots"), F.col("n")).alias("x"))
    shown = shown.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(MAX_LABELLED).collect()
    x = np.array([[1.0, *np.arcsinh(r["x"])] for r in shown]).reshape(len(shown), 2 * len(names) - 1)
    domain = np.array([names.index(r["domain"]) for r in shown], int)
    model.weights = softmax_regression(x, domain, len(names))
    if len(shown):
        model.weights[0, np.bincount(domain, minlength=len(names)) == 0] = IMPOSSIBLE
    return model


def rate(steps: list[list[float]], p: Column, whole: float | None = None) -> Column:
    """The rate after these steps, from the probabilities of the domains.

    With `whole` it is at most 1, and 1 where the first domain's probability is `whole` or more.
    """
    w = F.lit(1.0)
    for step in steps:
        move = sum((p[d] * F.lit(float(s)) for d, s in enumerate(step)), F.lit(0.0))
        w = F.greatest(F.lit(0.0), w - move)
        w = w if whole is None else F.least(F.lit(1.0), w)
    return w if whole is None else F.when(p[0] >= whole, 1.0).otherwise(w)


def fit_rates(weighed: DataFrame, targets, whole: float | None = None) -> tuple[list[list[float]], float]:
    """Steps whose rates bring the tokens of each domain to its target, and the largest share by which one is missed.

    `weighed` has n and p; `targets` maps the tokens per domain at rate 1 to those wanted. With `whole`, documents
    whose probability for the first domain is that or more keep the rate 1, the others make up for what these hold of the
    other domains, and the first domain has no target.
    """
    size = len(weighed.first()["p"]) if not weighed.isEmpty() else 0
    steps: list[list[float]] = []
    wanted, unmet = None, 0.0
    p = F.col("p")
    aimed = slice(0 if whole is None else 1, size)
    for left in reversed(range(STEPS + 1 if size else 0)):
        w = rate(steps, p, whole)
        mass = [F.sum(w * F.col("n") * p[d]).alias(f"a{d}") for d in range(size)]
        moves = w > 0 if whole is None else (w > 0) & (p[0] < whole)
        active = F.when(moves, F.col("n")).otherwise(0)
        gram = [
            F.sum(active * p[i] * p[j]).alias(f"g{i}{j}") for i in range(size) for j in range(i, size)
        ]
        row = weighed.agg(*mass, *gram).first()
        now = np.array([row[f"a{d}"] or 0.0 for d in range(size)])
        wanted = targets(now) if wanted is None else wanted
        gap = now - wanted
        unmet = float(np.max(np.abs(gap / np.maximum(wanted, 1))[aimed], initial=0.0))
        if unmet <= CLOSE or not left:
            break
        g = np.zeros((size, size))
        for i in range(size):
            for j in range(i, size):
                g[i, j] = g[j, i] = row[f"g{i}{j}"] or 0.0
        step = np.zeros(size)
        step[aimed] = np.linalg.pinv(g[aimed, aimed], rcond=1e-9) @ gap[aimed]
        steps.append(step.tolist())
    return steps, unmet


def shares(weights: dict[str, float]):
    """Targets from weights of the domains, with as many tokens in all as there are."""
    want = np.array(list(weights.values()))
    return lambda now: now.sum() * want / want.sum()


def factors(weights: dict[str, float]):
    """Targets that scale the tokens of each domain."""
    return lambda now: now * np.array(list(weights.values()))


def document_rates(docs: DataFrame, labelled: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(doc_id, n_tokens, p_<domain>, rate, unmet, copies) of each row; `weights` are target shares.

    `copies` rounds the rate up or down by a hash of the id, so that it holds on average; `unmet` is the largest share
    by which a target is missed, the same in all rows.
    """
    names = list(weights)
    model = fit_domains(docs, labelled, names)
    scored = docs.select("doc_id", model.scored(empty_text()).alias("s"))
    weighed = stored(scored.select("doc_id", "s.n", "s.p"), "mixing")
    steps, unmet = fit_rates(weighed, shares(weights))
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return weighed.select(
        "doc_id",
        F.col("n").alias("n_tokens"),
        *(F.col("p")[i].alias(f"p_{name}") for i, name in enumerate(names)),
        rate(steps, F.col("p")).alias("rate"),
        F.lit(unmet).alias("unmet"),
    ).withColumn("copies", F.floor(F.col("rate") + chance).cast("int"))


def thinned(docs: DataFrame, labelled: DataFrame, kept: dict[str, float], whole: float = 0.5) -> DataFrame:
    """Rows of `docs`, where the tokens of each domain are brought to a share of what they are.

    A document whose probability for the first domain is `whole` or more stays; of the others the share that their rate
    says, by a hash of the id, so that the other domains get what they are meant to have.
    """
    model = fit_domains(docs, labelled, list(kept))
    scored = model.scored(empty_text())
    weighed = stored(docs.select(scored.alias("s")).select("s.n", "s.p"), "mixing")
    steps, _ = fit_rates(weighed, factors(kept), whole)
    chance = F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(1_000_000)) / 1_000_000
    return docs.where(bound(scored, lambda s: chance < rate(steps, s["p"], whole)))
