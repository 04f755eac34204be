"""Domains and rates against plain code, and against held-out labels."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticklens.llm import mixing
from ticklens.llm.common import id_crc32

SF_DIR = "/root/testdata/sf0.1"
NAMES = ["clean", "low", "toxic"]


def made(n=300):
    """(id, text, language, domain): each domain has words of its own, each language too."""
    drawn = random.Random(9)
    out = []
    for i in range(n):
        lang, domain = drawn.choice(["en", "de", None]), drawn.choice([*NAMES, "clean", "clean"])
        words = drawn.choices([f"{lang}{k}" for k in range(30)], k=drawn.randrange(5, 60))
        if domain != "clean":
            words[drawn.randrange(len(words))] = f"{domain}{drawn.randrange(2)}"
        out.append((i, " ".join(words), lang, domain))
    return out


def tables(spark, rows):
    docs = spark.createDataFrame([r[:3] for r in rows], "doc_id bigint, text string, lang string")
    labelled = spark.createDataFrame([(r[0], r[3]) for r in rows if r[3]], "doc_id bigint, domain string")
    return docs, labelled


def slots_of(spark, words):
    rows = spark.createDataFrame([(w,) for w in words], "w string")
    return {r["w"]: r["s"][0] for r in rows.select("w", mixing._slots(F.col("w")).alias("s")).collect()}


def test_telling_words_equal_plain_counts(spark):
    rows = made()
    slot = slots_of(spark, sorted({w for r in rows for w in r[1].split()}))
    docs, labelled = tables(spark, rows)
    model = mixing.fit_domains(docs, labelled, NAMES)
    sizes, seen = Counter(), defaultdict(Counter)
    for _, text, lang, domain in rows:
        sizes[domain, lang] += 1
        for s in {slot[w] for w in text.split()}:
            seen[s][domain, lang] += 1
    told = 0
    for s, c in seen.items():
        for d, name in enumerate(NAMES[1:]):
            o = e = v = f = 0.0
            for lang in ("en", "de", None):
                t, t0, k, k0 = sizes[name, lang], sizes["clean", lang], c[name, lang], c["clean", lang]
                share = (k + k0) / (t + t0)
                o, e, f = o + k, e + t * share, f + t * k0 / t0
                v += share * (1 - share) * t * t0 / (t + t0)
            tells = v > 1e-9 and abs(o - e) >= mixing.LEAST_Z * math.sqrt(v)
            told += tells
            want = math.log((o + 0.5) / (f + 0.5)) if tells else 0.0
            assert math.isclose(model.tables[d, s], want, rel_tol=1e-9, abs_tol=1e-12)
    assert told >= 4 and np.count_nonzero(model.tables) == told


def test_probabilities_and_rates_equal_plain_steps(spark):
    rows = [*made(), (None, "en1 toxic0", "en", None), (7, "", "de", None), (7, None, None, None)]
    docs, labelled = tables(spark, rows)
    weights = {"clean": 0.7, "low": 0.2, "toxic": 0.1}
    got = mixing.document_rates(docs, labelled, weights).collect()
    assert Counter(r["doc_id"] for r in got) == Counter(r[0] for r in rows)
    p = np.array([[r[f"p_{name}"] for name in NAMES] for r in got])
    n, w = np.array([r["n_tokens"] for r in got]), np.array([r["rate"] for r in got])
    assert np.allclose(p.sum(axis=1), 1) and (w >= 0).all()
    want = (n[:, None] * p).sum() * np.array(list(weights.values()))
    assert np.abs((w * n) @ p - want).max() <= mixing.CLOSE * want.max()
    assert {r["unmet"] for r in got} == {got[0]["unmet"]} and got[0]["unmet"] <= mixing.CLOSE
    # The same steps, on plain arrays.
    own = np.ones(len(n))
    for _ in range(mixing.STEPS):
        now = (own * n) @ p
        if (np.abs(now - want) <= mixing.CLOSE * want).all():
            break
        gram = (p * np.where(own > 0, n, 0)[:, None]).T @ p
        own = np.maximum(0, own - p @ (np.linalg.pinv(gram, rcond=1e-9) @ (now - want)))
    assert np.allclose(own, w, atol=1e-6)
    # Evidence has no bound by the length of the text: one telling word is found in many plain ones.
    by_id = {r["doc_id"]: r for r in got}
    known = [max(NAMES, key=lambda name: by_id[i][f"p_{name}"]) == d for i, _, _, d in rows[:300] if i != 7]
    assert np.mean(known) > 0.95


def test_thinning_meets_factors_and_keeps_the_likely_clean(spark):
    rows = made(2000)
    docs, labelled = tables(spark, rows)
    kept = Counter()
    for r in mixing.thinned(docs, labelled, {"clean": 1.0, "low": 0.5, "toxic": 0.1}).collect():
        kept[rows[r["doc_id"]][3]] += 1
    all_of = Counter(r[3] for r in rows)
    assert kept["clean"] >= 0.99 * all_of["clean"]
    assert abs(kept["low"] / all_of["low"] - 0.5) < 0.1
    assert abs(kept["toxic"] / all_of["toxic"] - 0.1) < 0.06


@pytest.mark.parametrize(
    "domains,even",
    [([], True), (["clean"], False), (["clean", "toxic"], False)],
)
def test_missing_domains(spark, domains, even):
    rows = [r[:3] + (r[3] if r[3] in domains else None,) for r in made(40)]
    docs, labelled = tables(spark, rows)
    got = mixing.document_rates(docs, labelled, {name: 1.0 for name in NAMES}).collect()
    assert len(got) == 40
    for r in got:
        for name in NAMES:
            if even:
                assert math.isclose(r[f"p_{name}"], 1 / 3)
            elif name not in domains:
                assert r[f"p_{name}"] < 1e-9
    assert (got[0]["unmet"] <= mixing.CLOSE) == even


def test_held_out_labels(spark):
    """Documents whose labels were not learnt from get the probabilities of their domain."""
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    labelled = mixing.quality_domains(spark.read.parquet(f"{SF_DIR}/labels.parquet"))
    held = F.pmod(id_crc32(F.col("doc_id")), F.lit(5)) == 0
    model = mixing.fit_domains(docs, labelled.where(~held), NAMES)
    rows = docs.join(labelled.where(held), "doc_id").select(
        "domain", model.scored(F.coalesce("text", F.lit("")))["p"].alias("p")
    )
    means = {
        r["domain"]: r["m"]
        for r in rows.groupBy("domain")
        .agg(F.avg(F.element_at("p", F.array_position(F.array(*map(F.lit, NAMES)), F.col("domain")).cast("int"))).alias("m"))
        .collect()
    }
    assert means["clean"] > 0.9 and means["low"] > 0.6 and means["toxic"] > 0.6, means
