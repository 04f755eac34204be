"""Every stage of the corpus pipeline against plain code on rows with missing and repeated ids."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from ticklens.llm import quality

COLUMNS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
STAGE = dict(pipeline.STAGES)
ITEM = "the benchmark asks in ten or more plain words what this is"


def body(seed, n=40):
    drawn = random.Random(seed)
    return " ".join(drawn.choices([f"word{i}" for i in range(200)], k=n))


def rows():
    near = body(3, 60)
    texts = [
        *((i, body(i)) for i in range(30)),
        (1, body(1)),
        (2, body(500)),
        (None, body(1)),
        (None, body(600)),
        (None, body(600)),
        (700, near),
        (701, near + " more"),
        (None, near),
        (None, None),
        (None, None),
        (800, ""),
        (801, None),
        (5, f"{body(5, 12)} {ITEM} {body(6, 12)}"),
        (None, f"{ITEM} {body(7, 12)}"),
        (900, "short text"),
        (None, "short text"),
        (901, "aa bb " * 50),
    ]
    return [(i, t, "en", f"s{k % 3}", len(t or "")) for k, (i, t) in enumerate(texts)]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows(), COLUMNS).repartition(3).write.parquet(f"{root}/documents.parquet")
    labels = [(i, int(i % 3 > 0), int(i % 7 == 0)) for i in range(30)] + [(None, 1, 0), (3, None, None)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{root}/labels.parquet")
    items = [("a", ITEM), ("b", None), (None, body(8)), ("c", "short text")]
    spark.createDataFrame(items, "item_id string, text string").write.parquet(f"{root}/benchmark.parquet")
    return root


def documents(spark, tables):
    return spark.read.parquet(f"{tables}/documents.parquet")


def listed(df):
    return Counter(tuple(r) for r in df.select(*(c.split()[0] for c in COLUMNS.split(", "))).collect())


def words(text, pattern):
    lower = re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode())
    return re.findall(pattern, lower)


def test_stages_are_the_dealt_ones():
    assert [name for name, _ in pipeline.STAGES] == [
        "quality classifier",
        "MinHash near-dedup",
        "benchmark decontamination",
        "mixing sources to target weights",
        "token-ID / binary output",
    ]


def test_quality(spark, tables):
    docs, labels = documents(spark, tables), spark.read.parquet(f"{tables}/labels.parquet")
    scores = Counter(
        (r.doc_id, r.score >= pipeline.LEAST_QUALITY) for r in quality.quality_scores(docs, labels).collect()
    )
    got = STAGE["quality classifier"](spark, docs, tables)
    assert got.columns == docs.columns
    assert Counter(r.doc_id for r in got.collect()) == Counter(
        {i: n for (i, good), n in scores.items() if good}
    )


def test_near_dedup(spark, tables):
    got = STAGE["MinHash near-dedup"](spark, documents(spark, tables), tables)
    given = sorted(rows(), key=lambda r: (r[0] is None, r[0] or 0))
    sets = []
    for row in given:
        w = words(row[1], rb"[^\x20\x09-\x0D]+")
        sets.append({tuple(w[k : k + 5]) for k in range(max(len(w) - 4, min(len(w), 1)))})
    group = list(range(len(given)))
    for a in range(len(given)):
        for b in range(a):
            if sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                old, new = max(group[a], group[b]), min(group[a], group[b])
                group = [new if g == old else g for g in group]
    texts = Counter((r[0], r[1]) for k, r in enumerate(given) if not sets[k] or group[k] == k)
    assert Counter((r.doc_id, r.text) for r in got.collect()) == texts
    assert sum(texts.values()) < len(given)
    assert set(listed(got)) <= set(rows())


def test_decontamination(spark, tables):
    def hit(text):
        pattern = rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
        w = words(text, pattern)
        for item in (ITEM, "short text"):
            own = words(item, pattern)
            n = min(len(own), 10)
            passages = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)}
            if any(tuple(w[k : k + n]) in passages for k in range(len(w) - n + 1)):
                return True
        return False

    got = STAGE["benchmark decontamination"](spark, documents(spark, tables), tables)
    assert listed(got) == Counter(r for r in rows() if not hit(r[1]))
    assert sum(hit(r[1]) for r in rows()) == 4


def test_mixing_keeps_what_is_likely_clean(spark, tables):
    got = listed(STAGE["mixing sources to target weights"](spark, documents(spark, tables), tables))
    assert not got - Counter(rows())
    clean = {i for i in range(30) if i % 3 and i % 7}
    assert {r[0] for r in got} >= clean
    without = documents(spark, tables).drop("lang")
    assert STAGE["mixing sources to target weights"](spark, without, tables).count() > 0


def test_token_output(spark, tables):
    exact = Tokenizer.from_file(pipeline.TOKENIZER)
    got = STAGE["token-ID / binary output"](spark, documents(spark, tables), tables).collect()
    want = Counter()
    for i, text, *_ in rows():
        ids = np.array([*exact.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        want[i, len(ids), zlib.crc32(ids.tobytes())] += 1
    assert Counter((r.doc_id, r.n_tokens, r.ids_crc32) for r in got) == want
    starts = sorted((r.start, r.n_tokens) for r in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:]))


def test_clashing_columns(spark, tables):
    docs = documents(spark, tables)
    for name in ("row", "row_", "others", "n_hit", "items", "kept", "slot"):
        docs = docs.withColumnRenamed("source", "s").withColumn(name, docs["n_chars"])
    for name in ("MinHash near-dedup", "benchmark decontamination"):
        got = STAGE[name](spark, docs, tables)
        assert got.columns == docs.columns and got.dtypes == docs.dtypes
        assert got.count() == STAGE[name](spark, documents(spark, tables), tables).count()


def test_all_stages(spark, tables):
    got = pipeline.run(spark, tables).collect()
    docs = documents(spark, tables)
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, tables).collect(), docs.schema)
    assert Counter(r.doc_id for r in got) == Counter(r.doc_id for r in docs.collect())


def test_empty_tables(spark, tables, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{tables}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).collect() == []
