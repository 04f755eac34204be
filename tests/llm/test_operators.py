"""Small fixtures of the document operators against brute force."""

from __future__ import annotations

import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from ticklens.llm import decontaminate, fingerprints, fixity, katz, licenses, mixing, neardup
from ticklens.llm import quality, secrets, tokens
from ticklens.llm.common import stored
from ticklens.session import new_dir

SCHEMA = "doc_id bigint, text string, lang string, n bigint"
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 7) for i, t in rows], SCHEMA)


def texts():
    drawn = random.Random(3)
    base = [" ".join(drawn.choices([f"w{i}" for i in range(40)], k=60)) for _ in range(8)]
    near = [" ".join([*t.split()[:-2], "x", "y"]) for t in base[:4]]
    return [*base, *near, base[0], "", None, "a", "A b", "a b", "é Ü 日本", "x " * 3000]


ODD = list(enumerate(texts()))
EMPTY: list = []


@pytest.mark.parametrize("rows", [ODD, EMPTY, [*ODD, *ODD[:2], (None, "one two three")]])
def test_every_operator_takes_odd_rows(spark, rows):
    docs = frame(spark, rows)
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 0), (3, None, None)], "doc_id bigint, quality int, toxic int")
    bench = spark.createDataFrame([("1", "a b"), ("2", None), (None, "x y")], "item_id string, text string")
    assert quality.quality_scores(docs, labels).count() == len(rows)
    assert neardup.near_duplicates(docs).count() == len(rows)
    assert decontaminate.contamination(docs, bench).count() == len(rows)
    assert katz.katz_scores(docs).count() == len(rows)
    assert tokens.token_files(docs, TOKENIZER).count() == len(rows)
    ledger = new_dir(spark, "ledger")
    secrets.create_ledger(spark, ledger)
    assert secrets.secret_report(docs, ledger).count() == len(rows)
    assert fingerprints.edited_report(docs).count() == len(rows)
    assert licenses.license_matches(docs).count() == 0
    rates = mixing.document_rates(docs, mixing.quality_domains(labels), {"clean": 1.0, "low": 1.0})
    assert rates.count() == len(rows)


def test_near_duplicates_equal_brute_force(spark):
    found = {r["doc_id"]: r for r in neardup.near_duplicates(frame(spark, ODD)).collect()}
    sets = {}
    for i, t in ODD:
        words = (t or "").lower().split()
        spans = [words] if 0 < len(words) < 5 else [words[k : k + 5] for k in range(len(words) - 4)]
        sets[i] = {tuple(s) for s in spans}
    parent = {i: i for i in sets}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a in sets:
        for b in sets:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                low, high = sorted((root(a), root(b)))
                parent[high] = low
    for i, s in sets.items():
        assert (found[i]["n_shingles"], found[i]["component_id"]) == (len(s), root(i))


def test_tokens_round_trip(spark):
    rows = {r["doc_id"]: r for r in tokens.token_files(frame(spark, ODD), TOKENIZER).collect()}
    exact, start = Tokenizer.from_file(TOKENIZER), 0
    for i, t in ODD:
        ids = np.array([*exact.encode(t or "", add_special_tokens=False).ids, 2], "<u4")
        assert (rows[i]["start"], rows[i]["n_tokens"]) == (start, len(ids))
        assert rows[i]["ids_crc32"] == zlib.crc32(ids.tobytes())
        start += len(ids)


def test_encoder_equals_tokenizer_on_odd_texts():
    drawn, exact = random.Random(1), Tokenizer.from_file(TOKENIZER)
    signs = ["a", "é", "1", "²", " ", "\n", "\t", "'", "'s", ".", "×", "<|endoftext|>", "\xa0", "日", "\x00"]
    many = ["".join(drawn.choices(signs, k=drawn.randint(0, 12))) for _ in range(1000)]
    ids, counts = tokens.Encoder(TOKENIZER)(pa.array(many))
    for t, own in zip(many, np.split(ids, np.cumsum(counts)[:-1])):
        assert own.tolist() == exact.encode(t, add_special_tokens=False).ids


def katz_by_hand(rows):
    """Probability of a word (None: the end) after another, and the training words, from plain dictionaries."""
    words, pairs = Counter(), Counter()
    for i, text in rows:
        if zlib.crc32(str(i).encode()) % 7 != 2:
            line = [*(text or "").encode().lower().split(), None]
            words.update(line)
            pairs.update(zip([None, *line], line))
    sizes = [[list(c.values()).count(r) for r in range(1, katz.COUNTED + 1)] for c in (words, pairs)]
    alone = katz.Unigrams(np.array([*sizes[0], len(words), sum(words.values())]))
    kept = katz.Discounts(np.array(sizes[1]))

    def single(word):
        return float(alone(np.array([words[word]]))[0])

    def share(before, word):
        n = pairs[before, word]
        return float(kept(np.array([n]))[0]) * n / words[before]

    def probability(before, word):
        if not words[before]:
            return single(word)
        if pairs[before, word]:
            return share(before, word)
        seen = [w for w in words if pairs[before, w]]
        left = 1 - sum(share(before, w) for w in seen)
        return left / (1 - sum(map(single, seen))) * single(word)

    return probability, words


def test_katz_equals_brute_force_and_adds_up_to_one(spark):
    held = [i for i in range(1000, 3000) if zlib.crc32(str(i).encode()) % 7 == 2]
    probes = ["w1 never-seen W2", "never-seen never-seen", "a é w3 w3", "", None, "w4 w5 w6 w7"]
    rows = [*ODD, *zip(held, probes)]
    probability, words = katz_by_hand(rows)
    for before in [*words, b"never-seen"]:
        assert math.isclose(sum(probability(before, w) for w in [*words, b"never-seen"]), 1, rel_tol=1e-9)
    found = {r["doc_id"]: r for r in katz.katz_scores(frame(spark, rows)).collect()}
    total, kinds = sum(words.values()), len(words)
    for i, text in rows:
        line, row = [*(text or "").encode().lower().split(), None], found[i]
        score = sum(math.log10(probability(h, w)) for h, w in zip([None, *line], line))
        base = sum(math.log10((words[w] + 1) / (total + kinds + 1)) for w in line)
        assert math.isclose(row["score"], score, rel_tol=1e-9)
        assert math.isclose(row["base_score"], base, rel_tol=1e-9)
        assert (row["n_tokens"], row["n_known"]) == (len(line), sum(words[w] > 0 for w in line))
        assert (row["held_out"], row["train_tokens"]) == (zlib.crc32(str(i).encode()) % 7 == 2, total)


class Table:
    """Stands for a table: keeps what a task would run over its batches."""

    def mapInArrow(self, rows, schema):
        self.rows = rows
        return self


def test_katz_tasks_hold_little_and_one_block_at_a_time(spark):
    drawn = random.Random(5)
    words = [f"w{int(drawn.paretovariate(0.6)) % 60_000}" for _ in range(800_000)]
    rows = [(i, " ".join(words[at : at + 1000])) for i, at in enumerate(range(0, len(words), 1000))]
    blocks = stored(katz.token_blocks(frame(spark, rows).coalesce(1).repartition(2), F.lit(False)), "blocks")
    assert blocks.count() == 2
    counted = [stored(katz.add_counts(katz.ask_counts(blocks, 4, pairs=p)), "counts") for p in (False, True)]
    alone, kept = katz.Unigrams(katz._stats(counted[0])), katz.Discounts(katz._stats(counted[1])[: katz.COUNTED])
    placed = blocks
    for answers, name in zip(counted, ("word_answers", "pair_answers")):
        placed = placed.join(katz._by_block(answers, name), "block")
    weights = stored(katz.add_weights(katz.ask_weights(placed, 4, alone, kept)), "weights")
    placed = placed.join(katz._by_block(weights, "weight_answers"), "block", "left")
    [batch] = placed.toArrow().combine_chunks().to_batches()
    assert batch.num_rows == 2
    longest = max(batch.column("n").to_pylist())
    for work in (
        katz.ask_counts(Table(), 4, pairs=True),
        katz.ask_weights(Table(), 4, alone, kept),
        katz.score_blocks(Table(), alone, kept),
    ):
        tracemalloc.start()
        done = sum(1 for _ in work.rows([batch]))
        held = tracemalloc.get_traced_memory()[1] / longest
        tracemalloc.stop()
        assert done == 2 and held < 60, held  # bytes a token; two blocks kept whole take 90


def test_ledger_scans_only_what_is_new(spark):
    ledger = new_dir(spark, "ledger")
    secrets.create_ledger(spark, ledger)
    docs = frame(spark, [(1, "password = hunter22"), (2, "password = hunter22"), (3, "none")])
    secrets.scan_new(docs, ledger)
    first = secrets.read_ledger(spark, ledger).count()
    secrets.scan_new(docs, ledger)
    assert secrets.read_ledger(spark, ledger).count() == first == 2 * len(secrets.RULES)
    found = {r["doc_id"]: r["assign"] for r in secrets.findings(docs, ledger).collect()}
    assert [tuple(s) for s in found[1]] == [(0, 19)] and found[1] == found[2] and found[3] == []


def test_audit_finds_the_altered_pages(spark):
    pages = [(i, f"http://h/{i}", "x" * i) for i in range(2500)]
    kind = "page_id bigint, url string, html string"
    a = spark.createDataFrame(pages, kind)
    other = [(i, u, h + "!" * (i == 1500)) for i, u, h in pages if i != 40] + [(9000, "u", "h")]
    rows = fixity.audit(a, spark.createDataFrame(other, kind)).collect()
    assert {(r["page_id"], r["status"]) for r in rows} == {(40, "missing"), (1500, "changed"), (9000, "extra")}
    assert fixity.audit(a, a).count() == 0
