"""Operator 4: near-duplicate documents by HyperMinHash sketches, banding and exact confirmation.

1. Each text becomes a set of hashed five-word shingles; equal sets are one class, its
   representative is the smallest document id. From here on only representatives move.
2. A sketch has a register per bucket: leading zeros (6 bits) and mantissa (10 bits) of the
   bucket's smallest hash. Each bucket hashes all shingles, so that short documents leave
   none empty. Bands of four registers are the keys of candidates: a pair of similarity 0.75 shares
   one of 40 bands but for 3 in 10 million cases.
3. Round one pairs each member of a band's group with its most central member only. Round two takes
   the groups that still hold several components, and compares the members outside of the component of
   that member with all members of other components: small groups make pairs, large ones are
   compared in blocks of bounded size that give links only, whatever their number. Pairs inside a component are never
   made, so large families of near copies stay linear.
4. Pairs whose sketches estimate less than 0.75 by a wide margin (corrected for chance collisions of
   registers) are dropped; the rest are confirmed on the full shingle sets.

Defined results: words are runs of anything but ASCII white space, A-Z lower-cased; a text
of fewer than five words has one shingle, all of it; NULL, empty or blank texts have none and are linked
with nothing; rows that repeat a document id are each judged by their own text, and links of one
hold for the id; rows with a NULL id are left out of linking and returned with NULL component and
kept = true. Extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticklens.llm.common import NOT_SPACE, chunks, mix, numbered, owners, stored, windows, word_hashes
from ticklens.llm.components import components

SHINGLE = 5
BANDS = 40
ROWS = 4
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 10
THRESHOLD = (75, 100)
#: Five standard errors of a sketch below the threshold.
ESTIMATE_MARGIN = 5 * (0.75 * 0.25 / REGISTERS) ** 0.5
LEAST_ESTIMATE = THRESHOLD[0] / THRESHOLD[1] - ESTIMATE_MARGIN
#: Groups up to this size make pairs in round two; larger ones are compared in blocks.
SMALL_GROUP = 8
BLOCK_U, BLOCK_V = 256, 1024
#: Shingles that a side of a block holds, about (some 12 MB of text; a longer text is a block of its own size).
BLOCK_SHINGLES = 2_000_000
#: A set that more than one in so many rows have is joined by broadcast; there are fewer of these.
HOT_SHARE = 1_000
#: Bits of the filter that spares the shuffle of texts without candidates (half a MB).
FILTER_BITS = 1 << 22

_drawn = np.random.default_rng(11)
_XOR = _drawn.integers(0, 2**64, REGISTERS, dtype=np.uint64)
_ODD = _drawn.integers(0, 2**64, REGISTERS, dtype=np.uint64) | np.uint64(1)


def shingle_sets(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes of each text, sorted, and their number."""
    hashes, counts = word_hashes(texts, NOT_SPACE)
    values, n = windows(hashes, counts, SHINGLE)
    return distinct_by_row(values, n)


def distinct_by_row(values: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    owner = owners(n)
    order = np.lexsort((values, owner))
    owner, values = owner[order], values[order]
    new = np.ones(len(values), bool)
    new[1:] = (values[1:] != values[:-1]) | (owner[1:] != owner[:-1])
    return values[new], np.bincount(owner[new], minlength=len(n))


def registers(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Compressed registers, one row of REGISTERS for each set; empty sets give zeros."""
    out = np.zeros((len(n), REGISTERS), np.uint16)
    some = np.flatnonzero(n)
    if not len(some):
        return out
    begins = (np.cumsum(n) - n)[some]
    smallest = np.empty((len(some), REGISTERS), np.uint64)
    for i in range(REGISTERS):
        smallest[:, i] = np.minimum.reduceat((values ^ _XOR[i]) * _ODD[i], begins)
    # Leading zeros through the exponent of a double: exact for the upper 53 bits, and a sketch
    # needs the same rule on both sides only.
    exponent = np.frexp(smallest.astype(np.float64))[1].astype(np.int64)
    zeros = np.clip(64 - exponent, 0, 63)
    shift = np.maximum(exponent - 1 - MANTISSA_BITS, 0).astype(np.uint64)
    mantissa = (smallest >> shift) & np.uint64((1 << MANTISSA_BITS) - 1)
    out[some] = (zeros << MANTISSA_BITS).astype(np.uint16) | mantissa.astype(np.uint16)
    return out


def chance_collision(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Probability that registers of two unrelated sets of these sizes agree.

    Minima of n uniform hashes have the density n (1-x)^(n-1). Two agree if both fall into one
    cell [2^-z (1 + j/2^m), 2^-z (1 + (j+1)/2^m)); the sum over cells of one z is close to
    2^-m times the integral of the product of the densities times the length of the binade.
    """
    total = np.zeros(len(a))
    for z in range(1, 64):
        low, high = 2.0**-z, 2.0 ** (1 - z)
        in_a = np.exp(a * np.log1p(-low)) - (np.exp(a * np.log1p(-high)) if high < 1 else 0)
        in_b = np.exp(b * np.log1p(-low)) - (np.exp(b * np.log1p(-high)) if high < 1 else 0)
        total += in_a * in_b
    return total / 2**MANTISSA_BITS


def estimated_jaccard(x: np.ndarray, y: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of equal registers, corrected for chance collisions."""
    equal = (x == y).mean(axis=1)
    chance = chance_collision(a.astype(float), b.astype(float))
    return np.clip((equal - chance) / (1 - chance), 0, 1)


_SKETCH = "doc_id bigint, n bigint, low bigint, high bigint, sketch binary"


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, low, high, sketch); low and high together identify the set."""

    def rows(batches):
        for batch in batches:
            for first, part in chunks(batch.column(1)):
                values, n = shingle_sets(part)
                ends = np.cumsum(n)
                sums = []
                for salt in (0x243F6A8885A308D3, 0x13198A2E03707344):
                    hashed = mix(values ^ np.uint64(salt))
                    running = np.concatenate([np.zeros(1, np.uint64), np.cumsum(hashed)])
                    sums.append((running[ends] - running[ends - n]).view(np.int64))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, len(part)),
                        pa.array(n.astype(np.int64)),
                        pa.array(sums[0]),
                        pa.array(sums[1]),
                        pa.array([r.tobytes() for r in registers(values, n)], pa.binary()),
                    ],
                    ["doc_id", "n", "low", "high", "sketch"],
                )

    return docs.select("doc_id", "text").mapInArrow(rows, _SKETCH)


def band_members(reps: DataFrame) -> DataFrame:
    """(key, id): one row for each band of each representative."""
    salts = mix(np.arange(1, BANDS + 1, dtype=np.uint64))

    def rows(batches):
        for batch in batches:
            if not len(batch):
                continue
            quads = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint64)
            keys = mix(quads.reshape(-1, BANDS) ^ salts).view(np.int64).ravel()
            ids = np.repeat(batch.column(0).to_numpy(), BANDS)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(ids)], ["key", "id"])

    return reps.select("doc_id", "sketch").mapInArrow(rows, "key bigint, id bigint")


def _estimate(pairs: DataFrame, reps: DataFrame) -> DataFrame:
    """Pairs whose sketches do not rule out the threshold."""

    def rows(frames):
        for frame in frames:
            if not len(frame):
                continue
            x = np.frombuffer(b"".join(frame["x"]), np.uint16).reshape(-1, REGISTERS)
            y = np.frombuffer(b"".join(frame["y"]), np.uint16).reshape(-1, REGISTERS)
            likely = estimated_jaccard(x, y, frame["na"].to_numpy(), frame["nb"].to_numpy())
            yield frame.loc[likely >= LEAST_ESTIMATE, ["a", "b"]]

    left = reps.select(F.col("doc_id").alias("a"), F.col("n").alias("na"), F.col("sketch").alias("x"))
    right = reps.select(F.col("doc_id").alias("b"), F.col("n").alias("nb"), F.col("sketch").alias("y"))
    joined = pairs.join(right, "b").join(left, "a").where("100 * least(na, nb) >= 75 * greatest(na, nb)")
    return joined.mapInPandas(rows, "a bigint, b bigint")


def confirmed(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full shingle sets reach the threshold."""

    def rows(batches):
        for batch in batches:
            kept_a, kept_b = [], []
            ids = [batch.column(i).to_pylist() for i in (0, 1)]
            right = batch.column(3)
            last_id, last_set = None, np.zeros(0, np.uint64)
            for first, part in chunks(right):
                values, n = shingle_sets(part)
                ends = np.cumsum(n)
                for i in range(len(part)):
                    a, b = ids[0][first + i], ids[1][first + i]
                    if a != last_id:
                        last_id, last_set = a, shingle_sets(batch.column(2).slice(first + i, 1))[0]
                    own = values[ends[i] - n[i] : ends[i]]
                    both = len(np.intersect1d(own, last_set, assume_unique=True))
                    if 100 * both >= 75 * (len(own) + len(last_set) - both):
                        kept_a.append(a)
                        kept_b.append(b)
            yield pa.RecordBatch.from_arrays(
                [pa.array(kept_a, pa.int64()), pa.array(kept_b, pa.int64())], ["a", "b"]
            )

    left = docs.select(F.col("doc_id").alias("a"), F.col("text").alias("left"))
    right = docs.select(F.col("doc_id").alias("b"), F.col("text").alias("right"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return joined.mapInArrow(rows, "a bigint, b bigint")


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of `docs` whose id is in `ids`, and a few others.

    A bitmap of hashed ids, of fixed size, reaches all tasks; with very many ids it
    lets everything pass and only saves less.
    """
    slot = F.pmod(F.xxhash64("id"), F.lit(FILTER_BITS))
    words = (
        ids.select(slot.alias("slot"))
        .groupBy((F.col("slot") / 32).cast("int").alias("word"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(slot % 32 as int)))").alias("v"))
        .toPandas()
    )
    bits = np.zeros(FILTER_BITS // 32, np.uint32)
    bits[words["word"]] = words["v"]

    def rows(batches):
        for batch in batches:
            at = batch.column(2).to_numpy()
            keep = (bits[at // 32] >> (at % 32).astype(np.uint32)) & 1
            found = batch.filter(pa.array(keep.astype(bool)))
            yield pa.RecordBatch.from_arrays([found.column(0), found.column(1)], ["doc_id", "text"])

    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER_BITS)).alias("slot")
    return docs.select("doc_id", "text", at).mapInArrow(rows, "doc_id bigint, text string")


def _confirm(pairs: DataFrame, docs: DataFrame, name: str) -> DataFrame:
    pairs = stored(pairs, f"{name}_pairs")
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b"))
    return stored(confirmed(pairs, stored(_with_ids(docs, ids), f"{name}_texts")), f"{name}_links")


def _groups(members: DataFrame) -> DataFrame:
    """(key, id, head) of the groups of several members.

    The head is the member that meets most others over all its bands (of equals the smallest):
    the original of a family of copies is nearer to each copy than the copies to each other.
    """
    sizes = members.groupBy("key").agg(F.count("*").alias("m"))
    groups = stored(members.join(sizes.where("m > 1"), "key"), "groups")
    meets = groups.groupBy("id").agg(F.sum("m").alias("meets"))
    placed = groups.select("key", "id").join(meets, "id")
    heads = placed.groupBy("key").agg(F.max(F.struct("meets", -F.col("id"))).alias("h"))
    return placed.select("key", "id").join(heads.select("key", (-F.col("h.col2")).alias("head")), "key")


def _star_pairs(groups: DataFrame) -> DataFrame:
    """Each member of a group with the group's smallest member."""
    pairs = groups.where("id <> head")
    return pairs.select(F.col("head").alias("a"), F.col("id").alias("b")).distinct()


def _cross_pairs(groups: DataFrame) -> DataFrame:
    """Pairs of different components within groups (key, id, component, first)."""
    u = groups.where("component <> first").select(
        "key", F.col("id").alias("a"), F.col("component").alias("ca"), "first"
    )
    v = groups.select("key", F.col("id").alias("b"), F.col("component").alias("cb"))
    pairs = u.join(v, "key").where("ca <> cb and (cb = first or a < b)")
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _mixed_groups(groups: DataFrame, first: DataFrame) -> DataFrame:
    """(key, id, component, first, m) of the groups of several components.

    `first` is the component of the head, m the size of the group.
    """
    own = first.select("id", F.col("component").alias("c"))
    of_head = first.select(F.col("id").alias("head"), F.col("component").alias("h"))
    placed = (
        groups.join(own, "id", "left")
        .join(of_head, "head", "left")
        .select(
            "key", "id", F.coalesce("c", "id").alias("component"), F.coalesce("h", "head").alias("first")
        )
    )
    sizes = placed.groupBy("key").agg(
        F.count("*").alias("m"), F.count_if(F.col("component") != F.col("first")).alias("u")
    )
    return placed.join(sizes.where("u > 0"), "key").select("key", "id", "component", "first", "m")


def block_links(u: pd.DataFrame, v: pd.DataFrame) -> tuple[list[int], list[int]]:
    """Links between two blocks of documents (id, component, sketch, text).

    Sketches that rule a pair out spare it; intersections of the others come from
    products of 0/1 matrices, a slice of the shingles at a time. One link for a document and
    component is enough.
    """
    values_u, n_u = shingle_sets(pa.array(u["text"], pa.string()))
    values_v, n_v = shingle_sets(pa.array(v["text"], pa.string()))
    x = np.frombuffer(b"".join(u["sketch"]), np.uint16).reshape(-1, REGISTERS)
    y = np.frombuffer(b"".join(v["sketch"]), np.uint16).reshape(-1, REGISTERS)
    apart = u["component"].to_numpy()[:, None] != v["component"].to_numpy()[None, :]
    near = 100 * np.minimum.outer(n_u, n_v) >= 75 * np.maximum.outer(n_u, n_v)
    pairs_u, pairs_v = np.nonzero(apart & near)
    likely = np.zeros(len(pairs_u), bool)
    for at in range(0, len(pairs_u), 65_536):
        i, j = pairs_u[at : at + 65_536], pairs_v[at : at + 65_536]
        likely[at : at + 65_536] = estimated_jaccard(x[i], y[j], n_u[i], n_v[j]) >= LEAST_ESTIMATE
    pairs_u, pairs_v = pairs_u[likely], pairs_v[likely]
    if not len(pairs_u):
        return [], []
    known, at_u = np.unique(values_u, return_inverse=True)
    at_v = np.searchsorted(known, values_v)
    common = (at_v < len(known)) & (known[np.minimum(at_v, len(known) - 1)] == values_v)
    row_u, row_v, at_v = owners(n_u), owners(n_v)[common], at_v[common]
    both = np.zeros((len(u), len(v)), np.float32)
    width = 4096
    for low in range(0, len(known), width):
        left = np.zeros((len(u), width), np.float32)
        right = np.zeros((len(v), width), np.float32)
        some = (at_u >= low) & (at_u < low + width)
        left[row_u[some], at_u[some] - low] = 1
        some = (at_v >= low) & (at_v < low + width)
        right[row_v[some], at_v[some] - low] = 1
        both += left @ right.T
    shared = both[pairs_u, pairs_v].astype(np.int64)
    linked = 100 * shared >= 75 * (n_u[pairs_u] + n_v[pairs_v] - shared)
    found = pd.DataFrame(
        {
            "a": u["id"].to_numpy()[pairs_u[linked]],
            "b": v["id"].to_numpy()[pairs_v[linked]],
            "c": v["component"].to_numpy()[pairs_v[linked]],
        }
    ).drop_duplicates(["a", "c"])
    return found["a"].tolist(), found["b"].tolist()


def _family_links(groups: DataFrame, reps: DataFrame, docs: DataFrame) -> DataFrame:
    """Links (a, b) in large groups, without making rows of pairs.

    All groups whose heads are in one component form a family. Its members outside of
    that component are compared with all its members, block by block; a block has a bounded
    number of documents, and every pair of blocks is a group of its own.
    """
    family = stored(groups.select("first", "id", "component").distinct(), "families")
    outside = F.col("component") != F.col("first")
    sizes = family.groupBy("first").agg(
        F.ceil(F.count_if(outside) / BLOCK_U).cast("int").alias("nu"),
        F.ceil(F.count("*") / BLOCK_V).cast("int").alias("nv"),
    )
    texts = _with_ids(docs, family.select("id")).withColumnRenamed("doc_id", "id")
    rows = family.join(sizes, "first").join(reps.select(F.col("doc_id").alias("id"), "sketch"), "id")
    rows = rows.join(texts, "id")
    place = F.xxhash64("id")
    u = rows.where(outside).select(
        "first", "id", "component", "sketch", "text", F.pmod(place, "nu").cast("int").alias("bu"),
        F.explode(F.sequence(F.lit(0), F.col("nv") - 1)).alias("bv"), F.lit(True).alias("is_u"),
    )
    v = rows.select(
        "first", "id", "component", "sketch", "text",
        F.explode(F.sequence(F.lit(0), F.col("nu") - 1)).alias("bu"),
        F.pmod(place, "nv").cast("int").alias("bv"), F.lit(False).alias("is_u"),
    )

    def compare(frame: pd.DataFrame) -> pd.DataFrame:
        a, b = block_links(frame[frame["is_u"]], frame[~frame["is_u"]])
        return pd.DataFrame({"a": pd.Series(a, dtype="int64"), "b": pd.Series(b, dtype="int64")})

    return u.unionByName(v).groupBy("first", "bu", "bv").applyInPandas(compare, "a bigint, b bigint")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) of each document; see the module's text."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    own = stored(sketches(docs), "sketches")
    same = ["n", "low", "high"]
    linked = (F.col("n") > 0) & F.col("doc_id").isNotNull()
    first_of = F.min(F.struct("doc_id", "sketch")).alias("first")
    classes = own.where(linked).groupBy(*same).agg(first_of, F.count("*").alias("rows"))
    classes = stored(classes.select("first.*", *same, "rows"), "reps")
    reps = classes.select("doc_id", "n", "sketch")
    groups = stored(_groups(band_members(reps)), "groups")
    links = _confirm(_estimate(_star_pairs(groups), reps), docs, "star")
    first = stored(components(links), "components")
    mixed = stored(_mixed_groups(groups, first), "mixed")
    small = F.col("m") <= SMALL_GROUP
    more = _confirm(_estimate(_cross_pairs(mixed.where(small)), reps), docs, "rest")
    last = stored(_family_links(mixed.where(~small), reps, docs), "family_links")
    final = stored(components(links.union(more).union(last)), "components")
    by_class = classes.select(F.col("doc_id").alias("id"), *same, "rows").join(final, "id", "left")
    by_class = stored(
        by_class.select(*same, "rows", F.coalesce("component", "id").alias("component_id")), "by_class"
    )
    # Copies of one text may be a third of all rows, so sets of many rows are not joined through a shuffle.
    total = by_class.agg(F.sum("rows")).first()[0] or 0
    hot = F.col("rows") * HOT_SHARE > total
    few = F.broadcast(by_class.where(hot).drop("rows"))
    rows = own.select("doc_id", *same)
    alone = rows.where(~linked).select("doc_id", "n", F.col("doc_id").alias("component_id"))
    copied = rows.where(linked).join(few, same).select(alone.columns)
    others = rows.where(linked).join(few, same, "left_anti").join(by_class.where(~hot), same).select(alone.columns)
    return alone.unionByName(copied).unionByName(others).select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("component_id") == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of `docs` without near duplicates: of each group, the row of the smallest id.

    Every row is judged by itself: of rows that repeat an id, or have none, and have near the same text one stays as well.
    Rows without words stay.
    """
    rows, row = numbered(docs)
    found = near_duplicates(rows.select(F.col(row).alias("doc_id"), "text"))
    dropped = stored(found.where("not kept").select(F.col("doc_id").alias(row)), "dropped")
    return rows.join(dropped, row, "left_anti").select(docs.columns)
