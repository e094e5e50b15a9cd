"""Near-duplicate documents: circulant MinHash, banding, exact verification."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wardline.llm.common import release_kept, stored, text_batches
from wardline.llm.components import components, merged
from wardline.llm.shingles import mix64, shingle_sets

SHINGLE = 5
#: Percent of the union that two sets must share.
PERCENT = 80
BAND_ROWS = 4
#: Chance that a pair exactly at the threshold meets in no band.
MISS = 1e-8
#: A shingle of at most so many unsettled nodes is counted pair by pair.
RARE = 16
_SIGMA = np.uint64(0x6A09E667F3BCC909)


def n_bands(percent: int, rows: int = BAND_ROWS, miss: float = MISS) -> int:
    return max(1, math.ceil(math.log(miss) / math.log1p(-((percent / 100) ** rows)))) if percent < 100 else 1


def circulant_signatures(sets: list[np.ndarray], coordinates: int) -> np.ndarray:
    """MinHash signatures (uint32, one row per non-empty set) from two
    permutations of the 2 ** 32 places: the first scatters the shingles, the
    second, shifted circularly by k, gives coordinate k as its minimum."""
    out = np.empty((len(sets), coordinates), np.uint32)
    at = 0
    while at < len(sets):
        end, total = at, 0
        while end < len(sets) and (end == at or total + len(sets[end]) <= 1 << 15):
            total += len(sets[end])
            end += 1
        starts = np.concatenate(([0], np.cumsum([len(s) for s in sets[at:end]])[:-1]))
        place = (mix64(np.concatenate(sets[at:end]) ^ _SIGMA) >> np.uint64(32)).astype(np.uint32)
        x, y = np.empty_like(place), np.empty_like(place)
        for k in range(coordinates):
            np.add(place, np.uint32(k), out=x)  # wraps: the circular shift
            for shift, factor in ((16, 0x7FEB352D), (15, 0x846CA68B)):
                np.right_shift(x, np.uint32(shift), out=y)
                np.bitwise_xor(x, y, out=x)
                np.multiply(x, np.uint32(factor), out=x)
            np.right_shift(x, np.uint32(16), out=y)
            np.bitwise_xor(x, y, out=x)
            out[at:end, k] = np.minimum.reduceat(x, starts)
        at = end
    return out


def _band_keys(signatures: np.ndarray, rows: int) -> np.ndarray:
    bands = signatures.reshape(len(signatures), -1, rows).astype(np.uint64)
    keys = np.broadcast_to(np.arange(1, bands.shape[1] + 1, dtype=np.uint64), bands.shape[:2]).copy()
    for r in range(rows):
        keys = mix64(keys * np.uint64(0x9E3779B97F4A7C15) + bands[:, :, r])
    return keys.view(np.int64)


def _set_key(s: np.ndarray) -> tuple[int, int]:
    d = xxhash.xxh3_128_digest(s.tobytes())
    return int.from_bytes(d[:8], "little", signed=True), int.from_bytes(d[8:], "little", signed=True)


def _prints(shingle: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_kept()
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                sets = list(shingle_sets(some.column("text"), shingle))
                keys = [_set_key(s) for s in sets]
                full = [i for i, s in enumerate(sets) if len(s)]
                lists: list = [None] * len(sets)
                if full:
                    for i, k in zip(full, _band_keys(circulant_signatures([sets[i] for i in full], bands * rows), rows)):
                        lists[i] = k
                yield pa.record_batch([
                    some.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()),
                    pa.array([k[0] for k in keys], pa.int64()), pa.array([k[1] for k in keys], pa.int64()),
                    pa.array(lists, pa.list_(pa.int64())), some.column("digest")],
                    names=["doc_id", "n_shingles", "hi", "lo", "bands", "digest"])

    return run


def _sets(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                sets = list(shingle_sets(some.column("text"), shingle))
                same = [i for i, k in enumerate(zip(some.column("hi").to_pylist(), some.column("lo").to_pylist()))
                        if _set_key(sets[i]) == k]
                yield pa.record_batch([some.column("id").take(pa.array(same, pa.int64())),
                                       pa.array([sets[i].tobytes() for i in same], pa.binary())], names=["id", "shingles"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column("x"), batch.column("y")):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * shared >= percent * (len(x) + len(y) - shared))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b")], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", percent: int = PERCENT,
                    shingle: int = SHINGLE, band_rows: int = BAND_ROWS, miss: float = MISS) -> DataFrame:
    """Per row: ``doc_id, n_shingles, component_id, kept``.

    Two documents are linked if their sets of ``shingle``-word shingles share
    at least ``percent`` % of their union; ``component_id`` is the smallest id
    that a document reaches over links, ``kept`` tells whether that is its own.

    1. Every text gives its set, the set's 128-bit digest and its band keys.
       Rows with equal sets are one node from here on, however many they are.
    2. Nodes that share a band key meet.  Shingles that only one of them has
       cannot be shared; nodes with too many such shingles leave, and pairs
       whose other shingles cannot reach the threshold are never made.
    3. In each bucket every node is checked against one node only, on full
       sets: the one with most shingles in common with others, which in a
       group of edited copies is (near) their original.
    4. Buckets whose nodes are then still in several components are finished
       exactly: nodes outside the bucket's largest component are checked
       against all nodes of other components there that their shingles allow.
       So a group of many near copies costs its size, not its square, and no
       link that could join two components goes unchecked.

    Texts without words (null, empty, blank) have 0 shingles and are linked
    with nothing.  Rows without an id take part; a component without any id
    has none, and its rows are kept.  Rows that repeat an id are told apart by
    their texts.  An empty table gives no rows."""
    rows = text_batches(docs).select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("digest"))
    bands = n_bands(percent, band_rows, miss)
    prints = stored(rows.mapInArrow(_prints(shingle, bands, band_rows),
                                    "doc_id long, n_shingles long, hi long, lo long, bands array<long>, digest long"), "prints")
    # a node's text is found by id and digest, so rows that share an id do not multiply
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest"))
    nodes = (prints.where("n_shingles > 0").groupBy("hi", "lo")
             .agg(F.min("doc_id").alias("rep"), first.getField("digest").alias("digest"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
             .withColumn("id", F.monotonically_increasing_id()))
    nodes = stored(nodes, "nodes")

    placed = nodes.select("id", F.explode("bands").alias("bucket"))
    several = placed.groupBy("bucket").agg(F.min("id").alias("low"), F.max("id").alias("top")).where("low <> top").select("bucket")
    met = stored(placed.join(several, "bucket"), "buckets")

    wanted = nodes.join(met.select("id").distinct(), "id").select("id", "rep", "hi", "lo", F.col("digest").alias("of"))
    texts = rows.join(wanted, F.col("doc_id").eqNullSafe(F.col("rep")) & (F.col("digest") == F.col("of"))).select("id", "hi", "lo", "text")
    sets = stored(texts.mapInArrow(_sets(shingle), "id long, shingles binary").dropDuplicates(["id"]), "sets")
    able = _able(nodes.select("id", "n"), sets, percent)
    met = stored(met.join(able, "id"), "buckets")

    best = met.groupBy("bucket").agg(F.max(F.struct("m", -F.col("id"))).alias("hub"), F.count("*").alias("k")).where("k > 1")
    best = best.select("bucket", (-F.col("hub.col2")).alias("hub"))
    hubs = met.join(best, "bucket").where("id = hub").select("bucket", F.col("id").alias("h"), F.col("n").alias("hn"), F.col("m").alias("hm"))
    pairs = met.join(hubs, "bucket").where("id <> h").where(_can_link("n", "m", "hn", "hm", percent))
    pairs = stored(pairs.select(F.least("id", "h").alias("a"), F.greatest("id", "h").alias("b")).distinct(), "pairs")

    known = stored(components(stored(_verified(pairs, sets, percent), "links")), "components")
    at = met.join(known, "id", "left").withColumn("component", F.coalesce("component", "id"))
    sizes = at.groupBy("bucket", "component").agg(F.count("*").alias("k"))
    largest = sizes.groupBy("bucket").agg(F.max(F.struct("k", "component")).alias("l"), F.count("*").alias("parts")).where("parts > 1")
    open_rows = stored(at.join(largest.select("bucket", F.col("l.component").alias("largest")), "bucket"), "buckets")
    more = _unsettled(open_rows, sets, percent).join(pairs, ["a", "b"], "left_anti")
    of_node = merged(known, stored(_verified(stored(more, "pairs"), sets, percent), "links"))
    labelled = nodes.select("id", "hi", "lo", "rep").join(of_node, "id", "left")
    labelled = labelled.withColumn("component", F.coalesce("component", "id"))
    lowest = labelled.groupBy("component").agg(F.min("rep").alias("component_id"))
    labelled = labelled.join(lowest, "component").select("hi", "lo", "component_id")
    out = prints.select("doc_id", "n_shingles", "hi", "lo").join(labelled, ["hi", "lo"], "left")
    out = out.withColumn("component_id", F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, batch.num_rows, 64):
            some = batch.slice(at, 64)
            sets = [np.frombuffer(x.as_buffer(), np.int64) for x in some.column("shingles")]
            ids = np.repeat(some.column("id").to_numpy(), [len(s) for s in sets])
            yield pa.record_batch([pa.array(ids), pa.array(np.concatenate(sets))], names=["id", "shingle"])


def _able(sizes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """``(id, n, m)`` of the nodes that can be linked at all: of a node's ``n``
    shingles only the ``m`` that some other candidate has too can be shared."""
    seen = sets.mapInArrow(_shingles, "id long, shingle long").groupBy("shingle").agg(F.count("*").alias("k"), F.min("id").alias("id"))
    alone = seen.where("k = 1").groupBy("id").agg(F.count("*").alias("own"))
    counted = sizes.join(sets.select("id"), "id").join(alone, "id", "left")
    counted = counted.withColumn("m", F.col("n") - F.coalesce("own", F.lit(0))).drop("own")
    return stored(counted.where(100 * F.col("m") >= percent * F.col("n")), "able")


def _can_link(nx: str, mx: str, ny: str, my: str, percent: int):
    """Whether sets of these sizes can reach the threshold: they share at most
    the smaller ``m``."""
    most = F.least(mx, my)
    return 100 * most >= percent * (F.col(nx) + F.col(ny) - most)


def _unsettled(open_rows: DataFrame, sets: DataFrame, percent: int, rare: int = RARE) -> DataFrame:
    """Pairs ``(a, b)`` of nodes in different components of a bucket that may
    still be linked; one of them is outside the bucket's largest component.

    Of their shingles, those that at most ``rare`` of these nodes have are
    counted pair by pair, which is at most ``rare`` pairs for each; of the
    others a pair shares at most as many as either has.  So a pair is made
    either in its bucket, if the frequent shingles alone could do, or by the
    rare shingles it shares."""
    nodes = stored(open_rows.groupBy("id").agg(F.first("component").alias("component"), F.first("n").alias("n"),
                                               F.max(F.col("component") != F.col("largest")).alias("out")), "open")
    held = sets.join(nodes.select("id"), "id").mapInArrow(_shingles, "id long, shingle long")
    few = held.groupBy("shingle").agg(F.count("*").alias("k")).where(F.col("k") <= rare)
    few = stored(held.join(few, "shingle"), "rare")
    less = few.groupBy("id").agg(F.count("*").alias("few"))
    nodes = nodes.join(less, "id", "left").withColumn("m", F.col("n") - F.coalesce("few", F.lit(0))).drop("few")
    nodes = stored(nodes, "open")

    at = open_rows.select("bucket", "id", "largest").join(nodes, "id")
    outside = at.where("component <> largest").select(
        "bucket", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    in_bucket = outside.join(at, "bucket").where("component <> cb and (component = largest or id < b)")
    in_bucket = in_bucket.where(_can_link("n", "m", "nb", "mb", percent)).select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))

    shared = few.where("k > 1").select("id", "shingle").join(nodes, "id")
    y = shared.where("out").select("shingle", F.col("id").alias("b"), F.col("component").alias("cb"), F.col("n").alias("nb"), F.col("m").alias("mb"))
    by_rare = y.join(shared, "shingle").where("component <> cb and (not out or id < b)")
    by_rare = by_rare.groupBy("id", "b", "n", "m", "nb", "mb").agg(F.count("*").alias("r"))
    most = F.col("r") + F.least("m", "mb")
    by_rare = by_rare.where(100 * most >= percent * (F.col("n") + F.col("nb") - most))
    return in_bucket.union(by_rare.select(F.least("id", "b").alias("a"), F.greatest("id", "b").alias("b"))).distinct()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets share enough."""
    x = sets.select(F.col("id").alias("a"), F.col("shingles").alias("x"))
    y = sets.select(F.col("id").alias("b"), F.col("shingles").alias("y"))
    joined = pairs.join(y, "b").join(x.join(pairs.select("a").distinct(), "a", "left_semi"), "a").select("a", "b", "x", "y")
    return joined.mapInArrow(_linked(percent), "a long, b long")
