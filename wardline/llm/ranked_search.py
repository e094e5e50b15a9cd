"""Ranked lexical search of many queries at once, with shared sub-queries.

The queries' terms are put into one order, and term sets that several queries
share are mined by replacing the most frequent neighbouring pair by a node, again
and again.  The nodes form a DAG over the terms.  For a block of documents every
node's partial scores are computed once, from its two parts, and each query
adds up the few nodes that are left of it."""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from wardline.llm.common import row_blocks, stored, text_batches
from wardline.llm.shingles import mix64, text_bytes

TOP = 20
#: Queries that are mined and evaluated together; more go in blocks.
QUERY_BLOCK = 4096
#: Documents whose accumulators are held at once, and bytes of text worked on at once.
DOC_BLOCK = 256
BLOCK_BYTES = 1 << 20
#: Candidates that a task holds before it drops those beaten by others.
HELD = 200_000
#: Parts that a query's candidates are ranked in before they meet.
PARTS = 32

TERM = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_TERM = np.zeros(256, bool)
_IS_TERM[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_NO_ID = np.iinfo(np.int64).max


def terms_of(text: str | None) -> list[bytes]:
    """UTF-8 of the terms: ASCII letters (lower case) and digits, and every
    character beyond ASCII.  Bytes do, as all of those characters' bytes are."""
    return [m.lower() for m in TERM.findall((text or "").encode("utf-8", "surrogatepass"))]


# -- the query-sharing DAG ----------------------------------------------------------
class Shared:
    """``terms``: the distinct terms, nodes 0 to len(terms)-1.  ``pairs``: the
    two parts of each further node.  ``queries``: per query its nodes, whose
    terms are together the query's terms with repeats."""

    def __init__(self, queries: list[list[bytes]]):
        held = Counter(t for q in queries for t in set(q))
        # shared terms first, so that shared sets are neighbours
        self.terms = sorted(held, key=lambda t: (-held[t], t))
        number = {t: i for i, t in enumerate(self.terms)}
        rows, owner = [], []
        for k, q in enumerate(queries):
            times = Counter(q)
            for level in range(1, max(times.values(), default=0) + 1):  # repeats: a set per level
                rows.append(sorted(number[t] for t, n in times.items() if n >= level))
                owner.append(k)
        self.pairs: list[tuple[int, int]] = []
        self._mine(rows)
        self.queries: list[list[int]] = [[] for _ in queries]
        for k, row in zip(owner, rows):
            self.queries[k] += row
        self._plan()

    def _mine(self, rows: list[list[int]]) -> None:
        """Replace the pair of neighbours that most rows hold by a node while
        one is held twice.  No row holds a node twice, so counts are rows."""
        where = defaultdict(set)
        for r, row in enumerate(rows):
            for pair in zip(row, row[1:]):
                where[pair].add(r)
        heap = [(-len(s), p) for p, s in where.items() if len(s) > 1]
        heapq.heapify(heap)
        while heap:
            n, pair = heapq.heappop(heap)
            held = where.get(pair, ())
            if len(held) < 2:
                continue
            if len(held) != -n:
                heapq.heappush(heap, (-len(held), pair))
                continue
            node = len(self.terms) + len(self.pairs)
            self.pairs.append(pair)
            touched = set()
            for r in sorted(held):
                row = rows[r]
                i = row.index(pair[0])
                for old, new in (((row[i - 1], row[i]), (row[i - 1], node)) if i else (None, None),
                                 ((row[i + 1], row[i + 2]), (node, row[i + 2])) if i + 2 < len(row) else (None, None)):
                    if old:
                        where[old].discard(r)
                        where[new].add(r)
                        touched.add(new)
                row[i:i + 2] = [node]
            del where[pair]
            for p in touched:
                if len(where[p]) > 1:
                    heapq.heappush(heap, (-len(where[p]), p))

    def _plan(self) -> None:
        """Nodes by level, so that a level is one array operation."""
        depth = [0] * len(self.terms)
        for a, b in self.pairs:
            depth.append(1 + max(depth[a], depth[b]))
        by_level = defaultdict(list)
        for i, (a, b) in enumerate(self.pairs):
            by_level[depth[len(self.terms) + i]].append((len(self.terms) + i, a, b))
        self.levels = [np.array(by_level[k], np.int64).T for k in sorted(by_level)]
        self.full = [k for k, q in enumerate(self.queries) if q]
        self.flat = np.array([n for q in self.queries for n in q], np.int64)
        self.starts = np.concatenate(([0], np.cumsum([len(self.queries[k]) for k in self.full])))[:-1].astype(np.int64)

    def scores(self, impacts: np.ndarray) -> np.ndarray:
        """Query scores (a row for each query that has terms) from the terms'
        impacts (terms x documents): every accumulator is added up once."""
        nodes = np.empty((len(self.terms) + len(self.pairs), impacts.shape[1]), np.int64)
        nodes[:len(self.terms)] = impacts
        for out, a, b in self.levels:
            nodes[out] = nodes[a] + nodes[b]
        return np.add.reduceat(nodes[self.flat], self.starts, axis=0)


# -- documents' terms -------------------------------------------------------------
class Lookup:
    """Finds the queries' terms among the terms of texts."""

    def __init__(self, terms: list[bytes]):
        size = max(map(len, terms), default=0)
        self.powers = mix64((np.arange(1, size + 1, dtype=np.uint64)) * _FACTOR) | np.uint64(1)
        self.sizes = np.array([len(t) for t in terms], np.int64)
        data = np.frombuffer(b"".join(terms), np.uint8)
        self.data, self.at = data, np.concatenate(([0], np.cumsum(self.sizes)))[:-1].astype(np.int64)
        hashes = self.hashes(data, self.at, self.sizes)
        self.order = np.argsort(hashes, kind="stable")
        self.hash = hashes[self.order]
        if len(np.unique(hashes)) != len(hashes):
            raise ArithmeticError("two query terms share a hash")

    def hashes(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Of terms that are no longer than the longest query term."""
        if not len(starts):
            return np.zeros(0, np.uint64)
        of = np.repeat(np.arange(len(starts)), sizes)
        place = np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        values = mix64(data[starts[of] + place].astype(np.uint64) + np.uint64(1)) * self.powers[place]
        return mix64(np.add.reduceat(values, np.cumsum(sizes) - sizes) + sizes.astype(np.uint64))

    def find(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """Per term of a text its number, or -1; equal hashes are compared byte by byte."""
        out = np.full(len(starts), -1, np.int64)
        some = np.flatnonzero(sizes <= len(self.powers))
        if not len(some) or not len(self.hash):
            return out
        h = self.hashes(data, starts[some], sizes[some])
        at = np.minimum(np.searchsorted(self.hash, h), len(self.hash) - 1)
        same = self.hash[at] == h
        some, term = some[same], self.order[at[same]]
        same = self.sizes[term] == sizes[some]
        some, term = some[same], term[same]
        if len(some):
            n = sizes[some]
            of, begin = np.repeat(np.arange(len(some)), n), np.cumsum(n) - n
            place = np.arange(len(of)) - begin[of]
            equal = np.logical_and.reduceat(data[starts[some][of] + place] == self.data[self.at[term][of] + place], begin)
            out[some[equal]] = term[equal]
        return out


def document_terms(column: pa.Array, lookup: Lookup) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """For blocks of rows: the rows' numbers of terms, and (row, term, times)."""
    data, bounds = text_bytes(column)
    for first, last in row_blocks(np.diff(bounds), BLOCK_BYTES):
        part = _LOWER[data[bounds[first]:bounds[last]]]
        edges = bounds[first:last + 1] - bounds[first]
        inside = np.concatenate(([False], _IS_TERM[part], [False]))
        begins = inside[1:-1] & ~inside[:-2]
        ends = inside[1:-1] & ~inside[2:]
        cut = edges[(edges > 0) & (edges < len(part))]  # terms end with their text
        begins[cut] = inside[1:-1][cut]
        ends[cut - 1] = inside[1:-1][cut - 1]
        starts = np.flatnonzero(begins)
        sizes = np.flatnonzero(ends) + 1 - starts
        counts = np.diff(np.searchsorted(starts, edges))
        found = lookup.find(part, starts, sizes)
        row = np.repeat(np.arange(last - first), counts)
        hit = found >= 0
        keys, times = np.unique(row[hit] * max(1, len(lookup.sizes)) + found[hit], return_counts=True)
        yield counts, keys // max(1, len(lookup.sizes)), keys % max(1, len(lookup.sizes)), times


def _postings(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lookup = Lookup(shared.value.terms)
        for batch in batches:
            at = 0
            for counts, row, term, times in document_terms(batch.column("text"), lookup):
                n = len(counts)
                offsets = pa.array(np.searchsorted(row, np.arange(n + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, n), pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(offsets, pa.array(term, pa.int32())), pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))],
                    ["doc_id", "n", "terms", "times"])
                at += n

    return run


def impacts(weights: np.ndarray, term: np.ndarray, times: np.ndarray, m: np.ndarray) -> np.ndarray:
    """A term's share of a document's score (integers)."""
    return weights[term] * (1_000_000_000 * times // (1000 * times + 12 * m))


def _best(shared, weights, n_docs: int, n_terms: int, top: int):
    """The task's ``top`` documents of each query."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan, w = shared.value, weights.value
        least = np.zeros(len(plan.full), np.int64)  # scores below the top-th are beaten
        held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        waiting = 0

        def settle():
            nonlocal held, waiting
            query, doc, score = (np.concatenate(c) for c in zip(*held))
            order = np.lexsort((doc, -score, query))
            query, doc, score = query[order], doc[order], score[order]
            begin = np.searchsorted(query, np.arange(len(plan.full)))
            nth = np.arange(len(query)) - begin[query]
            least[query[nth == top - 1]] = score[nth == top - 1]
            keep = nth < top
            held, waiting = [(query[keep], doc[keep], score[keep])], 0

        for batch in batches:
            ids = batch.column("doc_id").fill_null(_NO_ID).to_numpy()
            sizes = batch.column("n").to_numpy()
            starts = batch.column("terms").offsets.to_numpy()
            terms = batch.column("terms").values.to_numpy()
            times = batch.column("times").values.to_numpy()
            able = np.flatnonzero(np.diff(starts))
            for a in range(0, len(able), DOC_BLOCK):
                rows = able[a:a + DOC_BLOCK]
                counts = starts[rows + 1] - starts[rows]
                column = np.repeat(np.arange(len(rows)), counts)
                at = np.arange(len(column)) - np.repeat(np.cumsum(counts) - counts, counts) + np.repeat(starts[rows], counts)
                m = 100 - 25 + 25 * sizes[rows] * n_docs // n_terms
                grid = np.zeros((len(plan.terms), len(rows)), np.int64)
                grid[terms[at], column] = impacts(w, terms[at], times[at], m[column])
                scores = plan.scores(grid)
                query, doc = np.nonzero(scores >= np.maximum(least, 1)[:, None])
                held.append((query, ids[rows][doc], scores[query, doc]))
                waiting += len(query)
                if waiting > HELD:
                    settle()
        if held:
            settle()
            query, doc, score = held[0]
            yield pa.RecordBatch.from_arrays([pa.array(np.array(plan.full, np.int32)[query]), pa.array(doc, mask=doc == _NO_ID), pa.array(score)], ["query", "doc_id", "score"])

    return run


def rank_documents(docs: DataFrame, items: DataFrame, *, item_col: str = "item_id", query_col: str = "text", id_col: str = "doc_id",
                   text_col: str = "text", top: int = TOP, query_block: int = QUERY_BLOCK) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``top`` documents by score,
    equal scores by ascending id.

    Items come to the driver ``query_block`` at a time; a block's texts are
    parsed once into a stored table of the documents' counts of its terms.
    Tasks hold accumulators of ``DOC_BLOCK`` documents and send ``top``
    candidates a query; these are ranked in parts before they meet.

    Null texts have no terms.  Null document ids come last among equal scores;
    rows that repeat an id, and items that do, count each (an item's rows are
    told apart, with the same ``item_id``).  Items without terms, or whose terms
    no document holds, have no rows; neither have empty tables.  Other columns
    of the inputs play no part."""
    spark = docs.sparkSession
    rows = text_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")))
    out = None
    asked = items.select(F.col(item_col).alias("item_id"), F.col(query_col).alias("text"))
    id_type = asked.schema["item_id"].dataType
    block: list = []
    for r in asked.toLocalIterator():
        block.append(r)
        if len(block) == query_block:
            part = _rank_block(spark, rows, block, id_type, top)
            out, block = part if out is None else out.unionByName(part), []
    if block or out is None:
        part = _rank_block(spark, rows, block, id_type, top)
        out = part if out is None else out.unionByName(part)
    return out


def _rank_block(spark: SparkSession, rows: DataFrame, block: list, id_type, top: int) -> DataFrame:
    plan = Shared([terms_of(r.text) for r in block])
    shared = spark.sparkContext.broadcast(plan)  # one block of queries
    postings = stored(rows.mapInArrow(_postings(shared), "doc_id long, n long, terms array<int>, times array<long>"), "postings")
    n_docs, n_terms = postings.agg(F.count_if(F.col("n") > 0), F.coalesce(F.sum("n"), F.lit(0))).first()
    held = postings.select(F.explode("terms").alias("term")).groupBy("term").count().collect()
    df = np.zeros(len(plan.terms), np.int64)
    for r in held:
        df[r.term] = r["count"]
    weights = spark.sparkContext.broadcast(np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * n + 1))) for n in df.tolist()], np.int64))
    best = postings.where(F.size("terms") > 0).mapInArrow(_best(shared, weights, n_docs, n_terms, top), "query int, doc_id long, score long")
    order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
    part = F.pmod(F.xxhash64("doc_id"), F.lit(PARTS)).alias("part")
    for keys in (["query", "part"], ["query"]):
        nth = F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("int")
        best = (best.select("*", part) if "part" in keys else best).withColumn("rank", nth).where(F.col("rank") <= top)
        best = best.drop("rank", "part") if "part" in keys else best
    names = spark.createDataFrame([(k, r.item_id) for k, r in enumerate(block)], f"query int, item_id {id_type.simpleString()}")
    return best.join(F.broadcast(names), "query").select("item_id", "rank", "doc_id", "score")
