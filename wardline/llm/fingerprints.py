"""SimHash fingerprints and their search by permuted block tables.
DataFrame expressions only."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wardline.llm.common import range_bounds, range_of, ranges

BITS = 64
#: Words are what lies between white space; case is ignored.
SPACE = r"[\x20\x09-\x0D]+"
#: Two 32-bit vote counters share a long.
_LANES = 0x0000000100000001


def votes(rows: DataFrame, keys: list[str], text_col: str) -> DataFrame:
    """One row per distinct ``keys`` with ``fingerprint`` (64 bits as long).

    Every word votes with its 64-bit hash, weighted by its length: words that
    say little are short, and repeats add up.  Bit i is set if words with that
    bit weigh more than half of all.  Weights of a text sum to at most its
    length, under 2 ** 31, so two counters fit one long and 32 sums hold all 64
    bits.  Text without words: all bits clear."""
    words = rows.select(*keys, F.explode(F.split(F.lower(F.coalesce(text_col, F.lit(""))), SPACE)).alias("_word"))
    hashed = words.select(*keys, F.xxhash64("_word").alias("_h"), F.char_length("_word").cast("long").alias("_w"))
    lane = [F.sum(F.shiftrightunsigned("_h", i).bitwiseAND(F.lit(_LANES)) * F.col("_w")).alias(f"_b{i}") for i in range(32)]
    summed = hashed.groupBy(*keys).agg(F.sum("_w").alias("_all"), *lane)
    low = lambda i: F.col(f"_b{i}").bitwiseAND(F.lit(0xFFFFFFFF))
    high = lambda i: F.shiftrightunsigned(f"_b{i}", 32)
    bits = F.lit(0).cast("long")
    for i in range(32):
        for at, votes_for in ((i, low(i)), (i + 32, high(i))):
            value = (1 << at) if at < 63 else -(1 << 63)
            bits = bits.bitwiseOR(F.when(votes_for * 2 > F.col("_all"), F.lit(value)).otherwise(F.lit(0)).cast("long"))
    return summed.select(*keys, bits.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """Share of equal bits."""
    return F.lit(1.0) - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_hex(bits: Column) -> Column:
    return F.lower(F.lpad(F.hex(bits), 16, "0"))


def edited_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each text with its successor by id, in ranges of ids:
    ``range, nth, copy, doc_id, text, edited``.

    The edited text is the text whose last floor(n / 4) code points are
    replaced by the first as many (or all) of the next document; the last
    document's next is the first.  Ids are cut into ranges by quantiles, and
    the document that opens a range is also sent (``copy`` = 1) to the end of
    the range before it, so one shuffle brings each document to its successor.

    A null text is empty.  Rows that repeat an id follow each other, ordered by
    text.  Rows without an id have no next document: their edited text only
    loses its last quarter."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    n = ranges(docs.sparkSession, per_partition=2)
    bounds = range_bounds(rows, "doc_id", n)
    k = len(bounds)
    dealt = k + F.pmod(F.monotonically_increasing_id(), F.lit(n)).cast("int")  # rows without an id go anywhere
    opens = F.coalesce(F.col("doc_id").isin(bounds), F.lit(False)) if bounds else F.lit(False)
    before = F.struct(F.when(F.col("range") == 0, k - 1).otherwise(F.col("range") - 1).cast("int").alias("range"), F.lit(1).alias("copy"))
    itself = F.struct(F.col("range"), F.lit(0).alias("copy"))
    sent = rows.withColumn("range", F.when(F.col("doc_id").isNull(), dealt).otherwise(range_of(F.col("doc_id"), bounds)))
    sent = sent.withColumn("to", F.explode(F.when(opens, F.array(itself, before)).otherwise(F.array(itself))))
    sent = sent.select(F.col("to.range").alias("range"), F.col("to.copy").alias("copy"), "doc_id", "text").repartition(n, "range")
    order = Window.partitionBy("range").orderBy("copy", "doc_id", "text")
    following = F.when(F.col("doc_id").isNotNull(), F.lead("text").over(order))
    size = F.char_length("text")
    cut = F.floor(size / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), size - cut), F.substring(F.coalesce("next", F.lit("")), F.lit(1), cut))
    return (sent.withColumn("next", following).withColumn("nth", F.row_number().over(order))
            .select("range", "nth", "copy", "doc_id", "text", edited.alias("edited")))


def fingerprint_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: ``doc_id, n_chars, edited_sha256, fingerprint,
    edited_fingerprint`` (hex), ``near_edited, near_next`` and the raw 64 bits
    ``fingerprint_bits``.  Without an id ``near_next`` is null.  See ``edited_documents`` for nulls, ties and empty
    texts; an empty table gives no rows."""
    pairs = edited_documents(docs, id_col=id_col, text_col=text_col)
    keys = ["range", "nth", "copy", "doc_id", "n_chars", "edited_sha256", "kind"]
    both = pairs.select(
        "range", "nth", "copy", "doc_id", F.char_length("text").cast("long").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        F.explode(F.when(F.col("copy") == 0, F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body")),
                                                     F.struct(F.lit(1).alias("kind"), F.col("edited").alias("body"))))
                  .otherwise(F.array(F.struct(F.lit(0).alias("kind"), F.col("text").alias("body"))))).alias("one"))
    both = both.select(*keys[:-1], F.col("one.kind").alias("kind"), F.col("one.body").alias("body"))
    printed = votes(both, keys, "body")
    each = printed.groupBy(*keys[:-1]).agg(
        F.max(F.when(F.col("kind") == 0, F.col("fingerprint"))).alias("bits"),
        F.max(F.when(F.col("kind") == 1, F.col("fingerprint"))).alias("edited_bits"))
    following = F.when(F.col("doc_id").isNotNull(), F.lead("bits").over(Window.partitionBy("range").orderBy("nth")))
    return each.withColumn("next_bits", following).where(F.col("copy") == 0).select(
        "doc_id", "n_chars", "edited_sha256", as_hex(F.col("bits")).alias("fingerprint"),
        as_hex(F.col("edited_bits")).alias("edited_fingerprint"),
        likeness(F.col("bits"), F.col("edited_bits")).alias("near_edited"),
        likeness(F.col("bits"), F.col("next_bits")).alias("near_next"),
        F.col("bits").alias("fingerprint_bits"))


def block_tables(radius: int, blocks: int) -> list[tuple[int, ...]]:
    """Masks of the permuted tables: bits are cut into ``blocks`` blocks, and
    two fingerprints within ``radius`` bits agree on at least
    ``blocks - radius`` whole blocks, so on the blocks of at least one table."""
    if not 0 <= radius < blocks <= BITS:
        raise ValueError("blocks must exceed the radius")
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [sum(1 << b for b in range(lo, hi)) for lo, hi in zip(edges, edges[1:])]
    return [tuple(masks[i] for i in c) for c in combinations(range(blocks), blocks - radius)]


def within_radius(queries: DataFrame, prints: DataFrame, radius: int = 3, blocks: int = 6) -> DataFrame:
    """All fingerprints of ``prints`` within ``radius`` bits of a query's:
    ``query_fingerprint, fingerprint, distance``, distinct values of the long
    columns ``fingerprint``; join them to their documents as needed.

    One table per choice of blocks: fingerprints meet on the bits of its blocks
    (32 of 64 bits by default) and the distance is checked in full.  A pair is
    made by one table only, the first on whose blocks it agrees.  Equal
    fingerprints count once on either side, so copies add nothing.  Null
    fingerprints take no part."""
    def keyed(df: DataFrame, name: str) -> DataFrame:
        distinct = df.select(F.col("fingerprint").alias(name)).where(F.col(name).isNotNull()).distinct()
        entries = [F.struct(F.lit(t).alias("table"), F.col(name).bitwiseAND(F.lit(_signed(sum(masks)))).alias("key"))
                   for t, masks in enumerate(block_tables(radius, blocks))]
        return distinct.withColumn("e", F.explode(F.array(*entries))).select(name, "e.table", "e.key")

    differ = F.col("query_fingerprint").bitwiseXOR(F.col("fingerprint"))
    first = F.lit(None).cast("int")
    for t, masks in reversed(list(enumerate(block_tables(radius, blocks)))):
        first = F.when(differ.bitwiseAND(F.lit(_signed(sum(masks)))) == 0, F.lit(t)).otherwise(first)
    met = keyed(queries, "query_fingerprint").join(keyed(prints, "fingerprint"), ["table", "key"])
    return (met.withColumn("distance", F.bit_count(differ).cast("int"))
            .where((F.col("distance") <= radius) & (F.col("table") == first))
            .select("query_fingerprint", "fingerprint", "distance"))


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >= 1 << 63 else mask
