"""Document fingerprints by one-permutation MinHash with optimal densification.

Each shingle of five words is hashed once; the top bits name one of ``BINS`` bins and the least rest in each bin is kept.
An empty bin takes the value of the first filled bin on a probe sequence of its own that visits all bins (bin b goes
through ``j * step(b) mod 257 - 1``), so that any number of filled bins will do. Of each bin 8 low-order bits are kept,
eight bins in a long; two fingerprints agree in a bin by chance with probability 1/256, which the likeness corrects.

Everything is a DataFrame expression over one row, except for the next document: documents are dealt by ranges of doc_id
with one shuffle and see the next row in a window over their range; only the first document of a range meets the last of
the range before it in a join.

Defined results: a null text is an empty one; a text without words has a fingerprint of zeros, which is like another such
one (1) and unlike all others; a text of one to four words has one shingle, all its words; rows with equal doc_id follow
each other in order of their text; rows without doc_id come first; a single row is its own next one; an empty table gives
an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from .common import GAP, constants, range_bounds, range_bucket

BINS, LANE, PER_LONG = 256, 8, 8
WIDTH = 5
PROBES = 12
SPACES = " \t\n\x0b\x0c\r"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is computed once however often it is used."""
    return F.get(F.transform(F.array(value), lambda v: body(v)), F.lit(0))


def steps() -> list[int]:
    """Step of each bin's probe sequence, 1 to 256."""
    return [xxh64_intdigest(b.to_bytes(4, "little"), 1) % BINS + 1 for b in range(BINS)]


def shingles(text: Column, width: int = WIDTH) -> Column:
    """Hash of each shingle, repeats included; null for a text without words."""
    words = F.split(F.btrim(text, F.lit(SPACES)), GAP)
    hashed = F.transform(words, lambda w: F.xxhash64(w))

    def of(h: Column) -> Column:
        each = F.transform(F.sequence(F.lit(0), F.size(h) - width), lambda i: F.xxhash64(*[F.get(h, i + k) for k in range(width)]))
        return F.when(F.size(h) >= width, each).otherwise(F.array(F.xxhash64(h)))

    return F.when(F.btrim(text, F.lit(SPACES)) != "", let(hashed, of))


def right(value: Column, bits: Column | int) -> Column:
    """Shift to the right that keeps the sign; ``bits`` may be a column."""
    return F.call_function("shiftright", value, bits if isinstance(bits, Column) else F.lit(bits))


def one_bit(place: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("long"), place)


def below(place: Column) -> Column:
    """All bits below one."""
    return F.bitwise_not(F.call_function("shiftleft", F.lit(-1).cast("long"), place))


def lanes(hashes: Column) -> Column:
    """The 8 bits of each bin, densified; null without hashes."""
    step = steps()
    forth, back = constants(step, "int"), constants([pow(x, -1, BINS + 1) for x in step], "int")
    cut_at = constants([b % 41 for b in range(BINS)], "int")
    # the top byte of a hash, -128 to 127, is its bin; in sorted order a bin's hashes are together, the least first
    tops = lambda s: F.filter(s, lambda h, i: (i == 0) | (right(h, 56) != right(F.get(s, i - 1), 56)))

    def dense(m: Column) -> Column:
        zero = F.lit(0).cast("long")

        def word(w: int) -> Column:
            """Which of the bins 64 w to 64 w + 63 are filled."""
            return F.aggregate(m, zero, lambda a, h: F.when(right(h, 62) == w - 2, a.bitwiseOR(one_bit(right(h, 56).bitwiseAND(63).cast("int")))).otherwise(a))

        def ranked(bits: Column) -> Column:
            n = [F.bit_count(F.get(bits, F.lit(w))).cast("int") for w in range(4)]

            def filled(before: Column) -> Column:
                def value(b: Column) -> Column:
                    """Least hash of bin b, null if it is empty: as many filled bins are before it as bits below its own."""
                    word, bit = F.get(bits, right(b, 6)), one_bit(b.bitwiseAND(63))
                    return F.when(word.bitwiseAND(bit) != 0, F.get(m, F.get(before, right(b, 6)) + F.bit_count(word.bitwiseAND(below(b.bitwiseAND(63)))).cast("int")))

                def rest(b: Column) -> Column:
                    """The filled bin that comes first on the probe sequence of bin b, by its place on it."""
                    place = lambda h: (F.get(back, b) * (right(h, 56).cast("int") + 129)) % (BINS + 1)
                    return F.array_min(F.transform(m, lambda h: F.struct(place(h).alias("p"), h.alias("h"))))["h"]

                def lane(b: Column) -> Column:
                    probes = [value((F.get(forth, b) * j) % (BINS + 1) - 1) for j in range(1, PROBES + 1)]
                    # which 8 of the lower 48 bits depends on the bin, so that bins filled from the same one differ
                    return right(F.coalesce(value(b), *probes, rest(b)), F.get(cut_at, b)).bitwiseAND(255)

                return F.transform(F.sequence(F.lit(0), F.lit(BINS - 1)), lane)

            return let(F.array(F.lit(0), n[0], n[0] + n[1], n[0] + n[1] + n[2]), filled)

        return let(F.array(*[word(w) for w in range(4)]), ranked)

    return let(let(F.sort_array(hashes), tops), dense)


def packed(text: Column) -> Column:
    """array<long>: the fingerprint of a text, eight bins in a long; zeros for a text without words."""

    def pack(x: Column) -> Column:
        def long(w: Column) -> Column:
            out = F.get(x, w * PER_LONG)
            for i in range(1, PER_LONG):
                out = out.bitwiseOR(F.shiftleft(F.get(x, w * PER_LONG + i), LANE * i))
            return out

        return F.transform(F.sequence(F.lit(0), F.lit(BINS // PER_LONG - 1)), long)

    none = F.array_repeat(F.lit(0).cast("long"), BINS // PER_LONG)
    return F.coalesce(let(shingles(text), lambda h: F.when(h.isNotNull(), let(lanes(h), pack))), none)


def likeness(a: Column, b: Column) -> Column:
    """Estimated resemblance of two fingerprints, 0 to 1, without the agreement that is due to chance."""

    def differing(x: Column, y: Column) -> Column:
        v = x.bitwiseXOR(y)
        for shift in (4, 2, 1):  # the lowest bit of each byte becomes the OR of its bits
            v = v.bitwiseOR(F.shiftrightunsigned(v, shift))
        return F.bit_count(v.bitwiseAND(0x0101010101010101)).cast("int")

    met = 1 - F.aggregate(F.zip_with(a, b, differing), F.lit(0), lambda s, n: s + n) / F.lit(float(BINS))
    chance = 1.0 / (1 << LANE)
    none = lambda x: F.forall(x, lambda v: v == 0)
    return F.when(none(a) != none(b), 0.0).otherwise(F.greatest(F.lit(0.0), (met - chance) / (1 - chance)))


def hexed(print_: Column) -> Column:
    return F.array_join(F.transform(print_, lambda v: F.lpad(F.lower(F.hex(v)), 16, "0")), "")


def with_next(docs: DataFrame, rows: int = 2048) -> DataFrame:
    """(doc_id, text, print, next_text, next_print): each document and the one after it, the first after the last."""
    bounds = range_bounds(docs, "doc_id", rows)
    keyed = docs.withColumn("_range", range_bucket(F.col("doc_id"), bounds)).withColumn("print", packed(F.col("text")))
    order = [F.col("doc_id").asc_nulls_first(), F.col("text")]
    here = Window.partitionBy("_range").orderBy(*order)
    after = lambda c: F.lead(c).over(here)
    linked = keyed.withColumns({"next_text": after("text"), "next_print": after("print"), "_last": F.lead(F.lit(False), 1, True).over(here)})
    # the ranges themselves: at most as many rows as there are bounds
    source = docs.withColumn("_range", range_bucket(F.col("doc_id"), bounds))
    firsts = source.groupBy("_range").agg(F.min(F.struct(F.col("doc_id").isNotNull().alias("a"), F.col("doc_id").alias("b"), F.col("text").alias("c")))["c"].alias("next_text"))
    every = Window.orderBy("_range")
    chain = source.groupBy("_range").agg(F.count(F.lit(1)).alias("n"))
    chain = chain.select(F.lag("_range").over(every).alias("_before"), "_range").withColumn("_before", F.coalesce("_before", F.max("_range").over(Window.partitionBy())))
    heads = firsts.join(chain, "_range").select(F.col("_before").alias("_range"), F.col("next_text").alias("_text"), packed(F.col("next_text")).alias("_print"))
    # rows are dealt and sorted by range already: the few heads come to them
    pick = lambda far, near: F.when(F.col("_last"), F.col(far)).otherwise(F.col(near)).alias(near)
    return linked.join(heads, "_range", "left").select("doc_id", "text", "print", pick("_text", "next_text"), pick("_print", "next_print"))


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row."""
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    n = F.length("text")
    part = F.floor(n / 4).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), n - part), F.substring(F.col("next_text"), F.lit(1), part))
    out = with_next(plain).withColumn("n_chars", n.cast("long")).withColumn("_edited", edited)
    out = out.withColumn("edited_sha256", F.sha2("_edited", 256)).withColumn("_edited_print", packed(F.col("_edited")))
    return out.select("doc_id", "n_chars", "edited_sha256", hexed(F.col("print")).alias("fingerprint"), hexed(F.col("_edited_print")).alias("edited_fingerprint"), likeness(F.col("print"), F.col("_edited_print")).alias("near_edited"), likeness(F.col("print"), F.col("next_print")).alias("near_next"))
