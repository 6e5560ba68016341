"""Language identification by prediction by partial matching.

For each language a context tree over bytes counts which byte follows which context, up to ``order`` bytes long. A byte
seen ``c`` times in a context with ``t`` bytes and ``d`` different ones costs ``-log2(c / (t + d))`` bits; an unseen one
costs the escape ``-log2(d / (t + d))`` and is then coded in the next shorter context (escape method C), down to a
uniform code over 256 bytes. The statistics are frozen after training, so that the code length of a text under each
language is exact and doesn't depend on what is scored before it. The language with the shortest code wins.

Training reads a bounded sample of labelled rows: documents are taken in an order given by a hash of their text until a
language has ``train_bytes`` bytes (default 1,000,000; all languages together ``MOST_BYTES``, and ``MOST_LANGS`` languages
at most, those of most bytes), the documented bounds. Everything is scored, whole.

Scoring is vectorised: the trees of all languages are merged into one table that maps an n-gram (context and byte) to
the vector of its code lengths in all languages, escapes resolved; a contextual miss falls back one order at a time.

Defined results: a null text, or one without any letter, gets ``und`` and score 0; rows with equal doc_id are rows of
their own; ties between languages go to the first by code point; with no labelled row at all every text gets ``und``;
an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, ship, slices, text_buffer, whole_rows

UNKNOWN = "und"
#: Of all languages together; with more than 64 each has a smaller sample. Languages beyond the number are those of least bytes.
MOST_BYTES, MOST_LANGS = 64 << 20, 256


@dataclass
class Level:
    """Sorted-free exact lookup of the n-grams of one length: two hash functions, one slot each in a table."""

    keys: np.ndarray  # of both halves; 0 is free, as keys are stored plus 1
    rows: np.ndarray
    bits: int
    mult: tuple[int, int]

    @classmethod
    def build(cls, keys: np.ndarray) -> Level:
        """Linear probing would need loops of unknown length; instead the table grows until every key has a slot of its two."""
        bits = max(4, int(2 * len(keys)).bit_length())
        rng = np.random.default_rng(7)
        while True:
            for _ in range(4):
                mult = tuple(int(x) | 1 for x in rng.integers(1 << 62, 1 << 63, 2, dtype=np.uint64))
                table, rows = np.zeros(2 << bits, np.uint64), np.zeros(2 << bits, np.int32)
                todo = np.arange(len(keys), dtype=np.int64)
                side = np.zeros(len(keys), np.int64)
                for _ in range(200):  # cuckoo: who is pushed out goes to the other side
                    slot = cls.slot(keys[todo], bits, mult, side[todo])
                    out = table[slot] > 0
                    pushed = rows[slot][out].astype(np.int64)
                    table[slot], rows[slot] = keys[todo] + np.uint64(1), todo
                    won = rows[slot] == todo
                    pushed = np.unique(np.concatenate([pushed, todo[~won]]))
                    where = cls.slot(keys[pushed], bits, mult, side[pushed])
                    pushed = pushed[rows[where] != pushed]
                    pushed = pushed[table[where] > 0] if len(pushed) else pushed
                    side[pushed] ^= 1
                    todo = pushed
                    if not len(todo):
                        return cls(table, rows, bits, mult)
            bits += 1

    @staticmethod
    def slot(keys: np.ndarray, bits: int, mult: tuple[int, int], side) -> np.ndarray:
        m = np.where(side, np.uint64(mult[1]), np.uint64(mult[0])) if isinstance(side, np.ndarray) else np.uint64(mult[side])
        return ((keys + np.uint64(1)) * m >> np.uint64(64 - bits)).astype(np.int64) + (side << bits if isinstance(side, np.ndarray) else int(side) << bits)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Row of each key, -1 if it isn't there."""
        a = self.slot(keys, self.bits, self.mult, 0)
        want = keys + np.uint64(1)
        out = np.where(self.keys[a] == want, self.rows[a], -1)
        left = np.flatnonzero(out < 0)
        b = self.slot(keys[left], self.bits, self.mult, 1)
        out[left] = np.where(self.keys[b] == want[left], self.rows[b], -1)
        return out


@dataclass
class Model:
    langs: list[str]
    order: int
    levels: list[Level]  # of n-grams of 1..order+1 bytes
    cost: list[np.ndarray]  # bits for each n-gram and language
    contexts: list[Level]  # of contexts of 1..order bytes
    escape: list[np.ndarray]
    base: np.ndarray  # bits of a byte never seen, by language

    def lengths(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Bits of each text under each language."""
        n, langs = len(data), len(self.langs)
        if not n:
            return np.zeros((len(offsets) - 1, langs))
        total = np.empty((n, langs), np.float32)
        into = np.minimum(np.arange(n) - np.repeat(offsets[:-1], np.diff(offsets)), self.order)  # context there is
        key = np.zeros(n, np.uint64)
        keys = []
        for k in range(self.order + 1):  # keys[k]: k bytes of context and the byte, most recent byte lowest
            shifted = data.astype(np.uint64)
            key = key | (np.concatenate([np.zeros(k, np.uint64), shifted[: n - k]]) << np.uint64(8 * k)) if k else shifted
            keys.append(key)
        owed = np.zeros((n, langs), np.float32)
        todo = np.arange(n)
        for k in range(self.order, -1, -1):
            enough = into[todo] >= k
            at = todo[enough]
            row = self.levels[k].find(keys[k][at])
            hit = row >= 0
            total[at[hit]] = owed[at[hit]] + self.cost[k][row[hit]]
            miss = at[~hit]
            if k and len(miss):
                ctx = self.contexts[k - 1].find(keys[k][miss] >> np.uint64(8))
                known = ctx >= 0
                owed[miss[known]] += self.escape[k - 1][ctx[known]]
            elif not k:
                total[miss] = owed[miss] + self.base
            todo = np.sort(np.concatenate([todo[~enough], miss]))
        sums = np.zeros((len(offsets) - 1, langs))
        full = np.flatnonzero(np.diff(offsets))
        sums[full] = np.add.reduceat(total, offsets[:-1][full], axis=0, dtype=np.float64)
        return sums


def train(samples: dict[str, list[bytes]], order: int = 4) -> Model:
    """A model of the texts of each language."""
    langs = sorted(samples)
    if not langs:
        return Model([], order, [], [], [], [], np.zeros(0, np.float32))
    seen: list[list[tuple[np.ndarray, np.ndarray]]] = []  # by length, by language: n-grams and counts
    for k in range(order + 1):
        seen.append([])
        for lang in langs:
            grams = []
            for t in samples[lang]:
                d = np.frombuffer(t, np.uint8).astype(np.uint64)
                if len(d) > k:
                    key = np.zeros(len(d) - k, np.uint64)
                    for j in range(k + 1):
                        key |= d[k - j : len(d) - j] << np.uint64(8 * j)
                    grams.append(key)
            seen[k].append(np.unique(np.concatenate(grams), return_counts=True) if grams else (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
    base = np.zeros(len(langs), np.float32)
    levels, cost, contexts, escape = [], [], [], []
    for k in range(order + 1):
        every = np.unique(np.concatenate([g for g, _ in seen[k]]))
        ctx_every = np.unique(every >> np.uint64(8)) if k else np.zeros(1, np.uint64)
        bits, esc = np.zeros((len(every), len(langs)), np.float32), np.zeros((len(ctx_every), len(langs)), np.float32)
        for i, (grams, counts) in enumerate(seen[k]):
            ctx = np.searchsorted(ctx_every, grams >> np.uint64(8) if k else np.zeros(len(grams), np.uint64))
            t = np.bincount(ctx, counts, len(ctx_every))
            d = np.bincount(ctx, minlength=len(ctx_every))
            with np.errstate(divide="ignore", invalid="ignore"):
                esc[:, i] = np.where(t > 0, np.log2((t + d) / np.maximum(d, 1)), 0)
            if not k:
                base[i] = esc[0, i] + 8
            mine = np.full(len(every), -1)
            mine[np.searchsorted(every, grams)] = np.arange(len(grams))
            own = mine >= 0
            at = mine[own]
            bits[own, i] = -np.log2(counts[at] / (t + d)[ctx[at]])
            other = np.flatnonzero(~own)
            if not k:
                bits[other, i] = base[i]
            else:  # escape, then the next shorter context, already resolved
                shorter = levels[k - 1].find(every[other] & np.uint64((1 << 8 * k) - 1))
                bits[other, i] = esc[np.searchsorted(ctx_every, every[other] >> np.uint64(8)), i] + cost[k - 1][shorter, i]
        levels.append(Level.build(every))
        cost.append(bits)
        if k:
            contexts.append(Level.build(ctx_every))
            escape.append(esc)
    return Model(langs, order, levels, cost, contexts, escape, base)


def sample(docs: DataFrame, eligible: Column, train_bytes: int, most_langs: int = MOST_LANGS) -> dict[str, list[bytes]]:
    """Texts of each language in the order of a hash of the text, up to ``train_bytes`` bytes; the last may be cut there.

    Copies count once. What share of the hashes to read is set from the languages' bytes, so that the driver reads about
    ``train_bytes`` for each and at least the first text.
    """
    rows = docs.where(eligible & F.col("lang").isNotNull() & (F.octet_length("text") > 0)).select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    rows = rows.withColumn("place", F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / float(1 << 30))
    size = F.least(F.octet_length("text"), F.lit(train_bytes))
    distinct = rows.groupBy("lang", "place").agg(F.min(size).alias("size"))
    sizes = distinct.groupBy("lang").agg(F.sum("size").alias("size"), F.min("place").alias("first")).orderBy(F.desc("size"), "lang").limit(most_langs).collect()
    if not sizes:
        return {}
    train_bytes = min(train_bytes, MOST_BYTES // len(sizes))
    share = F.create_map(*[x for r in sizes for x in (F.lit(r["lang"]), F.lit(max(r["first"] + 1e-12, min(1.0, 1.2 * train_bytes / r["size"] + 1e-9))))])
    got = rows.where(F.col("place") < share[F.col("lang")]).select("lang", F.substring("text", 1, train_bytes).alias("text"), "place").distinct()
    out: dict[str, list[bytes]] = {r["lang"]: [] for r in sizes}
    left = dict.fromkeys(out, train_bytes)
    for r in sorted(got.toLocalIterator(), key=lambda r: (r["lang"], r["place"], r["text"])):
        t = r["text"].encode("utf-8", "surrogatepass")[: left[r["lang"]]]
        left[r["lang"]] -= len(t)
        if t:
            out[r["lang"]].append(t)
    return out


def held_out() -> Column:
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def predict(docs: DataFrame, model: Model, keep: bool = False) -> DataFrame:
    """(doc_id, lang_pred, score, bits_per_byte) of every row; with ``keep``, ``row`` (all columns of ``docs``) for doc_id.

    The score is the winner's posterior under equal priors, with code lengths per 32 bytes for texts longer than that.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(model)  # bounded: n-grams of the bounded sample
    name = "row" if keep else "doc_id"
    own = whole_rows(docs).alias("row") if keep else F.col("doc_id").cast("long")
    source = docs.select(own, F.col("text").cast("string").alias("text"))
    field = f"{name} {source.schema[name].dataType.simpleString()}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for whole in batches:
            for b in slices(whole, "text", 1 << 19):
                texts = b.column("text")
                bits = np.zeros((b.num_rows, 0))
                known = np.zeros(b.num_rows, bool)
                data, offsets = text_buffer(texts)
                size = np.maximum(np.diff(offsets), 1)
                pred, score, rate = np.full(b.num_rows, UNKNOWN, object), np.zeros(b.num_rows), np.full(b.num_rows, np.nan)
                if m.langs:
                    bits = m.lengths(data, offsets)
                    known = np.array([t is not None and has_letter(t) for t in texts.to_pylist()], bool)
                    best = bits.argmin(axis=1)
                    least = bits[np.arange(len(best)), best]
                    gap = (bits - least[:, None]) / np.maximum(1, size / 32)[:, None]
                    pred[known] = np.array(m.langs, object)[best[known]]
                    score[known] = (1 / np.exp2(-gap).sum(axis=1))[known]
                    rate[known] = (least / size)[known]
                yield pa.RecordBatch.from_arrays([b.column(name), pa.array(pred, pa.string()), pa.array(score), pa.array(rate)], names=[name, "lang_pred", "score", "bits_per_byte"])

    return arrow_map(source, run, f"{field}, lang_pred string, score double, bits_per_byte double")


def identify(docs: DataFrame, order: int = 4, train_bytes: int = 1_000_000) -> DataFrame:
    """Train on the labelled documents that aren't held out, then predict every one."""
    model = train(sample(docs, ~held_out() | F.col("doc_id").isNull(), train_bytes), order)
    out = predict(docs, model)
    return out.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "lang_pred", "score", "bits_per_byte")


def accepted(docs: DataFrame, order: int = 4, train_bytes: int = 1_000_000, most_bits: float = 8.0) -> DataFrame:
    """The rows of ``docs`` in a language that the model knows: those with a letter that it codes in under ``most_bits`` bits a byte."""
    model = train(sample(docs, ~held_out() | F.col("doc_id").isNull(), train_bytes), order)
    kept = predict(docs, model, keep=True).where((F.col("lang_pred") != UNKNOWN) & (F.col("bits_per_byte") < most_bits))
    return kept.select("row.*")
