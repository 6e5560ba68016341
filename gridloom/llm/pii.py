"""Personal data by anchor expansion.

One Aho-Corasick pass over a text finds anchors: at-signs, plus signs, digits, schemes and identifier cues. From each
anchor a local parser reads outwards as far as its characters reach, settles the boundaries and validates: no pattern is
matched against the whole text, and each character is read a bounded number of times whatever the text.

Kinds, in the order in which spans are listed:

- ``email``, ``ip``, ``card``, ``phone``: the base grammar, leftmost and non-overlapping within a kind; a match that fails
  its validation (octets, Luhn, digit count) is dropped and still uses up its characters;
- ``account``: added by the method: an IBAN (mod 97), with a cue or without, and the identifier of at least six
  characters, four of them digits, that follows a cue word such as ``account`` or ``ssn``;
- ``login``: added by the method: the user part of ``scheme://user:password@host``.

Defined results: a null text is an empty one and has no spans; rows with equal doc_id are rows of their own; an empty
table gives an empty result; other columns are ignored by ``find_pii`` and kept by ``redact``. Positions are code points.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_map, set_batches, ship

KINDS = ("email", "ip", "card", "phone", "account", "login")
BASE = KINDS[:4]
#: Words that announce an identifier, lower case.
CUES = ("account", "acct", "iban", "passport", "ssn", "social security", "routing", "konto", "compte", "cuenta", "tax id", "driver license")

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"[0-9][ ().0-9-]+")
IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}")
AFTER_CUE = re.compile(r"(?: (?:number|no|nr|num|id))?\.?[:#=]? ?#?([A-Z0-9]{0,34}[0-9][A-Z0-9]{0,34}(?:[ -][A-Z0-9]{0,34}[0-9][A-Z0-9]{0,34}){0,8})(?![A-Za-z0-9])")
#: Ends at a slash, so before the next scheme: however many there are, each character is read once.
LOGIN = re.compile(r"[^\s/?#@:]++:[^\s/?#@]++(?=@)")
DIGITS = frozenset("0123456789")


@cache
def automaton() -> ahocorasick.Automaton:
    a = ahocorasick.Automaton()
    for d in DIGITS:
        a.add_word(d, ("digit", 1))
    a.add_word("@", ("at", 1))
    a.add_word("+", ("plus", 1))
    a.add_word("://", ("scheme", 3))
    for c in CUES:
        a.add_word(c, ("cue", len(c)))
    a.make_automaton()
    return a


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        v = ord(d) - 48
        if i % 2:
            v = v * 2 - 9 * (v > 4)
        total += v
    return total % 10 == 0


def iban_valid(value: str) -> bool:
    turned = value[4:] + value[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and (not part or int(part) <= 255)


def folded(text: str) -> str:
    """A-Z lower-cased, one character for one, so that positions hold."""
    return text.translate(FOLD) if not text.isascii() else text.lower()


FOLD = {c: c + 32 for c in range(65, 91)}


def find_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of each span, by kind in the order of KINDS, then by start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    done = dict.fromkeys(KINDS, 0)  # where the next match of a kind may begin
    ibans = 0
    for last, (what, length) in automaton().iter(folded(text)):
        at = last - length + 1
        if what == "digit":
            if at >= done["ip"]:
                chain = CHAIN.match(text, at)
                runs, at_run = chain.group().split("."), at
                for i in range(0, len(runs) - 3, 4):
                    four = runs[i : i + 4]
                    end = at_run + sum(map(len, four)) + 3
                    if all(map(octet, four)):
                        found["ip"].append((at_run, end))
                    at_run = end + 1
                done["ip"] = chain.end()
            if at >= done["card"]:
                m = CARD.match(text, at)
                end = m.end() if m else at + 1
                if m and end - at >= 13:
                    digits = m.group().replace(" ", "").replace("-", "")
                    if 13 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append((at, end))
                done["card"] = end
            if at >= ibans and 2 <= at:
                ibans = at + 1
                m = IBAN.match(text, at - 2) if text[at - 2 : at].isupper() and not text[at - 3 : at - 2].isalnum() else None
                if m:
                    end = iban_end(text, at - 2, m.end())
                    if end:
                        found["account"].append((at - 2, end))
                        ibans = end
        elif what == "at":
            start, low = at, done["email"]
            while start > low and text[start - 1] in LOCAL:
                start -= 1
            if start < at and (m := DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                done["email"] = m.end()
            # what was read on the left is never read again: a later match can't begin before this at-sign
            done["email"] = max(done["email"], at + 1)
        elif what == "plus":
            if at >= done["phone"] and (m := PHONE.match(text, at + 1)):
                end = m.end()
                while text[end - 1] not in DIGITS:
                    end -= 1
                if end >= at + 4:
                    n = sum(c in DIGITS for c in text[at:end])
                    if 9 <= n <= 15:
                        found["phone"].append((at, end))
                    done["phone"] = end
        elif what == "scheme":
            if at and text[at - 1].isalpha() and (m := LOGIN.match(text, last + 1)):
                found["login"].append((m.start(), m.end()))
        elif not text[at - 1 : at].isalnum():
            m = AFTER_CUE.match(text, last + 1)
            if m and len(m.group(1)) >= 6 and sum(c in DIGITS for c in m.group(1)) >= 4:
                found["account"].append(m.span(1))
    found["account"] = apart(found["account"])
    return [(k, a, b) for k in KINDS for a, b in found[k]]


def iban_end(text: str, start: int, end: int) -> int:
    """The longest end at a word boundary that makes a valid IBAN; 0 if none does."""
    while end - start >= 15:
        if not text[end : end + 1].isalnum():
            value = text[start:end].replace(" ", "")
            if 15 <= len(value) <= 34 and iban_valid(value):
                return end
        end -= 1
    return 0


def apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, those that overlap as one."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def listed(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


FOUND = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def find_pii(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans) of every row; the spans of all kinds."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts = {k: [] for k in BASE}
            sha, spans = [], []
            for t in b.column("text"):
                s = find_spans(t.as_py() or "")
                base = [x for x in s if x[0] in BASE]
                for k in BASE:
                    counts[k].append(sum(x[0] == k for x in base))
                sha.append(hashlib.sha256(listed(base).encode()).hexdigest())
                spans.append(listed(s))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), *[pa.array(counts[k], pa.int64()) for k in BASE], pa.array(sha, pa.string()), pa.array(spans, pa.string())], names=["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string").alias("text")), run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def masked(text: str) -> str:
    """Each span replaced by its kind in angle brackets; of overlapping ones the earliest, then longest, names the whole."""
    spans = sorted(((a, b, k) for k, a, b in find_spans(text)), key=lambda x: (x[0], -x[1]))
    if not spans:
        return text
    merged: list[list] = []
    for a, b, k in spans:
        if merged and a < merged[-1][1]:
            merged[-1][1] = max(merged[-1][1], b)
        else:
            merged.append([a, b, k])
    out, at = [], 0
    for a, b, k in merged:
        out += [text[at:a], f"<{k.upper()}>"]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with every span in ``text`` masked and ``n_chars``, where there is one, brought up to date. A null text stays null."""
    ship(docs.sparkSession)

    set_batches(docs.sparkSession)

    @F.pandas_udf("string")
    def mask(texts):
        return texts.map(lambda t: None if t is None else masked(t))

    out = docs.withColumn("text", mask("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out
