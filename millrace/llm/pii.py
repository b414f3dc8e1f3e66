"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs, the dot before a digit, the plus sign before
a digit, digits that open a number, schemes (``://``) and identifier cues (``iban``, ``passport``, ``password=`` and
so on). From each anchor a deterministic local parser expands to the left and right and validates what it finds:
emails and addresses from at-signs and dots, phones from plus signs, cards from digits (Luhn), addresses with
credentials from schemes, and accounts and credentials from cues.

The parsers of email, ip, card and phone return exactly the leftmost non-overlapping matches of their patterns, less
those that fail validation. The further kinds only add spans:

* ``url`` - ``scheme://user:secret@host`` (the part up to the white space after the host);
* ``account`` - a cue for an account or identity document, then at most three separators, then a token of 5 to 34
  letters and digits with at least 4 digits;
* ``credential`` - a cue with ``=`` or ``:`` and then a token of at least 6 characters, or an access key identifier.

Positions are code points, the end exclusive. Null texts count as empty; very long texts are read whole; each row of
the input gets one row.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: In the order in which spans are listed.
KINDS = ("email", "ip", "card", "phone", "url", "account", "credential")
BASE = KINDS[:4]
ACCOUNT_CUES = ("iban", "account", "acct", "konto", "kontonummer", "compte", "cuenta", "passport", "passeport", "reisepass", "pasaporte", "ssn")
CREDENTIAL_CUES = ("password", "passwd", "api_key", "apikey", "secret", "token")
ACCESS_KEYS = ("AKIA", "ASIA")

DIGITS = frozenset("0123456789")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LABEL = re.compile(r"[A-Za-z0-9-]+")
IN_PHONE = re.compile(r"[\x20().0-9-]*")
NUMBER = re.compile(r"[0-9]+")
CHAIN = re.compile(r"[0-9](?:[\x20-]?[0-9])*")
ACCOUNT = re.compile(
    r"[a-z]{0,8}(?:[\x20:#=.]{1,3}(?:number|nummer|no|nr|num))?[\x20:#=.]{1,3}"
    r"([A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])|[A-Za-z0-9-]{5,34}(?![A-Za-z0-9-]))"
)
CREDENTIAL = re.compile(r"[\x20]?[=:][\x20]?([A-Za-z0-9_+/.=-]{6,})")
ACCESS_KEY = re.compile(r"A[KS]IA[A-Z0-9]{16}(?![A-Za-z0-9])")
USERINFO = re.compile(r"[A-Za-z0-9._~%!$&'()*+,;=-]+:[^\s@/]+@[A-Za-z0-9.-]+(?::[0-9]+)?[^\s]*")


@lru_cache(maxsize=1)
def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    out.add_word("@", "@")
    out.add_word("://", "url")
    for d in sorted(DIGITS):
        out.add_word(d, "digit")
    for cue in ACCOUNT_CUES:
        for x in {cue, cue.upper(), cue.capitalize()}:
            out.add_word(x, cue)
    for cue in CREDENTIAL_CUES:
        for x in {cue, cue.upper(), cue.capitalize()}:
            out.add_word(x, "credential")
    for x in ACCESS_KEYS:
        out.add_word(x, "key")
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def _email(text: str, at: int, floor: int) -> tuple[int, int] | None:
    """The match around the at-sign at ``at``; nothing before ``floor`` is free."""
    start = at
    while start > floor and text[start - 1] in LOCAL:
        start -= 1
    m = LABEL.match(text, at + 1)
    if start == at or not m:
        return None
    end, labels = m.end(), 0
    while end < len(text) and text[end] == "." and (m := LABEL.match(text, end + 1)):
        end, labels = m.end(), labels + 1
    return (start, end) if labels else None


def _small(part: str) -> bool:
    return len(part) <= 3 and int(part) <= 255 or len(p := part.lstrip("0")) <= 3 and int(p or "0") <= 255


def spans(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) of everything found, in the order of KINDS, then of start."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    text = text or ""
    emailed = card_to = ip_to = 0
    for last, what in _automaton().iter(text):
        if what == "@":
            if span := _email(text, last, emailed):
                found["email"].append(span)
                emailed = span[1]
        elif what == "digit":
            if last and text[last - 1] == "+" and (m := IN_PHONE.match(text, last + 1)):
                end = m.end()
                while end > last + 2 and text[end - 1] not in DIGITS:
                    end -= 1
                if end >= last + 3 and 9 <= sum(c in DIGITS for c in text[last:end]) <= 15:
                    found["phone"].append((last - 1, end))
            if last >= card_to:
                m = CHAIN.match(text, last)
                card_to = m.end()
                if 13 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
                    found["card"].append(m.span())
            if last >= ip_to:
                parts, end = [], last
                while len(parts) < 4 and (m := NUMBER.match(text, end)):
                    parts.append(m[0])
                    end = m.end()
                    if len(parts) == 4 or end >= len(text) or text[end] != ".":
                        break
                    end += 1
                if len(parts) == 4:
                    ip_to = end
                    if all(map(_small, parts)):
                        found["ip"].append((last, end))
                else:
                    # No later start within these numbers can reach a fourth.
                    ip_to = end
        elif what == "url":
            start = last - 3
            while start >= 0 and text[start].isalpha() and text[start].isascii():
                start -= 1
            if start + 1 < last - 2 and (m := USERINFO.match(text, last + 1)):
                found["url"].append((start + 1, m.end()))
        elif what in ACCOUNT_CUES:
            begins = last - len(what)
            m = ACCOUNT.match(text, last + 1)
            if m and not (begins >= 0 and text[begins].isalpha()) and sum(c in DIGITS for c in m[1]) >= 4:
                found["account"].append(m.span(1))
        elif what == "credential":
            if m := CREDENTIAL.match(text, last + 1):
                found["credential"].append(m.span(1))
        elif m := ACCESS_KEY.match(text, last - 3):
            found["credential"].append(m.span())
    return [(k, *s) for k in KINDS for s in sorted(set(found[k]))]


def redacted(text: str | None, label: str = "[{}]") -> str | None:
    """The text with every span replaced by its kind; of overlapping spans the first, then the longest, stands."""
    if not text:
        return text
    out, at = [], 0
    for k, s, e in sorted(spans(text), key=lambda x: (x[1], -x[2])):
        if s >= at:
            out += [text[at:s], label.format(k.upper())]
            at = e
        elif e > at:
            at = e  # the rest of an overlap goes too
    return "".join(out) + text[at:]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [spans(x) for x in b.column(1).to_pylist()]
        join = lambda r: ",".join(f"{k}:{s}:{e}" for k, s, e in r)
        counts = [pa.array([sum(x[0] == k for x in r) for r in rows], pa.int64()) for k in BASE]
        digest = [hashlib.sha256(join([x for x in r if x[0] in BASE]).encode()).hexdigest() for r in rows]
        yield pa.RecordBatch.from_arrays([b.column(0), *counts, pa.array(digest, pa.string()), pa.array([join(r) for r in rows], pa.string())], ["doc_id", *[f"n_{k}" for k in BASE], "base_sha256", "spans"])


def scan(docs: DataFrame) -> DataFrame:
    """A row per row of ``docs``: doc_id, counts of the base kinds, digest of the base spans, all spans."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string"
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_scan, schema)


def redact(docs: DataFrame) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by its kind; ``n_chars``, where there is one, follows the text."""


    def run(x: pa.Array) -> pa.Array:
        return pa.array([redacted(t) for t in x.to_pylist()], pa.string())

    out = docs.withColumn("text", F.arrow_udf(run, "string")(F.col("text").cast("string")))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(common.table(spark, sf_dir, "documents"))
