"""Secret scans: patterns of known shape, and unusually random strings found by windowed entropy.

A candidate is a run of the characters a key is written in. A window slides over it; the counts of the
characters in the window are updated by one in, one out, and with them the sum of n * log2(n), which gives
the window's Shannon entropy. A candidate is a secret if one of its windows reaches the limit of its character
class and is not cleared: the allow list knows a piece in it, or its letters read like words. The limits follow
from the distribution of the entropy of random strings.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from diffgauge.llm.common import slices, texts_of

# fixed values: the patterns of known shape and the least lengths
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
                    re.IGNORECASE | re.ASCII)
ASSIGN_LEAST = 6
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
ACCESS_LEAST = 20
HEX = re.compile(r"[0-9a-f]{24,}")
KINDS = ("assign", "access", "hex", "entropy")
_KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")

CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
PIECE = re.compile(r"[A-Za-z0-9+]+")
WINDOW = 20
MISSED = 0.001          # share of the random windows of a class that lie below its limit


def _partitions(n: int, most: int) -> Iterator[list[int]]:
    """The ways to write ``n`` as a sum of falling numbers up to ``most``."""
    if n == 0:
        yield []
    for k in range(min(n, most), 0, -1):
        for rest in _partitions(n - k, k):
            yield [k, *rest]


def limit_of(letters: int, window: int = WINDOW, missed: float = MISSED) -> float:
    """The entropy that all but ``missed`` of the random strings over so many letters reach, exactly."""
    shares = []
    for counts in _partitions(window, window):
        if len(counts) <= letters:
            ways = math.factorial(window) * math.perm(letters, len(counts))
            for n in counts:
                ways //= math.factorial(n)
            for n in set(counts):
                ways //= math.factorial(counts.count(n))
            shares.append((math.log2(window) - sum(n * math.log2(n) for n in counts) / window, ways / letters ** window))
    below = 0.0
    for entropy, share in sorted(shares):
        below += share
        if below > missed:
            return entropy - 1e-9
    return entropy


# character class of a piece or of a whole candidate and the entropy (bits a character) from which a window is a secret
CLASSES = (
    ("digits", re.compile(r"[0-9]+"), math.inf),
    ("hex", re.compile(r"[0-9a-f]+|[0-9A-F]+"), limit_of(16)),
    ("one case letters", re.compile(r"[a-z]+|[A-Z]+"), limit_of(26)),
    ("letters", re.compile(r"[A-Za-z]+"), limit_of(52)),
    ("one case", re.compile(r"[a-z0-9]+|[A-Z0-9]+"), limit_of(36)),
    ("base64", re.compile(r"[A-Za-z0-9+/_=-]+"), limit_of(62)),
)
# what looks random but is known: examples in manuals, runs of the alphabet, ids, one mark repeated, joined words
ALLOWED = (
    re.compile(r"(?i).*(example|placeholder|changeme|dummy|redacted).*"),
    re.compile(r"(?i).*(0123456789|abcdefghij|qwertyuiop|1234567890).*"),
    re.compile(r"(?i)[0-9a-f]{8}(-[0-9a-f]{4}){3}-[0-9a-f]{12}"),
    re.compile(r"(.)\1*"),
    re.compile(r"[A-Za-z]+[/_=+-][A-Za-z/_=+-]*"),     # one way to read a text only: no search over splits
)
UUID = re.compile(rf"(?<![A-Za-z0-9+]){ALLOWED[2].pattern[4:]}(?![A-Za-z0-9+])", re.IGNORECASE)
KNOWN_LEAST = 4         # a shorter piece may be a part of a key between two marks
# letter pairs that are common in words and identifiers: a quarter of all pairs, most of those in use
PAIRS = frozenset("""
ab ac ad ag ai al am an ap ar as at au be bi bl ca ce ch ci ck cl co cr ct cu da de di do ds ea ec ed ee ef eg ei el em
en eo ep er es et ev ex fe ff fi fo ga ge ha he hh hi ho hs ht ia ib ic id ie if ig il im in io ip ir is it iv iz ke la
le li ll lo ls ly ma me mi mo mp na nc nd ne ng nh ni nl nn no ns nt oc od oi ol om on op or os ot ou ow pa pe pi pl po
pp pr pt qu ra rd re ri rm rn ro rr rs rt sa sc se sh si so sp ss st su ta te th ti to tr ts tt tu ty ue ul um un up ur
us ut ux va ve vi wa wh xt ze""".split())
WORDS, JOINED = 0.55, 0.4    # share of common pairs from which a window, or one of joined letters only, reads like words


def class_of(candidate: str) -> tuple[str, float]:
    return next((name, limit) for name, shape, limit in CLASSES if shape.fullmatch(candidate))


def entropies(text: str, window: int = WINDOW) -> Iterator[tuple[int, float]]:
    """Start and entropy of each window; of the whole text if it is shorter."""
    size = min(window, len(text))
    counts: dict[str, int] = {}
    # terms[n] is n * log2(n): a step changes the sum by the terms of the counts that change
    terms = [0.0] + [n * math.log2(n) for n in range(1, size + 1)]
    total = 0.0
    for i, c in enumerate(text):
        if i >= size:
            gone = text[i - size]
            n = counts[gone]
            total += terms[n - 1] - terms[n]
            counts[gone] = n - 1
        n = counts.get(c, 0)
        total += terms[n + 1] - terms[n]
        counts[c] = n + 1
        if i >= size - 1:
            yield i - size + 1, math.log2(size) - total / size


def highest_entropy(text: str, window: int = WINDOW) -> float:
    """The entropy of the most random window; of the whole text if it is shorter."""
    return max((entropy for _, entropy in entropies(text, window)), default=0.0)


def _known(run: str) -> bytearray:
    """1 for each character of a piece that the allow list knows, or of an id of several pieces."""
    known = bytearray(len(run))
    spans = [m.span() for m in UUID.finditer(run)] if run.count("-") >= 4 else []
    spans += [m.span() for m in PIECE.finditer(run)
              if len(m[0]) >= KNOWN_LEAST and any(a.fullmatch(m[0]) for a in ALLOWED[:4])]
    for start, end in spans:
        known[start:end] = b"\1" * (end - start)
    return known


def is_random(run: str) -> bool:
    """Whether a window of the run or of one of its pieces reaches the limit of its class and is not cleared.

    A piece, between / _ - and =, has the class of its own characters; a window across pieces that of the run.
    A window with a character of a known piece is cleared, as is one whose letter pairs are mostly common. A step
    from a small to a capital letter or to a digit is no common pair; marks and numbers are left out.
    """
    pieces = [m.span() for m in PIECE.finditer(run)]
    limits = {class_of(run[a:b])[1] for a, b in pieces if b - a >= WINDOW} | {class_of(run)[1]}
    if highest_entropy(run) < min(limits):
        return False
    known = list(accumulate(_known(run), initial=0))
    pair, common = bytearray(len(run)), bytearray(len(run))     # of a character and the next one
    for a, b in pieces:
        if not run[a:b].isdigit():
            for i in range(a, b - 1):
                pair[i] = 1
                common[i] = run[i:i + 2].lower() in PAIRS and not (run[i].islower() and run[i + 1].isupper())
    pairs, commons = list(accumulate(pair, initial=0)), list(accumulate(common, initial=0))

    def found(start: int, end: int) -> bool:
        limit = class_of(run[start:end])[1]
        for i, entropy in entropies(run[start:end]):
            i += start
            if entropy < limit or known[i + WINDOW] > known[i]:
                continue
            n = pairs[i + WINDOW - 1] - pairs[i]
            least = JOINED if ALLOWED[4].fullmatch(run, i, i + WINDOW) else WORDS
            if not n or commons[i + WINDOW - 1] - commons[i] < least * n:
                return True
        return False

    return found(0, len(run)) or any(found(a, b) for a, b in pieces if WINDOW <= b - a < len(run))


def secrets_of(text: str) -> list[tuple[str, int, int]]:
    """Spans (kind, start, end) by start, then kind; code points, end exclusive."""
    low = text.lower()
    spans = []
    if any(k in low for k in _KEYWORDS):
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= ASSIGN_LEAST]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    spans += [("entropy", *m.span()) for m in CANDIDATE.finditer(text) if is_random(m[0])]
    return sorted(spans, key=lambda s: (s[1], KINDS.index(s[0])))


RESULT = "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join("%s:%d:%d" % s for s in spans)


def scan(docs: DataFrame) -> DataFrame:
    """Secrets of every whole text, one row per row.

    A null or empty text has none: zero counts, the digest of the empty list and empty ``spans``. A null id
    stays null; repeated rows are scanned each; other columns are not read.
    """
    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            out: list[tuple] = []
            for text in texts_of(batch.column("text")):
                spans = secrets_of(text)
                base = [s for s in spans if s[0] != "entropy"]
                count = [s[0] for s in base].count
                out.append((count("assign"), count("access"), count("hex"),
                            hashlib.sha256(_joined(base).encode()).hexdigest(), _joined(spans)))
            columns = list(zip(*out)) or [()] * 5
            types = [pa.int64()] * 3 + [pa.string()] * 2
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(columns, types))],
                [f.split()[0] for f in RESULT.split(", ")])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.col("text").cast("string").alias("text")).mapInArrow(found, RESULT)


def redacted(text: str, mark: str) -> str:
    """The text with every secret, overlaps joined, replaced by ``mark``."""
    out, at = [], 0
    for _, start, end in secrets_of(text):
        if start >= at:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join([*out, text[at:]]) if out else text


def redact(docs: DataFrame, mark: str = "[secret]") -> DataFrame:
    """The same rows and columns; secrets in ``text`` give way to ``mark`` and ``n_chars`` follows.

    A null text stays null. Texts without a secret are untouched.
    """
    fields = docs.schema

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            old = batch.column("text").to_pylist()
            new = [None if t is None else redacted(t, mark) for t in old]
            columns = {n: batch.column(n) for n in batch.schema.names}
            columns["text"] = pa.array(new, pa.string())
            if "n_chars" in columns:
                kept = columns["n_chars"].to_pylist()
                columns["n_chars"] = pa.array([k if a == b or k is None else len(b)
                                               for k, a, b in zip(kept, old, new)], columns["n_chars"].type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return docs.mapInArrow(cleaned, fields)
