"""Secret scan: fixed patterns plus a token-efficiency test for random strings.

A byte-pair vocabulary spends few tokens on text that looks like its training data and many on random strings, so
a long run with few characters per token is suspect, whether it has digits or letters alone.  Runs that are known digests
(hex of a digest's length), UUIDs, numbers or identifiers (long words, by tokens too, joined by separators or capitals
with a number among them) are excluded, and so are runs that a fixed pattern already covers.

Defined results: a null text is empty and has no spans; repeated rows are scanned each; spans that begin at the same
place are ordered by kind as listed in ``KINDS``; an empty table gives an empty result; extra columns are ignored
by ``scan`` and kept by ``redact``.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barloom.llm.packing import encoder, vocabulary

KINDS = ("assign", "access", "hex", "random")
MIN_RUN, MAX_CHARS_PER_TOKEN, MIN_WORD_CHARS_PER_TOKEN, MASK = 20, 2.0, 2.5, "[SECRET]"

# The base patterns and their least lengths.
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.IGNORECASE | re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{32,}")
KEYWORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
MIN_ASSIGN, MIN_ACCESS = 8, 16

_RUN = re.compile(rf"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_=-]{{{MIN_RUN},}}")
_DIGEST = re.compile(r"(?:[0-9a-f]+|[0-9A-F]+)")
_DIGEST_LENGTHS = {32, 40, 56, 64, 96, 128}
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_PARTS = re.compile(r"[A-Z]?[a-z]+|[A-Z]+(?![a-z])|[0-9]+")

Span = tuple[int, int, int]  # start, place in KINDS, end


def base_spans(text: str) -> list[Span]:
    """What the fixed patterns find; leftmost and non-overlapping within a kind."""
    out: list[Span] = []
    low = text.lower()
    if any(k in low for k in KEYWORDS):
        out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= MIN_ASSIGN]
    if "AKIA" in text:
        out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if len(m[0]) >= MIN_ACCESS]
    out += [(m.start(), 2, m.end()) for m in HEX.finditer(text)]
    return sorted(out)


def _known(run: str, encode) -> bool:
    """A digest, a UUID, a number or an identifier made of words."""
    if len(run) in _DIGEST_LENGTHS and _DIGEST.fullmatch(run) or _UUID.fullmatch(run):
        return True
    parts = _PARTS.findall(run)
    letters = [p for p in parts if not p.isdigit()]
    # words of an identifier are few and long; in a random run capitals and digits change every other character
    size = sum(map(len, letters))
    return not letters or size >= 4.5 * max(1, len(parts)) and size >= MIN_WORD_CHARS_PER_TOKEN * sum(len(encode(p)) for p in letters)


def random_spans(text: str, taken: list[Span], encode, most: float = MAX_CHARS_PER_TOKEN) -> list[Span]:
    """Runs of at least ``MIN_RUN`` characters, letters among them, that take too many tokens."""
    out: list[Span] = []
    next_taken = covered = 0  # spans that begin before the run's end, and the farthest end of theirs
    for m in _RUN.finditer(text):
        a, run = m.start(), m[0].strip("-_=+/")
        if len(run) < MIN_RUN or not any(c.isalpha() for c in run):
            continue
        a = text.index(run, a)
        b = a + len(run)
        while next_taken < len(taken) and taken[next_taken][0] < b:
            covered, next_taken = max(covered, taken[next_taken][2]), next_taken + 1
        if covered > a:
            continue
        if len(run) < most * len(encode(run)) and not _known(run, encode):
            out.append((a, 3, b))
    return out


def find(text: str, encode) -> tuple[list[Span], list[Span]]:
    """Base spans, and all spans in order."""
    base = base_spans(text)
    return base, sorted(base + random_spans(text, base, encode))


def told(spans: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def mask(text: str, spans: list[Span]) -> str:
    """The text with each stretch of secrets replaced."""
    out, at = [], 0
    for a, _, b in sorted(spans):
        if b <= at:
            continue
        if a >= at:
            out += [text[at:a], MASK]
        at = b
    return "".join(out) + text[at:]


def scan(docs: DataFrame, text: str = "text", vocab: str | None = None) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    path = vocab or vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            rows = []
            for t in batch.column(1):
                base, spans = find(t.as_py() or "", encode)
                kinds = [k for _, k, _ in spans]
                rows.append((*(kinds.count(k) for k in range(4)), hashlib.sha256(told(base).encode()).hexdigest(), told(spans)))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2
            cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)] if rows else [pa.array([], k) for k in kinds]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_assign", "n_access", "n_hex", "n_random", "base_sha256", "spans"])

    schema = "doc_id long, n_assign long, n_access long, n_hex long, n_random long, base_sha256 string, spans string"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, schema)


def redact(docs: DataFrame, text: str = "text", length: str | None = "n_chars", vocab: str | None = None) -> DataFrame:
    """The rows of ``docs`` with secrets replaced by ``MASK``; ``length``, if there, follows. Null texts stay null."""
    path, names = vocab or vocabulary(), docs.columns
    at, n = names.index(text), names.index(length) if length in names else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path).encode_ordinary
        for batch in batches:
            cols = list(batch.columns)
            old = cols[at].to_pylist()
            new = [t if t is None or not (spans := find(t, encode)[1]) else mask(t, spans) for t in old]
            cols[at] = pa.array(new, cols[at].type)
            if n is not None:
                was = cols[n].to_pylist()
                cols[n] = pa.array([w if a == b else len(b) for a, b, w in zip(old, new, was, strict=True)], cols[n].type)
            yield pa.RecordBatch.from_arrays(cols, schema=batch.schema)

    return docs.mapInArrow(run, docs.schema)
