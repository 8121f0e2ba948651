"""Secrets in texts: known shapes by pattern, and random strings by token efficiency.

Known shapes ("assign", "access", "hex") are leftmost, non-overlapping matches of each pattern. Token efficiency adds
"random": a run of 20 or more characters of base64, URL or key alphabets whose number of characters for each token of a public
byte-level vocabulary is low, because the vocabulary has learned nothing like it. Excluded are known digests (hex of
the usual lengths), UUIDs, numbers, addresses, paths and names joined by marks or case, if each of their words has as
many characters for each token as a run needs to pass, and what a known shape covers.

Defined cases: a null text counts as empty; repeated rows get equal results; very long runs are encoded in pieces of
PIECE characters.
"""

from __future__ import annotations

import base64
import hashlib
import re
from bisect import bisect_left
from collections.abc import Iterator
from itertools import accumulate
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bounded_batches, quoted
from .wordhash import tidy

#: The shapes, and the split pattern that goes with the public byte-level vocabulary.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{32,}"
RUN = r"[A-Za-z0-9+/_=-]{20,}"
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
KINDS = ("assign", "access", "hex", "random")
DIGESTS = (32, 40, 48, 56, 64, 96, 128)

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
RATIO, PIECE = 1.8, 4096


def encoder(ranks: bytes):
    import tiktoken

    table = {base64.b64decode(a): int(b) for a, b in (x.split() for x in ranks.splitlines() if x)}
    return tiktoken.Encoding("secrets", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})


def identifier(run: str, encode, ratio: float = RATIO) -> bool:
    """Whether a run is a known digest, a UUID, a number or a name rather than a random string. A name's words have enough characters for each token."""
    if len(run) in DIGESTS and re.fullmatch(r"[0-9a-f]+|[0-9A-F]+", run):
        return True
    if re.fullmatch(r"[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}", run) or not re.search(r"[A-Za-z]", run):
        return True
    parts = [p for p in re.split(r"[-_/+=]", run) if p]
    # Words, also joined by marks or camel case, with a number at most at an end of each.
    if not all(re.fullmatch(r"\d{0,8}[A-Za-z]?[a-z]*(?:[A-Z][a-z]+){0,6}\d{0,8}|[A-Z]+|\d+", p) for p in parts):
        return False
    words = [w for w in re.findall(r"[A-Z]?[a-z]+|[A-Z]+", run) if len(w) > 1]  # a single letter says nothing
    return all(len(w) >= ratio * _tokens(w, encode) for w in words)


def _tokens(run: str, encode) -> int:
    return sum(len(encode(run[i : i + PIECE])) for i in range(0, len(run), PIECE))


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the known shapes."""
    out = [(m.start(), 0, m.end()) for m in re.finditer(ASSIGN, text, re.ASCII | re.IGNORECASE) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer(HEX, text)]
    return sorted(out)


def random_spans(text: str, encode, ratio: float = RATIO) -> list[tuple[int, int, int]]:
    """(start, kind, end) of runs with few characters for each token."""
    out = []
    for m in re.finditer(RUN, text):
        run = m[0]
        if len(run) < ratio * _tokens(run, encode) and not identifier(run, encode, ratio):
            out.append((m.start(), 3, m.end()))
    return out


def apart(spans: list[tuple[int, int, int]], base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """The spans that overlap none of base, which is sorted: of the base spans that start before a span ends, the one that reaches furthest decides."""
    starts, reach = [a for a, _, _ in base], list(accumulate((b for _, _, b in base), max))
    return [x for x in spans if not (k := bisect_left(starts, x[2])) or reach[k - 1] <= x[0]]


def written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _scan(shared, ratio: float, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = encoder(shared.value).encode_ordinary
    for batch in batches:
        counts, digest, every = ([], [], []), [], []
        for text in batch.column(1):
            text = text.as_py() or ""
            base = base_spans(text)
            more = apart(random_spans(text, encode, ratio), base)
            for k, column in enumerate(counts):
                column.append(sum(x[1] == k for x in base))
            digest.append(hashlib.sha256(written(base).encode()).hexdigest())
            every.append(written(sorted(base + more)))
        yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digest, pa.string()), pa.array(every, pa.string())], ["id", "n_assign", "n_access", "n_hex", "base_sha256", "spans"])


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = VOCABULARY, ratio: float = RATIO) -> DataFrame:
    """(id, n_assign, n_access, n_hex, base_sha256, spans), one row for each row of docs. vocabulary: a file of ranks
    that the driver can read; the executors get its contents."""
    bounded_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(Path(vocabulary).read_bytes())  # a vocabulary: under 1 MB
    return docs.select(F.col(quoted(id_col)).alias("id"), F.col(quoted(text_col)).alias("text")).mapInArrow(lambda b: tidy(_scan(shared, ratio, b)), f"id {kind}, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
