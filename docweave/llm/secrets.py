"""Secrets in texts: three stated patterns, and strings that a tokenizer compresses badly.

A public subword vocabulary turns prose into few tokens per character. Random strings (keys,
tokens) fall apart into many short tokens, so a low number of characters per token exposes them.
Digests of known length, UUIDs, plain words and numbers are excluded before the test.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from docweave.llm.common import slices, texts_of

KINDS = ("assign", "access", "hex", "dense")
SCHEMA = (
    "doc_id long, n_assign long, n_access long, n_hex long, n_dense long, "
    "spans array<struct<kind: string, start: long, end: long>>, base_sha256 string"
)

_ASSIGN = re.compile(
    r"(?:[Pp][Aa][Ss][Ss](?:[Ww][Oo][Rr][Dd]|[Ww][Dd])|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    r"""["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
#: Runs without blanks whose tokens are counted, and the stretches between separators within them.
_RUN = re.compile(r"[A-Za-z0-9+/_=-]{12,}")
_STRETCH = re.compile(r"[A-Za-z0-9+]{12,}")
_IDENTIFIERS = re.compile(
    r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}"  # UUID
    r"|[0-9a-fA-F]{32}|[0-9a-fA-F]{40}|[0-9a-fA-F]{56}|[0-9a-fA-F]{64}|[0-9a-fA-F]{96}|[0-9a-fA-F]{128}"  # digests
    r"|[0-9+/_=-]+"  # numbers, dates, rules
    r"|[0-9]{4}-?[0-9]{2}-?[0-9]{2}[T_][0-9-]+Z?"  # times
)
#: Paths and names of whole words and numbers: never dense as a whole, but a stretch of one may be.
_NAMES = re.compile(r"[/_=-]*(?:[A-Za-z]+|[0-9]+)(?:[/_=-]+(?:[A-Za-z]+|[0-9]+))*[/_=-]*")
#: Counting tokens of one piece may take time by the square of its length.
_COUNTED = 1024


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the stated patterns, leftmost and without overlaps within a kind, sorted."""
    found = [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    found += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [(m.start(), 2, m.end()) for m in _HEX.finditer(text)]
    return sorted(found)


def _limit(word: str, most: float) -> float:
    """The most characters per token at which ``word`` is held to be random; 0: it is never.

    Letters alone must stay further below prose: words of other languages also fall apart into short
    tokens. Laughter, rules and sequences of few different letters are never random.
    """
    digit, mixed = any(c.isdigit() for c in word), bool(re.search("[a-z]", word) and re.search("[A-Z]", word[1:]))
    if len(word) < 16:
        return most - 0.3 if digit and mixed else 0.0
    if digit:
        return most
    if len(set(word)) < 8:
        return 0.0
    return most - 0.15 if mixed or len(word) >= 24 else most - 0.4


def dense_spans(text: str, count_tokens, most_chars_per_token: float) -> list[tuple[int, int, int]]:
    """Spans of strings with few characters per token that are no known digest or identifier.

    A run is tested as a whole; if that is not dense, each stretch between ``/ _ = -`` is, so a key
    behind a path or a name is found.
    """

    def dense(word: str) -> bool:
        most = _limit(word, most_chars_per_token)
        if not most or _IDENTIFIERS.fullmatch(word):
            return False
        return len(word) <= most * sum(count_tokens(word[i : i + _COUNTED]) for i in range(0, len(word), _COUNTED))

    found = []
    for run in _RUN.finditer(text):
        word = run.group()
        if _IDENTIFIERS.fullmatch(word):
            continue
        if not _NAMES.fullmatch(word) and dense(word):
            found.append((run.start(), 3, run.end()))
            continue
        found += [(run.start() + m.start(), 3, run.start() + m.end()) for m in _STRETCH.finditer(word) if dense(m.group())]
    return found


def join_spans(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def find_secrets(
    docs: DataFrame,
    vocabulary: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    most_chars_per_token: float = 1.9,
) -> DataFrame:
    """One row per input row with its spans, in code points, end exclusive.

    ``vocabulary`` names a rank file (base64 token and rank per line) and ``pattern`` the split
    of texts before the merges. A dense span that touches a stated one is left out. Very long texts
    are read whole, and tokens of a very long run are counted in stretches of 1,024 signs. Null and empty
    texts give no spans; a null id stays null; repeated rows are answered each; other columns are
    not read, so their names cannot clash.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import tiktoken

        with open(vocabulary, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in slices(batches):
            columns: list[list] = [[], [], [], [], [], []]
            for text in texts_of(batch):
                base = base_spans(text)
                dense = dense_spans(text, lambda w: len(encoding.encode_ordinary(w)), most_chars_per_token)
                dense = [d for d in dense if not any(b[0] < d[2] and d[0] < b[2] for b in base)]
                kinds = [k for _, k, _ in base]
                for i in range(3):
                    columns[i].append(kinds.count(i))
                columns[3].append(len(dense))
                columns[4].append([{"kind": KINDS[k], "start": s, "end": e} for s, k, e in sorted(base + dense)])
                columns[5].append(hashlib.sha256(join_spans(base).encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0)]
                + [pa.array(c, pa.int64()) for c in columns[:4]]
                + [pa.array(columns[4], span), pa.array(columns[5], pa.string())],
                names=["doc_id", "n_assign", "n_access", "n_hex", "n_dense", "spans", "base_sha256"],
            )

    chosen = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return chosen.mapInArrow(run, SCHEMA)
