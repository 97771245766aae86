"""Token counts of a byte-level BPE, by a whole-token shortcut.

Offline, every string of the vocabulary is merged from its bytes by the ranks alone; those that come out as one token are
proved whole. Counting then cuts a text into pre-tokens: each that is a whole string counts as one, and only the rest are
merged, once for each distinct one that a worker meets.
"""

from __future__ import annotations

import base64
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from offerlake.llm import columnar as C

SCHEMA = "doc_id bigint, n_tokens bigint, n_pretokens bigint, n_whole bigint"
#: Distinct merged pre-tokens that a worker keeps before it begins anew; it bounds memory and changes no count.
KEPT = 300_000


def default_vocabulary() -> tuple[str, str]:
    """Path of the ranks and pattern of the pre-tokens of the public 50k byte-level BPE."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


@lru_cache(4)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[bytes]:
    """Byte-pair merging of one pre-token: again and again the pair of least rank, the leftmost of equals."""
    parts = [piece[i : i + 1] for i in range(len(piece))]
    while len(parts) > 1:
        best, at = min((ranks.get(parts[i] + parts[i + 1], 1 << 60), i) for i in range(len(parts) - 1))
        if best == 1 << 60:
            break
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return parts


@lru_cache(4)
def prove_whole(path: str) -> frozenset[str]:
    """The vocabulary's strings that merging turns into one token; those that aren't text can't be a pre-token's."""
    ranks, out = load_ranks(path), set()
    for token in ranks:
        if len(merge(token, ranks)) == 1:
            try:
                out.add(token.decode())
            except UnicodeDecodeError:
                pass
    return frozenset(out)


class _Rest(dict):
    """Token counts of pre-tokens that aren't whole; each is merged when first asked for."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import tiktoken

        encoding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.encode = encoding._core_bpe.encode_single_piece

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.encode(piece.encode()))
        return n


@lru_cache(4)
def _counter(path: str, pattern: str):
    import regex

    return regex.compile(pattern).findall, _Rest(load_ranks(path), pattern)


def count(text: str, find, whole: frozenset[str], rest: _Rest) -> tuple[int, int, int]:
    pieces = find(text)
    other = [p for p in pieces if p not in whole]
    n_whole = len(pieces) - len(other)
    n = n_whole + sum(map(rest.__getitem__, other))
    if len(rest) > KEPT:
        rest.clear()
    return n, len(pieces), n_whole


def token_counts(docs: DataFrame, path: str | None = None, pattern: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Tokens, pre-tokens and whole pre-tokens of each text, one row a row of docs.

    A null or empty text has no tokens; a null id stays null; repeated rows each give their row; other columns aren't
    read. Text that looks like a special token is ordinary text. Nothing is shuffled; the set of whole strings is
    broadcast, and its size is the vocabulary's.
    """
    if path is None or pattern is None:
        path, pattern = default_vocabulary()
    spark = docs.sparkSession
    C.small_batches(spark)
    sent = spark.sparkContext.broadcast(prove_whole(path))

    def run(batches):
        whole = sent.value
        find, rest = _counter(path, pattern)
        for batch in batches:
            found = [count(t or "", find, whole, rest) for t in batch.column(1).to_pylist()]
            tokens, pieces, wholes = zip(*found, strict=True) if found else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, pa.int64()) for c in (tokens, pieces, wholes)]], names=["doc_id", "n_tokens", "n_pretokens", "n_whole"])

    return docs.select(F.col(f"`{id_col}`").cast("bigint").alias("doc_id"), F.col(f"`{text_col}`").alias("text")).mapInArrow(run, SCHEMA)
