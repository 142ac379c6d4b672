"""Encoding with a public byte-level BPE vocabulary.

The text is cut into words by the vocabulary's pattern. Within a word each byte is a symbol of a
doubly linked list; a priority queue holds the ranks of possible merges, and an entry is skipped when
it is stale, that is when one of its symbols has meanwhile been merged away or has grown. A word of n
bytes costs O(n log n), so one word of a megabyte is no problem. Words repeat, so each worker keeps
the ids of recent words in a map of bounded size.

Defined results: NULL and empty texts give an empty list; special tokens' strings are ordinary text.
Decoding concatenates the vocabulary's byte strings; ``decode(encode(t)) == t`` for every text.
The files are read on the workers from a folder that is a parameter; nothing is broadcast.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the vocabulary files lie.
FOLDER = os.environ.get("TOKENIZERS_DIR", "/opt/tokenizers")
DEFAULT = "byte_bpe_50k"
#: The vocabulary's word pattern (fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Words a worker remembers before it forgets all of them, and the longest that it remembers.
REMEMBERED, LONGEST = 200_000, 64
#: Rows of one Arrow batch that are encoded before they are handed on.
ROWS = 512


class Vocabulary:
    """Ranks of a byte-level BPE vocabulary; a token's rank is its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.strings = {i: b for b, i in self.ranks.items()}
        import regex

        self.words: Callable[[str], list[str]] = regex.compile(PATTERN).findall
        self.seen: dict[str, list[int]] = {}

    def merge(self, word: bytes) -> list[int]:
        """Ids of one word."""
        ranks = self.ranks
        if (whole := ranks.get(word)) is not None:
            return [whole]
        n = len(word)
        part: list[bytes | None] = [word[i : i + 1] for i in range(n)]
        before, after = list(range(-1, n - 1)), [*range(1, n), -1]
        queue = []
        for i in range(n - 1):
            if (r := ranks.get(word[i : i + 2])) is not None:
                queue.append((r, i, i + 1, 2))
        heapq.heapify(queue)
        while queue:
            _, i, j, size = heapq.heappop(queue)
            a, b = part[i], part[j]
            # stale: a symbol is gone, is no longer the neighbour, or has grown
            if a is None or b is None or after[i] != j or len(a) + len(b) != size:
                continue
            part[i], part[j] = (joined := a + b), None
            k = after[i] = after[j]
            if k >= 0:
                before[k] = i
                if (r := ranks.get(joined + part[k])) is not None:
                    heapq.heappush(queue, (r, i, k, size + len(part[k])))
            if (h := before[i]) >= 0 and (r := ranks.get(part[h] + joined)) is not None:
                heapq.heappush(queue, (r, h, i, size + len(part[h])))
        return [ranks[x] for x in part if x is not None]

    def encode(self, text: str | None) -> list[int]:
        out: list[int] = []
        if not text:
            return out
        seen = self.seen
        for w in self.words(text):
            ids = seen.get(w)
            if ids is None:
                ids = self.merge(w.encode())
                if len(w) <= LONGEST:
                    if len(seen) >= REMEMBERED:
                        seen.clear()
                    seen[w] = ids
            out += ids
        return out

    def decode(self, ids: list[int]) -> str:
        return b"".join(self.strings[i] for i in ids).decode("utf-8", "replace")


@lru_cache(maxsize=4)
def vocabulary(name: str = DEFAULT, folder: str | None = None) -> Vocabulary:
    return Vocabulary(os.path.join(folder or FOLDER, f"{name}.tiktoken"))


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``(id_col, ids)``: the token ids of each row's text."""
    schema = pa.schema([(id_col, pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for big in batches:
            for lo in range(0, big.num_rows, ROWS):
                b = big.slice(lo, ROWS)
                ids = pa.array((v.encode(t) for t in b.column(1).to_pylist()), pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([b.column(0), ids], schema=schema)

    d = docs.select(F.col(id_col).cast("long").alias(id_col), F.col(text_col).cast("string").alias("text"))
    return d.mapInArrow(run, f"`{id_col}` long, ids array<int>")


def decode(rows: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``(id_col, text)``: texts of lists of ids. NULL lists give an empty text."""
    schema = pa.schema([(id_col, pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.decode(x or []) for x in b.column(1).to_pylist()], pa.string())], schema=schema)

    return rows.select(F.col(id_col).cast("long").alias(id_col), F.col(ids_col).alias("ids")).mapInArrow(run, f"`{id_col}` long, text string")


def sizes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), name: str = DEFAULT, folder: str | None = None) -> DataFrame:
    """``(id_col, *keep, tokens)``: the number of tokens only, so that no ids leave the worker."""
    d = docs.select(F.col(id_col).cast("long").alias(id_col), *keep, F.col(text_col).cast("string").alias("__text"))
    out = d.drop("__text").withColumn("tokens", F.lit(0).cast("long")).schema
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = to_arrow_schema(out)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(name, folder)
        for b in batches:
            n = pa.array([len(v.encode(t)) for t in b.column(b.num_columns - 1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], n], schema=schema)

    return d.mapInArrow(run, out)
