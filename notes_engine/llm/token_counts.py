"""Token counts: byte-pair merging with a heap of pairs and a linked list of symbols; no ids are made."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notes_engine.llm.tokens import DEFAULT_VOCABULARY, Pieces, Remembered, byte_level, byte_symbols, in_groups, run_of


def count_merged(symbols: list[bytes], ranks: dict[tuple[bytes, bytes], int]) -> int:
    """Symbols left after merging: pop the pair of the lowest rank, the leftmost of equals, until none is left.

    n log n in the number of symbols, also for one very long word.
    """
    n = len(symbols)
    symbols = list(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    heap = [(ranks[p], i, *p) for i, p in enumerate(zip(symbols, symbols[1:], strict=False)) if p in ranks]
    heapq.heapify(heap)
    merges = 0
    while heap:
        _, i, a, b = heapq.heappop(heap)
        j = after[i]
        if j >= n or symbols[i] != a or symbols[j] != b:
            continue  # one of the two has been merged meanwhile
        merges += 1
        symbols[i], symbols[j] = a + b, b""
        k = after[i] = after[j]
        if k < n:
            before[k] = i
            if (pair := (symbols[i], symbols[k])) in ranks:
                heapq.heappush(heap, (ranks[pair], i, *pair))
        if (h := before[i]) >= 0 and (pair := (symbols[h], symbols[i])) in ranks:
            heapq.heappush(heap, (ranks[pair], h, *pair))
    return n - merges


class TokenCounter:
    """Counts tokens of texts under a byte-level BPE vocabulary file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if not byte_level(spec):
            raise ValueError(f"not a plain byte-level BPE vocabulary: {path}")
        table = byte_symbols()
        as_bytes = lambda s: bytes(table[c] for c in s)
        pairs = (m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])
        self.ranks = {(as_bytes(a), as_bytes(b)): k for k, (a, b) in enumerate(pairs)}
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.word = regex.compile(public_tokenizers.PATTERN)
        self.bytes = [bytes([b]) for b in range(256)]
        self.memory = Remembered(self._led)

    def _merged(self, word: str) -> int:
        return count_merged([self.bytes[b] for b in word.encode()], self.ranks)

    def _led(self, words: list[str]) -> list[int]:
        """The tokens of each word with what leads it, its own line end or else a blank. A blank and letters are one token of the pattern."""
        return [self._merged(" " + w) if w.isalpha() else self.whole(w if w[0] == "\n" else " " + w) for w in words]

    def whole(self, text: str) -> int:
        """Tokens of a text that isn't cut into pieces first."""
        total, at = 0, 0
        for m in self.added.finditer(text) if self.added else ():
            total += 1 + sum(map(self._merged, self.word.findall(text, at, m.start())))
            at = m.end()
        return total + sum(map(self._merged, self.word.findall(text, at)))

    def count_all(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text: each distinct piece is counted once, and added up at all its places. A sign after a word is one token."""
        cut = Pieces(texts)
        words = np.zeros(len(cut.words), np.int64)
        plain = np.ones(len(words), bool)
        plain[cut.word[cut.odd]] = False
        words[plain] = self.memory.values([w for w, p in zip(cut.words, plain.tolist(), strict=True) if p])
        there = (words[cut.word] + (cut.sign >= 0))[cut.codes]
        there[cut.first] = 0
        total = np.add.reduceat(there, cut.first) if len(texts) else np.zeros(0, np.int64)
        total += np.fromiter(map(self.whole, cut.starts), np.int64, len(texts))
        for k in np.flatnonzero(cut.whole).tolist():
            total[k] = sum(map(self.whole, run_of(texts[k].as_py())))
        return total

    def count(self, text: str) -> int:
        return int(self.count_all(pa.array([text], pa.string()))[0])


_counters: dict[str, TokenCounter] = {}


def count_tokens(docs: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY, limit: int = 512, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    vocabulary: path of a byte-level BPE file, the same on every executor.
    Counts are those of the tokenizers library without added tokens; added
    tokens' own strings in a text count one. One pass, no shuffle; each Python
    worker remembers the counts of a bounded number of pieces. Null and empty
    text: 0. Null ids and repeated rows pass through. Very long texts and words:
    n log n. Empty table: no rows.
    """

    @F.arrow_udf("long")
    def counted(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        if vocabulary not in _counters:
            _counters[vocabulary] = TokenCounter(vocabulary)
        counter = _counters[vocabulary]
        for texts in batches:
            yield pa.array(np.concatenate([np.zeros(0, np.int64), *(counter.count_all(texts[group]) for group in in_groups(texts))]))
        counter.memory.clear()

    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col), F.octet_length(text).cast("long").alias("n_bytes"), counted(text).alias("n_tokens"))
    return rows.withColumn("over_limit", F.col("n_tokens") > limit)


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """count_tokens() over all documents."""
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
