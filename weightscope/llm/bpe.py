"""Byte-level BPE by prefix dynamic programming.

For every prefix of a byte string there is exactly one token that can be the
last one of the prefix's encoding. A token ``t`` that ends a prefix is that one
if the pair (last token of the prefix before it, ``t``) is stable, that is, if
encoding the bytes of both gives both back. The table of last tokens therefore
comes from one pass over the bytes, is exact, can be appended to, and can be
re-used up to any edit.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import re
from array import array
from functools import lru_cache
from operator import itemgetter

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightscope.llm.common import MEMO_ENTRIES, map_batches

#: Letters, digits and white space among the characters for which the fast
#: splitter below is exact: ASCII and the Latin letters up to U+024F.
_LATIN = "A-Za-zÀ-ÖØ-öø-ɏ"
_FAST_TEXT = re.compile(f"[\\x00-\\x1b\\x20-\\x7f{_LATIN}]*")
_FAST_SPLIT = re.compile(rf" ?[{_LATIN}]+| ?[0-9]+|'(?:[stmd]|re|ve|ll)| ?[^\s0-9{_LATIN}]+|\s+(?!\S)|\s+")

#: The pattern the fast splitter stands in for.
_KNOWN_PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The ranks in a ``.tiktoken`` file."""
    return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines()) if token}


def merge(ranks: dict[bytes, int], data: bytes, below: int | None = None) -> list[bytes]:
    """Plain merging: the adjacent pair of lowest rank first, leftmost on ties.

    With ``below``, only merges of a lower rank are made. Used to split tokens
    once at load, and as the brute force that tests compare with.
    """
    parts = [data[i : i + 1] for i in range(len(data))]
    while len(parts) > 1:
        best = min((ranks.get(a + b, 1 << 40), i) for i, (a, b) in enumerate(zip(parts, parts[1:], strict=False)))
        if best[0] >= (1 << 40 if below is None else below):
            break
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
    return parts


class PrefixBpe:
    """Encoder and decoder for one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, entries: int = MEMO_ENTRIES):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.fast = pattern == _KNOWN_PATTERN
        self.trie: dict = {}
        self.longest = 0
        self.right: dict[int, tuple] = {}
        self.left: dict[int, tuple] = {}
        self.stable: dict[int, bool] = {}
        self.known: dict[str, bytes] = {}
        self.entries = entries
        halves: dict[int, tuple[int, int] | None] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) == 1:
                halves[rank] = None
            else:
                parts = merge(ranks, token, rank)
                # A token that its own bytes don't lead to only stands for a whole piece.
                if len(parts) != 2 or any(halves.get(ranks[p], 0) == 0 for p in parts):
                    continue
                halves[rank] = (ranks[parts[0]], ranks[parts[1]])
            self.longest = max(self.longest, len(token))
            node = self.trie
            for byte in token:
                node = node.setdefault(byte, {})
            node[256] = rank
        for rank in halves:
            self.right[rank] = self._edge(rank, halves, 1)
            self.left[rank] = self._edge(rank, halves, 0)

    @staticmethod
    def _edge(rank: int, halves: dict, side: int) -> tuple:
        """The tokens that stand at one edge while ``rank`` is being merged.

        Triples of token, when it comes to be and when it goes into the next.
        """
        out, until = [], 1 << 40
        while True:
            pair = halves[rank]
            out.append((rank, -1 if pair is None else rank, until))
            if pair is None:
                return tuple(out)
            until, rank = rank, pair[side]

    def is_stable(self, a: int, b: int) -> bool:
        """Does encoding the bytes of ``a`` and ``b`` give ``a`` and ``b``?

        It doesn't if some token at the right edge of ``a`` meets one at the
        left edge of ``b`` and they merge before either is used up within its
        own side; at equal ranks the leftmost merge goes first.
        """
        key = a << 32 | b
        if (known := self.stable.get(key)) is not None:
            return known
        ranks, token, result = self.ranks, self.token, True
        for x, born_x, gone_x in self.right[a]:
            for y, born_y, gone_y in self.left[b]:
                if max(born_x, born_y) < min(gone_x, gone_y):
                    c = ranks.get(token[x] + token[y])
                    if c is not None and c < gone_x and c <= gone_y:
                        result = False
                        break
            if not result:
                break
        if len(self.stable) > 2 * self.entries:
            self.stable.clear()
        self.stable[key] = result
        return result

    def extend(self, data: bytes, last: list, begin: int) -> list:
        """Complete ``last`` for ``data`` where entries up to ``begin`` hold.

        ``last[i]`` is the last token of the encoding of ``data[:i]``; entry 0
        is -1. Appending bytes or replacing all after ``begin`` re-uses what
        stands before, except that tokens may reach over ``begin``.
        """
        size, stable, is_stable = len(data), self.stable.get, self.is_stable
        del last[begin + 1 :]
        last += [None] * (size - begin)
        for i in range(max(0, begin - self.longest), size):
            before, node = last[i], self.trie
            if before is None:
                continue
            high = before << 32
            for j in range(i, size):
                node = node.get(data[j])
                if node is None:
                    break
                rank = node.get(256)
                if rank is not None and last[j + 1] is None:
                    if before < 0 or (stable(high | rank) or is_stable(before, rank)):
                        last[j + 1] = rank
        return last

    def walk_back(self, data: bytes, last: list) -> list[int]:
        """The encoding of ``data`` from its table."""
        out, i = [], len(data)
        while i:
            out.append(last[i])
            i -= len(self.token[last[i]])
        return out[::-1]

    def encode_piece(self, data: bytes) -> list[int]:
        """Token ids of one piece that the pattern matched."""
        whole = self.ranks.get(data)
        return [whole] if whole is not None else self.walk_back(data, self.extend(data, [-1], 0))

    def split_text(self, text: str) -> list[str]:
        """The matches of the pattern."""
        if self.fast and _FAST_TEXT.fullmatch(text):
            return _FAST_SPLIT.findall(text)
        return self.split(text)

    def encode(self, text: str) -> bytes:
        """Token ids of a whole text as little-endian unsigned 32-bit integers."""
        known, parts = self.known, self.split_text(text)
        try:
            return b"".join([known[p] for p in parts])
        except KeyError:
            pass
        if len(known) > self.entries:
            known.clear()
        for p in set(parts).difference(known):
            known[p] = array("I", self.encode_piece(p.encode())).tobytes()
        return b"".join([known[p] for p in parts])

    def decode(self, ids: bytes) -> bytes:
        """The bytes that token ids stand for."""
        return b"".join(itemgetter(*np.frombuffer(ids, "<u4").tolist(), 0, 0)(self.token)[:-2])


@lru_cache(maxsize=2)
def _encoder(data: bytes, pattern: str) -> PrefixBpe:
    made = PrefixBpe(read_ranks(data), pattern)
    gc.freeze()  # the trie is never garbage: keep the collector from walking it
    return made


def _pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def encode_and_decode(docs: DataFrame, ranks_path: str, pattern: str | None = None, *, texts: bool = True) -> DataFrame:
    """Encode every whole text and decode the ids again.

    ``docs`` needs ``doc_id`` and ``text``; other columns are ignored. Returns
    a row per row: doc_id, n_tokens, ids (array of long, if ``texts``), decoded
    (binary, if ``texts``), ids_sha256 and decoded_sha256. Null counts as the
    empty text, which has no tokens; equal rows give equal rows; a null doc_id
    stays null; an empty table gives an empty one. The whole work is one pass
    without a shuffle, and the rank file, whose size the vocabulary bounds, is
    the only thing sent to the executors.
    """
    with open(ranks_path, "rb") as f:
        data = f.read()
    pattern = pattern or _pattern()
    wanted = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<long>, decoded binary" * texts

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        bpe = _encoder(data, pattern)
        counts, ids_hex, text_hex, ids, decoded = [], [], [], [], []
        for text in batch.column("text").to_pylist():
            coded = bpe.encode(text or "")
            back = bpe.decode(coded)
            counts.append(len(coded) // 4)
            ids_hex.append(hashlib.sha256(coded).hexdigest())
            text_hex.append(hashlib.sha256(back).hexdigest())
            if texts:
                ids.append(np.frombuffer(coded, "<u4").astype("i8"))
                decoded.append(back)
        columns = [batch.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(text_hex, pa.string())]
        names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
        if texts:
            columns += [pa.array(ids, pa.list_(pa.int64())), pa.array(decoded, pa.binary())]
            names += ["ids", "decoded"]
        return pa.RecordBatch.from_arrays(columns, names)

    return map_batches(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), work, wanted)
