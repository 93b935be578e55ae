"""Benchmark decontamination by a hash set of normalised windows.

The windows of the benchmark are hashed into a sorted array that is broadcast;
the windows of the training texts are looked up in it and each hit is verified
word by word.
"""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightscope.llm.common import boxed, map_batches, pieces, stored

#: Bytes of benchmark text in one block. A block's words and windows take some
#: 30 times as much on the driver and in a worker; a larger benchmark is
#: scanned in several blocks, each within this bound.
BLOCK_BYTES = 8 << 20

#: A-Z to a-z; what is no part of a word to a space.
_TABLE = bytes(
    b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256)
)
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def words_of(text: str | None) -> list[bytes]:
    """The normalised words of a text."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass
class Windows:
    """The windows of one block of the benchmark, by length."""

    ids: dict[bytes, int]
    items: list[str | None]
    by_length: dict[int, tuple]
    salt: np.ndarray

    @classmethod
    def of(cls, rows: list[tuple], n: int) -> Windows:
        """From (item_id, text) pairs; n words to a window."""
        ids: dict[bytes, int] = {}
        names: dict = {}
        found: dict[int, dict[tuple, set]] = defaultdict(lambda: defaultdict(set))
        for item, text in rows:
            got = [ids.setdefault(w, len(ids) + 1) for w in words_of(text)]
            size = min(n, len(got))
            if size:
                name = names.setdefault(item, len(names))
                for i in range(len(got) - size + 1):
                    found[size][tuple(got[i : i + size])].add(name)
        seed = 0
        while True:  # until no two windows share a hash
            salt = np.random.default_rng(seed).integers(1, 1 << 63, n, dtype=np.uint64) | np.uint64(1)
            by_length = {}
            for size, windows in found.items():
                table = np.array(list(windows), np.uint64).reshape(-1, size)
                keys = (table * salt[:size]).sum(1, dtype=np.uint64)
                order = np.argsort(keys)
                if (np.diff(keys[order]) == 0).any():
                    break
                who = [np.array(sorted(windows[w]), np.int64) for w in windows]
                by_length[size] = (keys[order], table[order], [who[i] for i in order])
            else:
                return cls(ids, [None if x is None else str(x) for x in names], by_length, salt)
            seed += 1

    def scan(self, ids: np.ndarray) -> dict[int, tuple[np.ndarray, np.ndarray]]:
        """By length, where verified windows start in ``ids`` (0: no word of the benchmark) and which they are."""
        run = np.arange(1, len(ids) + 1)  # known words in a row up to each place
        run -= np.maximum.accumulate(np.where(ids == 0, run, 0))
        out = {}
        for size, (keys, table, _) in self.by_length.items():
            at = np.flatnonzero(run >= size) - (size - 1)
            if not len(at):
                continue
            hashed = np.zeros(len(at), np.uint64)
            for k in range(size):
                hashed += ids[at + k] * self.salt[k]
            place = np.minimum(np.searchsorted(keys, hashed), len(keys) - 1)
            hit = keys[place] == hashed
            at, place = at[hit], place[hit]
            if len(at):
                same = (ids[at[:, None] + np.arange(size)] == table[place]).all(1)
                if same.any():
                    out[size] = (at[same], place[same])
        return out


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[list[tuple]]:
    """The benchmark's rows in blocks of bounded size, one on the driver at a time; one empty block if there are none."""
    rows = benchmark.select("item_id", "text").where("text is not null").orderBy("item_id", "text").toLocalIterator(prefetchPartitions=False)
    block, size, any_yet = [], 0, False
    for item, text in rows:
        block.append((item, text))
        size += len(text.encode())
        if size >= block_bytes:
            yield block
            block, size, any_yet = [], 0, True
    if block or not any_yet:
        yield block


def find_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 13, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Where windows of the benchmark occur in every text.

    A window is n consecutive words of an item, or all words of a shorter one.
    Adds to the rows and columns of ``docs`` (needs ``text``) a column ``leak``:
    n_words, hits (array of struct start, end: runs of hit words, by word, end
    exclusive) and items (distinct item ids as strings, sorted). A null text
    has no words; items without words or with null text hit nothing; an item
    with a null id hits words but is not listed; rows that repeat are treated
    alike; extra columns stay, except that one called ``leak`` is replaced.

    A benchmark of ordinary size is one block of ``block_bytes``, and the scan
    then needs no shuffle at all. A larger one is scanned block by block, each
    in a job of its own of which only the hits are stored, so that one block is
    in memory at a time however many there are.
    """
    kept = docs.drop("leak")
    inner, text = boxed(kept)
    return _scan(*_all_but_one(inner, text, benchmark, n, block_bytes)).toDF(*kept.columns, "leak")


def _all_but_one(docs: DataFrame, text: str, benchmark: DataFrame, n: int, block_bytes: int) -> tuple:
    """``docs`` (of ``boxed``) with a last column ``leak`` of all blocks' hits but the first's, ``text``, and the first block, broadcast."""
    send = docs.sparkSession.sparkContext.broadcast
    blocks = _blocks(benchmark, block_bytes)
    first = Windows.of(next(blocks), n)
    none, others, keyed = F.lit(None).cast(_LEAK), [], None
    for rows in blocks:
        if keyed is None:
            keyed = stored(docs.withColumn("_key", F.monotonically_increasing_id()), "documents")
        block = send(Windows.of(rows, n))
        found = _scan(keyed.select("_key", text).withColumn("leak", none), text, block)
        others.append(stored(found.where(F.size("leak.hits") > 0).select("_key", "leak"), "hits"))
        block.destroy()
    if keyed is None:
        return docs.withColumn("leak", none), text, send(first)
    gathered = reduce(DataFrame.union, others).groupBy("_key").agg(
        F.struct(F.max("leak.n_words").alias("n_words"), F.flatten(F.collect_list("leak.hits")).alias("hits"), F.array_distinct(F.flatten(F.collect_list("leak.items"))).alias("items")).alias("leak")
    )
    return keyed.join(gathered, "_key", "left").select(*docs.columns, F.col("leak").cast(_LEAK).alias("leak")), text, send(first)


_LEAK = "struct<n_words: bigint, hits: array<struct<start: int, end: int>>, items: array<string>>"


def _scan(docs: DataFrame, text: str, block) -> DataFrame:
    """``docs`` whose last column, ``leak``, also has the hits of the windows in the broadcast ``block``."""
    place, names = docs.columns.index(text), docs.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        leaks = _leaks(block.value, batch.column(place).to_pylist(), batch.column(batch.num_columns - 1).to_pylist())
        return pa.RecordBatch.from_arrays([*(batch.column(i) for i in range(batch.num_columns - 1)), pa.array(leaks, _ARROW_LEAK)], names)

    return map_batches(docs, work, docs.schema)


def _leaks(windows: Windows, texts: list, old: list) -> list[dict]:
    """The value of ``leak`` of each text, with what was found ``old``."""
    get, leaks = windows.ids.get, []
    for part in pieces(texts):
        words, starts = [], [0]
        for i in part:
            words += words_of(texts[i])
            starts.append(len(words) + 1)
            words.append(b"")
        ids = np.fromiter((get(w, 0) for w in words), np.uint64, len(words))
        edge = np.zeros(len(ids) + 1, np.int64)  # +1 where a hit window starts, -1 where it ends
        seen: dict[int, set] = defaultdict(set)
        for size, (at, which) in windows.scan(ids).items():
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            for doc, w in set(zip((np.searchsorted(starts, at, "right") - 1).tolist(), which.tolist(), strict=True)):
                seen[doc].update(windows.by_length[size][2][w].tolist())
        covered = np.concatenate([[0], (np.cumsum(edge) > 0).astype(np.int8)])
        begins, ends = np.flatnonzero(np.diff(covered) == 1), np.flatnonzero(np.diff(covered) == -1)
        first = np.searchsorted(begins, starts)
        for k, i in enumerate(part):
            low = starts[k]
            hits = [(int(b) - low, int(e) - low) for b, e in zip(begins[first[k] : first[k + 1]], ends[first[k] : first[k + 1]], strict=True)]
            items = {windows.items[x] for x in seen.get(k, ())} - {None}
            if old[i]:
                hits = _union(hits + [(h["start"], h["end"]) for h in old[i]["hits"]])
                items |= set(old[i]["items"])
            leaks.append({"n_words": starts[k + 1] - low - 1, "hits": [{"start": b, "end": e} for b, e in hits], "items": sorted(items)})
    return leaks


_ARROW_LEAK = pa.struct([("n_words", pa.int64()), ("hits", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))), ("items", pa.list_(pa.string()))])


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for b, e in sorted(spans):
        if out and b <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((b, e))
    return out


def summary(leaks: DataFrame, share: int = 20) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated of each row of ``find_leaks``."""
    n_hit = F.aggregate("leak.hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    return leaks.select(F.col("doc_id").cast("long").alias("doc_id"), "leak", n_hit.alias("n_hit")).select(
        "doc_id",
        F.col("leak.n_words").alias("n_words"),
        "n_hit",
        F.size("leak.items").cast("long").alias("n_items"),
        F.sha2(F.array_join("leak.items", ","), 256).alias("items_sha256"),
        ((F.col("n_hit") > 0) & (share * F.col("n_hit") >= F.col("leak.n_words"))).alias("contaminated"),
    )


def remove_leaks(docs: DataFrame, benchmark: DataFrame, n: int = 13, share: int = 20, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Drop contaminated documents; cut the hit spans out of the others.

    A document goes if ``share`` times its hit words are at least its words.
    From one that stays, each run of hit words is cut with what stands between
    them. Rows, columns and their order are else as in ``docs``: null and empty
    texts stay, rows that repeat are treated alike, other columns may have any
    name, an empty table gives an empty one.
    """
    inner, text = boxed(docs)
    marked, text, block = _all_but_one(inner, text, benchmark, n, block_bytes)
    place, names = inner.columns.index(text), inner.columns

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        """Found, judged and cut in one worker."""
        texts, keep = batch.column(place).to_pylist(), []
        for i, leak in enumerate(_leaks(block.value, texts, batch.column(batch.num_columns - 1).to_pylist())):
            runs = [(h["start"], h["end"]) for h in leak["hits"]]
            if not runs or share * sum(e - b for b, e in runs) < leak["n_words"]:
                keep.append(i)
                texts[i] = cut_words(texts[i], runs) if runs else texts[i]
        columns = [batch.column(i) for i in range(batch.num_columns - 1)]
        columns[place] = pa.array(texts, pa.string())
        return pa.RecordBatch.from_arrays(columns, names).take(pa.array(keep, pa.int64()))

    return map_batches(marked, work, inner.schema).toDF(*docs.columns)


def cut_words(text: str, runs: list[tuple[int, int]]) -> str:
    """``text`` without the words of ``runs`` and what stands between them."""
    spans = [m.span() for m in _WORD.finditer(text)]
    out, at = [], 0
    for b, e in runs:
        out.append(text[at : spans[b][0]])
        at = spans[e - 1][1]
    return "".join([*out, text[at:]])


def brute_force(text: str | None, rows: list[tuple], n: int = 13) -> tuple[int, int, list[str]]:
    """n_words, n_hit and items of one text, by comparing every window."""
    words, hit, items = words_of(text), set(), set()
    for item, other in rows:
        got = words_of(other)
        size = min(n, len(got))
        windows = {tuple(got[i : i + size]) for i in range(len(got) - size + 1)} if size else set()
        for i in range(len(words) - size + 1):
            if size and tuple(words[i : i + size]) in windows:
                hit.update(range(i, i + size))
                items |= {str(item)} - {"None"}
    return len(words), len(hit), sorted(items)


def items_digest(items: list[str]) -> str:
    """What the query returns for a list of items."""
    return hashlib.sha256(",".join(items).encode()).hexdigest()
