"""Token counts through a cache of digests.

The cache is a table of (content digest, tokenizer version digest, count). A
count is made only for contents that the cache lacks, once for each distinct
content, and appended to it.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from weightscope.llm.common import Memo, join_hot, new_path, short_batches, stored

CACHE = "content binary, version binary, n_tokens long"

#: Normal forms that leave a tokenizer's counts as they are.
#: ``spaces``: runs of white space count as one and none count at the ends,
#: and A-Z count as a-z (the tokenizer drops white space and lower-cases), but
#: for texts with a special token's string, which is matched by case.
#: ``none``: the text itself.
NORMAL_FORMS = ("none", "spaces")


def special_strings(path: str) -> list[str]:
    """What a tokenizer of the tokenizers library matches before it lower-cases."""
    if not path.endswith(".json"):
        return []
    with open(path, encoding="utf-8") as f:
        return [t["content"] for t in json.load(f).get("added_tokens") or []]


def normal_form(text: Column, kind: str, special: Iterable[str] = ()) -> Column:
    """The normalised content whose digest is the key of the cache; case stays in texts with a ``special`` string in any case."""
    text = F.coalesce(text, F.lit(""))
    if kind == "none":
        return text
    if kind != "spaces":
        raise ValueError(f"unknown normal form {kind!r}")
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    one = F.regexp_replace(text, r"[\x20\x09-\x0D]+", " ")
    one = F.trim(one)
    folded = F.translate(one, upper, upper.lower())
    cased = F.lit(False)
    for s in special:
        cased |= folded.contains(F.translate(F.lit(s), upper, upper.lower()))
    return F.when(cased, one).otherwise(folded)


def version_digest(path: str, kind: str) -> bytes:
    """Of the vocabulary file, the library that reads it and the normal form."""
    import sentencepiece
    import tokenizers

    with open(path, "rb") as f:
        data = f.read()
    library = f"tokenizers {tokenizers.__version__}" if path.endswith(".json") else f"sentencepiece {sentencepiece.__version__}"
    return hashlib.sha256(data + f"\n{library}\n{kind} 2".encode()).digest()


def _count_words(library, words: list[str], group: int = 256) -> list[int]:
    """Tokens of each word, from the offsets of tokens in the words of a group on lines of their own."""
    out: list[int] = []
    for i in range(0, len(words), group):
        part = words[i : i + group]
        begins = [o[0] for o in library.encode("\n".join(part), add_special_tokens=False).offsets]
        starts = np.cumsum([0, *(len(w) + 1 for w in part)])
        out += np.bincount(np.searchsorted(starts, np.array(begins, np.int64), "right") - 1, minlength=len(part)).tolist()
    return out


@lru_cache(maxsize=2)
def _word_counts(data: bytes, is_json: bool) -> Memo:
    if is_json:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; the library's threads would fight over it
        from tokenizers import Tokenizer

        library = Tokenizer.from_str(data.decode())
        library.no_truncation()
        library.no_padding()
        return Memo(lambda words: _count_words(library, [w.decode() for w in words]))
    import sentencepiece

    piece = sentencepiece.SentencePieceProcessor(model_proto=data)
    return Memo(lambda texts: list(map(len, piece.encode(texts, num_threads=1))), 0)


def _count(text: str, memo: Memo, by_words: bool) -> int:
    if not by_words:
        return memo.fill([text])[0]
    words = text.encode().split()
    try:
        return sum(map(memo.known.__getitem__, words))
    except KeyError:
        memo.learn(words)
        return sum(map(memo.known.__getitem__, words))


def token_counts(
    docs: DataFrame, vocabulary: str, *, kind: str = "spaces", cache_path: str | None = None, limit: int = 2048
) -> DataFrame:
    """Count the tokens of every whole text.

    ``vocabulary`` is the file of a public tokenizer (.json for the tokenizers
    library, .model for sentencepiece); ``kind`` one of ``NORMAL_FORMS``;
    ``cache_path`` the cache's table, made if it isn't there and appended to
    (a new one in the shared folder by default). With ``spaces`` the counts of
    white-space separated words are summed, which equals the whole text's count
    for a tokenizer that drops white space before its merges; with ``none``
    each text goes to the library whole.

    Returns a row per row of ``docs``: doc_id, n_bytes, n_tokens, over_limit
    (n_tokens > limit). Other columns are ignored. Null is the empty text (0
    bytes, 0 tokens); equal rows give equal rows; a null doc_id stays null; an
    empty table gives an empty one.

    Distinct misses are found by digest, not by text: a task forwards a text
    only the first time it meets its content, so a group of copies costs one
    text a task at most, however large it is. Digests and sizes are stored for
    the last join, which doesn't shuffle the rows of very common contents.
    """
    spark = docs.sparkSession
    short_batches(spark)
    version = version_digest(vocabulary, kind)
    cache_path = cache_path or new_path(spark, "token-cache")
    cached = _read(spark, cache_path).where(F.col("version") == F.lit(version)).select("content", "n_tokens")

    texts = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.coalesce("text", F.lit("")).alias("text"),
        F.unhex(F.sha2(normal_form(F.col("text"), kind, special_strings(vocabulary)), 256)).alias("content"),
    )
    had = cached.select("content").distinct()
    _encode_misses(texts.select("content", "text"), had, vocabulary, version, kind).write.mode("append").parquet(cache_path)

    keyed = stored(texts.select("doc_id", "content", F.octet_length("text").cast("long").alias("n_bytes")), "digests")
    now = _read(spark, cache_path).where(F.col("version") == F.lit(version)).groupBy("content").agg(F.max("n_tokens").alias("n_tokens"))
    counts = keyed.groupBy("content").agg(F.count(F.lit(1)).alias("rows"))
    found = join_hot(keyed, stored(counts.join(now, "content"), "counts"), "content", "rows")
    return found.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _read(spark: SparkSession, path: str) -> DataFrame:
    """The cache's rows; none if nothing has been written there."""
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    if not where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        return spark.createDataFrame([], CACHE)
    return spark.read.schema(CACHE).parquet(path)


def _encode_misses(texts: DataFrame, had: DataFrame, vocabulary: str, version: bytes, kind: str) -> DataFrame:
    """Rows of the cache for the contents of ``texts`` that ``had`` lacks."""
    with open(vocabulary, "rb") as f:
        data = f.read()
    is_json = vocabulary.endswith(".json")

    def once(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for batch in batches:
            new = []
            for i, key in enumerate(batch.column("content").to_pylist()):
                if key not in seen:
                    if len(seen) > 500_000:
                        seen.clear()
                    seen.add(key)
                    new.append(i)
            yield batch.take(pa.array(new, pa.int64()))

    def encode(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo, done = _word_counts(data, is_json), set()
        for batch in batches:
            rows = []
            for key, text in zip(batch.column("content").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if key not in done:  # several tasks may have met a content first; they all send it here
                    rows.append((key, _count(text, memo, kind == "spaces")))
                    done.add(key)
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in rows], pa.binary()), pa.array([version] * len(rows), pa.binary()), pa.array([r[1] for r in rows], pa.int64())],
                ["content", "version", "n_tokens"],
            )

    missing = texts.mapInArrow(once, "content binary, text string").join(had, "content", "left_anti")
    return missing.repartition("content").mapInArrow(encode, CACHE)
