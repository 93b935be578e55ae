"""Quality rules on tokenizer fertility.

A public vocabulary with byte fallback measures how well a text fits it:
characters per token, the share of byte-fallback tokens and the entropy of the
text's tokens. Texts outside the band of their language, or of their script
where the language is unknown, are rejected.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from weightscope.llm.common import boxed, map_batches, pieces


@dataclass(frozen=True)
class Band:
    """What a kept text has.

    ``chars``: least and most characters (code points of the whole text, white
    space included) per token; ``least_bytes``: the least
    tokens for which the lower bound counts in full (shorter texts get
    three quarters of it); ``fallback``: most share of byte tokens; ``entropy``:
    pairs (tokens, bits): a text of so many tokens has at least so many bits a
    token, the last pair that applies counting.
    """

    chars: tuple[float, float]
    fallback: float
    entropy: tuple[tuple[int, float], ...]
    full_from: int = 160


def _bands(chars: float, *bits: float) -> Band:
    """A band with bits at 20, 40, 80, 160, 320, 640 and 1500 tokens."""
    return Band((chars, 9.0), 0.15, tuple(zip((20, 40, 80, 160, 320, 640, 1500), bits, strict=True)))


#: By language code. Measured over the labelled documents of quality 1 that pass the base rules: the least characters per
#: token from 160 tokens on (en 2.19, de 2.37, fr 1.97, es 2.13; short texts go down to 2.01, 2.45, 2.18, 2.09), the most
#: fallback (0.057, 0.043, 0.044, 0.044) and the least bits by length, each with room to spare: a fifth of a character, three
#: times the fallback, a quarter of a bit. Least bits at 40, 80, 160, 320, 640 and 1500 tokens: en 4.99 5.36 5.89 6.20 6.50
#: 6.74, de 5.10 5.53 5.79 6.14 6.36 6.59, fr (none) 5.55 5.71 6.10 6.30 6.50, es 5.43 5.69 5.79 6.12 6.31 6.59.
LANGUAGES = {
    "en": _bands(2.0, 2.8, 4.6, 5.1, 5.6, 5.95, 6.25, 6.45),
    "de": _bands(2.15, 2.8, 4.6, 5.2, 5.5, 5.85, 6.1, 6.3),
    "fr": _bands(1.8, 2.8, 4.6, 5.2, 5.45, 5.8, 6.0, 6.25),
    "es": _bands(1.95, 2.8, 4.6, 5.3, 5.5, 5.85, 6.05, 6.3),
}
_ENTROPY = ((20, 2.8), (40, 3.3), (80, 3.8), (160, 5.4), (320, 5.75), (640, 5.95), (1500, 6.15))
_LOOSE = tuple((n, bits * 0.7) for n, bits in _ENTROPY)
#: By script, for other languages: wider, as nothing of theirs was measured. Scripts that the vocabulary hardly covers
#: fall back to bytes, three or four to a character.
SCRIPTS = {
    "latin": Band((1.4, 9.0), 0.25, _ENTROPY),
    "han": Band((0.3, 5.0), 0.95, _LOOSE),
    "other": Band((0.25, 9.0), 0.98, _LOOSE),
}

_SPACES = " \t\n\r\x0b\x0c"
_SYMBOLS = "#*$%&|<>"


def script_of(text: str) -> str:
    """The script of most of the characters beyond ASCII punctuation and digits."""
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    latin = ((code >= 0x41) & (code < 0x250) & (code != 0xA0)).sum()
    rest = (code >= 0x250).sum()
    han = ((code >= 0x2E80) & (code < 0xD7B0) | (code >= 0x20000)).sum()
    return "latin" if latin >= rest else "han" if 2 * han >= rest else "other"


def verdict(band: Band, chars: int, tokens: int, fallback: int, entropy: float) -> bool:
    """Does a text stay? One without tokens does not."""
    if not tokens:
        return False
    ratio = chars / tokens
    low = band.chars[0] * (1 if tokens >= band.full_from else 0.75)
    least = max((bits for n, bits in band.entropy if tokens >= n), default=0.0)
    return low <= ratio <= band.chars[1] and fallback <= band.fallback * tokens and entropy >= least


#: Characters of a text that the library gets at once.
LOT = 1 << 20
#: Where longer texts are cut: at a blank behind something else, with something to follow.
_CUT = re.compile("(?<=[^ ▁]) (?=.)", re.S)


class Pieces:
    """Token ids of whole texts under a sentencepiece model.

    A blank is ``▁`` to the model, which puts one before what it gets. Where no
    piece has one behind another character, no token reaches over a cut, and a
    long text's tokens are those of its parts, each without its first blank.
    Other models, which ``parted`` tells, get long texts whole too.
    """

    def __init__(self, data: bytes):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_proto=data)
        size = self.model.get_piece_size()
        self.is_byte = np.array([self.model.is_byte(i) for i in range(size)])
        self.parted = not any("▁" in self.model.id_to_piece(i).lstrip("▁") for i in range(size)) and all(
            self.encode(t, 1).tolist() == self.model.encode(t) for t in ("a b", " a  b ", "a \n b\n c", "▁x y", "x\ty é z\r\n①", "a  ", "ﬁ  \n  x")
        )

    def encode(self, text: str, lot: int = LOT) -> np.ndarray:
        """The token ids of a whole text."""
        out, at = [], 0
        while (len(text) - at > lot) and (lot < LOT or self.parted) and (cut := _CUT.search(text, at + lot)):
            out.append(np.array(self.model.encode(text[at : cut.start()], num_threads=1), np.int32))
            at = cut.end()
        return np.concatenate([*out, np.array(self.model.encode(text[at:], num_threads=1), np.int32)])


@lru_cache(maxsize=2)
def _pieces_of(data: bytes) -> Pieces:
    return Pieces(data)


def base_features(texts: list) -> np.ndarray:
    """By row n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, by column texts."""
    words = [(t or "").encode().split() for t in texts]
    out = np.zeros((5, len(texts)), np.int64)
    for i, (text, own) in enumerate(zip(texts, words, strict=True)):
        if not own:
            continue
        lines = [x for x in text.split("\n") if x.strip(_SPACES)]
        out[0, i] = len(own)
        out[1, i] = len(text) - sum(map(text.count, _SPACES))
        out[2, i] = sum(map(text.count, _SYMBOLS))
        out[3, i] = len(lines) - len(set(lines))
    out[2] = [sum(map((t or "").count, _SYMBOLS)) for t in texts]
    out[4] = repeated_words(words)
    return out


def repeated_words(words: list[list[bytes]], n: int = 8) -> np.ndarray:
    """For each list, the words in windows of n that occur twice or more in it."""
    flat = [w for own in words for w in own]
    sizes = np.array([len(own) for own in words], np.int64)
    if len(flat) < n:
        return np.zeros(len(words), np.int64)
    index = {w: i for i, w in enumerate(set(flat))}
    ids = np.fromiter(map(index.__getitem__, flat), np.uint64, len(flat))
    owner, windows = np.repeat(np.arange(len(words)), sizes), len(flat) - n + 1
    at = np.flatnonzero(owner[:windows] == owner[n - 1 :])
    salt = np.random.default_rng(n).integers(1, 1 << 63, n + 1, dtype=np.uint64) | np.uint64(1)
    hashed = owner[:windows].astype(np.uint64) * salt[n]
    for k in range(n):
        hashed += ids[k : k + windows] * salt[k]
    hashed = hashed[at]
    order = np.argsort(hashed, kind="stable")
    at, hashed = at[order], hashed[order]
    like_next = np.flatnonzero(hashed[1:] == hashed[:-1])
    left, right = at[like_next], at[like_next + 1]
    same = owner[left] == owner[right]
    for k in range(n):
        same &= ids[left + k] == ids[right + k]
    if not same.all():  # unlike windows share a hash: number windows instead
        rows = np.stack([owner[at].astype(np.uint64), *(ids[at + k] for k in range(n))], 1)
        _, which, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        twice = at[counts[which.ravel()] > 1]
    else:
        twice = np.union1d(left, right)
    edge = np.zeros(len(flat) + 1, np.int64)
    edge[twice] += 1
    edge[twice + n] -= 1
    covered = np.cumsum(edge[:-1]) > 0
    return np.bincount(owner[covered], minlength=len(words)).astype(np.int64)


_RESULT = pa.struct(
    [
        *((k, pa.int64()) for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")),
        ("base_failed", pa.bool_()),
        ("kept", pa.bool_()),
        ("n_tokens", pa.int64()),
        ("chars_per_token", pa.float64()),
        ("fallback_share", pa.float64()),
        ("token_entropy", pa.float64()),
        ("band", pa.string()),
    ]
)
_RESULT_SQL = (
    "struct<n_words: bigint, word_chars: bigint, n_symbols: bigint, n_dup_lines: bigint, n_repeat_words: bigint, base_failed: boolean,"
    " kept: boolean, n_tokens: bigint, chars_per_token: double, fallback_share: double, token_entropy: double, band: string>"
)


def judge(docs: DataFrame, model_path: str, languages: dict[str, Band] = LANGUAGES, scripts: dict[str, Band] = SCRIPTS, *, text: str = "text", lang: str = "lang") -> DataFrame:
    """Measure every whole text and give the verdict, in a column ``quality``.

    ``docs`` needs ``text``; ``lang`` chooses the band if it is there (both may
    be called otherwise). All
    other columns stay, except that one called ``quality`` is replaced. The
    struct has n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed (under 20 words, or over 30 % of the words in repeated windows
    of 8), kept, and the measures over all tokens of the whole text. Null and
    empty texts have no words, no measures (null) and fail; an unknown or null
    language takes the band of the text's script; equal rows give equal rows;
    an empty table gives an empty one. One pass, no shuffle.
    """
    with open(model_path, "rb") as f:
        data = f.read()
    docs = docs.drop("quality")
    place = docs.columns.index(text)
    lang_at = docs.columns.index(lang) if lang in docs.columns else None
    names = [*docs.columns, "quality"]

    def work(batch: pa.RecordBatch) -> pa.RecordBatch:
        vocabulary = _pieces_of(data)
        texts = batch.column(place).to_pylist()
        langs = batch.column(lang_at).to_pylist() if lang_at is not None else [None] * len(texts)
        rows = []
        for part in pieces(texts):
            own = [texts[i] for i in part]
            base = base_features(own)
            for k, i in enumerate(part):
                n_words, word_chars, symbols, dup, repeat = base[:, k].tolist()
                ids, chars = vocabulary.encode(own[k] or ""), len(own[k] or "")
                tokens, failed = len(ids), n_words < 20 or 100 * repeat > 30 * n_words
                row = {"n_words": n_words, "word_chars": word_chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": repeat, "base_failed": failed, "n_tokens": tokens}
                entropy, fallback = 0.0, 0
                if tokens:
                    counts = np.bincount(ids)
                    counts = counts[counts > 0]
                    entropy = float(np.log2(tokens) - (counts * np.log2(counts)).sum() / tokens)
                    fallback = int(vocabulary.is_byte[ids].sum())
                    row |= {"chars_per_token": chars / tokens, "fallback_share": fallback / tokens, "token_entropy": entropy}
                name = langs[i] if langs[i] in languages else script_of(own[k] or "")
                band = languages.get(name) or scripts[name]
                rows.append(row | {"band": name, "kept": not failed and verdict(band, chars, tokens, fallback, entropy)})
        columns = [batch.column(i) for i in range(batch.num_columns)]
        return pa.RecordBatch.from_arrays([*columns, pa.array(rows, _RESULT)], names)

    return map_batches(docs, work, docs.withColumn("quality", F.lit(None).cast(_RESULT_SQL)).schema)


def keep(docs: DataFrame, model_path: str, languages: dict[str, Band] = LANGUAGES, scripts: dict[str, Band] = SCRIPTS) -> DataFrame:
    """The rows of ``docs`` that ``judge`` keeps, with all their columns, whatever these are called."""
    inner, text = boxed(docs)
    lang = f"c{docs.columns.index('lang')}" if "lang" in docs.columns else "lang"
    judged = judge(inner, model_path, languages, scripts, text=text, lang=lang)
    return judged.where("quality.kept").select(*inner.columns).toDF(*docs.columns)
