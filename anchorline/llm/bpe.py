"""Byte-pair encoding by speculation: longest matches first, then a check of every adjacent pair.

A sequence of tokens is the one that merging gives if, and only if, merging the text of each adjacent pair gives that
pair back, and each token alone gives itself. So a cheap proposal (the longest vocabulary entry at each position) is
tested pair by pair, and only words with a failing pair are merged step by step. Words repeat, so both steps work on
the distinct words that a task has not met yet.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

# The splitting pattern and the end-of-word mark of this family of vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
WORD_END = "</w>"
# Words a task remembers; beyond that it starts afresh, which costs time and changes nothing.
REMEMBERED = 1_000_000


def _byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    for n, b in enumerate(b for b in range(256) if b not in letters):
        letters[b] = chr(256 + n)
    return [letters[b] for b in range(256)]


class Vocabulary:
    """A word-end BPE vocabulary read from its public JSON description."""

    def __init__(self, description: str):
        told = json.loads(description)
        self.ids: dict[str, int] = told["model"]["vocab"]
        self.suffix: str = told["model"]["end_of_word_suffix"] or ""
        merges = [m.split(" ") if isinstance(m, str) else m for m in told["model"]["merges"]]
        self.span = 1 + max(self.ids.values())
        self.ranks = {self.ids[a] * self.span + self.ids[b]: n for n, (a, b) in enumerate(merges)}
        self.merged = [self.ids[a + b] for a, b in merges]
        self.special = {t["content"]: t["id"] for t in told["added_tokens"]}
        named = {i: t for t, i in (*self.ids.items(), *self.special.items())}
        self.names = [named.get(i, "") for i in range(1 + max(named))]
        inner = [t for t in self.ids if not t.endswith(self.suffix)] if self.suffix else list(self.ids)
        # Every beginning of an entry, with the entry's id where it is one itself.
        self.starts = dict.fromkeys((t[:n] for t in inner for n in range(1, len(t))), -1) | {t: self.ids[t] for t in inner}
        self.letters = _byte_letters()
        self.bytes = {c: b for b, c in enumerate(self.letters)}
        self.pieces = regex.compile(PIECES)
        self.split = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.space = regex.compile(r"\s+")
        # Letters on whose case, form and class all Unicode versions agree; for others the vocabulary's own rules apply.
        self.settled = regex.compile(r"[\x00-\u052F\u2010-\u2027]*+")
        self.rules = Tokenizer.from_str(description)
        self.fits: dict[int, bool] = {}
        self.width = len(self.names)
        self.words: dict[str, tuple[int, ...]] = {}

    # Text to words

    def normalised(self, text: str) -> str:
        """Composed form, runs of white space as one space, lower case letter by letter."""
        text = self.space.sub(" ", unicodedata.normalize("NFC", text))
        # A letter's own lower case, not the form it takes at the end of a word.
        return text.replace("Σ", "σ").lower()

    def tokens_of(self, text: str) -> list[int]:
        """The ids of a whole text."""
        if self.split is None:
            return self._plain(text)
        parts = self.split.split(text)
        if len(parts) == 1:
            return self._plain(text)
        return list(chain.from_iterable(
            [self.special[p]] if p in self.special else self._plain(p) for p in parts if p
        ))

    def _plain(self, text: str) -> list[int]:
        if self.settled.fullmatch(text):
            found = self.pieces.findall(self.normalised(text))
        else:
            found = [p for p, _ in self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))]
            found = [bytes(map(self.bytes.__getitem__, p)).decode("utf-8", "surrogatepass") for p in found]
        known = self.words
        new = set(found).difference(known)
        if new:
            if len(known) + len(new) > REMEMBERED:
                known.clear()
                new = set(found)
            known.update(self.encode_words(sorted(new)))
        return list(chain.from_iterable(map(known.__getitem__, found)))

    # Words to tokens

    def encode_words(self, words: list[str]) -> dict[str, tuple[int, ...]]:
        """Propose, test all adjacent pairs of all words at once, and merge the words that fail."""
        letters = self.letters
        spelled = ["".join([letters[b] for b in w.encode("utf-8", "surrogatepass")]) for w in words]
        proposed = [self.propose(s) for s in spelled]
        lengths = np.fromiter(map(len, proposed), np.int64, len(proposed))
        flat = np.fromiter(chain.from_iterable(proposed), np.int64, int(lengths.sum()))
        owner = np.repeat(np.arange(len(words)), lengths)
        # Single tokens count as a pair with themselves as the second half left out (width - 1 is no id).
        first = np.concatenate([flat[:-1][owner[1:] == owner[:-1]], flat])
        second = np.concatenate([flat[1:][owner[1:] == owner[:-1]], np.full(len(flat), self.width)])
        of = np.concatenate([owner[:-1][owner[1:] == owner[:-1]], owner])
        codes, back = np.unique(first * (self.width + 1) + second, return_inverse=True)
        good = np.fromiter(map(self.compatible, codes.tolist()), bool, len(codes))
        bad = np.zeros(len(words), bool)
        bad[of[~good[back]]] = True
        for n in np.flatnonzero(bad):
            proposed[n] = self.merge(spelled[n])
        return dict(zip(words, proposed, strict=True))

    def propose(self, letters: str) -> tuple[int, ...]:
        """The longest entry at each position in turn."""
        starts, ids, suffix, at, end, out = self.starts.get, self.ids.get, self.suffix, 0, len(letters), []
        while at < end:
            token, stop = ids(letters[at:] + suffix), end
            if token is None:
                n = at + 1
                while n < end and (found := starts(letters[at:n])) is not None:
                    if found >= 0:
                        token, stop = found, n
                    n += 1
            if token is None:
                raise ValueError("the vocabulary lacks a byte")
            out.append(token)
            at = stop
        return tuple(out)

    def compatible(self, code: int) -> bool:
        """Whether merging the two texts together keeps the border between them."""
        known = self.fits.get(code)
        if known is None:
            a, b = divmod(code, self.width + 1)
            pair = (a,) if b == self.width else (a, b)
            text = "".join(self.names[i] for i in pair)
            ended = text.endswith(self.suffix)
            known = self.fits[code] = self.merge(text[: -len(self.suffix)] if ended else text, ended) == pair
        return known

    def merge(self, letters: str, ended: bool = True) -> tuple[int, ...]:
        """Exact encoding: the pair of least rank, leftmost first, joins until no pair is left."""
        parts = [self.ids[c] for c in letters]
        if ended and self.suffix:
            parts[-1] = self.ids[letters[-1] + self.suffix]
        if len(parts) > 200:
            return self._merge_long(parts)
        ranks, span, none = self.ranks.get, self.span, 1 << 60
        near = [ranks(a * span + b, none) for a, b in zip(parts, parts[1:], strict=False)]
        while near:
            rank = min(near)
            if rank == none:
                break
            at = near.index(rank)
            parts[at : at + 2] = [self.merged[rank]]
            del near[at]
            if at:
                near[at - 1] = ranks(parts[at - 1] * span + parts[at], none)
            if at < len(near):
                near[at] = ranks(parts[at] * span + parts[at + 1], none)
        return tuple(parts)

    def _merge_long(self, parts: list[int]) -> tuple[int, ...]:
        """The same with a heap over linked parts, for words of any length."""
        end = len(parts)
        after, before = list(range(1, end + 1)), list(range(-1, end - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(n: int) -> None:
            if n >= 0 and after[n] < end:
                a, b = parts[n], parts[after[n]]
                rank = self.ranks.get(a * self.span + b)
                if rank is not None:
                    heapq.heappush(heap, (rank, n, a, b))

        for n in range(end - 1):
            offer(n)
        while heap:
            rank, n, a, b = heapq.heappop(heap)
            m = after[n]
            if parts[n] != a or m >= end or parts[m] != b:
                continue
            parts[n], parts[m] = self.merged[rank], -1
            after[n] = after[m]
            if after[m] < end:
                before[after[m]] = n
            offer(n)
            offer(before[n])
        return tuple(p for p in parts if p >= 0)

    # Tokens to text

    def text_of(self, ids: list[int]) -> str:
        """Token texts with a space between, as a vocabulary without a decoder is read."""
        return " ".join(map(self.names.__getitem__, ids))


def little_endian(ids: list[int]) -> bytes:
    """Unsigned 32-bit integers, least byte first."""
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


_LOADED: dict[int, Vocabulary] = {}


def loaded(description: str) -> Vocabulary:
    """The vocabulary, read once in each Python process; what it has learnt about words stays."""
    key = hash(description)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = Vocabulary(description)
    return _LOADED[key]


SCHEMA = "doc_id {id}, n_tokens BIGINT, token_ids ARRAY<INT>, decoded STRING"


def encode_documents(docs: DataFrame, vocabulary: str, digests: bool = False) -> DataFrame:
    """Token ids and decoded text per row: doc_id, n_tokens, token_ids, decoded.

    ``vocabulary`` is the JSON description itself, which travels to the tasks. Needs doc_id and text, ignores other
    columns, keeps repeated rows; a null text is empty and gives no tokens. With ``digests`` the last two columns are
    replaced by ids_sha256 (of little-endian unsigned 32-bit ids) and decoded_sha256 (of UTF-8), both lower-case hex.
    """
    kind = dict(docs.dtypes)["doc_id"]
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocab = loaded(shared.value)
        for whole in batches:
            for start in range(0, whole.num_rows, 256):
                batch = whole.slice(start, 256)
                counts, left, right = [], [], []
                for text in batch.column(1):
                    ids = vocab.tokens_of(text.as_py() or "")
                    decoded = vocab.text_of(ids)
                    counts.append(len(ids))
                    if digests:
                        left.append(hashlib.sha256(little_endian(ids)).hexdigest())
                        right.append(hashlib.sha256(decoded.encode("utf-8")).hexdigest())
                    else:
                        left.append(ids)
                        right.append(decoded)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(left, pa.string() if digests else pa.list_(pa.int32())),
                     pa.array(right, pa.string())],
                    ["doc_id", "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("token_ids", "decoded"))],
                )

    schema = SCHEMA.format(id=kind)
    if digests:
        schema = schema.replace("token_ids ARRAY<INT>, decoded", "ids_sha256 STRING, decoded_sha256")
    return docs.select("doc_id", "text").mapInArrow(run, schema)
