"""Byte-pair encoding and decoding by merge rounds over many words at once.

The symbols of all new words of a block lie in one flat array. Each round looks up every neighbouring
pair by binary search among the sorted pair keys, and joins the pairs that no other merge can come
before: in a short word its pair of least rank, in a long one every pair that is least among all that
a token could reach. The vocabulary is a parameter (a ``tokenizers`` file) that every task reads once.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache, lru_cache
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quire.llm.kernels import blocks, flat

#: Words of more symbols than this are merged wherever a pair is least within reach, not pair by pair of the word.
LONG_WORD = 64
#: Distinct chunks of text whose ids a task remembers; at more it begins anew.
KNOWN_WORDS = 1 << 18
_NONE = np.iinfo(np.int64).max
#: Marks that stand alone behind a word.
MARKS = frozenset(".,;:!?")
#: White space as the tokenizer's own pattern has it.
SPACE = regex.compile(r"[\t-\r \x85\xa0  -     　]+")


@cache
def byte_characters() -> list[str]:
    """The printable stand-in of each byte: itself if it is a visible Latin-1 character, else the next from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(others)) for b in range(256)]


@cache
def newer_characters() -> str:
    """Letters and numbers that the pattern engine has and the Unicode tables of Python, which the tokenizer's agree with, lack: as ranges of a class."""
    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    points = [ord(c) for c in regex.findall(r"[\p{L}\p{N}]", every) if unicodedata.category(c) == "Cn"]
    heads = [c for c, before in zip(points, [None, *points], strict=False) if before is None or c != before + 1]
    tails = [c for c, after in zip(points, [*points[1:], None], strict=True) if after is None or c != after - 1]
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(heads, tails, strict=True))


def word_pattern(told: str) -> regex.Pattern:
    """The pattern that finds words, without characters newer than the tokenizer's tables."""
    newer = newer_characters()
    for kind in (r"\p{L}", r"\p{N}") if newer else ():
        told = told.replace(kind, f"[{kind}--[{newer}]]")
    return regex.compile(told, regex.V1)


@dataclass(frozen=True)
class Vocabulary:
    """A tokenizer file as arrays. ``keys`` are sorted pairs ``left * size + right``; ``ranks`` and ``made`` belong to them."""

    tokens: tuple[str, ...]
    special: dict[str, int]
    first: np.ndarray
    last: np.ndarray
    keys: np.ndarray
    ranks: np.ndarray
    made: np.ndarray
    reach: int
    pattern: regex.Pattern
    token_bytes: np.ndarray
    token_off: np.ndarray

    @property
    def size(self) -> int:
        return len(self.tokens)


@lru_cache(maxsize=4)
def load_vocabulary(path: str) -> Vocabulary:
    """Reads a tokenizer file whose model is BPE with an end-of-word suffix over the stand-ins of bytes.

    Every token may come from one merge only, and that before the merges that use it: then all pairs
    of equal rank join at once. A file where this does not hold is refused.
    """
    with open(path, encoding="utf-8") as f:
        told = json.load(f)
    model, vocab = told["model"], told["model"]["vocab"]
    suffix = model.get("end_of_word_suffix") or ""
    special = {t["content"]: t["id"] for t in told["added_tokens"]}
    tokens = [""] * (max([*vocab.values(), *special.values()]) + 1)
    for name, i in [*vocab.items(), *special.items()]:
        tokens[i] = name
    size = len(tokens)
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    left = np.array([vocab[a] for a, _ in pairs], np.int64)
    right = np.array([vocab[b] for _, b in pairs], np.int64)
    made = np.array([vocab[a + b] for a, b in pairs], np.int64)
    born = np.full(size, -1, np.int64)
    born[made] = np.arange(len(pairs))
    if len(np.unique(made)) < len(made) or (born[left] >= np.arange(len(pairs))).any() or (born[right] >= np.arange(len(pairs))).any():
        raise ValueError("the merges are not in the order in which tokens were made")
    order = np.argsort(left * size + right)
    split = next(p["pattern"]["Regex"] for p in told["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
    stand_in = byte_characters()
    encoded = [t.encode() for t in tokens]
    return Vocabulary(
        tuple(tokens), special, np.array([vocab[c] for c in stand_in]), np.array([vocab[c + suffix] for c in stand_in]), (left * size + right)[order], order.astype(np.int64), made[order],
        max(len(t.removesuffix(suffix)) for t in vocab), word_pattern(split),
        np.frombuffer(b"".join(encoded), np.uint8), np.concatenate([[0], np.cumsum([len(t) for t in encoded])]),
    )


def least_nearby(x: np.ndarray, reach: int) -> np.ndarray:
    """The least value within ``reach`` places of each, by running minima over blocks of the window's width."""
    width, n = 2 * reach + 1, len(x)
    padded = np.full(-(-(n + 2 * reach) // width) * width, _NONE)
    padded[reach : reach + n] = x
    rows = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(rows, 1).ravel()
    back = np.minimum.accumulate(rows[:, ::-1], 1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def merge_words(data: np.ndarray, off: np.ndarray, v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """The token ids of words (bytes ``data``, n+1 offsets; none empty) and their n+1 offsets.

    A pair joins in a round if it has the least rank of its word, or in a long word the least within
    ``reach`` places: what begins further away and comes nearer would be one token longer than the
    longest. Of equal pairs that overlap, every second joins, from the first on.
    """
    ids = v.first[data]
    ids[off[1:] - 1] = v.last[data[off[1:] - 1]]
    word = np.repeat(np.arange(len(off) - 1), np.diff(off))

    def look_up(at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and token of the pairs that begin at these places; none across words."""
        after = np.minimum(at + 1, len(ids) - 1)
        key = ids[at] * v.size + ids[after]
        place = np.minimum(np.searchsorted(v.keys, key), len(v.keys) - 1)
        there = (v.keys[place] == key) & (word[at] == word[after]) & (after > at)
        return np.where(there, v.ranks[place], _NONE), v.made[place]

    rank, made = look_up(np.arange(len(ids)))
    done_ids, done_words = [], []
    while len(ids):
        heads = np.flatnonzero(np.append(True, word[1:] != word[:-1]))
        sizes = np.diff(np.append(heads, len(ids)))
        least = np.minimum.reduceat(rank, heads)
        open_word = np.repeat(least < _NONE, sizes)
        bound = np.repeat(least, sizes)
        if (long := np.repeat(sizes > LONG_WORD, sizes)).any():
            bound[long] = least_nearby(rank, v.reach)[long]
        # overlapping joins are a run of one rank, as in "aaa": every second of it, from where the run begins; one whose beginning waits waits too
        at = np.flatnonzero((rank < _NONE) & (rank <= bound))
        begins = np.append(True, np.diff(at) > 1)[: len(at)]
        begin = at[np.maximum.accumulate(np.where(begins, np.arange(len(at)), 0))]
        whole = (begin == 0) | (rank[begin - 1] != rank[begin])
        at = at[whole & ((at - begin) % 2 == 0)]
        ids[at] = made[at]
        keep, changed = np.ones(len(ids), bool), np.zeros(len(ids), bool)
        keep[at + 1] = False
        changed[at] = True
        done = keep & ~open_word
        done_ids.append(ids[done])
        done_words.append(word[done])
        keep &= open_word
        ids, word, rank, made, changed = ids[keep], word[keep], rank[keep], made[keep], changed[keep]
        changed[:-1] |= changed[1:]
        stale = np.flatnonzero(changed)
        if len(stale):
            rank[stale], made[stale] = look_up(stale)
    if not done_ids:
        return np.zeros(0, np.int64), np.zeros(len(off), np.int64)
    ids, word = np.concatenate(done_ids), np.concatenate(done_words)
    order = np.argsort(word, kind="stable")
    return ids[order], np.concatenate([[0], np.cumsum(np.bincount(word, minlength=len(off) - 1))])


def spans(off: np.ndarray, items: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the parts of all ``items`` one after the other, and the n+1 offsets of the items in them."""
    sizes = off[items + 1] - off[items]
    out = np.concatenate([[0], np.cumsum(sizes)])
    return np.arange(out[-1]) + np.repeat(off[items] - out[:-1], sizes), out


class _Numbered(dict):
    """Numbers what it is asked for in the order of the first time."""

    def __missing__(self, key: str) -> int:
        self[key] = n = len(self)
        return n


class Encoder:
    """What a task has met between white space, with its ids; new words are merged together, block by block."""

    def __init__(self, v: Vocabulary):
        self.v = v
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(v.special, key=len, reverse=True))) + ")") if v.special else None
        self._forget()

    def _forget(self) -> None:
        # a special token's place is under its text behind a blank, which no word holds
        self.known = _Numbered((" " + t, i) for i, t in enumerate(self.v.special))
        self.ids, self.off = np.array(list(self.v.special.values()), np.int32), np.arange(len(self.v.special) + 1)

    def chunks(self, text: str) -> list[str]:
        """What lies between white space in a normalised text; special tokens in it are found before that. No word of the pattern holds white space."""
        out: list[str] = []
        parts = self.special.split(text) if self.special and "<" in text else (text,)
        for i, part in enumerate(parts):
            if i % 2:
                out.append(" " + part)
            elif part:
                # one lower case for each character: no final form of sigma
                part = unicodedata.normalize("NFC", part).replace("Σ", "σ").lower()
                # these four count as white space for Python alone
                out += filter(None, SPACE.split(part)) if any(c in part for c in "\x1c\x1d\x1e\x1f") else part.split()
        return out

    def _learn(self, new: list[str]) -> None:
        """Cuts new chunks into words, merges each word once, and keeps the ids of the chunks."""
        words, places, ends = _Numbered(), [], [0]
        number, cut_up = words.__getitem__, self.v.pattern.findall
        for chunk in new:
            # most are letters alone, or with one mark behind, which needs no pattern
            if chunk.isalpha():
                places.append(number(chunk))
            elif chunk[-1] in MARKS and chunk[:-1].isalpha():
                places += (number(chunk[:-1]), number(chunk[-1]))
            else:
                places += map(number, cut_up(chunk))
            ends.append(len(places))
        raw = [w.encode() for w in words]
        ids, off = merge_words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(w) for w in raw], dtype=np.int64)]), self.v)
        at, cut = spans(off, np.array(places, np.int64))
        self.ids = np.concatenate([self.ids, ids[at].astype(np.int32)])
        self.off = np.concatenate([self.off, self.off[-1] + cut[ends[1:]]])

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in one array, and the n+1 offsets of texts."""
        if len(self.known) > KNOWN_WORDS:
            self._forget()
        number, before, places, ends = self.known.__getitem__, len(self.known), [], [0]
        for text in texts:
            places += map(number, self.chunks(text))
            ends.append(len(places))
        if len(self.known) > before:
            self._learn(list(islice(self.known, before, None)))
        at, cut = spans(self.off, np.array(places, np.int64))
        return self.ids[at], cut[np.array(ends)]


def encode_texts(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, ids): the token ids of every whole text, as the ``tokenizers`` library gives them without added special tokens.

    Null and empty texts, and texts without a word, have no ids. Repeated rows stay, other columns are
    dropped. Characters that Unicode has had only since its version 16 are no letters here and have no
    lower case; all others are cut and lowered as the library does. A task holds a block of about 1 MB of texts, or one longer text, and the words that it knows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(load_vocabulary(path))
        for batch in batches:
            data, off = flat(batch.column("text"))
            for i, j in blocks(off):
                raw = data[off[i] : off[j]].tobytes()
                ids, cut = encoder.encode([raw[a:b].decode("utf-8", "replace") for a, b in zip(off[i:j] - off[i], off[i + 1 : j + 1] - off[i], strict=True)])
                lists = pa.ListArray.from_arrays(pa.array(cut, pa.int32()), pa.array(ids, pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], lists], names=["doc_id", "ids"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, ids array<int>")


def decode_ids(rows: DataFrame, path: str) -> DataFrame:
    """Adds ``decoded`` to (doc_id, ids): tokens joined by blanks, special ones too, as the library decodes where the file names no decoder.

    Ids that the vocabulary lacks are skipped, and null counts as no ids.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = load_vocabulary(path)
        for batch in batches:
            column = batch.column("ids").fill_null([]) if batch.column("ids").null_count else batch.column("ids")
            ids, counts = column.flatten().to_numpy(zero_copy_only=False).astype(np.int64), column.value_lengths().to_numpy(zero_copy_only=False)
            owner = np.repeat(np.arange(len(batch)), counts)
            held = (ids >= 0) & (ids < v.size)
            ids, owner = ids[held], owner[held]
            off = np.concatenate([[0], np.cumsum(np.bincount(owner, minlength=len(batch)))])
            for i, j in blocks(off, 1 << 18):
                some = ids[off[i] : off[j]]
                at, cut = spans(v.token_off, some)
                # a blank goes before every token but the first of a row
                blank = np.ones(len(some), bool)
                heads = off[i:j][off[i + 1 : j + 1] > off[i:j]] - off[i]
                blank[heads] = False
                shift = np.cumsum(blank)
                out = np.full(len(at) + int(blank.sum()), 0x20, np.uint8)
                out[np.arange(len(at)) + np.repeat(shift, np.diff(cut))] = v.token_bytes[at]
                ends = np.append(0, cut[1:] + shift)[off[i : j + 1] - off[i]]
                text = pa.LargeStringArray.from_buffers(j - i, pa.py_buffer(ends.astype(np.int64)), pa.py_buffer(out)).cast(pa.string())
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[i:j], batch.column("ids")[i:j], text], names=["doc_id", "ids", "decoded"])

    return rows.select("doc_id", "ids").mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, ids array<int>, decoded string")


def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of the ids and of the decoded text of every document, by the public 49k-word vocabulary."""
    import public_tokenizers

    path = public_tokenizers.path("word_bpe_49k.json")
    rows = decode_ids(encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), path), path)
    said = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return rows.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(said, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
