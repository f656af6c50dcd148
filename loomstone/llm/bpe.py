"""BPE encoding and decoding by batched numpy merge rounds.

The symbols of many distinct words lie in one flat array. In each round the keys of all neighbouring pairs are looked
up by binary search among the sorted pair keys, each word's lowest rank is found, all its places with that rank are
merged from the left, and words without a pair left retire.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from loomstone.llm.arrays import slices
from loomstone.llm.chunks import ChunkEncoder
from loomstone.llm.common import fresh, quoted, with_body

NO_RANK = np.int64(2**62)


def _new_characters() -> Iterator[str]:
    """What Python's tables do not know or the pattern's tables sort otherwise, as ranges of a character class."""
    letter, digit, space = (regex.compile(p) for p in (r"\p{L}", r"\p{N}", r"\s"))
    begun = None
    for point in range(0xA0, 0x110001):
        c = chr(min(point, 0x10FFFF))
        kind = unicodedata.category(c)
        new = point < 0x110000 and (kind == "Cn" or (kind[0] == "L") != bool(letter.match(c)) or (kind[0] == "N") != bool(digit.match(c)) or c.isspace() != bool(space.match(c)))
        if new and begun is None:
            begun = point
        elif not new and begun is not None:
            yield f"\\U{begun:08x}-\\U{point - 1:08x}"
            begun = None


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: printable ones for themselves, the rest from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class MergeRounds:
    """The merge rules of a vocabulary with an end-of-word suffix, as sorted pair keys."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.n = max(vocab.values()) + 1
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.final = np.array([vocab[c + suffix] for c in letters], np.int64)
        # A pair that is listed twice has its later rank, as in a map that is filled in order.
        rules = {(vocab[a], vocab[b]): (rank, vocab[a + b]) for rank, (a, b) in enumerate(merges)}
        keys = np.array([a * self.n + b for a, b in rules], np.int64)
        order = np.argsort(keys)
        values = np.array(list(rules.values()), np.int64).reshape(-1, 2)[order]
        self.keys, self.rank, self.made = keys[order], values[:, 0], values[:, 1]

    def _look_up(self, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        at = np.searchsorted(self.keys, pairs)
        at[at == len(self.keys)] = 0
        return at, np.where(self.keys[at] == pairs, self.rank[at], NO_RANK)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all words, flat, and how many each has; no word is empty."""
        if not words:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        sizes = np.array([len(w) for w in words], np.int64)
        raw = np.frombuffer(b"".join(words), np.uint8)
        symbols = self.inner[raw]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = self.final[raw[ends]]
        owner = np.repeat(np.arange(len(words)), sizes)
        done_symbols, done_owner = [], []
        while len(symbols):
            inside = owner[1:] == owner[:-1]
            at, rank = self._look_up(symbols[:-1] * self.n + symbols[1:])
            rank = np.where(inside, rank, NO_RANK)
            # The lowest rank of each word; its last symbol starts no pair.
            firsts = np.flatnonzero(np.concatenate(([True], ~inside)))
            least = np.minimum.reduceat(np.append(rank, NO_RANK), firsts)
            lengths = np.diff(np.append(firsts, len(symbols)))
            alive = np.repeat(least < NO_RANK, lengths)
            done_symbols.append(symbols[~alive])
            done_owner.append(owner[~alive])
            chosen = np.zeros(len(symbols), bool)
            chosen[:-1] = (rank == np.repeat(least, lengths)[:-1]) & (rank < NO_RANK)
            # Where chosen places follow one another they share a symbol: every second one counts, from the left.
            run = np.flatnonzero(chosen)
            if len(run):
                new = np.concatenate(([True], np.diff(run) > 1))
                offset = np.arange(len(run)) - np.flatnonzero(new)[np.cumsum(new) - 1]
                run = run[offset % 2 == 0]
            symbols = symbols.copy()
            symbols[run] = self.made[at[run]]
            keep = alive
            keep[run + 1] = False
            symbols, owner = symbols[keep], owner[keep]
        symbols, owner = np.concatenate(done_symbols), np.concatenate(done_owner)
        return symbols[np.argsort(owner, kind="stable")], np.bincount(owner, minlength=len(words)).astype(np.int64)


class WordBpe:
    """Encodes as the vocabulary file says: special tokens, NFC, lower case, words by pattern, bytes, merges."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        self.rounds = MergeRounds(model["vocab"], merges, model["end_of_word_suffix"])
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = next(p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(pattern)
        self.tokens = [""] * (max([*model["vocab"].values(), *self.special.values()]) + 1)
        for token, i in [*model["vocab"].items(), *self.special.items()]:
            self.tokens[i] = token
        self.library = Tokenizer.from_file(path)
        # Combining marks that the library's normalisation orders otherwise.
        marks = (chr(p) for p in range(0x300, 0x110000) if unicodedata.category(chr(p))[0] == "M")
        other = [c for c in marks if self.library.normalizer.normalize_str(f"a\u0345{c}\u0334") != unicodedata.normalize("NFC", f"a\u0345{c}\u0334").lower()]
        self.new = re.compile(f"[{''.join([*_new_characters(), *map(re.escape, other)])}]")
        self.bytes = {letter: b for b, letter in enumerate(byte_letters())}
        self.chunks = ChunkEncoder(self.encode_runs)

    def words(self, text: str) -> list[bytes]:
        if self.new.search(text):
            # The library's tables differ from Python's here: it says itself what is a letter.
            pieces = self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))
            return [bytes(self.bytes[c] for c in piece) for piece, _ in pieces]
        # Letter by letter, so that a capital sigma has one lower case wherever it stands.
        text = unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()
        return [w.encode() for w in self.pattern.findall(text)]

    def encode_runs(self, runs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of runs without white space, flat, and how many each has."""
        place: dict[bytes, int] = {}
        parts: list[int] = []
        counts = []
        for run in runs:
            text = run.decode()
            n = len(parts)
            for k, piece in enumerate(self.specials.split(text) if "<|" in text else (text,)):
                if k % 2:
                    parts.append(-1 - self.special[piece])
                elif piece:
                    parts += [place.setdefault(w, len(place)) for w in self.words(piece)]
            counts.append(len(parts) - n)
        ids, sizes = self.rounds(list(place))
        at = np.asarray(parts, np.int64)
        ordinary = at >= 0
        # The special tokens that occur are one-id words after all others.
        ids = np.concatenate((ids, -1 - at[~ordinary]))
        begin = np.zeros(len(at), np.int64)
        size = np.ones(len(at), np.int64)
        firsts = np.cumsum(sizes) - sizes
        begin[ordinary], size[ordinary] = firsts[at[ordinary]], sizes[at[ordinary]]
        begin[~ordinary] = len(ids) - (~ordinary).sum() + np.arange((~ordinary).sum())
        shift = np.repeat(begin - (np.cumsum(size) - size), size)
        flat = ids[shift + np.arange(int(size.sum()))]
        ends = np.concatenate(([0], np.cumsum(size)))
        return flat, np.diff(ends[np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))])

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        return self.chunks(column)

    def decode(self, ids: np.ndarray, sizes: np.ndarray) -> list[str]:
        """The tokens of each list of ids with a space between; ids outside the vocabulary have none."""
        tokens, n, out = self.tokens, len(self.tokens), []
        flat, at = ids.tolist(), 0
        for size in sizes.tolist():
            out.append(" ".join([tokens[i] for i in flat[at : at + size] if 0 <= i < n and tokens[i]]))
            at += size
        return out


@lru_cache(maxsize=2)
def loaded(path: str) -> WordBpe:
    """One copy of a vocabulary in each worker."""
    return WordBpe(path)


def _lists(flat: np.ndarray, sizes: np.ndarray) -> pa.Array:
    offsets = np.concatenate(([0], np.cumsum(sizes))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))


def encode(docs: DataFrame, vocabulary: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """``docs`` with ``ids`` (array of int), the ids of each whole text, and, if named, ``decoded``, what they decode to.

    ``vocabulary`` is the path of a file for the tokenizers library: BPE with an end-of-word suffix that drops white
    space, found on every worker. No rows move. Null and empty texts have no ids and decode to the empty string;
    repeated rows and extra columns stay; columns of the new names give way. A text without a space is one run and
    is encoded whole.
    """
    kept = docs.drop(ids, *([decoded] if decoded else []))
    names = kept.columns
    rows, body = with_body(kept, text)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            for part in slices(batch, body, 2 << 20):
                flat, sizes = bpe.encode(part.column(body))
                new = [_lists(flat, sizes)]
                if decoded:
                    new.append(pa.array(bpe.decode(flat, sizes), pa.string()))
                yield pa.RecordBatch.from_arrays([*part.columns[: len(names)], *new], names=[*names, ids, *([decoded] if decoded else [])])

    made = [T.StructField(ids, T.ArrayType(T.IntegerType())), *([T.StructField(decoded, T.StringType())] if decoded else [])]
    return rows.mapInArrow(work, T.StructType([*kept.schema, *made]))


def decode(docs: DataFrame, vocabulary: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``docs`` with ``decoded``, the text of each list of ``ids``; a null list decodes to null, a null id to nothing."""
    kept = docs.drop(decoded)
    names = kept.columns
    own, = fresh(kept, "ids_")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(vocabulary)
        for batch in batches:
            lists = batch.column(batch.num_columns - 1)
            flat = np.asarray(lists.flatten().fill_null(-1), np.int64)
            sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), np.int64)
            texts = pa.array(bpe.decode(flat, sizes), pa.string())
            texts = pc.if_else(lists.is_valid(), texts, pa.scalar(None, pa.string()))
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], texts], names=[*names, decoded])

    rows = kept.select(*[quoted(c) for c in names], F.col(f"`{ids}`").cast("array<int>").alias(own))
    return rows.mapInArrow(work, T.StructType([*kept.schema, T.StructField(decoded, T.StringType())]))
