"""Token counts by rank-synchronous array merging.

The vocabulary is a word-level byte-pair encoding (``word_bpe_49k.json``): text is composed (NFC),
white space is dropped, letters are lower-cased, and each pre-token ends in a ``</w>`` symbol. All
pre-tokens of a batch that the cache lacks are held as one ragged numpy array; in each round every
sequence merges its lowest-rank pair everywhere at once, until none has a pair left. In this
vocabulary each merge makes a symbol of its own, so merging all places of the lowest pair together
gives the same result as merging them one by one.

Defined results: a null text counts as empty (0 tokens, 0 bytes); an empty table gives an empty one;
repeated rows are counted row by row; columns other than ``doc_id`` and ``text`` are ignored.
"""

from __future__ import annotations

import json
import unicodedata
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

from kinforge.llm._arrays import HashTable, mix, prefix, segment_hash, text_slices
from kinforge.llm._store import bounded_batches

VOCABULARY = "word_bpe_49k.json"
#: How the vocabulary splits words; Encoder.spans does the same for whole arrays.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
TOKEN_LIMIT = 2048
#: Words that a worker's cache holds at most before it starts anew (memory only; results don't depend on it).
CACHE_WORDS = 400_000
_NONE = np.int64(1 << 40)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    extra = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(extra)) for b in range(256)]


class Encoder:
    """Encodes words by merging ragged batches; remembers words it has seen."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab = model["vocab"]
        suffix = model["end_of_word_suffix"]
        if len(vocab) >= 1 << 16:
            raise ValueError("ids don't fit 16 bits")
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        if split["pattern"]["Regex"] != PATTERN:
            raise ValueError("the vocabulary splits words by another pattern")
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        symbols = _byte_symbols()
        self.inner = np.array([vocab[s] for s in symbols], dtype=np.int64)
        self.final = np.array([vocab[s + suffix] for s in symbols], dtype=np.int64)
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        keys = np.array([(vocab[a] << 16) | vocab[b] for a, b in pairs], dtype=np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        if len(np.unique(self.merged)) != len(self.merged):
            raise ValueError("two merges make the same symbol; merging all places at once would be wrong")
        self._build(keys)
        self.cache_words = cache_words
        self.reserve(0)

    def _build(self, keys: np.ndarray) -> None:
        """An open-addressed table from pair to rank, looked up for whole arrays."""
        self.bits = 19
        size = 1 << self.bits
        self.slot_key = np.full(size, -1, dtype=np.int64)
        self.slot_rank = np.full(size, _NONE, dtype=np.int64)
        todo = np.arange(len(keys))
        at = self._slot(keys)
        self.probes = 0
        while len(todo):
            free = self.slot_key[at] < 0
            cand, where = todo[free], at[free]
            _, first = np.unique(where, return_index=True)
            self.slot_key[where[first]] = keys[cand[first]]
            self.slot_rank[where[first]] = cand[first]
            left = self.slot_key[at] != keys[todo]
            todo, at = todo[left], (at[left] + 1) & (size - 1)
            self.probes += 1

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        mixed = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        return (mixed >> np.uint64(64 - self.bits)).astype(np.int64)

    def ranks(self, keys: np.ndarray) -> np.ndarray:
        at = self._slot(keys)
        found = self.slot_key[at]
        out = np.where(found == keys, self.slot_rank[at], _NONE)
        open_ = np.flatnonzero((found != keys) & (found >= 0))
        for _ in range(self.probes):
            if not len(open_):
                break
            at_o = at[open_] = (at[open_] + 1) & (len(self.slot_key) - 1)
            found = self.slot_key[at_o]
            hit = found == keys[open_]
            out[open_[hit]] = self.slot_rank[at_o[hit]]
            open_ = open_[~hit & (found >= 0)]
        return out

    def merge(self, pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Symbol ids of non-empty byte strings, and how many each has."""
        lens = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        flat = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        sym = self.inner[flat]
        sym[starts + lens - 1] = self.final[flat[starts + lens - 1]]
        rows = np.arange(len(pieces))
        sizes = np.zeros(len(pieces), dtype=np.int64)
        done_sym, done_row = [], []
        while len(rows):
            rank = np.full(len(sym), _NONE, dtype=np.int64)
            rank[:-1] = self.ranks((sym[:-1] << 16) | sym[1:])
            rank[starts + lens - 1] = _NONE
            low = np.minimum.reduceat(rank, starts)
            done = low == _NONE
            if done.any():
                out = np.repeat(done, lens)
                done_sym.append(sym[out])
                done_row.append(np.repeat(rows[done], lens[done]))
                sizes[rows[done]] = lens[done]
                sym, rank = sym[~out], rank[~out]
                rows, lens, low = rows[~done], lens[~done], low[~done]
                if not len(rows):
                    break
                starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
            hit = rank == np.repeat(low, lens)
            at = np.flatnonzero(hit)
            follows = np.flatnonzero(np.diff(at) == 1)
            if len(follows):  # a run of one symbol: take every other place from its left end
                run_start = np.ones(len(at), dtype=bool)
                run_start[follows + 1] = False
                begin = at[np.maximum.accumulate(np.where(run_start, np.arange(len(at)), 0))]
                at = at[(at - begin) % 2 == 0]
            sym[at] = self.merged[rank[at]]
            gone = np.zeros(len(sym), dtype=np.int64)
            gone[at + 1] = 1
            lens = lens - np.add.reduceat(gone, starts)
            sym = sym[gone == 0]
            starts = np.concatenate(([0], np.cumsum(lens)[:-1]))
        order = np.argsort(np.concatenate(done_row), kind="stable")
        return np.concatenate(done_sym)[order].astype(np.uint16), sizes

    def _normal(self, text: str) -> str:
        """Composed and lowered; letters are lowered one by one, so that sigma has one form."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.lower() if "\u03a3" not in text else "".join(map(str.lower, text))

    def spans(self, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Starts and ends of the pre-tokens in code points that end in white space.

        Runs of letters, single numbers, runs of what is neither; an apostrophe that begins such a run
        and one of the known endings stay together.
        """
        kind = char_classes()[code]
        start = np.ones(len(code), dtype=bool)
        start[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        quote = np.flatnonzero(code[:-1] == 39)
        if len(quote):
            before = kind[quote - 1]
            before[quote == 0] = _SPACE
            quote = quote[before != _OTHER]
            one = code[np.minimum(quote + 1, len(code) - 1)]
            two = code[np.minimum(quote + 2, len(code) - 1)]
            short = np.isin(one, [ord(c) for c in "stmd"])
            long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
            for at, size in ((quote[short], 2), (quote[long], 3)):
                start[at + 1] = False
                start[at + size] = True
        begin = np.flatnonzero(start)
        end = np.append(begin[1:], len(code))
        real = kind[begin] != _SPACE
        return begin[real], end[real]

    def learn(self, hashes: np.ndarray, pieces: list[str]) -> None:
        """Encode pre-tokens that the table lacks and put them there."""
        ids, sizes = self.merge([p.encode("utf-8") for p in pieces])
        n, m = self.table.n, len(ids)
        self.table.insert(hashes)
        if self.used + m > len(self.pool):
            self.pool = np.concatenate((self.pool[: self.used], np.zeros(self.used + m, dtype=np.uint16)))
        self.pool[self.used : self.used + m] = ids
        self.size[n : n + len(pieces)] = sizes
        self.off[n : n + len(pieces)] = self.used + np.cumsum(sizes) - sizes
        self.used += m

    def reserve(self, words: int) -> None:
        """An empty table with room for so many words, ``cache_words`` at least."""
        self.room = max(words, self.cache_words)
        self.table = HashTable(max(12, (2 * self.room).bit_length()))
        self.pool = np.zeros(1 << 16, dtype=np.uint16)
        self.size = np.zeros(self.room, dtype=np.int32)
        self.off = np.zeros(self.room, dtype=np.int64)
        self.used = 0

    def chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of texts without special tokens: the table's position for each pre-token, and the texts' first ones."""
        normal = [self._normal(t) for t in texts]
        joined = "\n".join(normal) + "\n"
        code = np.frombuffer(joined.encode("utf-32-le"), dtype=np.uint32)
        begin, end = self.spans(code)
        hashes = segment_hash(prefix(mix(code.astype(np.uint64) + np.uint64(1))), begin, end)
        edge = np.concatenate(([0], np.cumsum(np.fromiter(map(len, normal), dtype=np.int64, count=len(normal)) + 1)))
        first = np.searchsorted(begin, edge)
        at = self.table.find(hashes)
        miss = np.flatnonzero(at < 0)
        if len(miss):
            new, where = np.unique(hashes[miss], return_index=True)
            if self.table.n + len(new) > self.room:
                new, where = np.unique(hashes, return_index=True)
                self.reserve(len(new))
                miss = np.arange(len(hashes))
            where = miss[where]
            for i in range(0, len(new), 50_000):
                part = where[i : i + 50_000]
                self.learn(new[i : i + 50_000], [joined[a:b] for a, b in zip(begin[part].tolist(), end[part].tolist())])
            at[miss] = self.table.find(hashes[miss])
        return at, first

    def groups(self, texts: list[str], limit: int = 1 << 20) -> Iterator[list[str]]:
        k = 0
        while k < len(texts):
            to, size = k, 0
            while to < len(texts) and (to == k or size + len(texts[to]) <= limit):
                size += len(texts[to])
                to += 1
            yield texts[k:to]
            k = to

    def _parts(self, texts: list[str]) -> tuple[list[str], list[tuple[int, int]], np.ndarray]:
        """Texts cut at special tokens; (place among the parts, id) of these; each text's first part."""
        parts: list[str] = []
        specials: list[tuple[int, int]] = []
        owner = []
        for t in texts:
            owner.append(len(parts))
            if "<|" in t and self.special_pattern.search(t):
                for k, part in enumerate(self.special_pattern.split(t)):
                    if k % 2:
                        specials.append((len(parts), self.special[part]))
                    else:
                        parts.append(part)
            else:
                parts.append(t)
        return parts, specials, np.array([*owner, len(parts)])

    def count(self, texts: list[str]) -> np.ndarray:
        """Number of tokens of each text."""
        out = []
        for group in self.groups(texts):
            parts, specials, owner = self._parts(group)
            at, first = self.chunk(parts)
            total = np.concatenate(([0], np.cumsum(self.size[at])))
            extra = np.zeros(len(parts) + 1, dtype=np.int64)
            for k, _ in specials:
                extra[k] += 1
            extra = np.concatenate(([0], np.cumsum(extra)))
            out.append(total[first[owner[1:]]] - total[first[owner[:-1]]] + extra[owner[1:]] - extra[owner[:-1]])
        return np.concatenate(out) if out else np.zeros(0, dtype=np.int64)

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """Each text's ids as unsigned 32-bit integers."""
        for group in self.groups(texts):
            parts, specials, owner = self._parts(group)
            at, first = self.chunk(parts)
            size = self.size[at].astype(np.int64)
            edge = np.concatenate(([0], np.cumsum(size)))
            ids = self.pool[np.repeat(self.off[at] - edge[:-1], size) + np.arange(edge[-1])].astype(np.uint32)
            bounds = edge[first]
            if specials:
                where = bounds[[k for k, _ in specials]]
                ids = np.insert(ids, where, np.array([n for _, n in specials], dtype=np.uint32))
                moved = np.zeros(len(parts) + 2, dtype=np.int64)
                for k, _ in specials:
                    moved[k + 1] += 1
                # a special token before part k moves that part's start, not the end of the one before it
                starts = bounds + np.cumsum(moved)[: len(bounds)]
                bounds = starts
            cut = bounds[owner]
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                yield ids[a:b]


_SPACE, _LETTER, _NUMBER, _OTHER = range(4)


@lru_cache(maxsize=1)
def char_classes() -> np.ndarray:
    """White space, letter, number or other, for each code point."""
    out = np.fromiter(({"L": _LETTER, "N": _NUMBER}.get(unicodedata.category(chr(c))[0], _OTHER) for c in range(0x110000)), dtype=np.uint8, count=0x110000)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = _SPACE
    return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)


def texts_of(column: pa.Array) -> list[str]:
    return pc.fill_null(column.cast(pa.large_string()), "").to_pylist()


def token_counts(docs: DataFrame, vocabulary: str = VOCABULARY, limit: int = TOKEN_LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of ``docs`` (doc_id, text)."""
    bounded_batches(docs.sparkSession)

    def run(batches):
        enc = encoder(vocabulary_path(vocabulary))
        for big in batches:
            for batch in text_slices(big, "text"):
                counts = enc.count(texts_of(batch["text"]))
                n_bytes = pc.fill_null(pc.binary_length(batch["text"]), 0).cast(pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch["doc_id"].cast(pa.int64()), n_bytes, pa.array(counts), pa.array(counts > limit)],
                    ["doc_id", "n_bytes", "n_tokens", "over_limit"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")


def crc(ids: bytes | memoryview) -> int:
    return zlib.crc32(ids) & 0xFFFFFFFF
