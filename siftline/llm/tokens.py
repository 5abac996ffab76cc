"""Token ids of whole texts with the ``tokenizers`` library, asked once for each new word.

Natural text repeats its words, so each Python worker keeps the ids of words it has seen and asks the
library only for new ones. Words are cut only where these vocabularies surely have a border between
tokens: at the white space behind a non-space, and between letters and plain punctuation at a word's end.
Texts whose white space is not that simple go to the library whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import accumulate, chain, pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .common import slices
from .shingles import mixed, odd_numbers

#: Words that a worker keeps (some 40 bytes each); beyond it only those just used stay. Only speed depends on it.
KEPT_WORDS = 1_500_000
#: Words of more bytes than this are not kept.
LONGEST_KEPT = 128
#: Bytes of text that are cut into words together; what that takes is some thirty times as much.
TOGETHER = 4 << 20

# Letters, then punctuation that neither joins letters nor starts a contraction.
_TAIL = re.compile(r"([\n\r]?[^\W\d_]+)([.,;:!?|$%&*#)]+)")


def tokenizer_path(name: str) -> str:
    """The file of a public tokenizer, where it lies on this machine (every executor has its own copy)."""
    import public_tokenizers

    return public_tokenizers.path(name)


def gather(flat: np.ndarray, start: np.ndarray, count: np.ndarray, block: int = 1 << 14) -> np.ndarray:
    """The runs of ``count`` entries of ``flat`` from each ``start``, one behind the other; in blocks, so indices stay small."""
    ends = np.cumsum(count)
    out = np.empty(int(ends[-1]) if len(ends) else 0, flat.dtype)
    for a in range(0, len(count), block):
        n, end = count[a : a + block], ends[a : a + block]
        low, high = int(end[0] - n[0]), int(end[-1])
        np.take(flat, np.arange(low, high) + np.repeat(start[a : a + block] - end + n, n), out=out[low:high])
    return out


_PLACES = [odd_numbers(512, seed) for seed in (31, 47)]


def _hashes(words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each word two hashes, of 64 and of 32 bits, and its bytes: sums of bytes times odd numbers by place."""
    ends = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = np.frombuffer(words.buffers()[2] or b"", np.uint8)[ends[0] : ends[-1]].astype(np.uint64) + np.uint64(1)
    ends -= ends[0]
    sizes = np.diff(ends)
    place = np.arange(len(data)) - np.repeat(ends[:-1], sizes)
    out = []
    for k, seed in enumerate((31, 47)):
        if len(sizes) and sizes.max() > len(_PLACES[k]):
            _PLACES[k] = odd_numbers(int(sizes.max()), seed)
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_PLACES[k][place] * data, dtype=np.uint64)])
        out.append(mixed(total[ends[1:]] - total[ends[:-1]] + sizes.astype(np.uint64)))
    return out[0], (out[1] >> np.uint64(32)).astype(np.uint32), sizes


class WordMemory:
    """Ids of whole texts from the ids of their words, each learned once.

    A subclass says which texts may be cut at blanks (``simple``), how a text is written so that cutting it gives its
    words' keys (``marked``), and the ids of new keys (``learn``) and of other texts (``whole``), as bytes of
    little-endian unsigned 32-bit integers. Words are known by 96 hash bits, in arrays: a dictionary of them would take five times the memory.
    """

    def __init__(self):
        self._forget()

    def _forget(self) -> None:
        self.hash, self.check = np.zeros(0, np.uint64), np.zeros(0, np.uint32)
        self.start, self.size, self.pool = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def simple(self, texts: pa.Array) -> pa.Array:
        raise NotImplementedError

    def marked(self, texts: pa.Array) -> pa.Array:
        raise NotImplementedError

    def learn(self, keys: list[str]) -> list[bytes]:
        raise NotImplementedError

    def whole(self, texts: list[str]) -> list[bytes]:
        raise NotImplementedError

    def _find(self, hashes: np.ndarray, checks: np.ndarray) -> np.ndarray:
        """Where each word is remembered, -1 if it is not."""
        if not len(self.hash):
            return np.full(len(hashes), -1, np.int64)
        at = np.minimum(np.searchsorted(self.hash, hashes), len(self.hash) - 1)
        return np.where((self.hash[at] == hashes) & (self.check[at] == checks), at, -1)

    def recall(self, keys: list[str]) -> list[bytes | None]:
        """The ids of those keys that are remembered."""
        at = self._find(*_hashes(pa.array(keys, pa.string()))[:2]).tolist() if keys else []
        return [None if k < 0 else self.pool[self.start[k] : self.start[k] + self.size[k]].tobytes() for k in at]

    def _ids_of(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids in which each of the distinct words has a run, and where that begins and how long it is."""
        hashes, checks, lengths = _hashes(words)
        at = self._find(hashes, checks)
        new = np.flatnonzero(at < 0)
        ids = self.learn(words.take(pa.array(new)).to_pylist())
        fresh = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat = np.concatenate([self.pool, np.frombuffer(b"".join(ids), "<u4")])
        start, size = (np.where(at >= 0, x[at], 0) if len(x) else np.zeros(len(words), np.int64) for x in (self.start, self.size))
        start[new], size[new] = len(self.pool) + np.cumsum(fresh) - fresh, fresh
        if len(self.hash) + len(new) > KEPT_WORDS:
            self._forget()
            new = np.arange(len(words))
        keep = new[lengths[new] <= LONGEST_KEPT]
        begin = len(self.pool) + np.cumsum(size[keep]) - size[keep]
        self.pool = np.concatenate([self.pool, gather(flat, start[keep], size[keep])])
        columns = [np.concatenate(x) for x in ((self.hash, hashes[keep]), (self.check, checks[keep]), (self.start, begin), (self.size, size[keep]))]
        order = np.argsort(columns[0], kind="stable")
        self.hash, self.check, self.start, self.size = (x[order] for x in columns)
        return flat, start, size

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one behind the other, and how many each text has. Null is empty."""
        texts = texts.fill_null("")
        simple = self.simple(texts)
        rows = np.flatnonzero(simple.to_numpy(zero_copy_only=False))
        cut = pc.split_pattern(self.marked(texts.filter(simple)), " ")
        words = cut.flatten().dictionary_encode()
        at = words.indices.to_numpy()
        flat, start, size = self._ids_of(words.dictionary)
        count = size[at]
        found = gather(flat, start[at], count)
        counts = np.zeros(len(texts), np.int64)
        if len(rows):
            ends = np.concatenate([[0], np.cumsum(count)])
            counts[rows] = np.diff(ends[cut.offsets.to_numpy() - cut.offsets[0].as_py()])
        if len(rows) == len(texts):
            return found, counts
        others = pc.invert(simple)
        ids = self.whole(texts.filter(others).to_pylist())
        counts[np.flatnonzero(others.to_numpy(zero_copy_only=False))] = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        # Both kinds lie one behind the other; each text takes its own.
        flat = np.concatenate([found, np.frombuffer(b"".join(ids), "<u4")])
        start, is_cut = np.zeros(len(texts), np.int64), np.zeros(len(texts), bool)
        is_cut[rows] = True
        start[is_cut] = np.cumsum(counts[is_cut]) - counts[is_cut]
        start[~is_cut] = len(found) + np.cumsum(counts[~is_cut]) - counts[~is_cut]
        return gather(flat, start, counts, 64), counts

    def __call__(self, texts: list[str]) -> list[bytes]:
        ids, counts = self.encode(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in pairwise(np.concatenate([[0], np.cumsum(counts)]).tolist())]


# Byte-level vocabularies write a byte as itself where it is printable Latin-1, else as U+0100 and on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTES = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in _PRINTABLE)}

# White space besides single blanks and line feeds between words.
_ODD = r"^[ \n]|[ \n][ \n]|[ \n]\z|^\z|[\t\x0B-\r\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


class WordIds(WordMemory):
    """Ids of texts by a file of the ``tokenizers`` library.

    A key of the memory is a word; ``\\n`` before it stands for the line feed before the word, ``\\r`` for
    nothing before it (as at a text's start), and a bare word has a blank before it. Words of letters
    alone are one unit of these vocabularies and go straight to the library's model, others through all of it.

    ``special`` says what a special token's string inside a text is: False is the library's own setting, the string
    becomes the special token (its ids are those of ``Tokenizer.from_file(path).encode(text,
    add_special_tokens=False)``, untouched); True makes it ordinary text, as a corpus that is
    not trusted needs.
    """

    def __init__(self, path: str, special_as_text: bool = False):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = special_as_text
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = [] if special_as_text else added
        if self.normalizer and self.normalizer.normalize_str("AZ") != "az":
            raise ValueError("the normaliser of this file does not lower-case")
        # Whether a blank is part of the word behind it, or dropped.
        plain, blank, self.line = self.whole(["a", " a", "\n"])
        self.lead = chr(_BYTES[32]) if plain != blank else ""

    def simple(self, texts):
        found = pc.invert(pc.match_substring_regex(texts, _ODD))
        for name in self.special:
            found = pc.and_(found, pc.invert(pc.match_substring(texts, name)))
        return found

    def marked(self, texts):
        return pc.binary_join_element_wise("\r", pc.replace_substring(texts, "\n", " \n"), "")

    def whole(self, texts):
        found = [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)] if texts else []
        flat = np.fromiter(chain.from_iterable(found), "<u4").tobytes()
        ends = list(accumulate(map(len, found), initial=0))
        return [flat[4 * a : 4 * b] for a, b in pairwise(ends)]

    def learn(self, keys):
        border = {k: m.start(2) for k in keys if (m := _TAIL.fullmatch(k))}
        bare = {k for k in keys if k not in border}.union(k[:n] for k, n in border.items()).union("\r" + k[n:] for k, n in border.items())
        tokenize, normalizer, lead, line = self.model.tokenize, self.normalizer, self.lead, self.line
        # What stands before or behind punctuation may be known already.
        parts = list(bare.difference(keys))
        found: dict[str, bytes] = {k: ids for k, ids in zip(parts, self.recall(parts), strict=True) if ids is not None}
        rest = []
        for key in bare:
            if key in found:
                continue
            mark = key[:1]
            word = key[1:] if mark in "\r\n" else key
            if normalizer and word.isalpha():
                word = word.lower() if word.isascii() else normalizer.normalize_str(word)
            if not word.isalpha():
                rest.append(key)
                continue
            said = word if word.isascii() else word.encode().decode("latin-1").translate(_BYTES)
            said = said if mark in "\r\n" else lead + said
            ids = array("I", [t.id for t in tokenize(said)]).tobytes()
            found[key] = line + ids if mark == "\n" else ids
        said = [w[1:] if w[:1] == "\r" else w if w[:1] == "\n" else " " + w for w in rest]
        found.update(zip(rest, self.whole(said), strict=True))
        found.update((k, found[k[:n]] + found["\r" + k[n:]]) for k, n in border.items())
        return list(map(found.__getitem__, keys))


def documents(batches: Iterator[pa.RecordBatch], encoder: WordMemory, most: int = TOGETHER) -> Iterator[tuple[int | None, np.ndarray, pa.Scalar]]:
    """(id, its text's ids, the text) of each row of Arrow batches of ids and texts, about ``most`` bytes of text at a time."""

    def encoded(parts):
        keys = [k for p in parts for k in p.column(0).to_pylist()]
        texts = pa.chunked_array([p.column(1) for p in parts]).combine_chunks()
        ids, counts = encoder.encode(texts)
        ends = np.cumsum(counts).tolist()
        for i, key in enumerate(keys):
            yield key, ids[ends[i - 1] if i else 0 : ends[i]], texts[i]

    waiting, size = [], 0
    for part in slices(batches, 1, most):
        more = pc.sum(pc.binary_length(part.column(1))).as_py() or 0
        if waiting and size + more > most:
            yield from encoded(waiting)
            waiting, size = [], 0
        waiting.append(part)
        size += more
    if waiting:
        yield from encoded(waiting)


_ENCODERS: dict[str, WordIds] = {}


def encoder(path: str) -> WordIds:
    """The worker's own encoder for a file; it outlives a task, so later tasks find the words known."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordIds(path)
    return _ENCODERS[path]
