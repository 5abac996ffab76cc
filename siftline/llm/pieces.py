"""SentencePiece encoding and decoding by batched Viterbi in numpy.

Distinct words of equal length advance together, position by position: hashes of all substrings that end at a
position probe the sorted hashes of the pieces, the best way to each position is a vectorised maximum, and
backpointers give the pieces.

What makes a way valid depends on the model. In a unigram model any pieces may follow each other and scores
add up. In a BPE model (the kind at hand) the encoding is defined by merges: of all segmentations
exactly one has only neighbours that merging would leave apart, so there the lattice admits a piece behind
another only if their pair stays apart (``Vocabulary.apart``), and the maximum picks that one way.

White space becomes U+2581 as in the library; no piece of these models has one behind another character, so
texts are cut before it, and at line feeds where those are no piece. Unknown characters become byte pieces.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from heapq import heapify, heappop, heappush
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import tokens
from .common import table
from .shingles import mixed

#: Characters of words that advance together; a longer word than LONG_WORD advances alone.
CELLS = 1 << 18
LONG_WORD = 256
#: The memory of pairs of pieces has two to this power slots. Only speed depends on it.
PAIR_BITS = 20
SPACE = "▁"
_BASE = np.uint64(0x100000001B3)
NEVER = np.iinfo(np.int64).max


def _prefixes(words: list[str]) -> np.ndarray:
    """Hashes of all beginnings of words of one length, a row for each number of characters."""
    size = len(words[0])
    codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(words), size).T
    out = np.zeros((size + 1, len(words)), np.uint64)
    if len(words) == 1:
        # A long word: its hashes one by one, as Python's integers.
        h, mask, base = 0, (1 << 64) - 1, int(_BASE)
        out[1:, 0] = [h := (h * base + x) & mask for x in mixed(codes[:, 0].astype(np.uint64) + np.uint64(1)).tolist()]
        return out
    for i in range(size):
        out[i + 1] = out[i] * _BASE + mixed(codes[i].astype(np.uint64) + np.uint64(1))
    return out


class Vocabulary:
    """Pieces with scores, as sorted substring hashes, and for BPE how each piece is merged."""

    def __init__(self, pieces: list[str], scores: list[float], usable: list[bool], byte_ids: list[int], unknown: int, bpe: bool):
        self.pieces, self.bpe, self.byte_ids, self.unknown = pieces, bpe, byte_ids, unknown
        ids = [i for i, ok in enumerate(usable) if ok]
        self.by_text = {pieces[i]: i for i in ids}
        self.longest = max((len(pieces[i]) for i in ids), default=1)
        self.score = np.append(np.asarray(scores, np.float64), min(scores, default=0.0) - 10)
        order = {s: r for r, s in enumerate(sorted({scores[i] for i in ids}, reverse=True))}
        # The merge order; characters are there from the start. The last entry stands for an unknown character.
        self.merge_rank = {pieces[i]: order[scores[i]] for i in ids if len(pieces[i]) > 1}
        rank, left, right = ([-1] * (len(pieces) + 1) for _ in range(3))
        valid = np.zeros(len(pieces) + 1, bool)
        valid[[*ids, len(pieces)]] = True
        for i in ids:
            if len(pieces[i]) > 1:
                rank[i] = self.merge_rank[pieces[i]]
                if bpe:
                    parts = self.merged(pieces[i], stop_before=pieces[i])
                    valid[i] = len(parts) == 2
                    if len(parts) == 2:
                        left[i], right[i] = (self.by_text[p] for p in parts)
        self.merges, self.valid = (rank, left, right), valid
        self.rank, self.left, self.right = (np.asarray(x, np.int64) for x in self.merges)
        self.size = np.asarray([len(p) for p in pieces] + [1], np.int64)
        self.value = np.zeros(len(pieces) + 1, np.uint64)
        for n in np.unique(self.size[ids]).tolist():
            same = [i for i in ids if len(pieces[i]) == n]
            self.value[same] = _prefixes([pieces[i] for i in same])[-1]
        at = np.argsort(self.value[ids])
        self.keys, self.ids = self.value[ids][at], np.asarray(ids, np.int64)[at]
        # Most substrings are no piece, which the highest bits of their hashes tell at once.
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.keys >> np.uint64(44)] = True
        self.power = np.concatenate([[np.uint64(1)], np.cumprod(np.full(self.longest, _BASE, np.uint64))])
        self.pairs, self.pair_apart = np.full(1 << PAIR_BITS, -1, np.int64), np.zeros(1 << PAIR_BITS, bool)
        self.one_apart: dict[tuple[int, int], bool] = {}

    def merged(self, word: str, stop_before: str | None = None) -> list[str]:
        """A word's pieces by merging the best-scored pair of neighbours, the leftmost of equals, until none is a piece."""
        parts: list[str | None] = list(word)
        after, before, ranks = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1)), self.merge_rank
        heap = [(ranks[both], k, both) for k, both in enumerate(map("".join, pairwise(word))) if both in ranks]
        heapify(heap)
        while heap:
            _, k, both = heappop(heap)
            other = after[k]
            if parts[k] is None or other >= len(parts) or parts[k] + parts[other] != both:
                continue
            if both == stop_before:
                break
            parts[k], parts[other], after[k] = both, None, after[other]
            if after[k] < len(parts):
                before[after[k]] = k
            for a, b in ((before[k], k), (k, after[k])):
                if a >= 0 and b < len(parts) and (both := parts[a] + parts[b]) in ranks:
                    heappush(heap, (ranks[both], a, both))
        return [p for p in parts if p is not None]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of substrings by hash, -1 where there is none."""
        out = np.full(len(hashes), -1, np.int64)
        maybe = np.flatnonzero(self.seen[hashes >> np.uint64(44)])
        if len(maybe):
            hashes = hashes[maybe]
            at = np.minimum(np.searchsorted(self.keys, hashes), len(self.keys) - 1)
            out[maybe] = np.where(self.keys[at] == hashes, self.ids[at], -1)
        return out

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves a border between pieces a and b, remembered for pairs met before."""
        pairs = a * len(self.score) + b
        slot = (pairs.astype(np.uint64) * _BASE * _BASE >> np.uint64(64 - PAIR_BITS)).astype(np.int64)
        out = self.pair_apart[slot]
        new = np.flatnonzero(self.pairs[slot] != pairs)
        if len(new):
            distinct, back = np.unique(pairs[new], return_inverse=True)
            out[new] = self._apart(distinct // len(self.score), distinct % len(self.score))[back]
            self.pairs[slot[new]], self.pair_apart[slot[new]] = pairs[new], out[new]
            # Of pairs that share a slot the last one is there; the bits must be its own.
            stays = new[self.pairs[slot[new]] == pairs[new]]
            self.pair_apart[slot[stays]] = out[stays]
        return out

    def _apart(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Whether merging leaves a border between pieces x and y.

        Backwards in merge order, the two parts that meet at the border are taken apart, the later one first. If
        any two parts that stood there together are a piece that would have come before what they went
        into (at the left: before it only if strictly better), the border would have gone.
        """
        above_x, above_y = np.full(len(x), NEVER), np.full(len(x), NEVER)
        out = np.ones(len(x), bool)
        live = np.flatnonzero((x != len(self.pieces)) & (y != len(self.pieces)))
        while len(live):
            p, q = x[live], y[live]
            both = self.value[p] * self.power[np.minimum(self.size[q], self.longest)] + self.value[q]
            whole = np.where(self.size[p] + self.size[q] <= self.longest, self.find(both), -1)
            rank = np.where(whole >= 0, self.rank[whole], NEVER)
            lost = (rank < above_x[live]) & (rank <= above_y[live]) & (whole >= 0)
            out[live[lost]] = False
            live = live[~lost]
            p, q = x[live], y[live]
            first = self.rank[p] > self.rank[q]
            above_x[live[first]], x[live[first]] = self.rank[p[first]], self.right[p[first]]
            above_y[live[~first]], y[live[~first]] = self.rank[q[~first]], self.left[q[~first]]
            # Once a character would have to be taken apart, all has been seen.
            live = live[(x[live] >= 0) & (y[live] >= 0)]
        return out

    def _apart_one(self, x: int, y: int) -> bool:
        """``_apart`` for one pair."""
        rank, left, right = self.merges
        above_x = above_y = NEVER
        while x >= 0 and y >= 0:
            both = self.merge_rank.get(self.pieces[x] + self.pieces[y], NEVER)
            if both < above_x and both <= above_y:
                return False
            if rank[x] > rank[y]:
                above_x, x = rank[x], right[x]
            else:
                above_y, y = rank[y], left[y]
        return True

    def advance(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Pieces of words of one length, one word behind the other, and how many each has; an unknown character is ``len(pieces)``.

        All words advance together. In a unigram model the best sum to a position is a running maximum over the lengths of
        the last piece. In a BPE model all ways to a position weigh alike and one alone is valid, so a word
        is done with a position as soon as a piece fits behind the way to where it begins, the longest tried first.
        """
        n, size, unknown = len(words), len(words[0]), len(self.pieces)
        prefix = _prefixes(words)
        best = np.full((size + 1, 1 if self.bpe else n), -np.inf)
        best[0] = 0
        last = np.full((size + 1, n), -1, np.int64)
        every = np.arange(n)
        for i in range(1, size + 1):
            open_ = every
            for k in range(min(i, self.longest), 0, -1):
                now, then = (prefix[i], prefix[i - k]) if open_ is every else (prefix[i][open_], prefix[i - k][open_])
                piece = self.find(now - then * self.power[k])
                if k == 1:
                    piece[piece < 0] = unknown
                at = np.flatnonzero(piece >= 0)
                at = at[self.valid[piece[at]]]
                if not len(at):
                    continue
                rows, piece = open_[at], piece[at]
                if self.bpe:
                    if i > k:
                        fits = self.apart(last[i - k][rows], piece)
                        at, rows, piece = at[fits], rows[fits], piece[fits]
                    last[i][rows] = piece
                    stays = np.ones(len(open_), bool)
                    stays[at] = False
                    open_ = open_[stays]
                    if not len(open_):
                        break
                else:
                    total = best[i - k][rows] + self.score[piece]
                    more = total > best[i][rows]
                    best[i][rows[more]], last[i][rows[more]] = total[more], piece[more]
        out = np.full((n, size), -1, np.int64)
        at, column = np.full(n, size), size - 1
        rows = every
        while len(rows):
            piece = last[at[rows], rows]
            out[rows, column] = piece
            at[rows] -= self.size[piece]
            rows, column = rows[at[rows] > 0], column - 1
        out = out[:, column + 1 :]
        return out[out >= 0], (out >= 0).sum(axis=1)

    def advance_one(self, word: str, block: int = 1 << 16) -> list[int]:
        """Pieces of one long word, by the same lattice: hashes probe for all positions of a block, the ways are followed one by one."""
        prefix, unknown, apart, score = _prefixes([word])[:, 0], len(self.pieces), self.one_apart, self.score.tolist()
        last, best = [-1] * (len(word) + 1), [0.0] + [-np.inf] * len(word)
        for low in range(0, len(word), block):
            high, hits = min(low + block, len(word)), []
            for k in range(1, self.longest + 1):
                ends = np.arange(max(low + 1, k), high + 1)
                piece = self.find(prefix[ends] - prefix[ends - k] * self.power[k])
                if k == 1:
                    piece[piece < 0] = unknown
                at = np.flatnonzero(piece >= 0)
                at = at[self.valid[piece[at]]]
                hits.append(np.stack([ends[at], np.full(len(at), -k), piece[at]]))
            hits = np.concatenate(hits, axis=1)
            for end, back, piece in hits[:, np.lexsort((hits[1], hits[0]))].T.tolist():
                start = end + back
                if not self.bpe:
                    if best[start] + score[piece] > best[end]:
                        best[end], last[end] = best[start] + score[piece], piece
                elif last[end] < 0:
                    pair = (last[start], piece)
                    if start and unknown not in pair:
                        if pair not in apart:
                            if len(apart) >= 1 << PAIR_BITS:
                                apart.clear()
                            apart[pair] = self._apart_one(*pair)
                        if not apart[pair]:
                            continue
                    last[end] = piece
        out, end = [], len(word)
        while end:
            out.append(last[end])
            end -= len(self.pieces[last[end]]) if last[end] != unknown else 1
        return out[::-1]

    def viterbi(self, words: list[str]) -> list[list[int]]:
        """Pieces of each of the words, which are of one length; an unknown character is ``len(pieces)``."""
        if len(words[0]) > LONG_WORD:
            return [self.advance_one(w) for w in words]
        flat, count = self.advance(words)
        return [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])]

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids, little-endian unsigned 32-bit, of each word. Runs of marks, whose pieces tie, are merged one by one."""
        out: list[bytes] = [b""] * len(words)
        by_size: dict[int, list[int]] = {}
        for at, w in enumerate(words):
            if self.bpe and SPACE * 2 in w:
                out[at] = self._bytes_of(w, [self.by_text.get(p, len(self.pieces)) for p in self.merged(w)])
            else:
                by_size.setdefault(len(w), []).append(at)
        by_size.pop(0, None)
        for size, same in by_size.items():
            if size > LONG_WORD:
                for at in same:
                    out[at] = self._bytes_of(words[at], self.advance_one(words[at]))
                continue
            together = CELLS // size
            for first in range(0, len(same), together):
                part = same[first : first + together]
                flat, count = self.advance([words[at] for at in part])
                ends = np.cumsum(count)
                odd = np.unique(np.searchsorted(ends, np.flatnonzero(flat == len(self.pieces)), "right")).tolist()
                data, begin = flat.astype("<u4").tobytes(), 0
                for at, end in zip(part, (4 * ends).tolist(), strict=True):
                    out[at] = data[begin:end]
                    begin = end
                for row in odd:
                    out[part[row]] = self._bytes_of(words[part[row]], flat[ends[row] - count[row] : ends[row]].tolist())
        return out

    def _bytes_of(self, word: str, ids: list[int]) -> bytes:
        """A word's ids as bytes, with byte pieces for its unknown characters."""
        if len(self.pieces) in ids:
            at, whole, ids = 0, ids, []
            for i in whole:
                if i == len(self.pieces):
                    raw = word[at].encode("utf-8", "replace")
                    ids += [self.byte_ids[c] for c in raw] if self.byte_ids else [self.unknown]
                    at += 1
                else:
                    ids.append(i)
                    at += len(self.pieces[i])
        return np.asarray(ids, "<u4").tobytes()

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces joined, byte pieces as UTF-8 (what is not valid becomes U+FFFD), the first blank off."""
        names = self._names
        text = b"".join([names[i] for i in ids.tolist()]).decode("utf-8", "replace").replace(SPACE, " ")
        return text[1:] if text[:1] == " " else text

    @property
    def _names(self) -> list[bytes]:
        if not hasattr(self, "_bytes"):
            value = {i: bytes([c]) for c, i in enumerate(self.byte_ids)}
            self._bytes = [value.get(i, p.encode()) for i, p in enumerate(self.pieces)]
        return self._bytes


def load(path: str, bpe: bool = True) -> Vocabulary:
    """The pieces of a SentencePiece model file."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    every = range(model.get_piece_size())
    usable = [not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i)) for i in every]
    pieces = [model.id_to_piece(i) for i in every]
    bytes_ = [i for i in every if model.is_byte(i)]
    return Vocabulary(pieces, [model.get_score(i) for i in every], usable, bytes_, model.unk_id(), bpe)


class PieceIds(tokens.WordMemory):
    """Ids of whole texts as bytes; each distinct word is encoded once.

    A key of the memory stands for the word with its mark before it, a key that begins with a line feed for
    the line feed and the unmarked word behind it. Texts with runs of blanks are cut by expression instead.
    """

    def __init__(self, vocabulary: Vocabulary):
        if any("\n" in p or SPACE in p.lstrip(SPACE) for p in vocabulary.by_text):
            raise ValueError("pieces reach over white space; texts cannot be cut there")
        super().__init__()
        self.vocabulary = vocabulary

    def simple(self, texts):
        return pc.invert(pc.match_substring_regex(texts, rf"^ |  |{SPACE}|^\z"))

    def marked(self, texts):
        return pc.replace_substring(texts, "\n", " \n")

    def learn(self, keys):
        words = [k[1:] if k[:1] == "\n" else SPACE + k for k in keys]
        ids = self.vocabulary.encode_words([*words, "\n"])
        line = ids.pop()
        return [line + found if k[:1] == "\n" else found for k, found in zip(keys, ids, strict=True)]

    def whole(self, texts):
        cut = [_SEGMENT.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        words = sorted(set().union(*cut))
        ids = dict(zip(words, self.vocabulary.encode_words(words), strict=True))
        return [b"".join(map(ids.__getitem__, c)) for c in cut]


_SEGMENT = re.compile(rf"\n|{SPACE}*[^\n{SPACE}]+|{SPACE}+")


@lru_cache(maxsize=2)
def encoder(path: str) -> PieceIds:
    """The worker's own encoder for a file; it outlives a task."""
    return PieceIds(load(path))


def encode_documents(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids (array of int) of each row of ``docs``.

    Null and empty texts have no ids. A null id is kept, rows that share an id are encoded each, an empty table
    gives no rows; a text may be of any length, and so may a word or a run of blanks in it. Other columns are not read.
    """

    def run(batches):
        schema = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])
        waiting, size = [], 0

        def batch_of(rows):
            ends = np.concatenate([[0], np.cumsum([len(ids) for _, ids in rows])])
            flat = np.concatenate([ids for _, ids in rows]).astype(np.int32)
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in rows], pa.int64()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))], schema=schema)

        for key, ids, _ in tokens.documents(batches, encoder(model)):
            waiting.append((key, ids))
            size += len(ids)
            if len(waiting) == 1024 or size > 1 << 20:
                yield batch_of(waiting)
                waiting, size = [], 0
        if waiting:
            yield batch_of(waiting)

    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, model: str) -> DataFrame:
    """doc_id, text of encoded rows; null ids decode to null, no ids to the empty text.

    The library's own losses remain: a blank at the start of a text and the mark U+2581 itself come back
    as the blank the mark stands for, and the first one is dropped.
    """

    def run(batches):
        for batch in batches:
            decode = encoder(model).vocabulary.decode
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [None if x is None else decode(np.asarray(x, np.int64)) for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digests(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_pieces, ids_crc32, whether decoding gives the text again.

    Null text counts as empty (no pieces, and the round trip holds); null ids are kept, rows that share an id come each,
    an empty table gives no rows, texts are read whole whatever their length. Other columns are not read.
    """
    names = ["doc_id", "n_pieces", "ids_crc32", "round_trip"]

    def run(batches):
        encode = encoder(model)

        def batch_of(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int64(), pa.int64(), pa.bool_()), strict=True)], names=names)

        rows = []
        for key, ids, text in tokens.documents(batches, encode):
            rows.append((key, len(ids), zlib.crc32(ids), encode.vocabulary.decode(ids) == (text.as_py() or "")))
            if len(rows) == 8192:
                yield batch_of(rows)
                rows = []
        if rows:
            yield batch_of(rows)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_pieces long, ids_crc32 long, round_trip boolean")


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), tokens.tokenizer_path("piece_bpe_32k.model"))
