"""SentencePiece BPE by vectorised merge rounds over flat numpy symbol arrays."""

from __future__ import annotations

import heapq
import re
import struct
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import map_arrow
from graphloom.llm.textops import CHUNK_BYTES

SPACE = "▁"
_NO_RANK = np.iinfo(np.int32).max
#: Characters above which a word is merged pair by pair from a heap. Rounds over a word may be as many as its characters, each
#: as long as the word; the heap takes a time of n * log(n). Both give the same ids.
LONG_WORD = 256
#: Words and ids that a worker remembers between batches before it starts anew.
KEPT_WORDS, KEPT_IDS = 60_000, 600_000


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of the fields of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = data[at]
            at += 1
            out |= (byte & 127) << shift
            if byte < 128:
                return out
            shift += 7

    while at < len(data):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = {1: 8, 5: 4}.get(kind) or varint()
            yield tag >> 3, data[at : at + size]
            at += size


class PieceModel:
    """Vocabulary and merge table of a BPE model whose normaliser only escapes spaces and adds a leading one."""

    def __init__(self, data: bytes):
        self.pieces, scores, kinds = [], [], []
        for number, value in _fields(data):
            if number == 1:
                own = dict(_fields(value))
                self.pieces.append(own[1].decode())
                scores.append(struct.unpack("<f", own[2])[0] if 2 in own else 0.0)
                kinds.append(own.get(3, 1))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                norm = dict(_fields(value))
        plain = not norm.get(2) and norm.get(3, 1) and not norm.get(4, 1) and norm.get(5, 1)
        if trainer.get(3) != 2 or not trainer.get(35) or not plain or {4, 5} & set(kinds):
            raise NotImplementedError("only BPE models with byte fallback, identity normaliser and plain pieces")
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.size = len(self.pieces)
        byte_id = {int(p[3:5], 16): i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 6}
        self.byte_ids = np.array([byte_id[b] for b in range(256)], np.int32)
        index = {p: i for i, (p, k) in enumerate(zip(self.pieces, kinds, strict=True)) if k == 1}
        if any(SPACE in p.lstrip(SPACE) for p in index):
            raise NotImplementedError("a piece goes on over a space")
        symbols = dict(index)
        for ch in sorted({c for p in index for c in p} - index.keys()):
            symbols[ch] = self.size + len(symbols) - len(index)
        self.stride = self.size + len(symbols) - len(index)
        self.of_char = np.full(0x110000, -1, np.int32)
        for s, i in symbols.items():
            if len(s) == 1:
                self.of_char[ord(s)] = i
        # equal scores share a rank, so that the leftmost of them goes first
        rank_of = {s: r for r, s in enumerate(sorted({scores[i] for i in index.values()}, reverse=True))}
        rank = {i: rank_of[scores[i]] for i in index.values()}
        keys, ranks, made = [], [], []
        #: Pieces that may at once go on to a piece of better or equal rank; these merge one at a time.
        self.eager = np.zeros(self.size, bool)
        for piece, i in index.items():
            for at in range(1, len(piece)):
                left, right = symbols.get(piece[:at]), symbols.get(piece[at:])
                if left is not None and right is not None:
                    keys.append(left * self.stride + right)
                    ranks.append(rank[i])
                    made.append(i)
                    for part in (left, right):
                        if part in rank and rank[i] <= rank[part]:
                            self.eager[part] = True
        self._pairs_by_key = None
        self._build(np.array(keys, np.int64), np.array(ranks, np.int32), np.array(made, np.int32))
        shown = [bytes([int(p[3:5], 16)]) if k == 6 else p.replace(SPACE, " ").encode() if k == 1 else b" \xe2\x81\x87 " if k == 2 else b"" for p, k in zip(self.pieces, kinds, strict=True)]
        self.shown_len = np.array([len(b) for b in shown], np.int64)
        self.shown_at = np.cumsum(self.shown_len) - self.shown_len
        self.shown = np.frombuffer(b"".join(shown), np.uint8)
        self.is_byte = np.array([k == 6 for k in kinds])
        self.is_control = np.array([k == 3 for k in kinds])

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return (key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def _build(self, keys: np.ndarray, ranks: np.ndarray, made: np.ndarray) -> None:
        """Open addressing: a key lies at its slot or in the places after it, before the first empty one."""
        self.bits = int(4 * len(keys)).bit_length()
        self.keys = np.full((1 << self.bits) + 1024, -1, np.int64)
        self.ranks, self.made = np.full(len(self.keys), _NO_RANK, np.int32), np.full(len(self.keys), -1, np.int32)
        left, at = np.arange(len(keys)), self._slot(keys)
        while len(left):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[left[free]]  # of several the last stays
            put = self.keys[at] == keys[left]
            self.ranks[at[put]], self.made[at[put]] = ranks[left[put]], made[left[put]]
            left, at = left[~put], at[~put] + 1

    def _look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = left.astype(np.int64) * self.stride + right
        key[(left < 0) | (right < 0)] = -2
        at = self._slot(key)
        found = self.keys[at]
        on = np.flatnonzero((found != key) & (found >= 0))
        while len(on):
            at[on] += 1
            found = self.keys[at[on]]
            on = on[(found != key[on]) & (found >= 0)]
        hit = self.keys[at] == key
        return np.where(hit, self.ranks[at], np.int32(_NO_RANK)), self.made[at]

    def merge_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids, count of each word) for words that no piece goes beyond."""
        long = [i for i, w in enumerate(words) if len(w) > LONG_WORD]
        if not long:
            return self._merge_in_rounds(words)
        ids, count = self._merge_in_rounds(["" if len(w) > LONG_WORD else w for w in words])
        parts, ends = [], np.cumsum(count)
        at = 0
        for i in long:
            own = self.merge_long(words[i])
            parts += [ids[at : ends[i]], own]
            at, count[i] = ends[i], len(own)
        return np.concatenate([*parts, ids[at:]]), count

    def merge_long(self, word: str) -> np.ndarray:
        """The ids of one word: the pair of least rank, of these the leftmost, merges until none is left. Its pairs wait in a heap."""
        codes = np.frombuffer(word.encode("utf-32-le", "surrogatepass"), np.uint32)
        symbols = self.of_char[codes]
        n = len(symbols)
        rank, made = self._pairs(symbols, np.zeros(n, np.int8), np.arange(n))
        first = np.flatnonzero(rank < _NO_RANK)
        # one number for rank and place; what it was pushed for is checked when it comes out
        heap = (rank[first].astype(np.int64) * n + first).tolist()
        heapq.heapify(heap)
        result = made.tolist()
        waiting = rank.tolist()  # rank of the pair that begins here, _NO_RANK if there is none
        sym, after, before = symbols.tolist(), list(range(1, n + 1)), list(range(-1, n - 1))
        table = self._table()
        stride, none = self.stride, int(_NO_RANK)

        def renew(i: int) -> None:
            j = after[i]
            a, b = sym[i], sym[j] if j < n else -1
            found = table.get(a * stride + b) if a >= 0 and b >= 0 else None
            if found is None:
                waiting[i] = none
            else:
                waiting[i], result[i] = found
                heapq.heappush(heap, found[0] * n + i)

        while heap:
            r, i = divmod(heapq.heappop(heap), n)
            if waiting[i] != r:
                continue
            j = after[i]
            sym[i], sym[j], waiting[j] = result[i], -2, none
            after[i] = k = after[j]
            if k < n:
                before[k] = i
            renew(i)
            if before[i] >= 0:
                renew(before[i])
        own = np.array(sym, np.int32)
        at = np.flatnonzero(own != -2)
        return self._with_bytes(codes, at, own[at], np.zeros(len(at), np.int64))[0]

    def _table(self) -> dict[int, tuple[int, int]]:
        """Rank and result by pair, as a dictionary; made when a long word first needs it."""
        if self._pairs_by_key is None:
            at = np.flatnonzero(self.keys >= 0)
            self._pairs_by_key = dict(zip(self.keys[at].tolist(), zip(self.ranks[at].tolist(), self.made[at].tolist(), strict=True), strict=True))
        return self._pairs_by_key

    def _with_bytes(self, codes: np.ndarray, own: np.ndarray, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words, characters without a piece given as their bytes; ``own`` is the place of a symbol's first character."""
        unknown = (sym < 0) | (sym >= self.size)
        if not unknown.any():
            return sym, word
        sizes = np.where(unknown, np.where(codes[own] < 0x80, 1, np.where(codes[own] < 0x800, 2, np.where(codes[own] < 0x10000, 3, 4))), 1)
        out = np.repeat(sym, sizes)
        raw = np.frombuffer("".join(map(chr, codes[own[unknown]])).encode(), np.uint8)
        out[np.repeat(unknown, sizes)] = self.byte_ids[raw]
        return out, np.repeat(word, sizes)

    def _merge_in_rounds(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The same by rounds over all words at once: each merges the leftmost pairs of each word's least rank and compacts the arrays."""
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32)
        sym, word = self.of_char[codes], np.repeat(np.arange(len(words)), [len(w) for w in words])
        own = np.arange(len(codes))  # place of a symbol's first character
        done: list[tuple[np.ndarray, np.ndarray]] = []
        rank, made = self._pairs(sym, word, np.arange(len(sym)))
        while len(sym):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            lengths = np.diff(np.append(starts, len(sym)))
            best = np.minimum.reduceat(rank, starts)
            live = np.repeat(best < _NO_RANK, lengths)
            if not live.all():
                done.append((own[~live], sym[~live]))
                sym, word, own, rank, made = (x[live] for x in (sym, word, own, rank, made))
                if not len(sym):
                    break
                going = best < _NO_RANK
                best, lengths = best[going], lengths[going]
                starts = np.cumsum(lengths) - lengths
            least = np.repeat(best, lengths)
            at = np.flatnonzero(rank == least)
            # leftmost of overlapping ones: every second place of a run; of eager pieces only a word's first
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            run_start = np.maximum.accumulate(np.where(fresh, np.arange(len(at)), 0))
            first = np.concatenate([[True], word[at[1:]] != word[at[:-1]]])
            alone = self._any_eager(at, made, first)
            take = np.where(alone, first, (np.arange(len(at)) - run_start) % 2 == 0)
            at = at[take]
            sym[at] = made[at]
            keep = np.ones(len(sym), bool)
            keep[at + 1] = False
            moved = at - np.searchsorted(at, at)  # places after those before are gone
            sym, word, own, rank, made = (x[keep] for x in (sym, word, own, rank, made))
            changed = np.zeros(len(sym), bool)
            changed[moved] = changed[np.maximum(moved - 1, 0)] = True
            touched = np.flatnonzero(changed)
            rank[touched], made[touched] = self._pairs(sym, word, touched)
        if not done:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        own, sym = (np.concatenate(x) for x in zip(*done, strict=True))
        order = np.argsort(own)
        own, sym = own[order], sym[order]
        word = np.repeat(np.arange(len(words)), [len(w) for w in words])[own]
        sym, word = self._with_bytes(codes, own, sym, word)
        return sym, np.bincount(word, minlength=len(words))

    def _any_eager(self, at: np.ndarray, made: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each candidate, whether any candidate of its word makes an eager piece."""
        group = np.cumsum(first) - 1
        return np.bincount(group, weights=self.eager[made[at]])[group] > 0

    def _pairs(self, sym: np.ndarray, word: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank and result of the pairs that begin at the places."""
        nxt = np.minimum(at + 1, len(sym) - 1)
        rank, made = self._look_up(sym[at], sym[nxt])
        rank[(word[at] != word[nxt]) | (nxt == at)] = _NO_RANK
        return rank, made

    def decode_bytes(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(bytes, count of each id) that the ids stand for, the leading space still there."""
        sizes = self.shown_len[ids]
        at = np.repeat(self.shown_at[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return self.shown[at], sizes

    def decode(self, ids: np.ndarray) -> str:
        """The text of one sequence of ids; a byte that is no valid UTF-8 gives U+FFFD."""
        ids = np.asarray(ids, np.int64)
        ids = ids[~self.is_control[ids]]
        data = self.decode_bytes(ids)[0].tobytes()
        if len(ids) and self.pieces[ids[0]].startswith(SPACE):
            data = data[1:]
        try:
            return data.decode()
        except UnicodeDecodeError:
            return self._decode_loosely(ids)

    def _decode_loosely(self, ids: np.ndarray) -> str:
        out, run = [], bytearray()

        def close() -> None:
            while run:
                for n in (1, 2, 3, 4):
                    try:
                        out.append(bytes(run[:n]).decode())
                        break
                    except UnicodeDecodeError:
                        if n == 4:
                            out.append("�")
                            n = 1
                            break
                del run[:n]

        for k, i in enumerate(ids):
            if self.is_byte[i]:
                run += self.decode_bytes(np.array([i]))[0].tobytes()
                continue
            close()
            shown = self.decode_bytes(np.array([i]))[0].tobytes().decode()
            out.append(shown[1:] if not k and self.pieces[i].startswith(SPACE) else shown)
        close()
        return "".join(out)


class _Numbers(dict):
    """Numbers words in the order of their first look-up; ``new`` gathers those since it was last emptied."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = out = len(self)
        self.new.append(word)
        return out


class Encoder:
    """Encodes texts; remembers the ids of words between calls."""

    _words = re.compile(f"{SPACE}+[^{SPACE}]*")

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self) -> None:
        self.index = _Numbers()
        self.ids, self.count = np.zeros(0, np.int32), np.zeros(0, np.int64)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        if len(self.index) > KEPT_WORDS or len(self.ids) > KEPT_IDS:
            self._forget()
        split = [self._words.findall(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        which = np.fromiter(map(self.index.__getitem__, chain.from_iterable(split)), np.int64, sum(map(len, split)))
        if self.index.new:
            ids, count = self.model.merge_words(self.index.new)
            self.ids, self.count, self.index.new = np.concatenate([self.ids, ids]), np.concatenate([self.count, count]), []
        start = np.cumsum(self.count) - self.count
        sizes = self.count[which] if len(which) else np.zeros(0, np.int64)
        at = np.repeat((start[which] if len(which) else sizes) - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        flat = self.ids[at]
        bounds = np.concatenate([[0], np.cumsum(sizes)])[np.concatenate([[0], np.cumsum([len(own) for own in split])])]
        return [flat[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]


def encode_decode(docs: DataFrame, model: bytes) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) for each row of (doc_id, text), extra columns unused.

    ``model`` is the content of a SentencePiece BPE model file. ``ids`` holds the begin id, the text's ids and the end
    id as little-endian unsigned 32-bit integers; ``decoded`` is the text that they stand for. Within a text, words
    begin at runs of spaces, which no piece crosses. All distinct words of a batch are merged at once: each round finds
    the least pair rank of every word, merges the leftmost pairs of that rank and compacts the arrays, until no pair is
    left. Several pairs of a word merge in one round only where no better pair can arise in between, so that the result
    is that of merging one at a time. A word of over LONG_WORD characters is merged pair by pair instead, in a time of
    n * log(n): a text of a million characters without spaces takes seconds. Texts are encoded in groups of some 0.5 MB;
    a longer one is a group by itself, and takes some 100 bytes of memory a character. Repeated rows are encoded each;
    an empty table gives an empty one. Null or empty text: begin and end only, empty ``decoded``; null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = PieceModel(shared.value)
        encoder = Encoder(own)
        ends = np.array([own.bos, own.eos], np.int32)
        for batch in batches:
            doc_ids = batch.column("doc_id")
            texts = [t or "" for t in batch.column("text").to_pylist()]
            at = 0
            while at < len(texts):
                end, size = at, 0
                while end < len(texts) and (end == at or size + len(texts[end]) <= CHUNK_BYTES):
                    size += len(texts[end])
                    end += 1
                coded = [np.concatenate([ends[:1], ids, ends[1:]]) for ids in encoder.encode(texts[at:end])]
                packed = [ids.astype("<u4").tobytes() for ids in coded]
                yield pa.RecordBatch.from_arrays(
                    [doc_ids.slice(at, end - at), pa.array([len(i) for i in coded], pa.int64()), pa.array(packed, pa.binary()), pa.array([own.decode(ids) for ids in coded], pa.string())], schema=schema
                )
                at = end

    picked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_arrow(picked, run, "doc_id long, n_tokens long, ids binary, decoded string")
