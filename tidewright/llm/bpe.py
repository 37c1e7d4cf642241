"""BPE encoding and decoding by prefix-sharing trie traversal.

The BPE encoding of a string extends the encoding of one of its prefixes by one token, so each
prefix is described by the last token of its own encoding. That token is the one suffix t in the
vocabulary for which the encoding of what stands before it ends in a token that BPE leaves next to t
(`Merges.stays`). The distinct words of a slice of rows are put into a trie, held as their sorted
list with each word's common prefix with the one before; last-token states are carried from each
node to its children, so a prefix shared by many words is worked out once, and a word's tokens are
read off by stepping back along its path. All branches advance together, byte by byte, in numpy;
words longer than `WIDTH` bytes, which share little, are walked by themselves: the vocabulary's tokens
that end at each byte are found in numpy, and the states then follow byte after byte.

Texts are cut first at single blanks between other characters, since such a blank always begins a
piece; each distinct chunk of a slice is then cut by the ByteLevel pattern. Special tokens that
stand in a text are taken out before, as the tokenizer file orders. Work is row by row: no shuffle,
no group, memory bounded by a slice of rows (or one row, if that is longer).

Edge cases: null is taken as empty, with no ids; repeated rows and rows without an id are each
encoded; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from tidewright.llm.spark_io import id_and_text
from tidewright.llm.text import _ODD, PIECE, mix, raw, slices

#: Entries that a worker keeps in each of its memos, which are emptied when full.
CACHE = 60_000
#: Longest word, in bytes, that takes part in the numpy traversal.
WIDTH = 40
#: Fixed value: the ByteLevel pattern, white space spelt as the Unicode property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"

#: Bytes that may end or begin white space, or be letters by themselves.
_WHITE = np.zeros(256, bool)
_WHITE[[*range(0x09, 0x0E), *range(0x1C, 0x21)]] = True
_WHITE_LEAD = _WHITE.copy()
_WHITE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True
_ASCII_LETTER = np.zeros(256, bool)
_ASCII_LETTER[[*range(65, 91), *range(97, 123)]] = True


_STOP = np.zeros(256, bool)
_STOP[[*b".,;:!?|"]] = True


def _gather(values: np.ndarray, begin: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """values[begin:begin + size] of all rows one after another, and where each begins there."""
    place = np.append(0, np.cumsum(size))
    return values[np.repeat(begin - place[:-1], size) + np.arange(place[-1])], place


def byte_alphabet() -> dict[str, int]:
    """Printable Latin-1 characters stand for their own byte, the rest for 256 and up, in order."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in set(own)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(rest)}


class Vocabulary:
    """Bytes of all tokens in one array: what decoding needs."""

    def __init__(self, file_text: str):
        spec = json.loads(file_text)
        back = byte_alphabet()
        tokens = {i: bytes(back[c] for c in s) for s, i in spec["model"]["vocab"].items()} | {t["id"]: t["content"].encode() for t in spec["added_tokens"]}
        parts = [tokens.get(i, b"") for i in range(max(tokens) + 1)]
        self.length = np.array(list(map(len, parts)), np.int64)
        self.begin = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(parts), np.uint8)

    def decode(self, ids: np.ndarray) -> bytes:
        """The bytes of ids, special tokens included."""
        return _gather(self.flat, self.begin[ids], self.length[ids])[0].tobytes()


class Merges(Vocabulary):
    """A byte-level BPE vocabulary with its merges, and the words encoded so far."""

    def __init__(self, file_text: str):
        super().__init__(file_text)
        spec = json.loads(file_text)
        cut = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type", "BPE") != "BPE" or spec.get("normalizer") or cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True):
            raise ValueError("the tokenizer file isn't a plain byte-level BPE: texts would be cut otherwise than here")
        back = byte_alphabet()
        of = lambda s: bytes(back[c] for c in s)
        vocab = spec["model"]["vocab"]
        self.id = {of(s): i for s, i in vocab.items()}
        self.bytes: dict[int, bytes] = {i: b for b, i in self.id.items()}
        self.rank: dict[tuple[int, int], int] = {}
        self.formed: dict[int, int] = {}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b = vocab[left], vocab[right]
            self.rank.setdefault((a, b), r)
            whole = vocab[left + right]
            if whole not in self.formed:
                self.formed[whole], self.halves[whole] = r, (a, b)
        self.longest = max(map(len, self.id))
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.bytes |= {i: s.encode() for s, i in self.special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pattern = regex.compile(PATTERN)
        self._stays: dict[int, bool] = {}
        self._whole: dict[int, bool] = {}
        self.words: dict[str, bytes] = {}
        self.known = (np.zeros(0, np.uint64), np.zeros(1, np.int64), np.zeros(0, np.uint32))
        self._tables()

    def _tables(self) -> None:
        """Vocabulary by length and hash, token bytes in one array, and a direct-mapped memo of `stays`."""
        self.value, self.base = _ODD(256), np.uint64(_ODD(1)[0])
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths: dict[int, list[int]] = {}
        for b, i in self.id.items():
            if self.whole(i):
                lengths.setdefault(len(b), []).append(i)
        for n, own in lengths.items():
            m = np.frombuffer(b"".join(self.bytes[i] for i in own), np.uint8).reshape(-1, n)
            h = np.zeros(len(own), np.uint64)
            for k in range(n):
                h = h * self.base + self.value[m[:, k]]
            order = np.argsort(h)
            bits = np.zeros(1 << 16, bool)
            bits[(h >> np.uint64(48)).astype(np.int64)] = True
            self.by_length[n] = (h[order], np.array(own, np.int32)[order], bits)
        self.memo_key = np.full(1 << 18, -1, np.int64)
        self.memo = np.zeros(1 << 18, bool)

    def stay(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`stays` of many pairs."""
        key = a.astype(np.int64) << 20 | b
        slot = ((key * 0x2545F4914F6CDD1D) >> 40) & 0x3FFFF
        new = np.flatnonzero(self.memo_key[slot] != key)
        if len(new):
            u, at = np.unique(key[new], return_inverse=True)
            got = np.array([self.stays(k >> 20, k & 0xFFFFF) for k in u.tolist()], bool)
            out = self.memo[slot]
            out[new] = got[at]
            self.memo_key[slot[new]], self.memo[slot[new]] = key[new], got[at]
            # Pairs that fell into one slot: the last write of both arrays is the same one.
            return out
        return self.memo[slot]

    def _spine(self, token: int, side: int) -> list[tuple[int, float, float]]:
        """From the outermost byte up to the token: (part, rank that forms it, rank that takes it up)."""
        out, taken = [], float("inf")
        while True:
            formed = self.formed.get(token, -1)
            out.append((token, formed, taken))
            if formed < 0:
                return out[::-1]
            taken, token = formed, self.halves[token][side]

    def stays(self, a: int, b: int) -> bool:
        """Whether BPE of the bytes of a followed by those of b is just (a, b).

        Both tokens grow by their own merges in order of rank. The two parts that meet at the
        border at a time must not merge before one of them is taken up; at equal rank the merge
        further left comes first.
        """
        key = a << 20 | b
        found = self._stays.get(key)
        if found is None:
            left, right = self._spine(a, 1), self._spine(b, 0)
            i = j = 0
            found = True
            while True:
                (x, _, x_taken), (y, _, y_taken) = left[i], right[j]
                r = self.rank.get((x, y))
                if r is not None and r < x_taken and r <= y_taken:
                    found = False
                    break
                if i == len(left) - 1 and j == len(right) - 1:
                    break
                if x_taken <= y_taken:
                    i += 1
                else:
                    j += 1
            if len(self._stays) > CACHE:
                self._stays.clear()
            self._stays[key] = found
        return found

    def whole(self, token: int) -> bool:
        """Whether BPE of a token's bytes is that token."""
        if token not in self._whole:
            self._whole[token] = token not in self.halves or (all(map(self.whole, self.halves[token])) and self._joins(token))
        return self._whole[token]

    def _joins(self, token: int) -> bool:
        """Whether its halves, once grown, are next to each other and meet no earlier merge."""
        a, b = self.halves[token]
        left, right = self._spine(a, 1), self._spine(b, 0)
        i = j = 0
        while (i, j) != (len(left) - 1, len(right) - 1):
            (x, _, x_taken), (y, _, y_taken) = left[i], right[j]
            r = self.rank.get((x, y))
            if r is not None and r < x_taken and r <= y_taken:
                return False
            if x_taken <= y_taken:
                i += 1
            else:
                j += 1
        return True

    def encode_words(self, words: list[str]) -> None:
        """Puts the ids of distinct words into the cache, walking their trie depth first."""
        path, last, ids = b"", [], self.id
        for own, word in sorted((w.encode(), w) for w in words):
            shared = 0
            limit = min(len(path), len(own))
            while shared < limit and path[shared] == own[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(own) + 1):
                for begin in range(max(0, end - self.longest), end):
                    t = ids.get(own[begin:end])
                    if t is not None and (self.whole(t) if begin == 0 else self.stays(last[begin - 1], t)):
                        last.append(t)
                        break
                else:
                    raise ValueError("the vocabulary lacks a byte")
            path = own
            out, end = [], len(own)
            while end:
                t = last[end - 1]
                out.append(t)
                end -= len(self.bytes[t])
            self.words[word] = np.array(out[::-1], "<u4").tobytes()

    def encode_text(self, text: str) -> bytes:
        """Ids of one text, special tokens looked for, words walked depth first."""
        out = []
        for k, span in enumerate(self.split.split(text) if self.split else [text]):
            if k % 2:
                out.append(np.array([self.special[span]], "<u4").tobytes())
            else:
                pieces = self.pattern.findall(span)
                self.encode_words(sorted({p for p in pieces if len(p) <= WIDTH and p not in self.words}))
                out += [self.words[p] if len(p) <= WIDTH else self._long(p.encode()) for p in pieces]
                if len(self.words) > CACHE:
                    self.words.clear()
        return b"".join(out)

    def encode_many(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words one after another, and where each word's ids begin (and the last ends)."""
        sizes = np.array(list(map(len, words)), np.int64)
        short = np.flatnonzero(sizes <= WIDTH)
        order = short[np.argsort(np.array([words[i] for i in short.tolist()], f"S{WIDTH}"), kind="stable")] if len(short) else short
        n, width = len(order), int(sizes[order].max()) if len(order) else 0
        counts = np.zeros(len(words), np.int64)
        out = []
        if n:
            m = np.array([words[i] for i in order.tolist()], f"S{WIDTH}").view(np.uint8).reshape(n, WIDTH)[:, :width]
            size = sizes[order]
            same = np.zeros((n, width), bool)
            same[1:] = (m[1:] == m[:-1]) & (np.arange(width) < np.minimum(size[1:], size[:-1])[:, None])
            shared = np.where(same.all(1), width, np.argmin(same, 1))
            depth = np.arange(width + 1)
            index = np.arange(n, dtype=np.int32)
            node = np.array([np.maximum.accumulate(np.where(shared < d, index, 0)) for d in depth])
            hashes = np.zeros((width + 1, n), np.uint64)
            last = np.full((width + 1, n), -1, np.int32)
            power = self._powers(width + 1, False)
            for d in range(1, width + 1):
                hashes[d] = hashes[d - 1] * self.base + self.value[m[:, d - 1]]
                rows = np.flatnonzero((shared < d) & (size >= d))
                for span in range(min(d, WIDTH), 0, -1):
                    if not len(rows):
                        break
                    if span not in self.by_length:
                        continue
                    known, ids, bits = self.by_length[span]
                    h = hashes[d, rows] - hashes[d - span, rows] * power[span]
                    maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
                    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                    hit = known[at] == h[maybe]
                    maybe, token = maybe[hit], ids[at[hit]]
                    if span < d and len(maybe):
                        before = last[d - span, node[d - span, rows[maybe]]]
                        good = self.stay(before, token)
                        maybe, token = maybe[good], token[good]
                    if len(maybe):
                        last[d, rows[maybe]] = token
                        left = np.ones(len(rows), bool)
                        left[maybe] = False
                        rows = rows[left]
                if len(rows):
                    raise ValueError("the vocabulary lacks a byte")
            at, live, back = size.copy(), np.arange(n), []
            while len(live):
                token = last[at[live], node[at[live], live]]
                back.append((live, token))
                at[live] -= self.length[token]
                counts[order[live]] += 1
                live = live[at[live] > 0]
        long = {i: np.frombuffer(self._long(words[i]), "<u4") for i in np.flatnonzero(sizes > WIDTH).tolist()}
        for i, own in long.items():
            counts[i] = len(own)
        ends = np.cumsum(counts)
        out = np.zeros(int(ends[-1]) if len(ends) else 0, np.uint32)
        if n:
            for k, (live, token) in enumerate(back):
                out[ends[order[live]] - 1 - k] = token
        for i, own in long.items():
            out[ends[i] - len(own) : ends[i]] = own
        return out, np.append(0, ends)

    def _long(self, word: bytes) -> bytes:
        """Ids of one word of any length."""
        data = np.frombuffer(word, np.uint8)
        n, block = len(word), 1 << 18
        last = np.full(n + 1, -1, np.int32)
        spans = sorted(self.by_length)
        for low in range(0, n, block):  # ends in (low, high]
            high, start = min(n, low + block), max(0, low - spans[-1] + 1)
            v = self.value[data[start:high]]
            h, ends, tokens, sizes = np.zeros(len(v), np.uint64), [], [], []
            for span in range(1, min(spans[-1], high) + 1):
                h = h[: len(v) - span + 1] * self.base + v[span - 1 :]
                if span in self.by_length:
                    known, ids, bits = self.by_length[span]
                    maybe = np.flatnonzero(bits[(h >> np.uint64(48)).astype(np.int64)])
                    maybe = maybe[maybe + start + span > low]
                    at = np.minimum(np.searchsorted(known, h[maybe]), len(known) - 1)
                    hit = known[at] == h[maybe]
                    ends.append(maybe[hit] + start + span)
                    tokens.append(ids[at[hit]])
                    sizes.append(np.full(int(hit.sum()), span))
            end, token, size = map(np.concatenate, (ends, tokens, sizes))
            order = np.lexsort((-size, end))
            state = last[: low + 1][-spans[-1] :].tolist()  # of the places before, up to the longest token
            offset = low + 1 - len(state)
            for e, t, z in zip(end[order].tolist(), token[order].tolist(), size[order].tolist(), strict=True):
                at = e - offset
                if len(state) <= at and (e == z or self.stays(state[at - z], t)):
                    state.append(t)
            if len(state) != high + 1 - offset:
                raise ValueError("the vocabulary lacks a byte")
            last[offset : high + 1] = state
        out, at = [], n
        while at:
            out.append(int(last[at]))
            at -= int(self.length[out[-1]])
        return np.array(out[::-1], "<u4").tobytes()

    def _chunks(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begins of all chunks and their hashes."""
        n = len(data)
        cut = data == 0x20
        cut[0] = cut[-1] = False
        before, after = data[:-2], data[2:]
        cut[1:-1] &= ~_WHITE[before] & ~_WHITE_LEAD[after]
        high = np.flatnonzero(cut[2:] & (data[1:-1] >= 0x80)) + 2
        cut[high[data[high - 2] != 0xC3]] = False
        edges = off[(off > 0) & (off < n)]
        cut[edges - 1] = False  # the last byte of a row
        cut[off[off < n]] = True
        begins = np.flatnonzero(cut)
        ends = np.append(begins[1:], n)
        h = np.zeros(len(begins), np.uint64)
        lo = 0
        while lo < len(begins):
            hi = max(lo + 1, int(np.searchsorted(ends, begins[lo] + PIECE, "right")))
            a, b = int(begins[lo]), int(ends[hi - 1])
            sums = np.zeros(b - a + 1, np.uint64)
            np.cumsum(self.value[data[a:b]] * self._powers(b - a, False), out=sums[1:])
            size = (ends[lo:hi] - begins[lo:hi]).astype(np.uint64)
            h[lo:hi] = mix((sums[ends[lo:hi] - a] - sums[begins[lo:hi] - a]) * self._powers(b - a, True)[begins[lo:hi] - a] + size)
            lo = hi
        return begins, h

    def _powers(self, n: int, inverse: bool) -> np.ndarray:
        have = self.__dict__.setdefault("_power_cache", {}).get(inverse)
        if have is None or len(have) < n:
            grown = np.full(max(n, PIECE), np.uint64(pow(int(self.base), -1, 1 << 64)) if inverse else self.base, np.uint64)
            grown[0] = 1
            have = self._power_cache[inverse] = np.cumprod(grown)
        return have[:n]

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after another, and where each text's ids begin (and the last ends)."""
        data, off = raw(texts)
        odd: dict[int, np.ndarray] = {}
        whole = data.tobytes()
        for s in self.special:
            at = whole.find(s.encode())
            while at >= 0:
                row = int(np.searchsorted(off, at, "right")) - 1
                if row not in odd and at + len(s.encode()) <= off[row + 1]:
                    odd[row] = np.frombuffer(self.encode_text(texts[row].as_py()), "<u4")
                at = whole.find(s.encode(), at + 1)
        if not len(data):
            return np.zeros(0, np.uint32), np.zeros(len(off), np.int64)
        begins, h = self._chunks(data, off)
        ends = np.append(begins[1:], len(data))
        distinct, first, chunk = np.unique(h, return_index=True, return_inverse=True)
        keys, held, flat = self.known
        at = np.minimum(np.searchsorted(keys, distinct), max(len(keys) - 1, 0))
        new = keys[at] != distinct if len(keys) else np.ones(len(distinct), bool)
        bound, ids = self._new_chunks(data, whole, begins[first[new]], ends[first[new]])
        size = np.zeros(len(distinct), np.int64)
        size[new] = np.diff(bound)
        source = np.zeros(len(distinct), np.int64)
        source[new] = bound[:-1] + len(flat)
        if len(keys):
            size[~new], source[~new] = np.diff(held)[at[~new]], held[at[~new]]
        ids = np.concatenate([flat, ids])
        out, place = _gather(ids, source[chunk], size[chunk])
        self._keep(keys, held, distinct, new, ids, source, size)
        edge = place[np.searchsorted(begins, off)]
        if odd:
            parts = [odd[r] if r in odd else out[edge[r] : edge[r + 1]] for r in range(len(off) - 1)]
            return np.concatenate(parts).astype(np.uint32), np.append(0, np.cumsum(list(map(len, parts))))
        return out, edge

    def _keep(self, keys, held, distinct, new, ids, source, size) -> None:
        """Remembers this slice's chunks by hash; a full memo starts again with them alone."""
        if not new.any():
            return
        if len(keys) + int(new.sum()) <= 3 * CACHE:
            k = np.concatenate([keys, distinct[new]])
            begin, n = np.concatenate([held[:-1], source[new]]), np.concatenate([np.diff(held), size[new]])
        else:
            k, begin, n = distinct, source, size
        order = np.argsort(k)
        flat, place = _gather(ids, begin[order], n[order])
        self.known = (k[order], place, flat)

    def _new_chunks(self, data: np.ndarray, whole: bytes, b: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of chunks, and where each chunk's ids begin (and the last ends)."""
        letter = _ASCII_LETTER[data]
        latin = np.flatnonzero(data[:-1] == 0xC3)
        latin = latin[(data[latin + 1] != 0x97) & (data[latin + 1] != 0xB7)]
        letter[latin] = letter[latin + 1] = True
        letters = np.append(0, np.cumsum(letter))
        stop = _STOP[data[e - 1]] & (e - b > 2)  # letters and one full stop or the like: two pieces
        e, tail = e - stop, e
        plain = letters[e] - letters[b] == e - b - (data[b] == 0x20)
        plain &= e - b > (data[b] == 0x20)
        words, count = [], np.ones(len(b), np.int64)
        find = self.pattern.findall
        for k, (x, y, z, p) in enumerate(zip(b.tolist(), e.tolist(), tail.tolist(), plain.tolist(), strict=True)):
            if p:
                words.append(whole[x:y])
                if z > y:
                    words.append(whole[y:z])
                    count[k] = 2
            else:
                pieces = find(whole[x:z].decode())
                count[k] = len(pieces)
                words += [q.encode() for q in pieces]
        ids, ptr = self.encode_many(words)
        return ptr[np.append(0, np.cumsum(count))], ids


class Tokenizer:
    """A tokenizer file, with its tables once a task has asked for them.

    As the value of a broadcast it goes, tables and all, when the worker takes a task of a query
    that doesn't use it: what a worker keeps for later tasks holds no tables of steps before.
    """

    def __init__(self, file_text: str):
        self.file_text, self._made = file_text, {}

    def __reduce__(self):
        return Tokenizer, (self.file_text,)

    def tables(self, kind: type) -> Vocabulary:
        """The tables, made once; those for encoding serve for decoding too."""
        found = self._made.get(Merges) or self._made.get(kind)
        if found is None:
            found = self._made[kind] = kind(self.file_text)
        return found


def _encode(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.tables(Merges)
        for batch in batches:
            for part in slices(batch, "text", 1 << 20):
                texts = part.column("text").fill_null("")
                ids, edge = m.encode(texts)
                column = pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer((edge * 4).astype(np.int32)), pa.py_buffer(ids.astype("<u4"))])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), column], ["doc_id", "ids"])

    return run


def _decode(shared) -> callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value.tables(Vocabulary)
        for batch in batches:
            for part in slices(batch, "ids", 1 << 20):
                data, off = raw(part.column("ids"))
                ids = np.frombuffer(data.tobytes(), "<u4").astype(np.int64)
                text = [m.decode(ids[a:b]).decode("utf-8", "replace") for a, b in zip((off[:-1] // 4).tolist(), (off[1:] // 4).tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("ids"), pa.array(text, pa.string())], ["doc_id", "ids", "decoded"])

    return run


def _round_trip(shared) -> callable:
    """Ids of texts and what they decode to, in one worker: the ids are read back as decode reads them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _decode(shared)(_encode(shared)(batches))

    return run


def tokenizer_text(path: str | os.PathLike) -> str:
    """The tokenizer file, read on the driver; its size is fixed by the vocabulary."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (binary, little-endian unsigned 32-bit). tokenizer: text of the tokenizer file."""
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer))
    return id_and_text(docs, id_col, text_col).mapInArrow(_encode(shared), "doc_id long, ids binary")


def counter(spark: SparkSession, tokenizer: str) -> Callable[[pa.Array], np.ndarray]:
    """A function from a column of texts to their numbers of tokens, to be called in tasks.

    A single text goes the way of rows with special tokens: for a short one numpy's passes cost more.
    """
    shared = spark.sparkContext.broadcast(Tokenizer(tokenizer))
    held: list[Merges] = []  # of the task

    def count(texts: pa.Array) -> np.ndarray:
        if not held:
            held.append(shared.value.tables(Merges))
        if len(texts) == 1:
            return np.array([len(held[0].encode_text(texts[0].as_py() or "")) // 4])
        return np.diff(held[0].encode(texts)[1])

    return count


def decode(encoded: DataFrame, tokenizer: str) -> DataFrame:
    """doc_id, ids and the decoded text."""
    shared = encoded.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer))
    return encoded.select("doc_id", "ids").mapInArrow(_decode(shared), "doc_id long, ids binary, decoded string")


def round_trip(docs: DataFrame, tokenizer: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, ids and the text decoded from them: `decode` of `encode`, with one worker for both."""
    shared = docs.sparkSession.sparkContext.broadcast(Tokenizer(tokenizer))
    return id_and_text(docs, id_col, text_col).mapInArrow(_round_trip(shared), "doc_id long, ids binary, decoded string")
