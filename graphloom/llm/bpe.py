"""Byte-pair encoding with a contiguous rank array.

A piece (one pre-token) is held as its parts and the ranks of adjacent parts.
The least rank is found by a scan, that boundary is deleted, and the two
neighbouring ranks are looked up again, until no adjacent pair has a rank.  The
pieces of a slice are made distinct first and all short ones take each step
together, as rows of one matrix.  Pieces over `SHORT` bytes use a heap of
boundaries instead, since scanning is quadratic in the length of a piece.
"""

from __future__ import annotations

import heapq
import json
import re
import unicodedata

import numpy as np

from graphloom.llm import textcore as tc

SHORT = 48
NONE = np.int32(2**31 - 1)
_BITS = 18
_MEMO = 20
_cache: dict[str, Encoder] = {}


def byte_chars() -> list[str]:
    """The printable stand-in for each byte in a byte-level vocabulary."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, n = {}, 0
    for b in range(256):
        out[b] = chr(b) if b in keep else chr(256 + n)
        n += b not in keep
    return [out[b] for b in range(256)]


def _classes() -> np.ndarray:
    """0 white space, 1 letter, 2 number, 3 other, by code point."""
    out = np.full(0x110000, 3, np.uint8)
    cat = unicodedata.category
    out[: 0x110000] = np.fromiter(({"L": 1, "N": 2}.get(cat(chr(c))[0], 3) for c in range(0x110000)), np.uint8, 0x110000)
    out[[*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]] = 0
    return out


_class_table: list[np.ndarray] = []


def classes_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Class of the character that each byte belongs to, and which bytes begin one."""
    if not _class_table:
        _class_table.append(_classes())
    table = _class_table[0]
    cls = table[buf]
    lead = np.ones(len(buf), bool)
    at = np.flatnonzero(buf >= 0xC0)
    if len(at):
        b = buf[at].astype(np.int32)
        pad = np.concatenate([buf, np.zeros(3, np.uint8)])
        n = np.where(b >= 0xF0, 4, np.where(b >= 0xE0, 3, 2))
        c1, c2, c3 = (pad[at + k].astype(np.int32) & 63 for k in (1, 2, 3))
        cp = np.where(n == 2, (b & 31) << 6 | c1, np.where(n == 3, (b & 15) << 12 | c1 << 6 | c2, (b & 7) << 18 | c1 << 12 | c2 << 6 | c3))
        kind = table[cp]
        cls[at] = kind
        for k in (1, 2, 3):
            w = n > k
            cls[at[w] + k] = kind[w]
            lead[at[w] + k] = False
    return cls, lead


def _contractions(buf: np.ndarray, at: np.ndarray, doc_end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the apostrophes `at`, those that begin 's 't 'm 'd 're 've 'll, and their lengths in bytes."""
    pad = np.concatenate([buf, np.zeros(2, np.uint8)])
    a, b = pad[at + 1], pad[at + 2]
    one = np.isin(a, np.frombuffer(b"stmd", np.uint8)) & (at + 1 < doc_end)
    two = (((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)) & (at + 2 < doc_end)
    n = np.where(one, 2, np.where(two, 3, 0))
    return at[n > 0], n[n > 0]


def pieces(buf: np.ndarray, off: np.ndarray, spaces: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and first piece of each document.  `spaces`: a piece takes one space before it and white space stays; else it is dropped and each number is its own piece."""
    n = len(buf)
    if not n:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    cls, lead = classes_of(buf)
    full = off[1:] > off[:-1]
    first, last = off[:-1][full], off[1:][full] - 1
    begin = np.empty(n, bool)
    begin[0] = True
    np.not_equal(cls[1:], cls[:-1], out=begin[1:])
    begin[first] = True
    white = cls == 0
    if spaces:
        # the last white character of a run that is followed by something begins anew; a plain space joins what follows
        after = np.zeros(n, bool)
        after[1:] = white[:-1]
        after[first] = False
        heads = np.flatnonzero(after & ~white)
        prev = heads - 1
        while (cont := ~lead[prev]).any():
            prev = np.where(cont, prev - 1, prev)
        begin[prev] = True
        begin[heads[buf[heads - 1] == 0x20]] = False
    else:
        begin |= (cls == 2) & lead
    at = np.flatnonzero((buf == 39) & begin)
    if len(at):
        end = off[np.searchsorted(off, at, "right")]
        at, size = _contractions(buf, at, end)
        begin[at + 1] = False
        nxt = at + size
        nxt = nxt[nxt < n]
        begin[nxt] = True
    if spaces:
        starts = np.flatnonzero(begin)
        ends = np.append(starts[1:], n)
    else:
        both = np.flatnonzero(begin)
        ends = np.append(both[1:], n)
        keep = ~white[both]
        starts, ends = both[keep], ends[keep]
    return starts, ends, np.searchsorted(starts, off)


class Encoder:
    """One vocabulary file of the `tokenizers` format, read directly."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        suffix = model.get("end_of_word_suffix") or ""
        self.fold = spec.get("normalizer") is not None
        self.joined = spec.get("decoder") is not None
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.size = 1 + max([*vocab.values(), *self.special.values()])
        chars = byte_chars()
        self.byte_id = np.array([vocab[c] for c in chars], np.int32)
        self.last_id = np.array([vocab[c + suffix] for c in chars], np.int32)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.result = np.array([vocab[a + b] for a, b in pairs], np.int32)
        self._table(left << 17 | right)
        self._reset()
        self.names: list[bytes] = [b""] * self.size
        for t, i in {**vocab, **self.special}.items():
            self.names[i] = t.encode()
        back = {c: b for b, c in enumerate(chars)}
        self.raw = [bytes(back[c] for c in t.decode()) if self.joined and t.decode() not in self.special else t for t in self.names]

    def _table(self, keys: np.ndarray) -> None:
        """Open addressing, so that ranks are looked up a whole column at a time."""
        _, keep = np.unique(keys, return_index=True)
        self.keys, self.ranks = np.full(1 << _BITS, -1, np.int64), np.full(1 << _BITS, NONE, np.int32)
        todo, slot = keep, self._slot(keys[keep])
        while len(todo):
            free = self.keys[slot] < 0
            self.keys[slot[free]] = keys[todo[free]]
            won = self.keys[slot] == keys[todo]
            self.ranks[slot[won]] = todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & ((1 << _BITS) - 1)
        self.by_pair = dict(zip(keys[keep].tolist(), keep.tolist(), strict=True))

    @staticmethod
    def _slot(keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BITS)).astype(np.int64)

    def rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 17 | b
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != key) & (found >= 0))
        while len(todo):
            slot[todo] = (slot[todo] + 1) & ((1 << _BITS) - 1)
            found = self.keys[slot[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
        return out

    def _short(self, ids: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of parts and how many each has, merged."""
        rows, width = ids.shape
        out, left = ids.copy(), n.copy()
        if width < 2:
            return out, left
        at, cols = np.arange(rows), np.arange(width - 1)
        ranks = np.full((rows, width), NONE, np.int32)
        valid = cols[None, :] + 1 < n[:, None]
        ranks[:, :-1][valid] = self.rank(ids[:, :-1][valid], ids[:, 1:][valid])
        ids, n = ids.copy(), n.copy()
        while True:
            j = ranks.argmin(1)
            r = np.arange(len(j))
            best = ranks[r, j]
            go = best < NONE
            if not go.all():
                done = ~go
                out[at[done], : ids.shape[1]] = ids[done]
                left[at[done]] = n[done]
                at, ids, n, ranks, j, best = at[go], ids[go], n[go], ranks[go], j[go], best[go]
                r = np.arange(len(j))
                if not len(j):
                    return out, left
            ids[r, j] = self.result[best]
            src = cols[None, : ids.shape[1] - 1] + (cols[None, : ids.shape[1] - 1] > j[:, None])
            ids = np.take_along_axis(ids, src, 1)
            # the boundary after j goes: its rank is the one at j; later ranks move down by one
            src = cols[None, : ids.shape[1]] + (cols[None, : ids.shape[1]] >= j[:, None])
            ranks = np.take_along_axis(ranks, src, 1)
            n -= 1
            if ids.shape[1] == 1:
                ranks[:] = NONE
                continue
            ranks[r, j.clip(max=ids.shape[1] - 1)] = NONE
            w = j + 1 < n
            ranks[r[w], j[w]] = self.rank(ids[r[w], j[w]], ids[r[w], j[w] + 1])
            w = j > 0
            ranks[r[w], j[w] - 1] = self.rank(ids[r[w], j[w] - 1], ids[r[w], j[w]])

    def _long(self, ids: list[int]) -> list[int]:
        n = len(ids)
        nxt, prv, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        get = self.by_pair.get
        heap = [(r, i, ids[i], ids[i + 1]) for i in range(n - 1) if (r := get(ids[i] << 17 | ids[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i]
            if not alive[i] or j >= n or ids[i] != a or ids[j] != b:
                continue
            ids[i] = int(self.result[r])
            alive[j] = False
            nxt[i] = nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (s := get(ids[i] << 17 | ids[nxt[i]])) is not None:
                    heapq.heappush(heap, (s, i, ids[i], ids[nxt[i]]))
            if (p := prv[i]) >= 0 and (s := get(ids[p] << 17 | ids[i])) is not None:
                heapq.heappush(heap, (s, p, ids[p], ids[i]))
        return [x for x, ok in zip(ids, alive, strict=True) if ok]

    def _distinct(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of these pieces, one after another, and how many each has."""
        size = ends - starts
        count = np.zeros(len(starts), np.int64)
        parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        low = 0
        for high in (1, 2, 4, 6, 8, 10, 12, 16, 24, 32, SHORT):
            rows = np.flatnonzero((size > low) & (size <= high))
            low = high
            for k in range(0, len(rows), 1 << 16):
                w = rows[k : k + (1 << 16)]
                cols = np.arange(high)
                inside = cols[None, :] < size[w][:, None]
                at = np.where(inside, starts[w][:, None] + cols[None, :], 0)
                ids = self.byte_id[buf[at]]
                ids[np.arange(len(w)), size[w] - 1] = self.last_id[buf[ends[w] - 1]]
                ids, n = self._short(ids, size[w].copy())
                count[w] = n
                parts.append((w, ids[cols[None, :] < n[:, None]], n))
        for w in np.flatnonzero(size > SHORT):
            b = buf[starts[w] : ends[w]]
            ids = self.byte_id[b].tolist()
            ids[-1] = int(self.last_id[b[-1]])
            got = np.array(self._long(ids), np.int32)
            count[w] = len(got)
            parts.append((np.array([w]), got, np.array([len(got)])))
        begin = np.cumsum(count) - count
        flat = np.zeros(int(count.sum()), np.int32)
        for w, ids, n in parts:
            flat[tc.ragged(begin[w], n)] = ids
        return flat, count

    def _reset(self) -> None:
        self.seen = np.zeros(1 << _MEMO, np.uint64)
        self.seen_at, self.seen_n = np.zeros(1 << _MEMO, np.int64), np.zeros(1 << _MEMO, np.int64)
        self.store, self.used = np.zeros(1 << 20, np.int32), 0

    def _lookup(self, buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where in `store` the ids of each piece lie, and how many.  Pieces met before are remembered by hash, one to a slot."""
        if self.used > 1 << 23:
            self._reset()
        h = tc.span_hashes(buf, starts, ends)
        slot = (h >> np.uint64(64 - _MEMO)).astype(np.int64)
        at, n = self.seen_at[slot], self.seen_n[slot]
        miss = np.flatnonzero((self.seen[slot] != h) | (n == 0))
        if len(miss):
            _, one, inverse = np.unique(h[miss], return_index=True, return_inverse=True)
            one = miss[one]
            flat, count = self._distinct(buf, starts[one], ends[one])
            begin = np.cumsum(count) - count + self.used
            while self.used + len(flat) > len(self.store):
                self.store = np.concatenate([self.store, np.zeros(len(self.store), np.int32)])
            self.store[self.used : self.used + len(flat)] = flat
            self.used += len(flat)
            at[miss], n[miss] = begin[inverse], count[inverse]
            keep = ends[one] - starts[one] <= SHORT
            to = slot[one[keep]]
            self.seen[to], self.seen_at[to], self.seen_n[to] = h[one[keep]], begin[keep], count[keep]
        return at, n

    def _plain(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        starts, ends, po = pieces(buf, off, not self.fold)
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(off), np.int64)
        at, n = self._lookup(buf, starts, ends)
        return self.store[tc.ragged(at, n)], np.concatenate([[0], np.cumsum(n)])[po]

    def _fold(self, text: str) -> str:
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # lower() of the whole text would see the end of a word
        return text.lower()

    def encode(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all documents, and where each begins; special tokens' texts become their ids."""
        data = buf.tobytes()
        marked = b"<|" in data and any(t.encode() in data for t in self.special)
        if not self.fold and not marked:
            return self._plain(buf, off)
        texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(off[:-1].tolist(), off[1:].tolist(), strict=True)]
        owner, parts, marks = [], [], []
        for i, t in enumerate(texts):
            cut = self.split.split(t) if marked and "<|" in t else [t]
            for k, x in enumerate(cut):
                owner.append(i)
                marks.append(self.special[x] if k % 2 else -1)
                parts.append(b"" if k % 2 else (self._fold(x) if self.fold else x).encode())
        ids, po = self._plain(np.frombuffer(b"".join(parts), np.uint8), np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int64))
        if len(parts) == len(texts):
            return ids, po
        out, n = [], np.zeros(len(texts), np.int64)
        for i, mark, a, b in zip(owner, marks, po[:-1], po[1:], strict=True):
            out.append(ids[a:b] if mark < 0 else np.array([mark], np.int32))
            n[i] += len(out[-1])
        return np.concatenate(out) if out else ids, np.concatenate([[0], np.cumsum(n)])

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text; without a decoder in the file the tokens are joined by spaces."""
        if self.joined:
            return b"".join(map(self.raw.__getitem__, ids.tolist())).decode("utf-8", "replace").encode()
        return b" ".join(map(self.names.__getitem__, ids.tolist()))


def encoder(path: str) -> Encoder:
    if path not in _cache:
        _cache[path] = Encoder(path)
    return _cache[path]
