"""Token ids of many texts at once, by a byte-level BPE file of the tokenizers library.

If the file's pre-tokenizer is the byte-level one, a text is cut as it cuts; each distinct piece is
encoded once by the library and its ids are kept for later texts of the same worker. With any other
pre-tokenizer, or a normalizer, the library gets texts whole.
"""

from __future__ import annotations

import json
import unicodedata

import numpy as np
import pyarrow as pa

from .common import span_hashes

_U = np.uint64
LETTER, NUMBER, OTHER, WHITE, SPACE, UNSURE = range(6)
#: Pieces that a worker keeps; beyond it starts anew.
MOST_PIECES = 2_000_000
#: Ranges of characters whose class is the same in all versions of Unicode that matter here.
SURE = ((0x09, 0x0D), (0x20, 0x7E), (0xA0, 0x241), (0x391, 0x3A1), (0x3A3, 0x3CE), (0x400, 0x481), (0x48A, 0x513), (0x2010, 0x2027), (0x2030, 0x205E), (0x20A0, 0x20B0), (0x4E00, 0x9FA5), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3))


def _classes() -> np.ndarray:
    t = np.full(0x110000, UNSURE, dtype=np.uint8)
    for a, b in SURE:
        for cp in range(a, b + 1):
            kind = unicodedata.category(chr(cp))
            t[cp] = LETTER if kind[0] == "L" else NUMBER if kind[0] == "N" else WHITE if chr(cp).isspace() else OTHER
    t[0x20] = SPACE
    return t


def _byte_level(spec: dict) -> bool:
    """Whether texts are cut by the byte-level pattern and by nothing else."""
    cut = spec.get("pre_tokenizer") or {}
    kind = (cut.get("type"), cut.get("add_prefix_space"), cut.get("use_regex", True))
    return spec.get("normalizer") is None and kind == ("ByteLevel", False, True)


class Encoder:
    """Ids by one tokenizer file. `encode` is exact: texts with rare characters go to the library whole."""

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tool = Tokenizer.from_file(path)
        self.tool.encode_special_tokens = True
        if self.tool.get_vocab_size() > 1 << 16:
            raise ValueError("ids are kept in 16 bits; the vocabulary has more")
        self.cuts = _byte_level(json.loads(self.tool.to_str()))
        self.classes = _classes()
        self._clear()

    def _clear(self) -> None:
        empty = lambda kind: np.zeros(0, kind)
        # of each piece: hash, where its ids are, how many, where its bytes are, how many
        self.tiers = [(empty(_U), empty(np.int64), empty(np.int32), empty(np.int64), empty(np.int64))] * 2
        self.flat, self.used = np.zeros(1 << 16, np.uint16), 0
        self.bytes, self.used_bytes = np.zeros(1 << 18, np.uint8), 0

    def _batch(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tool.encode_batch_fast(texts, add_special_tokens=False)]

    def _add(self, hashes: np.ndarray, pieces: list[str]) -> None:
        ids = self._batch(pieces)
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        body = [p.encode("utf-8", "surrogatepass") for p in pieces]
        length = np.fromiter(map(len, body), np.int64, len(body))
        at, where = self.used + np.r_[0, np.cumsum(size[:-1], dtype=np.int64)], self.used_bytes + np.r_[0, np.cumsum(length[:-1])]
        self.flat, self.used = _appended(self.flat, self.used, np.fromiter((x for y in ids for x in y), np.uint16, int(size.sum())))
        self.bytes, self.used_bytes = _appended(self.bytes, self.used_bytes, np.frombuffer(b"".join(body), np.uint8))
        old, new = self.tiers
        new = self._merged(new, (hashes, at, size, where, length))
        if len(new[0]) * 8 > len(old[0]):
            old, new = self._merged(old, new), tuple(x[:0] for x in new)
        self.tiers = [old, new]

    @staticmethod
    def _merged(a, b):
        order = np.argsort(np.concatenate([a[0], b[0]]), kind="stable")
        return tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True))

    def _find(self, hashes: np.ndarray):
        """Of each hash: where its ids are (-1: not known), how many, where its bytes are, how many."""
        n = len(hashes)
        out = np.full(n, -1, np.int64), np.zeros(n, np.int32), np.zeros(n, np.int64), np.zeros(n, np.int64)
        for key, *columns in self.tiers:
            if len(key):
                i = np.minimum(np.searchsorted(key, hashes), len(key) - 1)
                hit = key[i] == hashes
                for o, c in zip(out, columns, strict=True):
                    o[hit] = c[i[hit]]
        return out

    def cut(self, cp: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Where pieces begin in the characters of the texts that begin at off[:-1]; no text is empty."""
        kind, n = self.classes[cp], len(cp)
        head = np.zeros(n + 1, dtype=bool)
        head[off] = True
        white = kind >= WHITE
        before = np.r_[np.uint8(9), kind[:-1]]
        start = head[:-1].copy()
        # a letter, number or other sign begins where its class does, unless one blank stands before it
        start |= ~white & (kind != before) & (before != SPACE)
        # white space begins at its run; the last of several before a word stands alone or joins it
        white_before = np.r_[False, white[:-1]] & ~head[:-1]
        word_next = np.r_[~white[1:], False] & ~head[1:]
        start |= white & (~white_before | word_next)
        # contractions at the beginning of a piece
        quote = np.flatnonzero((cp == 0x27) & (head[:-1] | ((before != OTHER) & (before != SPACE))))
        if len(quote):
            padded = np.r_[cp, 0, 0, 0]
            border = np.r_[head, True, True, True]
            one, two = padded[quote + 1], padded[quote + 2]
            inside = ~border[quote + 1]
            short = inside & np.isin(one, [ord(c) for c in "stmd"])
            r, v, e, ll = map(ord, "rvel")
            long = inside & ~border[quote + 2] & ((((one == r) | (one == v)) & (two == e)) | ((one == ll) & (two == ll)))
            start = np.r_[start, False, False, False]
            for found, width in ((quote[short], 2), (quote[long], 3)):
                start[found + 1] = False
                start[found + width - 1] = False
                start[found + width] = True
            start = start[:n] | head[:-1]
        return np.flatnonzero(start)

    def _differ(self, buf: np.ndarray, start: np.ndarray, stop: np.ndarray, where: np.ndarray, length: np.ndarray) -> np.ndarray:
        """Which pieces [start, stop) of buf aren't the known pieces of the same hash, byte by byte."""
        out = stop - start != length
        same = np.flatnonzero(~out)
        size = length[same]
        step = _within(size)
        unlike = buf[np.repeat(start[same], size) + step] != self.bytes[np.repeat(where[same], size) + step]
        if unlike.any():
            out[same[np.repeat(np.arange(len(same)), size)[unlike]]] = True
        return out

    def encode(self, texts: list[str], end_id: int | None = None):
        """(ids as uint16, where each text's begin with the end, hashes of pieces, where each text's begin)."""
        if self.tiers[0][0].size + self.tiers[1][0].size > MOST_PIECES:
            self._clear()
        whole = "".join(texts)
        cp = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        off = np.r_[0, np.cumsum(sizes)]
        odd = np.zeros(len(texts), dtype=bool)
        unsure = np.flatnonzero(self.classes[cp] == UNSURE)
        odd[np.searchsorted(off, unsure, "right") - 1] = True
        odd |= not self.cuts
        filled = off[:-1][sizes > 0]
        begin = self.cut(cp, np.r_[filled, len(cp)]) if len(cp) else np.zeros(0, np.int64)
        stop = np.r_[begin[1:], len(cp)]
        width = 1 + (cp >= 0x80).astype(np.int64) + (cp >= 0x800) + (cp >= 0x10000)
        place = np.r_[0, np.cumsum(width)]
        buf = np.frombuffer(whole.encode("utf-8", "surrogatepass"), dtype=np.uint8)
        hashes = span_hashes(buf, place[begin], place[stop])
        first = np.searchsorted(begin, off)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        keep = ~odd[owner] if odd.any() else np.ones(len(hashes), bool)
        distinct, sample, inverse = np.unique(hashes[keep], return_index=True, return_inverse=True)
        at, size, where, length = self._find(distinct)
        new = np.flatnonzero(at < 0)
        if len(new):
            k = np.flatnonzero(keep)[sample[new]]
            self._add(distinct[new], [whole[a:b] for a, b in zip(begin[k].tolist(), stop[k].tolist(), strict=True)])
            at, size, where, length = self._find(distinct)
        # a piece that shares its hash with another one: its text goes to the library whole
        k = np.flatnonzero(keep)
        differ = self._differ(buf, place[begin[k]], place[stop[k]], where[inverse], length[inverse]) if len(k) else keep[:0]
        if differ.any():
            odd[owner[k[differ]]] = True
            stay = ~odd[owner[k]]
            keep[k[~stay]] = False
            inverse = inverse[stay]
        each = np.zeros(len(hashes), np.int64)
        each[keep] = size[inverse]
        run = np.r_[0, np.cumsum(each)]
        count = run[first[1:]] - run[first[:-1]]
        ids = self.flat[np.repeat(np.r_[at, 0][inverse] if len(inverse) else inverse, size[inverse]) + _within(size[inverse])] if len(inverse) else np.zeros(0, np.uint16)
        if not odd.any() and end_id is None:
            return ids, np.r_[0, np.cumsum(count)], hashes, first
        parts, got, a = [], [], 0
        special = dict(zip(np.flatnonzero(odd).tolist(), self._batch([texts[i] for i in np.flatnonzero(odd)]), strict=True)) if odd.any() else {}
        tail = np.array([], np.uint16) if end_id is None else np.array([end_id], np.uint16)
        for i, c in enumerate(count.tolist()):
            own = np.array(special[i], np.uint16) if i in special else ids[a : a + c]
            a += 0 if i in special else c
            parts += [own, tail]
            got.append(len(own) + len(tail))
        return np.concatenate(parts) if parts else ids, np.r_[0, np.cumsum(np.array(got, np.int64))], hashes, first


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each, one after the other."""
    run = np.cumsum(size, dtype=np.int64)
    return np.arange(run[-1] if len(run) else 0) - np.repeat(run - size, size)


def _appended(a: np.ndarray, used: int, more: np.ndarray) -> tuple[np.ndarray, int]:
    """The array with more after its used part, and how much of it is used then."""
    if used + len(more) > len(a):
        a = np.r_[a, np.zeros(max(len(a), len(more)), a.dtype)]
    a[used : used + len(more)] = more
    return a, used + len(more)


_tools: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file."""
    if path not in _tools:
        _tools[path] = Encoder(path)
    return _tools[path]


def text_slices(texts: pa.Array, most: int = 1 << 20):
    """Runs (start, list of texts) of about that many characters; null is an empty text."""
    held, size, start = [], 0, 0
    for i, t in enumerate(texts.to_pylist()):
        held.append(t or "")
        size += len(held[-1])
        if size >= most:
            yield start, held
            held, size, start = [], 0, i + 1
    if held:
        yield start, held
