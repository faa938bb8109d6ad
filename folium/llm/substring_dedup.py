"""Removal of long passages that an earlier document has, by recompression."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_key, mix, part_column, part_of, partition_count, power_table, slices, span_hashes, text_buffer, word_spans

_U = np.uint64
#: Rounds after which symbols span some 24 words on average, and those that can settle within a window.
LONG_ROUNDS, SHORT_ROUNDS = 11, 2
#: Entries that a task keeps before it combines and sends them.
BLOCK_ENTRIES = 4_000_000
#: Compressed input of a partition; decoded it is some three times as much.
PART_BYTES = 24 << 20
_KINDS = {"bucket": pa.int32(), "part": pa.int32(), "names": pa.binary(), "rows": pa.binary(), "places": pa.binary(), "words": pa.binary()}
_BLOBS = "bucket int, part int, names binary, rows binary, places binary, words binary"


def name_runs(s: dict) -> dict:
    """Names each maximal run of one symbol; a run's name says symbol and length."""
    name, doc, n = s["name"], s["doc"], len(s["name"])
    first = np.flatnonzero(np.r_[True, (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])]) if n else np.zeros(0, np.int64)
    count = np.diff(np.r_[first, n])
    new = name[first]
    many = count > 1
    new[many] = mix(new[many] ^ mix(count[many].astype(_U) + _U(0xA5A5A5A5)))
    out = {"name": new, "doc": doc[first], "begin": s["begin"][first], "words": s["words"]}
    if "lo" in s:
        # that a run ends here is known from the symbols next to it
        last = first + count - 1
        out["lo"] = np.where(first > 0, s["lo"][np.maximum(first - 1, 0)], -1)
        out["hi"] = np.where(last + 1 < n, s["hi"][np.minimum(last + 1, n - 1)], s["words"] + 1)
    return out


def name_pairs(s: dict, salt: int) -> dict:
    """Names each pair of a left-class and a right-class symbol; a hash bit of the name is its class."""
    name, doc, n = s["name"], s["doc"], len(s["name"])
    right = (mix(name ^ _U(salt)) & _U(1)).astype(bool)
    opens = np.zeros(n, dtype=bool)
    opens[:-1] = ~right[:-1] & right[1:] & (doc[1:] == doc[:-1])
    at = np.flatnonzero(~np.r_[False, opens[:-1]][:n])
    pair = opens[at]
    last = at + pair
    new = name[at]
    new[pair] = mix(new[pair] * _U(0x9E3779B97F4A7C15) + mix(name[last[pair]]))
    out = {"name": new, "doc": doc[at], "begin": s["begin"][at], "words": s["words"]}
    if "lo" in s:
        # a lone left symbol depends on its right neighbour, a lone right symbol on its left one
        lone_left, lone_right = ~pair & ~right[at], ~pair & right[at]
        out["lo"] = np.where(lone_right, np.where(at > 0, s["lo"][np.maximum(at - 1, 0)], -1), s["lo"][at])
        out["hi"] = np.where(lone_left, np.where(at + 1 < n, s["hi"][np.minimum(at + 1, n - 1)], s["words"] + 1), s["hi"][last])
    return out


def recompress(words: np.ndarray, doc: np.ndarray, rounds: int, settled: bool) -> list[dict]:
    """The symbols after each round: names, documents, first words and, if asked for, the words [lo, hi) that settle them.

    Names depend on what they stand for alone, so they are the same in all documents and tasks.
    """
    n = len(words)
    s = {"name": words.copy(), "doc": doc, "begin": np.arange(n), "words": n}
    if settled:
        s |= {"lo": np.arange(n), "hi": np.arange(n) + 1}
    out = []
    for k in range(rounds):
        s = name_pairs(name_runs(s), 0x51ED270B + k)
        out.append(s)
    return out


def fingerprints(words: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Fingerprints of the word windows that start at the given places."""
    f = np.zeros(len(at), dtype=_U)
    for j in range(window):
        f = f * _U(0x5851F42D4C957F2D) + words[at + j]
    return mix(f)


def _span_sums(words: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Fingerprints of the words [lo, hi)."""
    p, inv = power_table(len(words) + 1)
    c = np.zeros(len(words) + 1, dtype=_U)
    np.cumsum(words * p[: len(words)], out=c[1:])
    return mix((c[hi] - c[lo]) * inv[lo])


def digests(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64 bits of the BLAKE2b digest of the bytes of the words [lo, hi), each word followed by a blank."""
    body, begin, end = _joined([(buf, starts, ends)])
    view = memoryview(body)
    got = [hashlib.blake2b(view[a:b], digest_size=8).digest() for a, b in zip(begin[lo].tolist(), end[hi - 1].tolist(), strict=True)]
    return np.frombuffer(b"".join(got), _U)


def long_symbols(words: np.ndarray, spans: tuple[np.ndarray, np.ndarray, np.ndarray], first: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
    """(document number, first word, words, name, check) of each two neighbouring high-level symbols, or of a document's only one.

    Neighbours overlap by a symbol, so every window of a passage of several symbols is inside one of
    them. spans: bytes, begins and ends of the words, of which the check is a digest.
    """
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    s = recompress(words, doc, LONG_ROUNDS, False)[-1]
    name, own, begin = s["name"], s["doc"], s["begin"]
    if not len(name):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, _U),) * 2
    same = np.r_[own[1:] == own[:-1], False]
    end = np.where(same, np.r_[begin[1:], 0], first[1:][own])
    lone = ~same & ~np.r_[False, same[:-1]]
    after = np.minimum(np.arange(len(name)) + 1, len(name) - 1)
    hi = np.where(same, end[after], end)
    both = np.where(same, mix(name * _U(0x9E3779B97F4A7C15) + mix(name[after] ^ _U(7))), mix(name ^ _U(0xC0FFEE)))
    some = np.flatnonzero((same | lone) & (hi - begin >= window))
    return own[some], begin[some] - first[own[some]], hi[some] - begin[some], both[some], digests(*spans, begin[some], hi[some])


def window_anchors(words: np.ndarray, first: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, document number, anchor) of each window of words.

    A symbol whose name and borders are settled by words inside a window is the same wherever that
    window occurs. The anchor is the smallest name among the window's settled symbols of the highest
    level that has any, named anew together with all the words that settle them, so that chance
    matches are rare; if there are none, it is a fingerprint of the window itself. So equal windows
    have equal anchors.
    """
    n = len(words)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    left = first[1:][doc] - np.arange(n) if n else np.zeros(0, np.int64)
    at = np.flatnonzero(left >= window)
    out = np.zeros(len(at), dtype=_U)
    todo = np.arange(len(at))
    for s in reversed(recompress(words, doc, SHORT_ROUNDS, True)) if len(at) else ():
        m = len(s["name"])
        lo, hi = np.clip(s["lo"], 0, n), np.clip(s["hi"], 0, n)
        name = mix(_span_sums(words, lo, hi) ^ s["name"])
        # the settled symbols of the window from p are numbers a to b
        a = np.cumsum(np.bincount(np.minimum(s["lo"] + 1, n), minlength=n + 1))[at[todo]]
        b = np.cumsum(np.bincount(np.minimum(s["hi"], n + 1), minlength=n + 2))[at[todo] + window]
        size = b - a
        best, width = name, 1
        while width <= window:
            some = np.flatnonzero((size >= width) & (size < 2 * width))
            out[todo[some]] = np.minimum(best[a[some]], best[b[some] - width])
            if 2 * width > m:
                break
            best, width = np.minimum(best[:-width], best[width:]), 2 * width
        todo = todo[size <= 0]
    out[todo] = fingerprints(words, at[todo], window)
    return at, doc[at], out


def word_numbers(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A number for each word, equal for equal words only."""
    size = ends - starts
    data = buf[np.repeat(starts - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())] if len(size) else np.zeros(0, np.uint8)
    off = np.r_[0, np.cumsum(size)].astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(off.tobytes()), pa.py_buffer(data.tobytes())])
    return words.dictionary_encode().indices.to_numpy().astype(np.int64)


def late_windows(numbers: np.ndarray, at: np.ndarray, doc: np.ndarray, window: int) -> np.ndarray:
    """Which windows of words, given by word numbers, also start in a document with a smaller id. Compares all words."""
    if not len(at):
        return np.zeros(0, bool)
    f = fingerprints(mix(numbers.astype(_U)), at, window)
    order = np.lexsort((doc, f))
    f, d, p = f[order], doc[order], at[order]
    head = np.r_[True, f[1:] != f[:-1]]
    group = np.cumsum(head) - 1
    lead = np.flatnonzero(head)[group]
    same = np.ones(len(p), dtype=bool)
    for j in range(window):
        same &= numbers[p + j] == numbers[p[lead] + j]
    late = same & (d > d[lead])
    for g in np.unique(group[~same]):  # different windows with one fingerprint
        least: dict[tuple, int] = {}
        members = np.flatnonzero(group == g)
        words = [tuple(numbers[p[i] : p[i] + window]) for i in members]
        for i, w in zip(members, words, strict=True):
            least[w] = min(least.get(w, d[i]), d[i])
        late[members] = [d[i] > least[w] for i, w in zip(members, words, strict=True)]
    out = np.empty(len(p), dtype=bool)
    out[order] = late
    return out


def _chunks(batch, whole: bool = False):
    """(row keys, ids, texts) in runs of whole texts of bounded size; rows without an id only if `whole`, with a mark."""
    known = batch.column("doc").is_valid()
    if not whole and batch.column("doc").null_count:
        batch, known = batch.filter(known), None
    row = batch.column("row").to_numpy(zero_copy_only=False)
    ids = batch.column("doc").fill_null(0).to_numpy(zero_copy_only=False)
    buf, off = text_buffer(batch.column("text"))
    for a, b in slices(off):
        texts = buf[off[a] : off[b]], off[a : b + 1] - off[a]
        yield (row[a:b], ids[a:b], *texts, known.slice(a, b - a).to_numpy(zero_copy_only=False)) if whole else (row[a:b], ids[a:b], *texts)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(_KINDS.values())], names=list(_KINDS))


def _table(rows: list[tuple]) -> pa.Table:
    return pa.Table.from_batches([_batch(rows)])


def _pack(*arrays: np.ndarray) -> bytes:
    return b"".join(np.ascontiguousarray(a).tobytes() for a in arrays)


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Where any of the columns changes."""
    if not len(columns[0]):
        return np.zeros(0, np.int64)
    return np.flatnonzero(np.r_[True, np.logical_or.reduce([c[1:] != c[:-1] for c in columns])])


def _within(size: np.ndarray) -> np.ndarray:
    """0, 1, ... size - 1 for each, one after the other."""
    return np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)


def _bucket(names: np.ndarray, n: int) -> np.ndarray:
    return (names % _U(n)).astype(np.int32)


def _say_late(row: np.ndarray, doc: np.ndarray, place: np.ndarray, count: np.ndarray, n: int):
    """Rows that tell the documents' partitions which windows are late, as runs; all groupings on the way pass them on."""
    for part, (r, d, p, c) in by_key(part_of(row, n), row, doc, place, count):
        yield (part, part, None, _pack(r, d), _pack(p.astype(np.int32), c.astype(np.int32)), None)


def _late_runs(row: np.ndarray, doc: np.ndarray, place: np.ndarray, n: int):
    """Says that single windows are late, those that follow each other as one run."""
    order = np.lexsort((place, doc, row))
    row, doc, place = row[order], doc[order], place[order]
    begin = _starts(row, doc, place - np.arange(len(place)))
    yield from _say_late(row[begin], doc[begin], place[begin], np.diff(np.r_[begin, len(row)]), n)


def _passed(rows: pa.Table) -> tuple[list[dict], list[tuple]]:
    """A group's rows for itself, and those that it passes on."""
    mine, on = [], []
    for r in rows.select(list(_KINDS)).to_pylist():
        if r["part"] is None:
            mine.append(r)
        else:
            on.append(tuple(r.values()))
    return mine, on


class _Late:
    """The late windows that a partition was told of."""

    def __init__(self, rows: list[tuple]):
        told = [r for r in rows if r[4] is not None]
        keys = [np.frombuffer(r[3], np.int64).reshape(2, -1) for r in told]
        spans = [np.frombuffer(r[4], np.int32).reshape(2, -1) for r in told]
        self.row, self.doc = np.concatenate(keys, axis=1) if told else np.zeros((2, 0), np.int64)
        self.place, self.count = np.concatenate(spans, axis=1).astype(np.int64) if told else np.zeros((2, 0), np.int64)
        order = np.argsort(self.row, kind="stable")
        self.row, self.doc, self.place, self.count = (x[order] for x in (self.row, self.doc, self.place, self.count))

    def starts(self, row: np.ndarray, doc: np.ndarray, first: np.ndarray) -> np.ndarray:
        """For each word of the texts whether a late window starts there."""
        a, b = np.searchsorted(self.row, row, "left"), np.searchsorted(self.row, row, "right")
        size = b - a
        which = np.repeat(a, size) + _within(size)
        text = np.repeat(np.arange(len(row)), size)
        which, text = which[mine := self.doc[which] == doc[text]], text[mine]
        edge = np.zeros(int(first[-1]) + 1, dtype=np.int64)
        at = first[text] + self.place[which]
        np.add.at(edge, at, 1)
        np.add.at(edge, at + self.count[which], -1)
        return np.cumsum(edge[:-1]) > 0


def _send_anchors(anchor: np.ndarray, row: np.ndarray, n: int):
    """Combines a block's anchors: at most one entry of each goes out, whatever number of documents has it.

    An anchor of several of the block's rows is known to be shared here, so they are answered at
    once and only its name goes on; one of a single row goes on with it.
    """
    order = np.lexsort((row, anchor))
    anchor, row = anchor[order], row[order]
    fresh = _starts(anchor, row)
    anchor, row = anchor[fresh], row[fresh]
    head = _starts(anchor)
    count = np.diff(np.r_[head, len(row)])
    lone, many = head[count == 1], head[count > 1]
    for bucket, (h, r) in by_key(_bucket(anchor[lone], n), anchor[lone], row[lone]):
        yield (bucket, None, h.tobytes(), r.tobytes(), None, None)
    for bucket, (h,) in by_key(_bucket(anchor[many], n), anchor[many]):
        yield (bucket, None, h.tobytes(), None, None, None)
    own = np.repeat(count > 1, count)
    yield from _say_shared(anchor[own], row[own], n)


def _say_shared(anchor: np.ndarray, row: np.ndarray, n: int):
    for part, (h, r) in by_key(part_of(row, n), anchor, row):
        yield (part, part, h.tobytes(), r.tobytes(), None, None)


def _first_of(name: np.ndarray, check: np.ndarray, row: np.ndarray, doc: np.ndarray, place: np.ndarray, size: np.ndarray):
    """Long symbols sorted by name, once each, and which of them a smaller document has too."""
    order = np.lexsort((place, row, doc, check, name))
    cols = [c[order] for c in (name, check, row, doc, place, size)]
    fresh = _starts(*cols[:5])
    cols = [c[fresh] for c in cols]
    head = _starts(*cols[:2])
    return cols, cols[3] > np.repeat(cols[3][head], np.diff(np.r_[head, len(fresh)]))


def dedup_substrings(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 13) -> DataFrame:
    """Removes words covered by a window of words that also starts in a document with a smaller id.

    Returns id_col (long), n_words, n_removed, kept_text: the kept words joined by one space.

    Recompression names runs and pairs of words, then of their names, round by round. A name depends
    on its content alone, so every task gives it without a dictionary and equal substrings have
    equal symbols inside. Three groupings follow. First, symbols of LONG_ROUNDS rounds: Spark groups
    them by name and by an independent 64-bit fingerprint of their words (two different passages
    agree in both with a chance of 2^-128), which reveals long repeats; all windows within a symbol
    that a smaller document has are done. Second, for the other windows: the highest symbol settled
    inside each is its anchor, and Spark tells each text which of its anchors others have. Third,
    windows of shared anchors meet and are compared word by word, so no window goes on the word of
    a hash. Every task combines what it sends, so a passage, anchor or window that a third of all
    documents have costs one entry for each task.

    Words are separated by 0x20 and 0x09 to 0x0D. Null or empty texts have no words and an empty
    kept text. Rows with a null id keep all words and take no part. Rows that repeat an id belong to
    one document, so they take nothing from each other, and each loses what its own text shares
    with smaller ids (rows are told apart by id and a 64-bit hash of id and text). Texts may be
    longer than a task's blocks: one is never cut. Equal windows go by the smallest id; an empty
    table gives an empty result. Other columns of df, whatever their names, aren't looked at.
    """
    n = partition_count(df, PART_BYTES)
    docs = df.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).cast("string").alias("text"))
    docs = docs.withColumn("row", F.xxhash64("doc", "text"))

    def read(buf, off):
        starts, ends, first = word_spans(buf, off)
        return starts, ends, first, span_hashes(buf, starts, ends)

    def send_symbols(held: list[tuple]):
        if held:
            (name, check, row, doc, place, size), late = _first_of(*(np.concatenate(x) for x in zip(*held, strict=True)))
            yield from _say_late(row[late], doc[late], place[late], size[late] - window + 1, n)
            go = ~late
            for bucket, (h, c, r, d, p, s) in by_key(_bucket(name[go], n), *(x[go] for x in (name, check, row, doc, place, size))):
                yield (bucket, None, _pack(h, c), _pack(r, d), _pack(p.astype(np.int32), s.astype(np.int32)), None)

    def symbols(batches):
        held, count = [], 0
        for batch in batches:
            for row, ids, buf, off in _chunks(batch):
                starts, ends, first, words = read(buf, off)
                own, place, size, name, check = long_symbols(words, (buf, starts, ends), first, window)
                held.append((name, check, row[own], ids[own], place, size))
                count += len(own)
                if count >= BLOCK_ENTRIES:
                    yield _batch(list(send_symbols(held)))
                    held, count = [], 0
        yield _batch(list(send_symbols(held)))

    def repeats(rows: pa.Table) -> pa.Table:
        mine, out = _passed(rows)
        if mine:
            name, check = np.concatenate([np.frombuffer(r["names"], _U).reshape(2, -1) for r in mine], axis=1)
            row, doc = np.concatenate([np.frombuffer(r["rows"], np.int64).reshape(2, -1) for r in mine], axis=1)
            place, size = np.concatenate([np.frombuffer(r["places"], np.int32).reshape(2, -1) for r in mine], axis=1)
            (_, _, row, doc, place, size), late = _first_of(name, check, row, doc, place, size)
            out += _say_late(row[late], doc[late], place[late], size[late] - window + 1, n)
        return _table(out)

    def anchors(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, out = _passed(right)
        late = _Late(out)
        names, owners, held = [], [], 0
        for batch in left.select(["doc", "text", "row"]).combine_chunks().to_batches():
            for row, ids, buf, off in _chunks(batch):
                _, _, first, words = read(buf, off)
                at, own, anchor = window_anchors(words, first, window)
                open_ = ~late.starts(row, ids, first)[at]
                own, anchor = own[open_], anchor[open_]
                begin = _starts(anchor, own)
                names.append(anchor[begin])
                owners.append(row[own[begin]])
                held += len(begin)
                if held >= BLOCK_ENTRIES:
                    out += _send_anchors(np.concatenate(names), np.concatenate(owners), n)
                    names, owners, held = [], [], 0
        if held:
            out += _send_anchors(np.concatenate(names), np.concatenate(owners), n)
        return _table(out)

    def shared(rows: pa.Table) -> pa.Table:
        mine, out = _passed(rows)
        lone = [r for r in mine if r["rows"] is not None]
        many = [np.frombuffer(r["names"], _U) for r in mine if r["rows"] is None]
        if lone:
            h, row = (np.concatenate([np.frombuffer(r[c], kind) for r in lone]) for c, kind in (("names", _U), ("rows", np.int64)))
            order = np.lexsort((row, h))
            h, row = h[order], row[order]
            head = _starts(h)
            size = np.diff(np.r_[head, len(h)])
            known = row[head] != row[head + size - 1]
            if many:
                known |= np.isin(h[head], np.concatenate(many))
            hit = np.repeat(known, size)
            out += _say_shared(h[hit], row[hit], n)
        return _table(out)

    def windows(key, left: pa.Table, right: pa.Table) -> pa.Table:
        _, told = _passed(right)
        late, out = _Late(told), [r for r in told if r[4] is not None]
        some = [r for r in told if r[4] is None]
        if not some:
            return _table(out)
        known = np.sort(np.concatenate([mix(np.frombuffer(r[2], _U) ^ mix(np.frombuffer(r[3], np.int64).astype(_U))) for r in some]))
        got, texts, words_before = [], [], 0
        for batch in left.select(["doc", "text", "row"]).combine_chunks().to_batches():
            for row, ids, buf, off in _chunks(batch):
                starts, ends, first, words = read(buf, off)
                at, own, anchor = window_anchors(words, first, window)
                begin = _starts(anchor, own)
                key_ = mix(anchor[begin] ^ mix(row[own[begin]].astype(_U)))
                place = np.minimum(np.searchsorted(known, key_), len(known) - 1)
                hit = np.repeat(known[place] == key_, np.diff(np.r_[begin, len(at)])) & ~late.starts(row, ids, first)[at]
                p, d = at[hit], own[hit]
                # only words of those windows are kept, in order
                cover = np.zeros(len(words) + 1, dtype=np.int64)
                np.add.at(cover, p, 1)
                np.add.at(cover, p + window, -1)
                cover = np.cumsum(cover[:-1]) > 0
                new = np.cumsum(cover) - 1 + words_before
                w = np.flatnonzero(cover)
                texts.append((buf, starts[w], ends[w]))
                words_before += len(w)
                got.append((anchor[hit], row[d], ids[d], p - first[d], new[p]))
        buf, starts, ends = _joined(texts)
        anchor, row, doc, place, at = (np.concatenate(x) for x in zip(*got, strict=True)) if got else (np.zeros(0, np.int64),) * 5
        gone = late_windows(word_numbers(buf, starts, ends), at, doc, window)
        out += _late_runs(row[gone], doc[gone], place[gone], n)
        anchor, row, doc, place, at = (x[~gone] for x in (anchor, row, doc, place, at))
        # windows of one anchor that follow each other go as a run, with their words
        begin = _starts(anchor, row, place - np.arange(len(place)), at - np.arange(len(at)))
        size = np.diff(np.r_[begin, len(anchor)])
        width = ends - starts + 1
        for bucket, (a, length) in by_key(_bucket(anchor[begin], n), begin, size):
            each = np.repeat(at[a], length + window - 1) + _within(length + window - 1)
            body = np.full(int(width[each].sum()), 0x20, dtype=np.uint8)
            fill = width[each] - 1
            body[np.repeat(np.cumsum(width[each]) - width[each], fill) + _within(fill)] = buf[np.repeat(starts[each], fill) + _within(fill)]
            out.append((bucket, None, None, _pack(row[a], doc[a]), _pack(place[a].astype(np.int32), length.astype(np.int32)), body.tobytes()))
        return _table(out)

    def earliest(rows: pa.Table) -> pa.Table:
        mine, out = _passed(rows)
        if mine:
            row, doc = np.concatenate([np.frombuffer(r["rows"], np.int64).reshape(2, -1) for r in mine], axis=1)
            place, length = np.concatenate([np.frombuffer(r["places"], np.int32).reshape(2, -1) for r in mine], axis=1).astype(np.int64)
            buf = np.frombuffer(b"".join(r["words"] for r in mine), np.uint8)
            ends = np.flatnonzero(buf == 0x20)
            numbers = word_numbers(buf, np.r_[0, ends[:-1] + 1], ends)
            size = length + window - 1
            at = np.repeat(np.cumsum(size) - size, length) + _within(length)
            row, doc, place = np.repeat(row, length), np.repeat(doc, length), np.repeat(place, length) + _within(length)
            gone = late_windows(numbers, at, doc, window)
            out += _late_runs(row[gone], doc[gone], place[gone], n)
        return _table(out)

    def finish(key, left: pa.Table, right: pa.Table) -> pa.Table:
        late, parts = _Late(_passed(right)[1]), []
        for batch in left.select(["doc", "text", "row"]).combine_chunks().to_batches():
            for row, ids, buf, off, known in _chunks(batch, True):
                starts, ends, first = word_spans(buf, off)
                start = late.starts(row, ids, first)
                run = np.r_[0, np.cumsum(start)]
                gone = run[1:] > run[np.maximum(np.arange(len(start)) - window + 1, 0)]
                gone &= np.repeat(known, np.diff(first))
                lost = np.r_[0, np.cumsum(gone)][first]
                kept = np.flatnonzero(~gone)
                owner = np.repeat(np.arange(len(row)), np.diff(first))[kept]
                size = ends[kept] - starts[kept]
                # a blank follows each kept word but a text's last
                width = size + np.r_[owner[1:] == owner[:-1], False] if len(kept) else size
                body = np.full(int(width.sum()), 0x20, dtype=np.uint8)
                body[np.repeat(np.cumsum(width) - width, size) + _within(size)] = buf[np.repeat(starts[kept], size) + _within(size)]
                stop = np.r_[0, np.cumsum(width)][np.searchsorted(owner, np.arange(len(row) + 1))]
                text = pa.LargeStringArray.from_buffers(len(row), pa.py_buffer(stop.astype(np.int64).tobytes()), pa.py_buffer(body.tobytes()))
                parts.append(pa.table([pa.array(ids, mask=~known), pa.array(np.diff(first), pa.int64()), pa.array(np.diff(lost), pa.int64()), text.cast(pa.string())], names=["doc", "n_words", "n_removed", "kept_text"]))
        return pa.concat_tables(parts) if parts else pa.table([pa.array([], k) for k in (pa.int64(),) * 3 + (pa.string(),)], names=["doc", "n_words", "n_removed", "kept_text"])

    def alone(batches):
        for batch in batches:
            yield from finish(None, pa.Table.from_batches([batch]), _table([])).to_batches()

    # rows without an id take nothing and give nothing, so they need not meet
    idless = docs.where("doc is null").mapInArrow(alone, "doc long, n_words long, n_removed long, kept_text string")
    docs = docs.where("doc is not null")
    # every pass over the texts reads one exchange of them
    parted = docs.withColumn("part", part_column("row", n))
    long_ = docs.mapInArrow(symbols, _BLOBS).groupBy("bucket").applyInArrow(repeats, _BLOBS)
    named = parted.groupBy("part").cogroup(long_.groupBy("part")).applyInArrow(anchors, _BLOBS)
    told = named.groupBy("bucket").applyInArrow(shared, _BLOBS)
    found = parted.groupBy("part").cogroup(told.groupBy("part")).applyInArrow(windows, _BLOBS)
    gone = found.groupBy("bucket").applyInArrow(earliest, _BLOBS)
    out = parted.groupBy("part").cogroup(gone.groupBy("part")).applyInArrow(finish, "doc long, n_words long, n_removed long, kept_text string")
    return out.unionByName(idless).withColumnRenamed("doc", id_col)


def _joined(texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The given words of several buffers in one, each followed by a blank."""
    bodies, sizes = [], []
    for buf, starts, ends in texts:
        size = ends - starts
        body = np.full(int((size + 1).sum()), 0x20, dtype=np.uint8)
        body[np.repeat(np.cumsum(size + 1) - size - 1, size) + _within(size)] = buf[np.repeat(starts, size) + _within(size)]
        bodies.append(body)
        sizes.append(size)
    size = np.concatenate(sizes) if sizes else np.zeros(0, np.int64)
    end = np.cumsum(size + 1) - 1
    return np.concatenate(bodies) if bodies else np.zeros(0, np.uint8), end - size, end
