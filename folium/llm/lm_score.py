"""Log-probabilities of texts by an n-gram model of the corpus, as a weighted automaton with failure arcs."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import IS_SPACE, mix, partition_count, slices, span_hashes, text_buffer, word_spans

_U = np.uint64
#: What stands before a text's first word, and the token after its last one.
BEGIN, END = _U(0x6A09E667F3BCC909), _U(0xBB67AE8584CAA73B)
#: Compressed input of a block of documents; a worker keeps a block's distinct n-grams.
PART_BYTES = 5 << 20
#: Tokens of a piece: long texts are traversed in pieces side by side.
PIECE = 512
#: Distinct words that a task keeps before it sends them.
MOST_HELD = 4_000_000
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLOBS = "bucket int, block int, keys binary, counts binary"


def token_keys(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each text's tokens, with BEGIN before its words and END after them, and where each text's begin, with the end."""
    buf = _LOWER[buf]
    starts, ends, first = word_spans(buf, off, IS_SPACE)
    count = np.diff(first)
    begin = first + 2 * np.arange(len(first))
    seq = np.empty(int(begin[-1]), dtype=_U)
    seq[np.arange(len(starts)) + 2 * np.repeat(np.arange(len(count)), count) + 1] = span_hashes(buf, starts, ends)
    seq[begin[:-1]], seq[begin[1:] - 1] = BEGIN, END
    return seq, begin


def longer(keys: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    """Keys of n-grams that go on by one token."""
    return mix(keys * _U(0x9FB21C651E98DF25) + tokens)


def ngrams(seq: np.ndarray, begin: np.ndarray, order: int) -> list[tuple[np.ndarray, ...]]:
    """For each length up to order: places of the last tokens, and keys of the n-gram, of what it goes on from, and of what it ends in.

    A text's BEGIN counts as a token of its first n-grams but ends none, except itself.
    """
    start = np.zeros(len(seq), dtype=bool)
    start[begin[:-1]] = True
    at, keys = np.arange(len(seq)), seq
    out = [(at, keys, keys[:0], keys[:0])]
    whole = seq.copy()
    for _ in range(order - 1):
        ok = np.zeros(len(seq), dtype=bool)
        ok[at] = True
        at = np.flatnonzero(np.r_[False, ok[:-1]] & ~start)
        new = whole.copy()
        new[at] = longer(whole[at - 1], seq[at])
        out.append((at, new[at], whole[at - 1], whole[at]))
        whole = new
    return out


def summed(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct keys in order, their summed counts, and the place of one entry of each."""
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    head = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]]) if len(keys) else np.zeros(0, np.int64)
    return keys[head], np.add.reduceat(counts, head) if len(head) else counts, order[head]


def _planes(numbers: np.ndarray) -> bytes:
    """Bytes of 64-bit numbers by significance, so that small ones compress."""
    return np.ascontiguousarray(numbers.astype("<u8").view(np.uint8).reshape(-1, 8).T).tobytes()


def _numbers(blob: bytes) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(blob, np.uint8).reshape(8, -1).T).view("<u8").reshape(-1)


def pack_keys(keys: np.ndarray) -> bytes:
    """Keys in order, as their differences."""
    return _planes(np.diff(keys, prepend=_U(0)))


def unpack_keys(blob: bytes) -> np.ndarray:
    return np.cumsum(_numbers(blob), dtype=_U)


def _dealt(keys: np.ndarray, n: int) -> np.ndarray:
    """Where each of n buckets of keys in order begins, with the end."""
    bucket = ((keys >> _U(32)) * _U(n)) >> _U(32)
    return np.searchsorted(bucket, np.arange(n + 1, dtype=_U))


def _send(keys: np.ndarray, counts: np.ndarray, block: int, n: int) -> list[tuple]:
    cuts = _dealt(keys, n).tolist()
    return [(k, block, pack_keys(keys[a:b]), _planes(counts[a:b])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]


def _blobs(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], names=["bucket", "block", "keys", "counts"])


class Automaton:
    """States are the n-grams that training texts have and go on from; the root is state 0.

    levels: for each length, keys in order, counts in training, keys of what the n-gram goes on from
    and of what it ends in. A known n-gram is an arc from the state of all its tokens but the last,
    with its smoothed log-probability; a failure arc leads to the state of all tokens but the first,
    with the log of the weight that is left for it. The root has an arc for every token.
    """

    def __init__(self, levels: list[tuple[np.ndarray, ...]], tokens: int, words: int, strength: tuple[float, ...]):
        self.order = len(levels)
        known = [tuple(x[t[1] > 0] if len(x) else x for x in t) for t in levels]
        sizes = [1] + [len(k[0]) for k in known[:-1]]
        at = np.cumsum(sizes)  # first state of each level
        n = int(at[-1])
        place = lambda level, keys: np.searchsorted(known[level][0], keys)
        self.key, self.fail, self.fail_weight = np.zeros(n, _U), np.zeros(n, np.int64), np.zeros(n)
        keys, count, _, _ = levels[0]
        self.tokens, self.unknown = keys, -np.log10(tokens + words + 1.0)
        self.token_weight = np.log10(count + 1.0) + self.unknown
        self.token_known = count > 0
        self.token_state = np.zeros(len(keys), np.int64)
        if self.order > 1:
            self.token_state[count > 0] = at[0] + np.arange(len(known[0][0]))
        chance = (known[0][1] + 1.0) / (tokens + words + 1.0)
        arcs = []
        for k in range(1, self.order):
            keys, count, context, suffix = known[k]
            lower, here = known[k - 1], at[k - 1] + np.arange(len(known[k - 1][0]))
            self.key[here] = lower[0]
            self.fail_weight[here] = np.log10(strength[k - 1] / (lower[1] + strength[k - 1]))
            if k > 1:
                self.fail[here] = at[k - 2] + place(k - 2, lower[3])
            chance = (count + strength[k - 1] * chance[place(k - 1, suffix)]) / (lower[1][place(k - 1, context)] + strength[k - 1])
            target = at[k] + np.arange(len(keys)) if k < self.order - 1 else at[k - 1] + place(k - 1, suffix)
            arcs.append((keys, np.log10(chance), target))
        del known
        self.arc, self.arc_weight, self.arc_state = (np.concatenate(x) for x in zip(*arcs, strict=True)) if arcs else (np.zeros(0, _U), np.zeros(0), np.zeros(0, np.int64))
        order = np.argsort(self.arc, kind="stable")
        self.arc, self.arc_weight, self.arc_state = self.arc[order], self.arc_weight[order], self.arc_state[order]
        # one entry more, so that every search ends inside
        self.arc, self.arc_weight, self.arc_state = np.r_[self.arc, _U(0)], np.r_[self.arc_weight, -np.inf], np.r_[self.arc_state, 0]
        i = np.searchsorted(self.tokens, BEGIN)
        self.start = int(self.token_state[i]) if i < len(self.tokens) and self.tokens[i] == BEGIN else 0

    def step(self, state: np.ndarray, token: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """From states, reading a token each (its key and its place among tokens): new states and log-probabilities."""
        new, weight = self.token_state[number], np.zeros(len(state))
        todo, at = np.flatnonzero(state > 0), state[state > 0]
        done = np.zeros(len(state), dtype=bool)
        while len(todo):
            want = longer(self.key[at], token[todo])
            i = np.searchsorted(self.arc[:-1], want)
            hit = self.arc[i] == want
            got = todo[hit]
            weight[got] += self.arc_weight[i[hit]]
            new[got], done[got] = self.arc_state[i[hit]], True
            todo, at = todo[~hit], at[~hit]
            weight[todo] += self.fail_weight[at]
            at = self.fail[at]
            todo, at = todo[at > 0], at[at > 0]
        rest = ~done
        weight[rest] += self.token_weight[number[rest]]
        return new, weight

    def score(self, seq: np.ndarray, begin: np.ndarray, number: np.ndarray | None = None) -> np.ndarray:
        """Log-probability of each text, read from left to right; all pieces of texts are a step further at a time.

        A piece that begins inside a text first reads the tokens before it that a state can hold.
        """
        first, last = begin[:-1] + 1, begin[1:]
        pieces = np.maximum(1, -(-(last - first) // PIECE))
        owner = np.repeat(np.arange(len(first)), pieces)
        rank = np.arange(len(owner)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        a = first[owner] + rank * PIECE
        b = np.minimum(a + PIECE, last[owner])
        lead = np.where(rank > 0, self.order - 1, 0)
        state = np.where(rank > 0, 0, self.start)
        order = np.argsort(-(b - a + lead), kind="stable")
        a, b, lead, state, owner = a[order], b[order], lead[order], state[order], owner[order]
        number = np.searchsorted(self.tokens, seq) if number is None else number
        total = np.zeros(len(a))
        n = len(a)
        for t in range(int((b - a + lead).max()) if n else 0):
            while a[n - 1] - lead[n - 1] + t >= b[n - 1]:
                n -= 1
            at = a[:n] - lead[:n] + t
            state[:n], weight = self.step(state[:n], seq[at], number[at])
            total[:n] += np.where(at >= a[:n], weight, 0.0)
        back = np.argsort(order, kind="stable")
        return np.add.reduceat(total[back], np.cumsum(pieces) - pieces) if n or len(total) else np.zeros(len(first))


def _block_grams(texts: pa.Array, learn: np.ndarray, order: int, whole: bool):
    """The block's distinct n-grams: for each length keys in order, counts in texts to learn from and, if asked for, the keys of their parts."""
    held: list[list[tuple[np.ndarray, ...]]] = [[] for _ in range(order)]
    buf, off = text_buffer(texts)
    for a, b in slices(off):
        seq, begin = token_keys(buf[off[a] : off[b]], off[a : b + 1] - off[a])
        mine = np.repeat(learn[a:b], np.diff(begin)).astype(np.int64)
        for k, (at, keys, context, suffix) in enumerate(ngrams(seq, begin, order)):
            keys, count, one = summed(keys, mine[at])
            held[k].append((keys, count, context[one], suffix[one]) if whole and k else (keys, count))
    out = []
    for k in range(order):
        parts, held[k] = held[k], []
        keys, count, *more = (np.concatenate(x) for x in zip(*parts, strict=True)) if parts else (np.zeros(0, _U), np.zeros(0, np.int64), *[np.zeros(0, _U)] * 2)
        del parts
        keys, count, one = summed(keys, count)
        out.append((keys, count, *((x[one] for x in more) if more else [keys[:0]] * 2)))
    return out


def score_texts(df: DataFrame, learn, id_col: str = "doc_id", text_col: str = "text", order: int = 2, strength: tuple[float, ...] = (1.0,)) -> DataFrame:
    """Scores every whole text by a model of the texts of rows where the condition `learn` holds.

    Returns id_col (long), held_out (not learned from), n_tokens, n_known (tokens that training texts
    have), train_tokens, base_score and score. Tokens are words, lower-cased in A to Z and separated
    by 0x20 and 0x09 to 0x0D, and one end. base_score sums log10((c + 1) / (N + V + 1)) over tokens;
    c is a token's count in training texts, N that of all, V how many there are. score is the log10
    probability by n-grams up to `order` (1 to 3), each smoothed by the next shorter one, in the end by
    that of base_score: (c(uw) + s * P(w)) / (c(u) + s) with strength s for each length from two on.
    Probabilities of all known words and of an unknown one sum to 1 in every state.

    Documents are dealt into blocks by a hash of id and text. A block asks for the counts of its
    distinct n-grams, with its own part of them; Spark groups these by n-gram and answers each block
    where others add to its own. So a frequent n-gram costs an entry for each block, and no model is
    held whole anywhere. A worker makes its block's part of the automaton from the answers and
    traverses its texts once, from left to right, carrying the state. N and V come from a pass
    before. Words and n-grams are told by 64-bit hashes.

    Null or empty texts are the end alone. Rows with a null id are scored and not learned from;
    repeated rows count as often as they are there (equal rows share a block). Texts of any length
    are read whole. Without anything to learn from all scores are 0; an empty table gives no rows.
    Other columns of df, whatever their names, aren't used but by `learn`.
    """
    if order not in (1, 2, 3) or len(strength) < order - 1 or any(s <= 0 for s in strength):
        raise ValueError("order is 1, 2 or 3, with a positive strength for each length from two on")
    known = F.coalesce(learn, F.lit(False)) & F.col(id_col).isNotNull()
    docs = df.select(F.col(id_col).cast("long").alias("doc"), known.alias("learn"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    n = partition_count(df, PART_BYTES)

    def words(batches):
        held, size, total = [], 0, 0
        for batch in batches:
            buf, off = text_buffer(batch.column("text"))
            for a, b in slices(off):
                seq, begin = token_keys(buf[off[a] : off[b]], off[a : b + 1] - off[a])
                total += len(seq) - (len(begin) - 1)
                held.append(np.unique(seq[seq != BEGIN]))
                size += len(held[-1])
                if size > MOST_HELD:
                    held = [np.unique(np.concatenate(held))]
                    size = len(held[0])
                    if 2 * size > MOST_HELD:
                        yield _blobs(_send(held[0], held[0][:0], -1, n))
                        held, size = [], 0
        keys = np.unique(np.concatenate(held)) if held else np.zeros(0, _U)
        yield _blobs(_send(keys, keys[:0], -1, n) + [(0, -1, None, _planes(np.array([total])))])

    def count_words(rows: pa.Table) -> pa.Table:
        keys = [unpack_keys(k) for k in rows.column("keys").to_pylist() if k is not None]
        total = sum(int(_numbers(c)[0]) for c, k in zip(rows.column("counts").to_pylist(), rows.column("keys").to_pylist(), strict=True) if k is None)
        return pa.table([pa.array([total], pa.int64()), pa.array([len(np.unique(np.concatenate(keys))) if keys else 0], pa.int64())], names=["n", "v"])

    some = docs.where("learn").select("text").mapInArrow(words, _BLOBS).groupBy("bucket").applyInArrow(count_words, "n long, v long")
    tokens, vocabulary = (x or 0 for x in some.agg(F.sum("n"), F.sum("v")).first())

    def ask(rows: pa.Table) -> pa.Table:
        levels = _block_grams(rows.column("text"), rows.column("learn").to_numpy(), order, False)
        keys, count, _ = summed(*(np.concatenate(x) for x in zip(*(t[:2] for t in levels), strict=True)))
        block = rows.column("block")[0].as_py()
        return pa.Table.from_batches([_blobs(_send(keys, count, block, n))])

    def answer(rows: pa.Table) -> pa.Table:
        blocks = rows.column("block").to_numpy()
        keys = [unpack_keys(k) for k in rows.column("keys").to_pylist()]
        own = np.concatenate([_numbers(c) for c in rows.column("counts").to_pylist()]).astype(np.int64)
        block = np.repeat(np.arange(len(blocks)), [len(k) for k in keys])
        keys = np.concatenate(keys)
        order_ = np.argsort(keys, kind="stable")
        keys, own, block = keys[order_], own[order_], block[order_]
        head = np.r_[True, keys[1:] != keys[:-1]]
        total = np.add.reduceat(own, np.flatnonzero(head))[np.cumsum(head) - 1]
        told = np.flatnonzero(total != own)
        told = told[np.argsort(block[told], kind="stable")]
        cuts = np.searchsorted(block[told], np.arange(len(blocks) + 1)).tolist()
        out = [(0, int(blocks[k]), pack_keys(keys[told[a:b]]), _planes(total[told[a:b]])) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if b > a]
        return pa.Table.from_batches([_blobs(out)])

    def score(key, left: pa.Table, right: pa.Table) -> pa.Table:
        learned = left.column("learn").to_numpy()
        levels = _block_grams(left.column("text"), learned, order, True)
        if right.num_rows:
            keys = np.concatenate([unpack_keys(k) for k in right.column("keys").to_pylist()])
            total = np.concatenate([_numbers(c) for c in right.column("counts").to_pylist()]).astype(np.int64)
            for own, count, *_ in levels:
                if len(own):
                    i = np.minimum(np.searchsorted(own, keys), len(own) - 1)
                    hit = own[i] == keys
                    count[i[hit]] = total[hit]
        model = Automaton(levels, tokens, vocabulary, strength)
        del levels
        found = []
        buf, off = text_buffer(left.column("text"))
        for a, b in slices(off):
            seq, begin = token_keys(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            number = np.searchsorted(model.tokens, seq)
            first, last = begin[:-1] + 1, begin[1:]
            sums = []
            for each in (model.token_known[number].astype(np.int64), model.token_weight[number]):
                each = each.copy()
                each[begin[:-1]] = 0
                sums.append(np.add.reduceat(each, begin[:-1]))
            found.append((last - first, *sums, model.score(seq, begin, number)))
        size, hits, base, whole = (np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0),) * 4
        columns = [left.column("doc"), pa.array(~learned), pa.array(size, pa.int64()), pa.array(hits, pa.int64()), pa.array(np.full(len(size), tokens), pa.int64()), pa.array(base, pa.float64()), pa.array(whole, pa.float64())]
        return pa.table(columns, names=["doc", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    # both passes over the texts read one exchange of them
    parted = docs.withColumn("block", F.pmod(F.xxhash64("doc", "text"), F.lit(n)).cast("int"))
    told = parted.groupBy("block").applyInArrow(ask, _BLOBS).groupBy("bucket").applyInArrow(answer, _BLOBS)
    out = parted.groupBy("block").cogroup(told.groupBy("block")).applyInArrow(score, "doc long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
    return out.withColumnRenamed("doc", id_col)
