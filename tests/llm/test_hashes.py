"""Hashes of words against words made to collide in polynomial hashes modulo a power of two."""

import numpy as np
import pyarrow as pa
import pytest

from folium.llm.common import span_hashes, text_buffer, word_spans
from folium.llm.minhash_dedup import near_documents
from folium.llm.substring_dedup import dedup_substrings

SCHEMA = "doc_id long, text string"


def twisted(n: int, swap: bool) -> str:
    """The first n letters of the sequence of bit-count parities, or of its complement."""
    return "".join("ab"[(bin(i).count("1") + swap) % 2] for i in range(n))


@pytest.mark.parametrize("size", [64, 1024, 2048, 4096])
@pytest.mark.parametrize("which", [0, 1])
def test_no_collision_of_twisted_words(size, which):
    buf, off = text_buffer(pa.array([twisted(size, False), twisted(size, True)]))
    starts, ends, _ = word_spans(buf, off)
    a, b = span_hashes(buf, starts, ends, which)
    assert a != b


def test_hashes_follow_content_alone():
    rng = np.random.default_rng(3)
    words = ["".join(rng.choice(list("abcdefgh"), n)) for n in rng.integers(1, 90, 3000)]
    want: dict[str, int] = {}
    for lead in ("", "x ", "some words before "):
        buf, off = text_buffer(pa.array([lead + " ".join(words)]))
        starts, ends, _ = word_spans(buf, off)
        got = span_hashes(buf, starts, ends).tolist()[len(lead.split()) :]
        for w, h in zip(words, got, strict=True):
            assert want.setdefault(w, h) == h
    assert len(set(want.values())) == len(want)
    buf, off = text_buffer(pa.array([" ".join(words)]))
    starts, ends, _ = word_spans(buf, off)
    assert (span_hashes(buf, starts, ends, 0) != span_hashes(buf, starts, ends, 1)).all()


def test_zero_bytes_and_length_count():
    texts = ["a", "a\0", "a\0\0", "\0a", "", "aaaaaaaa", "aaaaaaaa\0", "aaaaaaa"]
    buf, off = text_buffer(pa.array(texts))
    h = span_hashes(buf, off[:-1], off[1:])
    assert len(set(h.tolist())) == len(texts)


def test_substring_dedup_keeps_words_of_another_passage(spark):
    before, after = [f"p{i}" for i in range(20)], [f"q{i}" for i in range(20)]
    texts = [" ".join([*before, twisted(2048, swap), *after]) for swap in (False, True)]
    got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(list(enumerate(texts, 1)), SCHEMA)).collect()}
    assert got[1].n_removed == 0
    assert got[2].n_removed == 40 and got[2].kept_text == twisted(2048, True)


def test_substring_dedup_of_twisted_word_sequences(spark):
    # whole words arranged so that sums of their powers cancel out
    swap = {"a": "lorem", "b": "ipsum"}
    texts = [" ".join(swap[c] for c in twisted(4096, s)) for s in (False, True)]
    rows = list(enumerate(texts, 1))
    got = {r.doc_id: r for r in dedup_substrings(spark.createDataFrame(rows, SCHEMA)).collect()}
    first = {tuple(texts[0].split()[i : i + 13]) for i in range(4096 - 12)}
    words, gone = texts[1].split(), set()
    for i in range(4096 - 12):
        if tuple(words[i : i + 13]) in first:
            gone |= set(range(i, i + 13))
    assert got[1].n_removed == 0 and got[2].n_removed == len(gone)


def test_near_documents_tell_twisted_words_apart(spark):
    rows = [(k, twisted(size, bool(swap))) for k, (size, swap) in enumerate([(1024, 0), (1024, 1), (2048, 0), (2048, 1), (2048, 0)])]
    got = {r.doc_id: r.component_id for r in near_documents(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {0: 0, 1: 1, 2: 2, 3: 3, 4: 2}


def test_encoder_compares_bytes(monkeypatch):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    from folium.llm import tokens

    path = public.path("byte_bpe_50k.json")
    tool = Tokenizer.from_file(path)
    texts = [twisted(2048, False), twisted(2048, True), "some plain words", "Some plain words, other words", ""]
    want = [tool.encode(t, add_special_tokens=False).ids for t in texts]

    def ids(own):
        got, off, _, _ = own.encode(texts)
        return [got[a:b].tolist() for a, b in zip(off[:-1], off[1:], strict=True)]

    assert ids(tokens.Encoder(path)) == want
    # even if hashes do collide
    monkeypatch.setattr(tokens, "span_hashes", lambda buf, s, e: (e - s).astype(np.uint64))
    own = tokens.Encoder(path)
    assert ids(own) == want and ids(own) == want
