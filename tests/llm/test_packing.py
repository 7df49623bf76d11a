import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from reelrank.llm import packing as P
from reelrank.llm.queries import pack_vocabulary

PATH = pack_vocabulary()


@pytest.fixture(scope="module")
def plain():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: np.asarray(t.encode(text, add_special_tokens=False).ids, np.uint32)


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet="abzAZéÉßÑñŁœŸΣσςİıſĳ 中́\x1c\x85 \t\n'strevldm0199%-–’“…€²ªµ<|endoftext|>", max_size=40))
def test_ids_equal_the_tokenizer(text):
    assert (np.frombuffer(P.tokenizer(PATH).encode(text), np.uint32) == _plain()(text)).all()


@pytest.mark.parametrize("text", ["hello <|endoftext|> world", "<|startoftext|>a<|endoftext|>", "a <|ENDOFTEXT|> b", "x<|endoftext|", "don't <|endoftext|> É %%"])
def test_strings_of_added_tokens_are_those_tokens(text):
    assert (np.frombuffer(P.tokenizer(PATH).encode(text), np.uint32) == _plain()(text)).all()


def test_a_full_cache_changes_no_ids(monkeypatch):
    monkeypatch.setattr(P, "CACHE_WORDS", 20)
    t = P.WordTokenizer(PATH)
    texts = [f"w{i} word{i} other {i}" for i in range(60)] + ["", "é中 whole"]
    assert t.encode_all(texts) == t.encode_all(texts) == [_plain()(x).tobytes() for x in texts]


def _plain(cache={}):
    if not cache:
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(PATH)
        cache["f"] = lambda text: np.asarray(t.encode(text, add_special_tokens=False).ids, np.uint32)
    return cache["f"]


def test_cuts_and_bins():
    r = np.random.default_rng(3)
    for n in [*range(1, 2100, 7), 2047, 2048, 2049, 9000]:
        cut = P.cut_lengths(n)
        assert sum(cut) == n and 0 < min(cut) and max(cut) <= 2048
    length = np.array([x for n in r.integers(1, 6000, 3000) for x in P.cut_lengths(int(n))])
    where, offset = P.harmonic_bins(length)
    assert sorted(set(where)) == list(range(where.max() + 1))
    for b in range(where.max() + 1):
        at = np.flatnonzero(where == b)
        at = at[np.argsort(offset[at])]
        assert (offset[at] == np.cumsum(length[at]) - length[at]).all() and length[at].sum() <= 2048
    fill = np.bincount(where, length)
    assert 1 - fill.sum() / (len(fill) * 2048) < 0.02


def check(rows, texts, plain):
    by, seq = {}, {}
    for r in rows:
        by.setdefault(r.doc_id, []).append(r)
        seq.setdefault(r.sequence_id, []).append(r)
    for i, copies in texts.items():
        for t in set(copies):
            ids = np.append(plain(t or ""), np.uint32(1)).astype("<u4")
            own = [r for r in by[i] if r.doc_tokens == len(ids)]
            covered = np.zeros(len(ids), int)
            for r in own:
                assert zlib.crc32(ids[r.start: r.start + r.length].tobytes()) == r.ids_crc32
                covered[r.start: r.start + r.length] += 1
            assert (covered == copies.count(t)).all()
    for pieces in seq.values():
        pieces.sort(key=lambda r: r.offset)
        at = 0
        for r in pieces:
            assert r.offset == at
            at += r.length
        assert at <= 2048


def test_round_trip_and_edge_rows(edge_docs, no_docs, edge_rows, plain):
    rows = P.pack_documents(edge_docs, PATH).collect()
    texts = {}
    for i, t in edge_rows:
        texts.setdefault(i, []).append(t)
    check(rows, {k: v for k, v in texts.items() if k is not None}, plain)
    assert P.pack_documents(no_docs, PATH).count() == 0


def test_sequences_give_the_ids_back(sample, plain):
    packed = P.pack_documents(sample, PATH, with_ids=True).cache()
    seq = {r.sequence_id: r for r in P.sequences(packed).collect()}
    for r in packed.collect():
        whole = np.frombuffer(bytes(seq[r.sequence_id].ids), np.uint32)
        assert (whole[r.offset: r.offset + r.length] == np.frombuffer(bytes(r.ids), np.uint32)).all()
