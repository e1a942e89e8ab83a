"""Operators 2 and 3 against the library over whole texts."""
import hashlib
import random

import pytest

from kitlend.llm import bpe, token_counts
from kitlend.llm.encoder import Encoder, encoder
from kitlend.llm.queries import vocabulary

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def lib():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(vocabulary())


def odd_texts():
    rnd = random.Random(5)
    word = lambda: "".join(rnd.choice("abcdeéßÑ漢😀'") for _ in range(rnd.randint(1, 9)))
    prose = " ".join(word() for _ in range(9000))
    passage = " ".join(word() for _ in range(400))
    return [None, "", "   \n\t ", "a", "A<|endoftext|>b <|startoftext|>", "é e ́x", "x\x1cy\x0bz w v",
            "İstanbul ΣΑΣ don't I'LL 12 345", "a" * 40_000, "ab" * 3000 + " " + "é" * 9000, prose, prose, passage,
            word() + passage + word(), "q" + prose + "q", "z" * 700 + passage, "x " * 20_000, "." * 30_000 + " end"]


def expected(lib, text):
    ids = lib.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(" ".join(map(str, ids))), sha(lib.decode(ids, skip_special_tokens=False))


def test_counts_match_library(make_docs, lib):
    texts = odd_texts()
    out = token_counts.token_counts(make_docs(list(enumerate(texts)), clash=True), vocabulary())
    assert out.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    got = {r.doc_id: r for r in out.collect()}
    for i, t in enumerate(texts):
        n = expected(lib, t)[0]
        assert (got[i].n_tokens, got[i].n_bytes, got[i].over_limit) == (n, len((t or "").encode()), n > 2048), i


def test_narrow_overlaps_are_widened(make_docs, lib):
    """Overlaps without white space are cut anew, wider, until they align."""
    texts = [("w" * 500 + " ") * 40, "y" * 5000, "short words here " * 200]
    out = token_counts.token_counts(make_docs(list(enumerate(texts))), vocabulary(), chunk_bytes=128, overlap=32)
    assert {r.doc_id: r.n_tokens for r in out.collect()} == {i: expected(lib, t)[0] for i, t in enumerate(texts)}


def test_round_trip_matches_library(make_docs, lib):
    texts = odd_texts()
    out = bpe.encoded_documents(make_docs(list(enumerate(texts)), clash=True), vocabulary())
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in out.collect()}
    assert got == {i: expected(lib, t) for i, t in enumerate(texts)}


def test_shared_chunks_are_reused(make_docs):
    """Texts around one long passage are joined from its chunks, encoded once."""
    rnd = random.Random(1)
    passage = " ".join("".join(rnd.choice("abcdefg") for _ in range(6)) for _ in range(2000))
    rows = [(i, f"start{i} " + passage + f" end{i}") for i in range(4)]
    assert all(r.n_pieces > 3 for r in bpe.encoded_documents(make_docs(rows), vocabulary()).collect())


def test_joins_inside_words_are_repaired():
    enc: Encoder = encoder(vocabulary())
    rnd = random.Random(3)
    text = " ".join("".join(rnd.choice("abcdeéß") for _ in range(rnd.randint(1, 30))) for _ in range(200)).encode()
    for _ in range(200):
        cuts = sorted({0, len(text), *(c for c in rnd.sample(range(len(text)), 9) if text[c] & 0xC0 != 0x80)})
        pieces = [(a, b, enc.packed(text[a:b])) for a, b in zip(cuts, cuts[1:], strict=False)]
        assert bpe.join_pieces(enc, text, pieces) == enc.packed(text)


def test_empty_and_repeated_rows(make_docs):
    assert token_counts.token_counts(make_docs([]), vocabulary()).collect() == []
    assert bpe.encoded_documents(make_docs([]), vocabulary()).collect() == []
    twice = make_docs([(1, "one two"), (1, "one two"), (None, "x")])
    assert sorted(r.n_tokens for r in token_counts.token_counts(twice, vocabulary()).collect()) == [1, 2, 2]
    assert sorted(r.n_tokens for r in bpe.encoded_documents(twice, vocabulary()).collect()) == [1, 2, 2]
