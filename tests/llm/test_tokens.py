"""Token counts against the library on whole texts."""

import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from plumbline.llm import tokens

from . import brute

FILE = "byte_bpe_50k.json"


@pytest.fixture(scope="module")
def whole():
    tok = Tokenizer.from_file(public_tokenizers.path(FILE))
    return lambda text: len(tok.encode(text or "", add_special_tokens=False).ids)


def odd_texts(seed):
    tok = Tokenizer.from_file(public_tokenizers.path(FILE))
    special = [t.content for t in tok.get_added_tokens_decoder().values()] or ["<|endoftext|>"]
    rng = random.Random(seed)
    bits = [" ", "  ", "\n", "\n\n", "\t", " \n ", "\u00a0", "\u3000", "'s", "'", "don't", "1234567", "é", "日本", "😀", "!!!", " word", "Word", "x" * 60, "\x0b", "\r\n", *special, special[0][:-1]]
    return ["".join(rng.choices(bits, k=rng.randint(0, 400))) for _ in range(150)]


def test_pieces(whole):
    c = tokens.Counter(public_tokenizers.path(FILE))
    assert c.independent
    texts = odd_texts(1)
    assert c.count(texts)[0] == [whole(t) for t in texts]


def test_splices(whole):
    c = tokens.Counter(public_tokenizers.path(FILE), chunk=300, overlap=40)
    texts = [t for t in odd_texts(2) if t] + ["a" * 5000, " " * 3000, "1" * 4000, "x y" * 2000, "\n" * 2500, "日" * 3000]
    n, chunks = c.count(texts)
    assert n == [whole(t) for t in texts]
    assert c.widened > 0 and sum(k > 1 for k in chunks) > 100


def test_work_without_stable_places_is_bounded(whole):
    """A run of one letter has no place to splice at; what is encoded grows with its length, not with the square."""
    c = tokens.Counter(public_tokenizers.path(FILE), chunk=200, overlap=40)
    encoded = []
    inner = c._encode
    c._encode = lambda text: (encoded.append(len(text)), inner(text))[1]
    for size in (10_000, 40_000):
        encoded.clear()
        assert c.count(["a" * size])[0] == [whole("a" * size)]
        assert sum(encoded) < 20 * size


def test_huge_document(whole):
    rng = random.Random(3)
    text = " ".join("".join(rng.choices("abcdefgh é1.,", k=rng.randint(1, 12))) for _ in range(60_000))
    assert tokens.Counter(public_tokenizers.path(FILE)).count([text])[0] == [whole(text)]


def test_documents(documents, cluttered, empty, whole):
    rows = [*enumerate(brute.passages(6)), (None, "a b"), (3, None), (1, "")]
    got = tokens.token_counts(cluttered(documents(rows)), FILE, limit=50).collect()
    key = lambda r: (r[0] is None, r[0] or 0, *r[1:])
    want = [(i, len((t or "").encode()), n, n > 50) for i, t in rows for n in [whole(t)]]
    assert sorted((tuple(r)[:4] for r in got), key=key) == sorted(want, key=key)
    assert tokens.token_counts(empty, FILE).collect() == []
