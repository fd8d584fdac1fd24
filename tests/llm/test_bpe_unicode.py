"""Every code point and random strings of rare ones must encode and decode as in the library."""

import random

import pytest

from erlink.llm import bpe


@pytest.fixture(scope="module")
def both():
    tokenizers = pytest.importorskip("tokenizers")
    path = bpe.tokenizer_path()
    return tokenizers.Tokenizer.from_file(path), bpe.codec(path)


def _points():
    """All code points; of the planes without assigned ones every 97th."""
    return [x for x in range(0x110000) if not 0xD800 <= x < 0xE000 and (x < 0x40000 or 0xE0000 <= x < 0xE0200 or x % 97 == 0)]


def test_every_code_point(both):
    library, own = both
    points = _points()
    texts = [" ".join(f"a{chr(x)}1" for x in points[k : k + 60]) for k in range(0, len(points), 60)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    got = [[int(i) for p in parts for i in p[1].split(" ")] for parts in own.encode_batch(texts)]
    assert [texts[k] for k in range(len(texts)) if got[k] != want[k]] == []


def test_random_strings(both):
    library, own = both
    rng, points = random.Random(3), _points()
    pieces = ["'s", "'re", "'LL", " ", "\t", "‍", "́", "é", "A", "1", "<|startoftext|>", "<|endoftext|>", "<|", "　", "ſ", "K", "İ", "ǅ", "Σ", "᫄", "഻", "̴", "Ɤ"]
    kinds = [
        lambda: chr(rng.choice(points)),
        lambda: chr(rng.choice([rng.randrange(0x20, 0x250), rng.randrange(0x300, 0x370), rng.randrange(0x370, 0x2000)])),
        lambda: chr(rng.choice([rng.randrange(0x20, 0x7F), rng.randrange(0x1100, 0x1200), rng.randrange(0xA000, 0xD800), 0x345])),
        lambda: rng.choice(pieces),
    ]
    for k in range(10_000):
        text = "".join(kinds[k % 4]() for _ in range(rng.randint(1, 30)))
        want = library.encode(text, add_special_tokens=False).ids
        assert own.encode(text) == want, ascii(text)
        assert own.decode(want) == library.decode(want, skip_special_tokens=False)
