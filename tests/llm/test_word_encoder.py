"""What the third review found of op5: CPU seconds of its word encoder."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from tessera.llm.tokens import WordEncoder, vocabulary


@pytest.fixture(scope="module")
def path():
    pytest.importorskip("tokenizers")
    return vocabulary("word_bpe_49k.json")


class Counted:
    """A tokenizer that keeps what it is asked for."""

    def __init__(self, inner):
        self.inner, self.asked = inner, []

    def encode_batch_fast(self, some, **options):
        self.asked += some
        return self.inner.encode_batch_fast(some, **options)


def test_latin_words_skip_the_normalizer(path):
    encoder = WordEncoder(path)
    encoder.tokenizer = Counted(encoder.tokenizer)
    encoder(pa.array(["Équipe naïve, ÀÉÎ it's 12x don't. Ænima", "straße ÿ Ÿ"]))
    assert encoder.tokenizer.asked == []
    encoder(pa.array(["слово"]))
    assert len(encoder.tokenizer.asked) == 1


def test_ids_are_those_of_the_tokenizer(path):
    """Letters whose lower case has another length, white space that isn't ASCII, letters that compose, and the mark itself."""
    encoder, rng = WordEncoder(path), random.Random(5)
    odd = "abcdeèÉßİıǅǆȺɐΣσς \u0085\u001c Åẛﬁ가가éЖя中１²½'.,%#_-0123456789\x01é \n\t"
    texts = ["".join(rng.choice(odd) for _ in range(rng.randrange(60))) for _ in range(3000)]
    texts += [w + "'s don't, I'LL. x." for w in ("Été", "NAÏVE", "İstanbul", "ΣΑΣ")]
    plain = ["".join(rng.choice("abCdÈéßİǅȺ \u0085'.,%12 ") for _ in range(rng.randrange(60))) for _ in range(3000)]
    for some in (texts, plain):
        ids, sizes = encoder(pa.array(some, pa.string()))
        want = [e.ids for e in encoder.tokenizer.encode_batch(some, add_special_tokens=False)]
        got = [x.tolist() for x in np.split(ids, np.cumsum(sizes)[:-1])]
        assert got == want
