"""What a worker holds while it encodes and decodes: the texts' own size counts, not a multiple for places and strings."""

from __future__ import annotations

import tracemalloc

import numpy as np
import pytest

from docloom.llm import pieces


@pytest.fixture(scope="module")
def encoder() -> pieces.Encoder:
    return pieces.Encoder(pieces.load())


def _peak(f):
    tracemalloc.start()
    out = f()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    return out, peak


def test_decoding_takes_few_bytes_a_byte(encoder):
    text = "international documentation " * 80_000
    ids, offsets, _ = encoder.encode([text, "", "née", text[:500]])
    assert len(ids) > 2 * pieces.BLOCK
    back, peak = _peak(lambda: encoder.decoder.texts(ids, offsets))
    assert back == [text, "", "née", text[:500]]
    assert peak < 15 * len(text), peak / len(text)


def test_a_batch_holds_the_words_of_one_text(encoder):
    texts = [" ".join(f"a{(k * 7 + i) % 50} bc" for i in range(500)) for k in range(200)]
    encoder.encode(texts[:50])
    bounds = [len(encoder.words(t)) for t in texts]
    (ids, offsets, best), peak = _peak(lambda: encoder.encode(texts))
    assert encoder.decoder.texts(ids, offsets) == texts
    assert peak < 110 * sum(bounds), peak / sum(bounds)


def test_the_table_of_steps_has_rows_for_what_goes_on_only(encoder):
    forward = encoder.forward
    assert forward.step.nbytes < 24 << 20
    assert forward.step[1:].any(1).all() and not forward.step[0].any()


def test_new_words_keep_their_numbers_whatever_their_size():
    encoder = pieces.Encoder(pieces.load())
    words = ["longer words first", "b", "née 日本語 x", "a" * 200, "b a b", "zz " * 3]
    both = [encoder.nbest_ids(w) for w in words]
    again = pieces.Encoder(encoder.v)
    ids, offsets, best = again.encode(words)
    for k, w in enumerate(words):
        assert [(s, x.tolist()) for s, x in best[k]] == both[k]
        assert np.array_equal(ids[offsets[k] : offsets[k + 1]], both[k][0][1])
    assert again.decoder.texts(ids, offsets) == words
