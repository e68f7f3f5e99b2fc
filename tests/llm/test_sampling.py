"""Tables of the beginnings of pieces."""

import numpy as np
import pytest

pytest.importorskip("public_tokenizers")

from millrace.llm import piece_sampling as P  # noqa: E402
from millrace.llm.queries import tokenizer_file  # noqa: E402


def test_beginnings_are_found_as_by_bisection():
    model = P.piece_model(tokenizer_file("piece_bpe_32k.model"), 1.0)
    rng = np.random.default_rng(1)
    for size in range(1, model.longest + 1):
        keys = model.tables[size][0]
        h = np.concatenate((keys, keys - np.uint64(1), keys + np.uint64(1), rng.integers(0, 2**64, 5000, np.uint64), np.array([0, 2**64 - 1], np.uint64)))
        want = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
        assert (model.find(size, h) == want).all()
    assert P.Lattices(model, []).begin.tolist() == [0]
