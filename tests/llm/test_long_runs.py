"""Long texts without a blank are folded in memory of their own size."""

import tracemalloc

from cadastrum.llm import token_counts
from cadastrum.llm.queries import tokenizer_path


def test_unbroken_text_takes_linear_memory():
    counts = token_counts.unit_counts(tokenizer_path("piece_bpe_32k.model"))
    text = "xyz" * 100_000
    expected = token_counts.count_text(text, counts)
    tracemalloc.start()
    try:
        assert token_counts.count_text(text, counts, 1000) == expected
        assert tracemalloc.get_traced_memory()[1] < 20 * len(text)
    finally:
        tracemalloc.stop()
