"""The index of the examples is built in bounded memory."""
import random
import tracemalloc

from logsift.llm import toxicity as T


def test_whole_index_holds_arrays_not_dictionaries():
    rng = random.Random(4)
    vocab = [f"word{i}" for i in range(2000)]
    texts = [" ".join(rng.sample(vocab, 300)) for _ in range(400)]
    tracemalloc.start()
    index = T.WholeIndex(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert len(index.vectors) == 400
    assert peak < 80 * 400 * 300        # bytes a word of a text
