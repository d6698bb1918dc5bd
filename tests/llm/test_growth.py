"""What a worker keeps between batches."""

import public_tokenizers
from marginalia.llm import packing as P


def test_words_of_a_batch_are_kept(monkeypatch):
    path = public_tokenizers.path("word_bpe_49k.json")
    letters = "abcdefghijklmnopqrst"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters][:150_000]
    asked, learn = [], P._learn
    monkeypatch.setattr(P, "_learn", lambda new, path: asked.append(len(new)) or learn(new, path))
    P._loaded.clear()
    first, again = [list(P._ids([" ".join(words)], path)) for _ in range(2)]
    assert first == again and asked == [len(words), 0]
