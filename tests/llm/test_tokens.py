import random

import numpy as np

from quillspark.llm import tokens
from quillspark.llm.catalog import tokenizer_path

PARTS = [" ", "  ", "\n", "\t", "a", "Zoë", "don't", "12", "!!", " ", "\x1c", "\x85", "Ġ", "Ġa", "<|endoftext|>", "日本", "🙂", "\r\n", "...", "\x00"]


def test_new_pieces_are_encoded_many_at_a_time(monkeypatch):
    """Ids as of whole texts, also while the memory of pieces turns over, from few calls of the library."""
    with open(tokenizer_path("byte_bpe_50k.json"), encoding="utf-8") as f:
        encoder = tokens.Encoder(f.read())
    plain = lambda texts: [np.array(encoder.tokenizer.encode(t, add_special_tokens=False).ids, encoder.kind).tobytes() for t in texts]
    rng = random.Random(2)
    calls, arrays = [], encoder._arrays
    monkeypatch.setattr(encoder, "_arrays", lambda texts: calls.append(len(texts)) or arrays(texts))
    words = [" ".join(f"{rng.randrange(10**9):x}.\nYe{rng.randrange(10**6)}" for _ in range(50)) for _ in range(100)]
    assert encoder.encode(words) == plain(words)
    assert len(calls) <= 5 and sum(calls) < 200
    monkeypatch.setattr(tokens, "CACHE", 7)
    monkeypatch.setattr(tokens, "JOINED", 5)
    odd = ["".join(rng.choice(PARTS + [" "] * 8) for _ in range(rng.randrange(30))) for _ in range(600)]
    for texts in (odd, ["", " "], [], odd[:50], words[:20]):
        assert encoder.encode(texts) == plain(texts)
    assert len(encoder.known) <= 7 and len(encoder.older) <= 7
