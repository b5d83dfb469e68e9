"""The encoder's known pieces stay bounded, and forgetting some changes no id."""

import random

import numpy as np

from plumbtrace.llm import token_frames
from plumbtrace.llm.queries import tokenizer_path


def test_frequent_pieces_outlive_a_turn_and_ids_stay():
    encoder, rng = token_frames.PieceEncoder(tokenizer_path(), cache=40), random.Random(6)
    plain = token_frames._tokenizer(tokenizer_path())
    for n in range(30):
        texts = [" ".join(["the", "often,", f"w{rng.randrange(10 ** 6)}", f"rare{n}"]) for _ in range(5)]
        got = encoder(texts)
        assert got == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
        assert "often," in encoder.later and len(encoder.later) + len(encoder.later.older) <= 40 + 2 * 5 * 4
        assert not set(encoder.later) & set(encoder.later.older)
    assert encoder.later.older and len(encoder.later) <= 40


def test_lines_are_cut_and_only_their_words_are_kept():
    encoder, rng = token_frames.PieceEncoder(tokenizer_path()), random.Random(9)
    plain = token_frames._tokenizer(tokenizer_path())
    bits = ["a", "Word.", "so,", "\n", "\n", " ", "\t", "\r", "Ñes", "'s", "<|endoftext|>", "\u00a0", "\x1c", "1", "\u0301", ".%%%", "_", "½"]
    texts = ["one end.\nNext line,\nand last", "x\n", "\ny", "a \nb", "a\n b", "a\n\nb", "a\n\tb"]
    texts += ["".join(rng.choices(bits, k=rng.randrange(1, 12))) for _ in range(3000)]
    assert encoder(texts) == [np.array(plain.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert "end." in encoder.later and {"Next", "and"} <= set(encoder.first)
    assert "end.\nNext" not in encoder.later and "line,\nand" not in encoder.later
