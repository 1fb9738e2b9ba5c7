"""Token ids of a text do not depend on where it is cut for encoding."""

import random

import pytest

from stockflow.llm import chat


def prose(seed, n):
    r, out = random.Random(seed), []
    words = ["the", "don't", "we'll", "x1", "2024", "ünï", "漢字", "...", "--", "a_b", "(ok)", "\U0001f600", "<s>", "[INST]", "O'Neil's"]
    while len(out) < n:
        out.append(r.choice(words) + r.choice([" ", " ", " ", "  ", "\n", "\n\n ", "\t", " \u00a0", "\x1c", "", ", "]))
    return "".join(out)


@pytest.mark.parametrize("piece", [1, 2, 3, 7, 50, 997])
def test_pieces_equal_the_whole(monkeypatch, piece):
    t = chat.Template(chat.VOCABULARY)
    texts = [prose(k, 300) for k in range(30)] + ["", " ", "\n", "word", "word ", " a  b ", "x" * 500, "'s 's", "a 's"]
    whole = [t.bpe.encode_ordinary(chat.escape(x)) for x in texts]
    monkeypatch.setattr(chat, "PIECE", piece)
    assert [t.encode(x) for x in texts] == whole


def test_200_000_characters_at_every_offset():
    t = chat.Template(chat.VOCABULARY)
    text = prose(99, 50_000)[:200_000]
    for shift in range(0, 24):
        x = "y" * shift + text
        assert t.encode(x) == t.bpe.encode_ordinary(chat.escape(x))
