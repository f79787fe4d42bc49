"""Long texts go to the tokenizer library in parts."""

from array import array

import pytest
from tallyloom.llm import packing

TEXTS = ["two  spaces, and \n\n lines\n 's it's  ", "漢字と、カナ。です！ 終わり？", "<|endoftext|> x<|endoftext|>\t\r\n y  ", "don't　do  it  \x1c é é 7  8\n", "a" + " \n" * 40 + "b" + "\t" * 30, "  lead\n\nand trail \n"]


@pytest.mark.parametrize("most", [1, 2, 3, 7, 50])
def test_parts_have_the_ids_of_the_whole(most):
    enc = packing.Encoder(*packing.byte_bpe())
    for text in (*(t * 9 for t in TEXTS), "".join(TEXTS) * 3):
        parts = list(packing.parted(text, most))
        ids = lambda t: enc.full.encode(t, add_special_tokens=False).ids
        assert "".join(parts) == text and [x for p in parts for x in ids(p)] == ids(text)


def test_the_library_never_gets_a_long_text_at_once():
    enc = packing.Encoder(*packing.byte_bpe())
    seen, full = [], enc.full

    class Watched:
        def encode(self, text, **options):
            seen.append(len(text))
            return full.encode(text, **options)

    enc.full = Watched()
    text = "two  spaces and a line\n here " * 20_000
    got = enc.encode(text)
    assert max(seen) < 60_000 and got == array("H", full.encode(text, add_special_tokens=False).ids).tobytes()
