import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from steadyhum.llm.encoding import SETTLED, default_path, encoder

FILES = ("byte_bpe_50k.json", "word_bpe_49k.json")


def same(name: str, text: str) -> None:
    e = encoder(default_path(name))
    assert e.encode(text).tolist() == e.library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("name", FILES)
def test_every_settled_character_beside_letters_digits_and_blanks(name):
    for a, b in SETTLED:
        for low in range(a, b + 1, 500):
            chars = [chr(c) for c in range(low, min(low + 500, b + 1))]
            same(name, "".join(f"x{c}Y{c}1 {c}{c}\n" for c in chars))


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=150, deadline=None)
@given(text=st.text(max_size=300))
def test_any_text(name, text):
    same(name, text)


@pytest.mark.parametrize("name", FILES)
@pytest.mark.parametrize(
    "text",
    ["", " ", "\n\n x  ", "a<|endoftext|>b", "<|endoftext|><|startoftext|>", "It's we'LL 'tis!'s", "a\x00b\x01c", "ΣΑΣ Σ",
     "İstanbul", "q" * 30000, " " * 30000 + "x", "!?" * 20000, "日本語のテキスト", "é", "가"],
)
def test_odd_texts(name, text):
    same(name, text)
