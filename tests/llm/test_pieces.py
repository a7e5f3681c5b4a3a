"""Signs after a run of letters are a piece of their own, so a word is learned once whatever follows it."""

import random

import pytest
from tokenizers import Tokenizer

from segmint.llm.tokens import Encoder, tokenizer_path

KINDS = [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")]


@pytest.mark.parametrize("kind, file", KINDS)
def test_a_word_is_learned_once(kind, file):
    enc = Encoder(tokenizer_path(file), kind)
    enc.encode(["word, word. word; é! word:) word"])
    space = " " if kind == "byte" else ""
    assert sorted(enc.index) == sorted({"word", space + "word", space + "é", ",", ".", ";", "!", ":)"})


@pytest.mark.parametrize("kind, file", KINDS)
def test_ids_of_parted_texts(kind, file):
    enc, lib = Encoder(tokenizer_path(file), kind), Tokenizer.from_file(tokenizer_path(file))
    r = random.Random(11)
    texts = ["", "a", ".", " ", "", "a.", ".a", "É×÷é.", "x\xaa.", "ñ.", "a̸>", "İ.", "it's 's.'s", "..", "", "日本.a", "a,\n", "\n\n.", ""]
    texts += ["".join(r.choice("abZ .,'\"(-\n\t\r1é×Éª̸́日") for _ in range(r.randrange(30))) for _ in range(2000)]
    for some in (texts, texts[::-1], [""], ["", ""], [" "], []):
        assert [x.tolist() for x in enc.encode(some)] == [lib.encode(t, add_special_tokens=False).ids for t in some]
