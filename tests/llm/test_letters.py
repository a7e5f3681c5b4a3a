"""Runs of letters go to the tokenizer's model as they stand and get the ids of whole texts."""

import pytest
from tokenizers import Tokenizer

from segmint.llm.tokens import Encoder, tokenizer_path

KINDS = [("byte", "byte_bpe_50k.json"), ("word", "word_bpe_49k.json")]
LETTERS = "".join(c for c in map(chr, range(256)) if c.isalpha() and c not in "ªµº")
TEXTS = [
    "", " ", "Straße ÄÖÜ ÿÝþ naïve CAFÉ", "été né", "İstanbul ǅ ﬁne ſo", "it's we'll O'Neil 's d'accord",
    " ".join(LETTERS), LETTERS, "a" * 3000 + " " + "É" * 500, "x1y2 ½ ª º µ × ÷", "tab\tword\nline \n end ", "word,(tail) «été»",
    "<|endoftext|>letters <|startoftext|>", "\0null\0 é\0", "日本 letters 日本é", "Σίσυφος ΑΣ mixed", "a b c",
]


@pytest.mark.parametrize("kind, file", KINDS)
def test_ids_of_letters_are_those_of_whole_texts(kind, file):
    enc, lib = Encoder(tokenizer_path(file), kind), Tokenizer.from_file(tokenizer_path(file))
    for texts in (TEXTS, [t + "!" for t in TEXTS], [t.upper() for t in TEXTS], TEXTS):
        for t, ids in zip(texts, enc.encode(texts, 2)):
            assert ids.tolist() == [*lib.encode(t, add_special_tokens=False).ids, 2], repr(t)


@pytest.mark.parametrize("kind, file", KINDS)
def test_letters_skip_the_way_of_whole_texts(kind, file):
    enc, seen = Encoder(tokenizer_path(file), kind), []
    lib = enc.lib

    class Seen:
        def __getattr__(self, name):
            def run(pieces, **options):
                seen.extend(pieces)
                return getattr(lib, name)(pieces, **options)
            return run

    enc.lib = Seen()
    enc.encode(["plain words and Straße, then 1234 x9"], 2)
    assert seen and not [p for p in seen if p.strip().isalpha()]
