"""Words put together from remembered parts: the library's ids, and few words asked."""

import random
import string
from array import array

from marketloom.llm import token_store
from marketloom.llm.common import tokenizer_file
from marketloom.llm.token_store import WordwiseTokenizer


def test_words_with_marks_are_not_asked_again():
    words = WordwiseTokenizer(tokenizer_file("byte_bpe_50k.json"))
    asked, ask = [], words.ask
    words.ask = lambda texts: asked.extend(texts) or ask(texts)
    words.encode(["a gorvel trintha Prundel"])
    asked.clear()
    text = "a gorvel. gorvel, trintha.\nPrundel gorvel. Prundel, trintha, gorvel.\nPrundel."
    assert words.encode([text])[0] == array("i", words.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert sorted(asked) == [",", ".", ".\n", "Prundel", "a"]


def test_ids_of_odd_texts_are_the_librarys():
    words = WordwiseTokenizer(tokenizer_file("byte_bpe_50k.json"))
    random.seed(3)
    marks = [*"abéßZ'’.,;:!?\n\n\n  09½²ªµα中_-#@[`{~|\t ​́🙂", "'s", "'t", "<|endoftext|>", "...\n", "\n\n", "Étoile"]
    plain = list("abcé.,\n' 1#")
    texts = ["", " ", "a ", "a b"] + ["".join(random.choice(m) for _ in range(random.randint(0, 14)))
                                     for m in (marks, plain) for _ in range(5000)]
    got = [ids for i in range(0, len(texts), 500) for ids in words.encode(texts[i:i + 500])]
    want = [array("i", e.ids).tobytes() for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
    assert got == want and words.encode([]) == []


def test_words_of_letters_are_asked_of_the_model_alone():
    words = WordwiseTokenizer(tokenizer_file("byte_bpe_50k.json"))
    asked, ask = [], words.ask
    words.ask = lambda texts: asked.extend(texts) or ask(texts)
    latin = "".join(chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7))
    random.seed(5)
    plain = ["".join(random.choices(string.ascii_letters + latin, k=random.randint(1, 12))) for _ in range(3000)]
    text = " ".join(["a", *string.ascii_letters, *latin, *plain, "x" * 5000, "ª", "привет", "gorvel.\nÉtoile,", "1st"])
    want = words.tokenizer.encode(text, add_special_tokens=False).ids
    assert words.encode([text]) == [array("i", want).tobytes()]
    assert sorted(asked) == sorted([" ª", " привет", " 1", "st", ".\n", "Étoile", ",", "a"])


def test_words_put_together_are_not_remembered():
    words = WordwiseTokenizer(tokenizer_file("byte_bpe_50k.json"))
    text = "a gorvel gorvel. gorvel, gorvel.\nGorvel gorvel;"
    for _ in range(2):
        assert words.encode([text])[0] == array("i", words.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
    assert sorted(words.pieces.to_pylist()) == [" gorvel", ",", ".", ".\n", ";", "Gorvel"]


def test_forgotten_pieces_are_asked_again(monkeypatch):
    monkeypatch.setattr(token_store, "REMEMBERED", 40)
    words = WordwiseTokenizer(tokenizer_file("byte_bpe_50k.json"))
    random.seed(7)
    names = ["".join(random.choices("abcdeé", k=3)) for _ in range(150)]
    for _ in range(40):
        texts = [" ".join(random.choice(names) + random.choice(["", ".", ",\nAnd"]) for _ in range(20)) for _ in range(2)]
        assert words.encode(texts) == [array("i", e.ids).tobytes()
                                       for e in words.tokenizer.encode_batch(texts, add_special_tokens=False)]
        assert len(words.pieces) == len(words.sizes) == len(words.met) <= 2 * 40 + 41 * 2
    monkeypatch.setattr(token_store, "REMEMBERED_BYTES", 1000)
    words.encode(["a " + "x" * 3000])
    assert words.encode(["a b"]) and words.pieces.nbytes < 3000
