import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from keysift.llm import bpe

PATH = public_tokenizers.path("byte_bpe_50k.json")
ALPHABET = "abcdeinorst ABE' \n\t\r\x0b\x1c\x85 éüß中文字𝔘😀1234567890½²-=_*#.,!?'́ "


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def own():
    return bpe.Encoder(PATH)


def ids(own, text):
    return np.frombuffer(b"".join(own.ids(text)), "<u4").tolist()


def test_random_texts(own, library):
    draw = random.Random(5)
    for _ in range(2000):
        text = "".join(draw.choices(draw.choice([ALPHABET, "ab", "aA ", "-=", "the an"]), k=draw.choice([0, 1, 3, 8, 30, 200])))
        text += draw.choice(["", "<|endoftext|>", "'s", "'ll  x", "   "]) + draw.choice(["", text])
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("window", [8, 50, 1000])
def test_windows_change_nothing(own, library, window, monkeypatch):
    monkeypatch.setattr(bpe, "WINDOW_CHARS", window)
    draw = random.Random(window)
    for _ in range(150):
        text = "".join(draw.choices(draw.choice([ALPHABET, "abcdefghij", "=-", " "]), k=draw.choice([5, 60, 3000])))
        text += draw.choice("a=é1 ") * draw.randint(0, 2000) + "'ll x"
        assert ids(own, text) == library.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["ab" * 20_000, "=" * 60_000, "aaaaabbb" * 6000, " " * 50_000, "thequickbrownfox" * 3000, "é" * 30_000])
def test_memory_of_the_transducer_is_constant(own, library, text):
    machine, out, held = bpe.Transducer(own.merges), [], 0
    for at in range(0, len(text), 1000):
        out += machine.feed(text[at:at + 1000].encode())
        held = max(held, machine.held())
    out += machine.finish()
    assert out == library.encode(text, add_special_tokens=False).ids
    assert held <= own.merges.lookahead < 1000


def test_decoding_in_pieces(own):
    text = "naïve 😀 中文 <|endoftext|> x" * 30
    for step in (1, 2, 5):
        machine, every, out = bpe.Decoder(own.merges.bytes), ids(own, text), ""
        for at in range(0, len(every), step):
            out += machine.feed(every[at:at + step])
        assert out + machine.finish() == text
    broken = bpe.Decoder(own.merges.bytes)
    assert broken.feed([own.merges.by_bytes[b"\xe4"]]) + broken.finish() == "�"


def test_merges_that_make_one_token_twice_are_refused(tmp_path):
    path = tmp_path / "t.json"
    path.write_text('{"added_tokens": [], "model": {"vocab": {"a": 0, "aa": 1, "aaa": 2}, "merges": [["a", "a"], ["aa", "a"], ["a", "aa"]]}}')
    with pytest.raises(ValueError):
        bpe.Merges(str(path))


def test_documents(spark, library):
    rows = [(1, "Hello  world's"), (2, None), (3, ""), (4, "é" * 200_000), (5, "a<|endoftext|>b"), (5, "a<|endoftext|>b"), (None, "x y")]
    docs = spark.createDataFrame([(i, t, 1, "s") for i, t in rows], "doc_id long, text string, n_tokens int, ids string").repartition(2)
    got = sorted(map(tuple, bpe.round_trip(docs, PATH).collect()), key=str)
    want = []
    for i, t in rows:
        e = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(e), hashlib.sha256(np.array(e, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(library.decode(e, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    back = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert sorted(((r.doc_id, r.text) for r in back), key=str) == sorted(((i, t or "") for i, t in rows), key=str)
    assert bpe.round_trip(docs.limit(0), PATH).count() == 0
