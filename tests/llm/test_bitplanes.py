import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from keysift.llm import bitplanes as B
from keysift.llm import word_ids
from keysift.llm.word_ids import WordEncoder, word_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")


@settings(max_examples=50, deadline=None)
@given(st.lists(st.integers(0, 65535), max_size=300), st.booleans(), st.sampled_from(["<u2", "<u4"]))
def test_planes_round_trip(ids, bits, kind):
    ids = np.array(ids, kind)
    planes = B.to_planes(ids, bits)
    assert len(planes) == ids.dtype.itemsize * (8 if bits else 1)
    assert np.array_equal(B.from_planes(planes, len(ids), ids.dtype.itemsize, bits), ids)


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


TEXTS = ["Hello World", "don't  STOP\nnow", "ÀÉß Größe, x9.", "", "a<|endoftext|>b", "İstanbul ΣΑΣ 中文 ﬁ x́", "'s'RE \x01\x7f",
         "w" * 5000, "12345", "\x85a b", '"quoted", (é)']


def test_words_equal_whole_texts(library):
    encoder = WordEncoder(PATH)
    assert encoder._cuts_plain
    for _ in range(2):
        got = encoder.ids([t.encode() for t in TEXTS])
        assert [np.frombuffer(g, "<u2").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in TEXTS]


@settings(max_examples=200, deadline=None)
@given(st.text(st.sampled_from("aZ\u00e9\u00c0\u00d7\u00df's'tTre9. \t\n\r\x0b\x0c\x1c\x85\xa0\u2019\u0130\u4e2d\u0301-<|>"), max_size=40))
def test_any_text_equals_the_library(library, text):
    assert np.frombuffer(word_encoder(PATH).ids([text.encode()])[0], "<u2").tolist() == library.encode(text, add_special_tokens=False).ids


def test_pieces_are_asked_for_once(library):
    encoder, asked = WordEncoder(PATH), []

    class Model:
        def tokenize(self, piece):
            asked.append(piece)
            return library.model.tokenize(piece)

    encoder._model = Model()
    texts = ["Hello hello, HELLO. (hello)", "hello.hello 'hello' é", "hello\u2019 hello, Hello"]
    got = encoder.ids([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u2").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert asked.count("hello") == 1 and len(asked) == len(set(asked))


def test_dictionaries_are_bounded(library, monkeypatch):
    monkeypatch.setattr(word_ids, "KEPT", 6)
    encoder, texts = WordEncoder(PATH), [f"w{chr(97 + k)} mine \u2019{k} {'x' * 60}{chr(97 + k)} e" for k in range(20)]
    for _ in range(2):
        for t in texts:
            assert np.frombuffer(encoder.ids([t.encode()])[0], "<u2").tolist() == library.encode(t, add_special_tokens=False).ids
            assert len(encoder._pieces) <= 12 and len(encoder._words) <= 12
    assert all(len(w) <= word_ids.KEPT_BYTES for kept in (encoder._pieces, encoder._words) for w in kept)


def written(spark, rows, bits):
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, start int, shard int").repartition(3)
    manifest = B.write_shards(docs, lambda: (word_encoder(PATH).ids, 2), end_id=1, bits=bits)
    return manifest, [tuple(r) for r in B.read_shards(spark, manifest).orderBy("start").collect()]


@pytest.mark.parametrize("bits", [False, True])
def test_files(spark, library, bits, monkeypatch):
    rows = [(100 - i, t) for i, t in enumerate(TEXTS)] + [(500, None), (7, "long " * 60_000), (7, "again")]
    manifest, got = written(spark, rows, bits)
    want, start = [], 0
    for i, t in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(library.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert got == want
    assert manifest.agg({"n_tokens": "sum"}).first()[0] == start
    reader = B.ShardReader(manifest.orderBy("n_tokens", ascending=False).first().uri)
    assert reader.block(len(reader.blocks) - 1).size == reader.blocks[-1][1]  # any block without the others


def test_nothing_and_no_id(spark):
    assert written(spark, [], False)[1] == []
    assert [r[0] for r in written(spark, [(3, "a"), (None, "b")], False)[1]] == [None, 3]


def test_other_files_are_refused(tmp_path):
    (tmp_path / "x").write_bytes(b"KSPL" + b"\0" * 40)
    with pytest.raises(ValueError):
        B.ShardReader(f"file://{tmp_path}/x")
