"""Token files: exact round trip, seeking, checksums, and words as the tokenizer gives them."""

import io
import zlib

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

pytest.importorskip("corpus_pipeline")
tokenizers = pytest.importorskip("public_tokenizers")
from reviewloom.llm import token_output as O  # noqa: E402

PATH = tokenizers.path("byte_bpe_50k.json")
LIBRARY = Tokenizer.from_file(PATH)  # as it is, with no setting changed


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|endoftext|>", "x <|endoftext|> y <|endoftext|>", "<|endoftext|", "日本<|endoftext|>"])
def test_added_tokens_as_the_library_does_it(text):
    assert np.frombuffer(O.encoder(PATH).ids(text), dtype="<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=80) | st.text(alphabet="aB'st 12½ªéǅ\t\n\r\x0b\x1c .!_<|>", max_size=40))
def test_ids_are_the_tokenizers(text):
    assert np.frombuffer(O.encoder(PATH).ids(text), dtype="<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids


def written(documents):
    out = io.BytesIO()
    writer = O.TokenWriter(out)
    for key, ids in documents:
        writer.add(key, np.array(ids, dtype="<u4").tobytes())
    writer.close()
    return out.getvalue()


def test_round_trip_and_seeking(monkeypatch):
    monkeypatch.setattr(O, "FRAME_IDS", 5)
    documents = [(None, [0]), (1, [7, 8, 0]), (2, [0]), (2, list(range(20)) + [0]), (9, [5, 0])]
    data = written(documents)
    reader = O.TokenFile(io.BytesIO(data))
    assert [(k, ids.tolist()) for k, _, ids in reader.read()] == documents
    assert [first for _, first, _ in reader.read()] == [0, 1, 4, 5, 26]
    assert [(k, ids.tolist()) for k, _, ids in reader.read([4, 1])] == [documents[4], documents[1]]
    # Any decoder reads the ids of the whole file.
    whole = zstandard.ZstdDecompressor().stream_reader(io.BytesIO(data), read_across_frames=True).read()
    assert np.frombuffer(whole, dtype="<u4").tolist() == [i for _, ids in documents for i in ids]


def test_damage_is_found_in_its_frame_only(monkeypatch):
    monkeypatch.setattr(O, "FRAME_IDS", 1)
    data = bytearray(written([(1, [3] * 50), (2, [4, 5])]))
    first = int(O.TokenFile(io.BytesIO(bytes(data))).seek["packed"][0])
    data[first - 3] ^= 0xFF
    reader = O.TokenFile(io.BytesIO(bytes(data)))
    assert list(reader.read([1]))[0][2].tolist() == [4, 5]
    with pytest.raises((ValueError, zstandard.ZstdError)):
        list(reader.read([0]))


def test_query(spark, sf_dir):
    rows = {r["doc_id"]: r for r in O.op8_token_output(spark, sf_dir).collect()}
    encode, start = O.encoder(PATH), 0
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect():
        ids = np.array([*encode.whole(r["text"] or ""), 0], dtype="<u4")
        got = rows[r["doc_id"]]
        assert (got["start"], got["n_tokens"], got["ids_crc32"]) == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_remembered_words_are_bounded_and_words_in_use_stay(monkeypatch):
    monkeypatch.setattr(O, "CACHE_WORDS", 50)
    encode, seen = O.Encoder(PATH), []
    plain = encode.word
    monkeypatch.setattr(encode, "word", lambda w: seen.append(w) or plain(w))
    for i in range(300):
        text = f"often q{chr(97 + i % 26)}z{chr(97 + i // 26)}"
        assert np.frombuffer(encode.ids(text), dtype="<u4").tolist() == LIBRARY.encode(text, add_special_tokens=False).ids
        assert len(encode.known) + len(encode.older) <= 100
    assert seen.count("often") == 1


def test_reports_are_one_table_file(spark, tmp_path):
    docs = spark.range(0, 400, 1, 4).selectExpr("id AS doc_id", "concat('some words ', id) AS text")
    files = O.write_files(docs, f"file://{tmp_path}/ids", PATH)
    assert files.count() > 1 and len(files.inputFiles()) == 1
    assert files.agg({"documents": "sum"}).first()[0] == 400
