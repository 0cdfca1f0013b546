import hashlib
import zlib

import numpy as np
import odd
import public_tokenizers
import pytest
import sentencepiece
from llm_helpers import SF, docs, local  # noqa: F401
from hypothesis import given, settings, strategies as st
from tokenizers import Tokenizer

from flipside.llm import pieces_codec, queries, records, token_counts
from flipside.llm.token_memo import TokenMemo

PIECES, BYTES = public_tokenizers.path("piece_bpe_32k.model"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY, TOKENIZER = sentencepiece.SentencePieceProcessor(model_file=PIECES), Tokenizer.from_file(BYTES)
ENCODER, MEMO = pieces_codec.Encoder(PIECES, 1000, check=False), TokenMemo(BYTES, 1000)
TEXT = st.lists(st.sampled_from(list("ab  \n\t\x85 　\x1c.,'s▁é漢🙂1<|") + ["<|endoftext|>", " don't", "  "]), max_size=60).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=40)))
def test_pieces_match_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    ((raw,), (said,), _) = ENCODER.batch([text])
    want = LIBRARY.encode(text)
    assert np.frombuffer(raw, np.uint32).tolist() == want and said == ",".join(map(str, want))


@settings(max_examples=400, deadline=None)
@given(st.one_of(TEXT, st.text(max_size=40)))
def test_memo_matches_the_library(text):
    text = text.encode("utf-8", "ignore").decode()
    assert np.frombuffer(MEMO.ids([text])[0], "<u4").tolist() == TOKENIZER.encode(text, add_special_tokens=False).ids


def test_pieces_round_trip(spark):
    table = odd.table(spark)
    ids = {(r.doc_id, tuple(r.ids)): r.agrees for r in pieces_codec.encode(table, PIECES).collect()}
    want = [(r[0], tuple(LIBRARY.encode(r[1] or ""))) for r in odd.rows()]
    assert set(ids) == set(want) and all(ids.values())
    back = pieces_codec.decode(pieces_codec.encode(table, PIECES), PIECES)
    assert sorted((str(r.doc_id), r.text) for r in back.collect()) == sorted((str(r[0]), LIBRARY.decode(LIBRARY.encode(r[1] or ""))) for r in odd.rows())
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in pieces_codec.round_trip(table, PIECES).collect()}
    assert got == {(i, len(t), sha(",".join(map(str, t))), sha(LIBRARY.decode(list(t)))) for i, t in want}
    assert local(pieces_codec.round_trip(odd.empty(spark), PIECES)).empty


def test_pieces_query(spark, docs):
    got = local(queries.op2_sentencepiece(spark, SF)).set_index("doc_id")
    assert got.agrees.all() and len(got) == len(docs)
    for i, text in zip(docs.doc_id, docs.text):
        ids = LIBRARY.encode(text)
        assert got.ids_sha256[i] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest() and got.n_tokens[i] == len(ids)


def test_other_models_are_refused(tmp_path):
    with pytest.raises(Exception):
        pieces_codec.MergeVocabulary(BYTES)


@pytest.mark.parametrize("chunk, overlap", [(64, 16), (200, 80), (32_768, 512)])
def test_counts_with_small_chunks(spark, chunk, overlap):
    got = local(token_counts.count_tokens(odd.table(spark), BYTES, chunk=chunk, overlap=overlap, guard=14))
    want = sorted((str(r[0]), len((r[1] or "").encode()), len(TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids)) for r in odd.rows())
    assert sorted((str(None if r.doc_id is None else int(r.doc_id)), r.n_bytes, r.n_tokens) for r in got.itertuples()) == want
    assert local(token_counts.count_tokens(odd.empty(spark), BYTES)).empty


def test_counts_across_special_tokens(spark):
    text = ("word <|endoftext|>" * 40 + "!!<|endoftext|>x" * 40) * 3
    frame = spark.createDataFrame([(k, text[k:]) for k in range(12)], "doc_id long, text string")
    got = {r.doc_id: r.n_tokens for r in token_counts.count_tokens(frame, BYTES, chunk=96, overlap=48).collect()}
    assert got == {k: len(TOKENIZER.encode(text[k:], add_special_tokens=False).ids) for k in range(12)}


def test_counts_query(spark, docs):
    got = local(queries.op9_token_counts(spark, SF)).set_index("doc_id").n_tokens.to_dict()
    assert got == {i: len(TOKENIZER.encode(t, add_special_tokens=False).ids) for i, t in zip(docs.doc_id, docs.text)}


def test_crc32c():
    assert records.crc32c([b"123456789"])[0] == 0xE3069283
    assert records.crc32c([b"\0" * 32, b"\xff" * 32, bytes(range(32))]).tolist() == [0x8A9136AA, 0x62A8AB43, 0x46DD794E]
    pick = np.random.default_rng(0)
    messages = [pick.bytes(n) for n in (4, 511, 512, 513, 5000, 1024, 77)]
    assert records.crc32c(messages).tolist() == [int(records.crc32c([m], 64)[0]) for m in messages]


def test_records_round_trip(spark):
    table = odd.table(spark)
    folder, manifest = records.write_records(table, BYTES)
    got = local(records.read_records(manifest, folder)).sort_values(["start"])
    want, start = [], 0
    rows = sorted((r[0], r[1] or "") for r in odd.rows() if r[0] is not None)
    for i, text in rows:
        ids = [*TOKENIZER.encode(text, add_special_tokens=False).ids, 0]
        want.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert list(got.itertuples(index=False, name=None)) == want
    shard = manifest.orderBy("shard").first()
    assert records.read_at(folder, shard.name, [1])[0].tolist() == [*TOKENIZER.encode(rows[1][1], add_special_tokens=False).ids, 0]


def test_records_empty_table(spark):
    folder, manifest = records.write_records(odd.empty(spark), BYTES)
    assert local(records.read_records(manifest, folder)).empty


def test_damage_is_noticed():
    import io

    framed = records.frames([b"payload one", b"payload two"])
    assert list(records.read_frames(io.BytesIO(b"".join(framed)))) == [[b"payload one", b"payload two"]]
    with pytest.raises(ValueError):
        list(records.read_frames(io.BytesIO(b"".join(framed).replace(b"two", b"twO"))))


def test_records_query(spark, docs):
    got = local(queries.op5_records(spark, SF)).sort_values("doc_id")
    ids = [[*TOKENIZER.encode(t, add_special_tokens=False).ids, 0] for t in docs.text]
    assert got.n_tokens.tolist() == [len(x) for x in ids] and got.start.tolist() == np.cumsum([0, *map(len, ids[:-1])]).tolist()
    assert got.ids_crc32.tolist() == [zlib.crc32(np.array(x, "<u4").tobytes()) for x in ids]
