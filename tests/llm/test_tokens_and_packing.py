"""Token coder, packing and token files against direct use of the tokenizers library."""
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from larder.llm import packing, token_files
from larder.llm.common import shared_dir
from larder.llm.tokens import TokenCoder, coder, default_tokenizer

TEXTS = ["", None, "   ", "Hello, WORLD! don't stop", "<|endoftext|> and a<|startoftext|>b", "\x1cx \x85 \xa0y z",
         "İstanbul ΣΑΣ é ŉ ßẞ ﬁ Ǆ", "12.5%% ***und&&& a—. 's 'll", "word " * 9000, "naïve\tfaçade\r\nüber\x0bx"]
SCHEMA = "doc_id bigint, text string, piece string, length string, id string"


def reference_ids(text):
    return coder(default_tokenizer()).tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(max_size=60))
def test_word_coder_equals_library(text):
    got = np.frombuffer(coder(default_tokenizer()).encode(text), dtype="<u4").tolist()
    assert got == reference_ids(text)


def test_word_coder_on_odd_texts_and_other_tokenizers():
    for text in TEXTS:
        assert np.frombuffer(coder(default_tokenizer()).encode(text), dtype="<u4").tolist() == reference_ids(text)
    import public_tokenizers

    other = TokenCoder(public_tokenizers.path("byte_bpe_50k.json"))
    assert not other.by_word  # white space matters there: encoded text by text
    assert np.frombuffer(other.encode("two  spaces here"), "<u4").tolist() == other.tokenizer.encode("two  spaces here").ids


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200), st.integers(1, 9))
def test_packer_is_best_fit_with_a_bound(lengths, open_bins):
    packer, free, open_now, n_bins = packing.BestFitPacker(64, open_bins), {}, set(), 0
    for n in lengths:
        number, offset = packer.place(n)
        fits = [b for b in open_now if free[b] >= n]
        if fits:
            assert number in fits and free[number] == min(free[b] for b in fits)
        else:
            assert number == n_bins
            if len(open_now) == open_bins:
                gone = [b for b in open_now if free[b] == min(free[x] for x in open_now)]
                open_now.discard(gone[0] if len(gone) == 1 else next(b for b in gone if b in open_now and b not in sum(packer.by_free.values(), [])))
            n_bins, free[number] = n_bins + 1, 64
            open_now.add(number)
        assert offset == 64 - free[number]
        free[number] -= n
        if not free[number]:
            open_now.discard(number)
        assert open_now == set(sum(packer.by_free.values(), []))


def _docs(spark):
    rows = [(i, t, "x", "y", "z") for i, t in enumerate(TEXTS)] + [(3, TEXTS[3], None, None, None), (40, "tail", "", "", "")]
    return spark.createDataFrame(rows, SCHEMA).repartition(3), rows


def test_pack_documents(spark):
    df, rows = _docs(spark)
    out = packing.pack_documents(df).collect()
    want = []
    for doc, text, *_ in rows:
        ids = reference_ids(text) + [packing.END_ID]
        for k, at in enumerate(range(0, len(ids), 4096)):
            part = ids[at:at + 4096]
            want.append((doc, k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == sorted(want)
    for seq in {r.sequence_id for r in out}:
        at = 0
        for r in sorted((r for r in out if r.sequence_id == seq), key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 4096
    assert len({r.sequence_id for r in out}) <= -(-sum(r.length for r in out) // 4096) + 1


def test_sequences_hold_the_ids(spark):
    df, _ = _docs(spark)
    df = df.filter("doc_id <> 3")
    pieces = packing.token_pieces(df, with_ids=True)
    placed = packing.best_fit_pack(pieces.drop("ids"), ["doc_id", "piece"])
    seqs = {r.sequence_id: r for r in packing.sequences(pieces, placed, ["doc_id", "piece"]).collect()}
    for r in placed.collect():
        part = bytes(seqs[r.sequence_id].ids)[4 * r.offset:4 * (r.offset + r.length)]
        assert zlib.crc32(part) == r.ids_crc32


def test_packing_of_an_empty_table(spark):
    df, _ = _docs(spark)
    assert packing.pack_documents(df.limit(0)).count() == 0


def test_token_files_round_trip(spark):
    df, rows = _docs(spark)
    folder = shared_dir(spark, "test-files")
    parts = token_files.write_token_files(df, folder, tasks=3)
    out = sorted(token_files.read_token_files(spark, folder, parts).collect(), key=lambda r: r.start)
    want, start = [], 0
    for doc, text, *_ in sorted(rows, key=lambda r: (r[0], r[1] or "")):
        ids = np.array(reference_ids(text) + [token_files.END_ID], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in out] == want
    assert sum(p["n_tokens"] for p in parts) == start and parts[0]["width"] == 2
    first = token_files.TokenPart(folder, parts[0]["name"], 2)
    assert first.document(0).tolist() == reference_ids(TEXTS[0]) + [token_files.END_ID]


def test_token_files_edges(spark):
    df, _ = _docs(spark)
    assert token_files.token_file_round_trip(df.limit(0)).count() == 0
    with pytest.raises(ValueError):
        token_files.mounted("hdfs://store/x")


def test_token_files_of_documents_without_an_id(spark):
    rows = [(None, "b c"), (7, "z"), (None, None), (0, "y"), (None, "a"), (7, "a b"), (-3, None)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    folder = shared_dir(spark, "test-files")
    parts = token_files.write_token_files(df, folder, tasks=3)
    out = sorted(token_files.read_token_files(spark, folder, parts).collect(), key=lambda r: r.start)
    want, start = [], 0
    for doc, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(reference_ids(text) + [token_files.END_ID], "<u4")
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert [tuple(r) for r in out] == want
    nulls = df.filter("doc_id is null")
    assert [r.doc_id for r in token_files.token_file_round_trip(nulls).collect()] == [None] * 3
