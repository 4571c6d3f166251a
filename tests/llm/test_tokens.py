import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tallymap.llm import idfiles, packing
from tallymap.llm.encode import Encoder
from tallymap.llm.tables import sorted_counts, word_hashes
from tallymap.session import new_path

from .helpers import odd_documents, odd_rows, words

BYTES, WORDS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def plain_ids(path, text, end):
    return [*Tokenizer.from_file(path).encode(text or "", add_special_tokens=False).ids, end]


def crc(ids):
    return zlib.crc32(np.array(ids, dtype="<u4").tobytes())


@pytest.mark.parametrize("path", [BYTES, WORDS])
def test_encoder_gives_the_tokenizers_ids(path):
    draw = random.Random(3)
    signs = "abcXYZ'sdtm.,!*#$%0189 \n éßÄñ\t²ªº́’<|_-\x1c\xa0ŽяЖİ日"
    texts = ["".join(draw.choice(signs) for _ in range(draw.randint(0, 50))) for _ in range(4000)]
    texts += ["it's I'll we've 'sabc a'S, end.", "x" * 500 + ",", "<|endoftext|> a<|endoftext|>", "a\n\n  b \n", "Word. word, WORD!"]
    encoder = Encoder(path, most=500)  # generations change often
    whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
    for text, e in zip(texts, whole, strict=True):
        assert encoder.ids(text) == np.array(e.ids, dtype="<u4").tobytes(), text


def test_long_texts_are_cut_where_white_space_begins(monkeypatch):
    monkeypatch.setattr("tallymap.llm.encode.SLICE_BYTES", 50)
    encoder = Encoder(BYTES)
    text = "some words\n\n and   more, of them.\n" * 40
    assert encoder.ids(text) == np.array(encoder.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


@settings(max_examples=60, deadline=None)
@given(st.integers(1, 24), st.lists(st.integers(0, 2**24 - 1), max_size=200))
def test_ids_round_trip_in_any_width(bits, ids):
    ids = np.array([i & ((1 << bits) - 1) for i in ids], dtype=np.uint32)
    packed = idfiles.pack_ids(ids, bits)
    assert len(packed) == -(-len(ids) * bits // 8)
    assert (idfiles.unpack_ids(packed, len(ids), bits) == ids).all()


def test_width_is_the_least_for_the_vocabulary():
    assert [idfiles.bits_for(n) for n in (1, 2, 3, 256, 257, 50_257, 65_537)] == [1, 1, 2, 8, 9, 16, 17]


def test_a_file_gives_any_range(tmp_path):
    from pyarrow import fs

    writer = idfiles.IdWriter(fs.LocalFileSystem(), str(tmp_path / "x.ids"), 0, 17, block=16)
    ids = np.random.default_rng(1).integers(0, 1 << 17, 500, dtype=np.uint32)
    at = 0
    for doc, n in ((5, 0), (6, 3), (None, 200), (9, 297)):
        writer.add(doc, ids[at : at + n].astype("<u4").tobytes())
        at += n
    writer.close()
    file = idfiles.IdFile(fs.LocalFileSystem(), str(tmp_path / "x.ids"))
    assert file.first.tolist() == [0, 0, 3, 203, 500] and file.known.tolist() == [1, 1, 0, 1]
    for a, b in ((0, 500), (15, 17), (16, 32), (3, 203), (499, 500), (7, 7)):
        assert (file.ids(a, b) == ids[a:b]).all()
    assert [p.name for p in tmp_path.iterdir()] == ["x.ids"]


def test_written_ids_are_read_back(spark):
    docs = odd_documents(spark)
    folder = new_path(spark, "test-ids")
    files = idfiles.write_ids(docs, folder, BYTES, 50_257, 2, file_ids=400)
    assert files.count() > 2
    got = sorted((tuple(r) for r in idfiles.read_ids(files, folder, most=64).collect()), key=lambda r: r[1])
    assert [r[0] for r in got] == sorted((r[0] for r in odd_rows()), key=lambda i: (i is not None, i or 0))
    expected = sorted((r[0] or -1, len(ids), crc(ids)) for r in odd_rows() for ids in [plain_ids(BYTES, r[1], 2)])
    assert sorted((d or -1, n, c) for d, _, n, c in got) == expected
    assert [r[1] for r in got] == np.cumsum([0, *(r[2] for r in got)])[:-1].tolist()
    assert idfiles.round_trip(odd_documents(spark, empty=True), BYTES, 50_257).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=60))
def test_best_fit_is_valid_and_the_bound_holds(lengths):
    lengths = np.array(sorted(lengths, reverse=True), dtype=np.int64)
    bins, offsets, fill = packing.best_fit(lengths, 50)
    seen = {}
    for b, o, n in sorted(zip(bins.tolist(), offsets.tolist(), lengths.tolist(), strict=True), key=lambda x: x[:2]):
        assert seen.get(b, 0) == o
        seen[b] = o + n
    assert all(v <= 50 for v in seen.values()) and [seen[b] for b in range(len(fill))] == fill.tolist()
    bound = packing.lower_bound(lengths, 50)
    assert -(-lengths.sum() // 50) <= bound <= len(fill)


def test_bound_sees_lengths_that_do_not_pair():
    assert packing.lower_bound(np.array([26] * 10), 50) == 10  # the sum alone says 6
    assert packing.lower_bound(np.array([17] * 9), 50) == 5  # three do not fit


def test_packing_whole_documents(spark):
    got = [tuple(r) for r in packing.pack_texts(odd_documents(spark), WORDS, capacity=512).collect()]
    expected = []
    for r in odd_rows():
        ids = plain_ids(WORDS, r[1], 1)
        expected += [(r[0] or -1, k, s, len(ids[s : s + 512]), crc(ids[s : s + 512])) for k, s in enumerate(range(0, len(ids), 512))]
    assert sorted((r[0] or -1, *r[1:5]) for r in got) == sorted(expected)
    check_sequences(got, 512)
    assert packing.pack_texts(odd_documents(spark, empty=True), WORDS).count() == 0


def check_sequences(rows, capacity):
    by = {}
    for *_, length, _, sequence, offset in rows:
        by.setdefault(sequence, []).append((offset, length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_groups_exchange_until_little_is_open(spark, monkeypatch):
    monkeypatch.setattr(packing, "MERGED", 4)
    rows = spark.range(3000).selectExpr(
        "id AS doc_id", "0 AS piece", "0L AS start", "1 + pmod(xxhash64(id), 99) AS length", "id AS ids_crc32"
    )
    got = [tuple(r) for r in packing.pack_documents(rows, 100, group=400).collect()]
    assert sorted(r[0] for r in got) == list(range(3000))
    used = check_sequences(got, 100)
    apart = [tuple(r) for r in packing.pack_documents(rows, 100, group=10**6).collect()]
    assert used <= check_sequences(apart, 100) * 1.01 + 2


def test_rounds_go_on_while_they_save_sequences(spark, monkeypatch, caplog):
    names = []
    write = packing.write_stage
    monkeypatch.setattr(packing, "write_stage", lambda df, name: names.append((name, write(df, name))) or names[-1][1])
    rows = spark.range(1500).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "20 + pmod(xxhash64(id), 37) AS length", "id AS ids_crc32")
    with caplog.at_level("INFO", logger=packing.__name__):
        got = [tuple(r) for r in packing.pack_documents(rows, 100, group=150).collect()]
    assert sorted(r[0] for r in got) == list(range(1500))
    check_sequences(got, 100)
    sequences = [df.select("sequence_id").distinct().count() for _, df in names]
    assert len(names) > packing.PATIENCE
    if caplog.records:  # a gap is left: the last rounds saved nothing, those before did
        last = [df.where("open").select("sequence_id").distinct().count() for _, df in names]
        assert all(now >= open_ for now, open_ in zip(sequences[-packing.PATIENCE :], last[-packing.PATIENCE - 1 : -1], strict=True))


def test_no_task_packs_all_that_cannot_be_filled(spark, monkeypatch):
    sizes = spark.sparkContext.accumulator(0)
    packed = packing._packed

    def watched(capacity, first_round):
        run = packed(capacity, first_round)

        def of_group(rows):
            if len(rows) > 800:  # twice what a group has on average
                sizes.add(1)
            return run(rows)

        return of_group

    monkeypatch.setattr(packing, "_packed", watched)
    alone = spark.range(4000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "51 + pmod(xxhash64(id), 42) AS length", "id AS ids_crc32")
    mixed = spark.range(4000).selectExpr("id AS doc_id", "0 AS piece", "0L AS start", "IF(id % 3 = 0, 60L, 25 + pmod(xxhash64(id), 10)) AS length", "id AS ids_crc32")
    for rows in (alone, mixed):
        got = [tuple(r) for r in packing.pack_documents(rows, 100, group=400).collect()]
        assert sorted(r[0] for r in got) == list(range(4000)) and sizes.value == 0
        used = check_sequences(got, 100)
        if rows is alone:
            assert used == 4000
        else:
            whole = [tuple(r) for r in packing.pack_documents(rows, 100, group=10**6).collect()]
            sizes.value = 0
            assert used <= check_sequences(whole, 100) * 1.01 + 2


def test_word_hashes_tell_words_apart():
    texts = ["The cat  sat\n", "", " the\tCAT sat\x0b\x0c", "é x\x1cy"]
    hashes, first = word_hashes([t.encode() for t in texts])
    assert first.tolist() == np.cumsum([0, *(len(words(t)) for t in texts)]).tolist()
    assert len(set(hashes.tolist())) == len({w for t in texts for w in words(t)})
    low, _ = word_hashes([t.encode() for t in texts], lower=True)
    assert low[:3].tolist() == low[3:6].tolist()
    assert [x.tolist() for x in sorted_counts(np.array([3, 1, 3, 2], dtype=np.uint64))] == [[1, 2, 3], [1, 1, 2]]
