import zlib

import numpy as np
import pytest
from tokenizers import Tokenizer
import public_tokenizers

import __spark_entry__
import corpus_pipeline
from tallymap.llm import mixing, secrets, toxicity
from tallymap.llm.tables import table
from tallymap.session import write_stage

from .helpers import odd_documents, words
from .test_mixing import plain_targets
from .test_neardup import plain_classes
from .test_tokens import check_sequences

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark):
    docs = table(spark, SF, "documents")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(write_stage(stage(spark, found[-1], SF), f"test-{name}"))
    return [[r.asDict() for r in df.collect()] for df in found], [df.columns for df in found]


def test_each_stage_on_what_the_one_before_kept(spark, stages):
    (docs, clean, single, masked, mixed, packed), columns = stages
    assert columns[:5] == [columns[0]] * 5
    documents = table(spark, SF, "documents")
    model = toxicity.train(documents, table(spark, SF, "labels"))
    scores = toxicity.score_texts([r["text"] for r in docs], model)
    assert [r["doc_id"] for r in clean] == [r["doc_id"] for r, s in zip(docs, scores, strict=True) if s < 0.5]
    assert len(clean) >= 0.8 * len(docs)

    clean.sort(key=lambda r: r["doc_id"])
    classes = plain_classes([r["text"] for r in clean])
    assert sorted(r["doc_id"] for r in single) == [r["doc_id"] for i, r in enumerate(clean) if classes[i] == i]

    by_id = {r["doc_id"]: r for r in masked}
    assert sorted(by_id) == sorted(r["doc_id"] for r in single)
    for r in single:
        new = by_id[r["doc_id"]]
        assert (new["text"] == r["text"]) == (not secrets.find(r["text"])) and new["n_chars"] == len(new["text"])
        assert not secrets.base_spans(new["text"])

    sizes, taken, largest = {}, {}, {}
    for r in masked:
        sizes[r["source"]] = sizes.get(r["source"], 0) + len(words(r["text"]))
        largest[r["source"]] = max(largest.get(r["source"], 0), len(words(r["text"])))
    for r in mixed:
        taken[r["source"]] = taken.get(r["source"], 0) + len(words(r["text"]))
        assert r == by_id[r["doc_id"]]
    targets = plain_targets(sizes)
    assert all(abs(taken.get(s, 0) - t) <= largest[s] for s, t in targets.items())
    copies = mixing.mixture(spark.createDataFrame([(r["doc_id"], r["text"], r["source"]) for r in masked], "doc_id long, text string, source string"))
    assert sum(r["copies"] for r in copies.collect()) == len(mixed)

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = []
    for r in mixed:
        ids = [*tokenizer.encode(r["text"], add_special_tokens=False).ids, 1]
        expected += [(r["doc_id"], k, s, len(ids[s : s + 4096]), zlib.crc32(np.array(ids[s : s + 4096], "<u4").tobytes())) for k, s in enumerate(range(0, len(ids), 4096))]
    rows = [tuple(r[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")) for r in packed]
    assert sorted(r[:5] for r in rows) == sorted(expected)
    least = -(-sum(r[3] for r in rows) // 4096)
    assert least <= check_sequences(rows, 4096) <= least + 2


def test_stages_with_odd_rows_and_none(spark):
    kept = {}
    for docs in (odd_documents(spark), odd_documents(spark, empty=True)):
        columns = docs.columns
        for name, stage in corpus_pipeline.STAGES:
            docs = write_stage(stage(spark, docs, SF), f"odd-{name}")
            assert name == "packing" or docs.columns == columns
            kept[name] = [r.asDict() for r in docs.collect()]
            if name == "toxicity" and kept[name]:
                assert sorted(map(repr, kept[name])) == sorted(repr(r.asDict()) for r in odd_documents(spark).collect())  # none is toxic
            elif name == "near_duplicates" and kept[name]:
                # rows without a text stay, texts without a word are apart, copies of the plain text are one class
                assert sorted((r["doc_id"] or -1, r["text"] is None) for r in kept[name]) == [
                    (-1, True), (1, False), (2, True), (3, False), (4, False), (5, False), (7, False), (8, False), (2**62 + 1, False),
                ]
                single = kept[name]
            elif name == "secrets" and kept[name]:
                by_id = {r["doc_id"]: r["text"] for r in kept[name]}
                assert len(kept[name]) == len(single) and by_id[8] == "[SECRET] and token: abc"
                assert all(by_id[r["doc_id"]] == r["text"] for r in single if r["doc_id"] != 8)
                masked = {repr(r): len(words(r["text"])) for r in kept[name]}
            elif name == "mixing" and kept[name]:
                assert all(repr(r) in masked for r in kept[name])
                assert max(kept[name].count(r) for r in kept[name]) <= 3
                mixed = len(kept[name])
            elif kept[name]:
                assert sum(r["piece"] == 0 for r in kept[name]) == mixed
        assert name == "packing"
    assert all(not rows for rows in kept.values())


def test_registered():
    names = [n for n in __spark_entry__.queries() if n == "pipeline" or n.startswith("op")]
    assert sorted(n.split("_")[0] for n in names) == sorted(["pipeline", *(f"op{i}" for i in range(1, 14))])
    assert "op5_exact_topk" in __spark_entry__.oracle_sql()
