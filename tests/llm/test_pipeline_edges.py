"""The pipeline on nulls, empty and very long texts, repeated rows, columns of clashing names and empty tables."""

import random

import pytest

import corpus_pipeline
from sahifa.llm import bpe

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, quality int, row string, copies int, gone string"


def prose(rng, n):
    return " ".join("".join(rng.choice("aeiou") + rng.choice("bcdfghlmnrst") for _ in range(rng.randint(1, 4))) for _ in range(n)).capitalize() + "."


def write(spark, path, docs, labels):
    spark.createDataFrame(docs, COLUMNS).coalesce(1).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").coalesce(1).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_awkward_documents(spark, tmp_path):
    rng = random.Random(3)
    extra = ("q", 7, "r", 8, "g")
    good = [(i, prose(rng, 80) + "\n" + prose(rng, 60), "en", f"src{i % 5}", 1, 5, "r", 6, "g") for i in range(60)]
    bad = [(100 + i, "@@@ ### $$$ 12345 |||| %%%\n" * 12, "en", "src1", 1, 5, "r", 6, "g") for i in range(30)]
    long_text = "\n".join(prose(rng, 40) for _ in range(2000))
    odd = [
        (200, None, "en", "src0", None, None, None, None, None), (201, "", None, None, 0, 1, "", 0, ""), (202, " \n\t", "en", "src0", 3, 1, "", 0, ""),
        (None, prose(rng, 90), None, None, 5, 1, "n", 1, "n"), (None, None, None, None, None, None, None, None, None), (203, long_text, "en", None, len(long_text), 1, "l", 1, "l"),
        (5, good[5][1], "en", "src0", 1, 5, "r", 6, "g"), (5, good[5][1], "en", "src0", 1, 5, "r", 6, "g"), (204, good[6][1] + " more", "en", "src0", 1, 5, "r", 6, "g"), (205, "z" * 200_000, "en", "src2", 1, 1, "z", 1, "z"),
    ]
    folder = write(spark, tmp_path, good + bad + odd, [(r[0], 1, 0) for r in good] + [(r[0], 0, 0) for r in bad] + [(None, 1, 0), (3, None, None), (77, 0, 0)])
    rows = corpus_pipeline.run(spark, folder).collect()
    ids = {r.doc_id for r in rows}
    # The classifier rejects what has no words; near copies of 6 go; repeated rows are one document, kept or gone together.
    assert not ids & {200, 201, 202, 204} and len(ids & set(range(60))) >= 20 and not ids & set(range(101, 130))
    assert len([r for r in rows if r.doc_id == 5]) % 3 == 0
    assert {"quality", "row", "copies", "gone", "tokens", "n_tokens"} <= set(rows[0].asDict()) and "text" not in rows[0].asDict()
    assert all(r.n_tokens == len(r.tokens) for r in rows)
    decode = bpe.encoder().automaton.decode
    texts = {r[0]: r[1] for r in good + odd if r[0] is not None}
    for r in rows:
        if r.doc_id in ids and r.doc_id is not None and r.doc_id < 60:
            assert decode(r.tokens) in texts[r.doc_id] and (r.quality, r.row, r.copies, r.gone) == (5, "r", 6, "g")


@pytest.mark.parametrize("labels", [[], [(1, 1, 0), (2, 1, 0)]])
def test_empty_documents(spark, tmp_path, labels):
    folder = write(spark, tmp_path, [], labels)
    found = corpus_pipeline.run(spark, folder)
    assert found.count() == 0 and "tokens" in found.columns


def test_one_document(spark, tmp_path):
    folder = write(spark, tmp_path, [(1, "One short text.", "en", None, 15, 1, "r", 1, "g")], [])
    rows = corpus_pipeline.run(spark, folder).collect()
    assert {r.doc_id for r in rows} <= {1}
