import os
import random

import pytest
from pyspark.sql import functions as F

from roadgrain.llm import bpe
from roadgrain.llm.pieces import oversized, split_documents, split_text, strength

pytestmark = pytest.mark.skipif(not os.path.exists(os.path.join(bpe.VOCAB_DIR, "byte_bpe_50k.tiktoken")), reason="no vocabulary files here")


def texts():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(1, 9)))
    prose = lambda n: "".join(word() + rng.choice([" ", " ", " ", ", ", ". ", "\n", "\n\n"]) for _ in range(n))
    return ["", "short", prose(300), prose(5000), "x" * 9000, "0123456789" * 900, "加速度計を交換した。" * 400, "é" * 5000, prose(400) + "QUJD" * 4000 + prose(400), " " * 4000, "👩‍👩‍👧‍👦" * 700]


@pytest.mark.parametrize("limit,overlap", [(512, 64), (40, 0), (16, 7)])
def test_pieces_cover_the_text(limit, overlap):
    e = bpe.load()
    for text in texts():
        ids, parts = split_text(text, e, limit, overlap)
        assert ids == e.encode(text)
        body, at = [], 0
        for n, (a, z, o, kind) in enumerate(parts):
            assert z - a <= limit and a + o == at and o == (min(overlap, at) if n else 0)
            body += ids[a + o : z]
            at = z
        assert body == ids and (len(parts) > 1) == (len(ids) > limit)


def test_natural_cuts():
    e = bpe.load()
    text = "\n\n".join("Some words stand here, and more follow. " * 20 for _ in range(10))
    kinds = [k for *_, k in split_text(text, e, 512, 64)[1][1:]]
    assert kinds and all(k == "paragraph" for k in kinds)
    one = "The gyro drifts in heavy rain. " * 200
    assert {k for *_, k in split_text(one, e, 512, 64)[1][1:]} == {"sentence"}
    assert strength("end.", " Next") == 3 and strength("a", ",") == 0 and strength("x", "\n\n") == 5 and strength("。", "次") == 3


def test_documents(spark):
    long = "word " * 3000
    d = spark.createDataFrame([(1, long), (2, None), (3, ""), (4, "short"), (5, long), (5, long)], "doc_id long, text string").withColumn("piece_no", F.lit("x"))
    p = split_documents(d)
    assert sorted(r.doc_id for r in oversized(d).collect()) == [1, 5, 5]
    one = p.where("doc_id = 1").orderBy("piece_no").collect()
    assert all(r.n_tokens <= 512 and r.n_pieces == len(one) for r in one) and all(r.overlap == 64 for r in one[1:])
    assert all(list(a.ids[-64:]) == list(b.ids[:64]) for a, b in zip(one, one[1:]))
    assert {r.doc_id: r.n_tokens for r in p.where("doc_id in (2, 3)").collect()} == {2: 0, 3: 0}
    assert split_documents(d.limit(0)).count() == 0
    with pytest.raises(ValueError):
        split_documents(d, 64, 64)


def test_texts_of_pieces_hold_whole_characters_only(spark):
    from roadgrain.llm.pieces import whole_characters

    assert whole_characters("aé漢😀".encode()) == ("aé漢😀", 0)
    assert whole_characters("é漢".encode()[1:]) == ("漢", 1) and whole_characters("a😀".encode()[:-1]) == ("a", 3) and whole_characters(b"") == ("", 0)
    text = "漢字😀かな交じり文𝒜𝓑𝒞 " * 400
    rows = split_documents(spark.createDataFrame([(1, text)], "doc_id long, text string"), 64, 16).collect()
    assert len(rows) > 10 and all("\ufffd" not in r.text and r.text in text and r.cut_bytes < 7 for r in rows)
