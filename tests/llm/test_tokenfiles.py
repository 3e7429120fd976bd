"""Token files: what is read back equals the tokenizer's output, in order and place."""

import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from riskweave.llm import tokenfiles
from riskweave.llm.queries import QUERIES, vocabulary
from riskweave.session import scratch_path

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    tokenizer = Tokenizer.from_file(vocabulary()[0])
    return lambda text: [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]


def expected(plain, rows):
    ids = [(d, plain(t)) for d, t in rows]
    sums = [(d, len(x), zlib.crc32(np.array(x, "<u4").tobytes())) for d, x in ids]
    out, start = [], 0
    for d, n, crc in sorted(sums, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])):
        out.append((d, start, n, crc))
        start += n
    return out


def by_start(df):
    return [tuple(r)[:4] for r in df.orderBy("start").collect()]


def test_query_gives_the_ids_of_all_documents(spark, plain):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert by_start(QUERIES["op12_token_files"](spark, SF)) == expected(plain, rows)


def test_odd_rows(spark, plain):
    rows = [(None, "b"), (None, None), (5, ""), (5, None), (5, "x y"), (5, "x y"), (-3, "é \U0001f600 <|endoftext|>"), (9, "word " * 60_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    extra = df.select("*", *[F.lit(1).alias(c) for c in ("row", "frame", "crc", "n_tokens", "slice", "start")])
    assert by_start(tokenfiles.round_trip(extra, *vocabulary())) == expected(plain, rows)
    assert tokenfiles.round_trip(df.limit(0), *vocabulary()).collect() == []


def test_one_hot_id(spark, plain):
    rows = [(1, f"t {i % 7}") for i in range(900)] + [(i, "z") for i in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    assert by_start(tokenfiles.round_trip(df, *vocabulary())) == expected(plain, rows)


def test_files_serve_single_documents(spark, plain, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FILE_BYTES", 2000)
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    folder = scratch_path(spark, "tokens")
    listed = tokenfiles.write_tokens(docs, folder, *vocabulary()).orderBy("slice", "nth").collect()
    assert len(listed) > 8 and sum(r["documents"] for r in listed) == docs.count()
    assert [r["base"] for r in listed] == [sum(x["tokens"] for x in listed[:i]) for i in range(len(listed))]
    dictionary = tokenfiles.load_dictionary(folder, listed[0]["dictionary"])
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    seen = []
    for r in listed:
        file = tokenfiles.TokenFile(folder, r["file"], dictionary)
        seen += [file.doc_id(i) for i in range(len(file))]
        last = seen[-1]
        assert [file.ids(i).tolist() for i in file.find(last)] == [plain(texts[last])]
        assert not file.find(-1)
        with pytest.raises(ValueError, match="another dictionary"):
            tokenfiles.TokenFile(folder, r["file"], dictionary + b"x")
    assert seen == sorted(texts)
    rows = tokenfiles.read_tokens(spark, folder, ids=True).collect()
    assert all(r["ids"] == plain(texts[r["doc_id"]]) for r in rows)


def test_the_dictionary_makes_short_documents_smaller(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").where("n_chars < 500").select("doc_id", "text")
    file, ranks = vocabulary()
    width = tokenfiles.id_width(file)
    trained = tokenfiles.train_dictionary(tokenfiles.sample_arrays(docs, file, ranks, width))
    size = lambda d: tokenfiles.frames(docs, file, ranks, width, d).agg(F.sum(F.length("frame"))).first()[0]
    assert size(trained) < 0.9 * size(b"")


def test_damaged_files_are_refused(spark, tmp_path):
    df = spark.createDataFrame([(1, "some words")], "doc_id long, text string")
    folder = str(tmp_path / "t")
    (row,) = tokenfiles.write_tokens(df, folder, *vocabulary()).collect()
    path = tmp_path / "t" / row["file"]
    data = path.read_bytes()
    dictionary = tokenfiles.load_dictionary(folder, row["dictionary"])
    for at in (0, len(data) - 60):
        path.write_bytes(data[:at] + bytes([data[at] ^ 1]) + data[at + 1 :])
        with pytest.raises(ValueError):
            tokenfiles.TokenFile(folder, row["file"], dictionary)
