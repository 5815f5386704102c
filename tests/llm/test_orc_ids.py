import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gradelake.llm import orc_ids, queries

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def expected(rows):
    """Documents in order with the library's ids, one text at a time."""
    encoder = Tokenizer.from_file(VOCABULARY)
    encoder.encode_special_tokens = True
    out, start = [], 0
    for key, text in rows:
        ids = encoder.encode(text or "", add_special_tokens=False).ids + [0]
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.fixture(scope="module")
def written(spark, tmp_path_factory):
    rows = [(i * 3, f"text {i} " * (i % 17)) for i in range(3000)] + [(20_000, "long wörds " * 40_000), (20_001, None), (20_002, ""), (20_003, "<|endoftext|> end")]
    path = str(tmp_path_factory.mktemp("orc") / "ids")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    orc_ids.write(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), path, VOCABULARY)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    return rows, path


def test_stream_equals_the_library(spark, written):
    rows, path = written
    found = orc_ids.digests(orc_ids.read(spark, path)).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected(rows)


def test_files_lie_in_key_order_with_indexes(spark, written):
    rows, path = written
    spans = sorted((r["part"], r["first_id"], r["last_id"]) for r in orc_ids.parts(spark, path).collect())
    assert len(spans) > 1 and all(a[2] < b[1] for a, b in zip(spans, spans[1:]))
    from glob import glob

    from pyarrow import orc

    for file in glob(path + "/*.orc"):
        assert orc.ORCFile(file).row_index_stride == orc_ids.STRIDE and orc.ORCFile(file).compression == "ZSTD"


def test_lookup_prunes_by_metadata(spark, written):
    rows, path = written
    assert orc_ids.lookup(spark, path, [1]).count() == 0
    found = orc_ids.lookup(spark, path, [300, 300, None, 20_001])
    assert sorted(r["doc_id"] for r in found.collect()) == [300, 20_001]
    assert "PushedFilters: [In(doc_id" in found._jdf.queryExecution().toString()


def test_token_range(spark, written):
    rows, path = written
    want = expected(rows)
    for first, last in [(0, 1), (1000, 1010), (want[-1][1], want[-1][1] + 9), (5, 5), (10**9, 10**9 + 5)]:
        found = sorted((r["doc_id"], r["start"], len(r["ids"])) for r in orc_ids.token_range(spark, path, first, last).collect())
        assert found == [w[:3] for w in want if w[1] < last and w[1] + w[2] > first and first < last]


def test_nulls_repeats_names_and_nothing(spark, tmp_path):
    rows = [(None, "none", 1), (2, "b", 2), (1, "same", 3), (1, "same", 4), (1, None, 5)]
    orc_ids.write(spark.createDataFrame(rows, "doc_id long, text string, ids int").withColumn("part", F.lit("x")), str(tmp_path / "a"), VOCABULARY)
    found = orc_ids.digests(orc_ids.read(spark, str(tmp_path / "a"))).orderBy("start").collect()
    assert [r["doc_id"] for r in found] == [None, 1, 1, 1, 2]
    assert [r["start"] for r in found] == list(np.cumsum([0] + [r["n_tokens"] for r in found])[:-1])
    orc_ids.write(spark.createDataFrame([], "doc_id long, text string"), str(tmp_path / "b"), VOCABULARY)
    assert orc_ids.digests(orc_ids.read(spark, str(tmp_path / "b"))).count() == 0


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet").orderBy("doc_id").collect()
    found = queries.QUERIES["op11_orc_ids"](spark, sf).orderBy("doc_id").collect()
    assert [tuple(r) for r in found] == expected([(d["doc_id"], d["text"]) for d in docs])


def test_pieces_are_cut_as_the_library_cuts():
    """Every kind of character that the two patterns or the two cutters could tell apart."""
    encoder = orc_ids.Encoder(VOCABULARY)
    latin = ["".join(f"a{chr(c)}1{chr(c)}!{chr(c)} {chr(c)}{chr(c)}x " for c in range(start, start + 16)) for start in range(0, 256, 16)]
    texts = latin + [t + "“π”" for t in latin] + ["it's we'll I'D  \n\n x\t ", "՘a՘ 1\U0010fffe", "日本語 ³ Ⅷ ١٢", "", "é   \x1c \x85"]
    want = [encoder.whole.encode(t, add_special_tokens=False).ids for t in texts]
    for _ in range(2):  # the second time from what is remembered
        assert [np.frombuffer(i, np.int32).tolist() for i in encoder.encode(texts)] == want
