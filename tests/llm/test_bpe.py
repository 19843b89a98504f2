import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from rankflow.llm.bpe import Transducer, Utf8Machine, decode, decoder, default_path, default_pattern, encode, encoder, read_ranks, round_trip

from .helpers import awkward_texts, documents

REFERENCE = tiktoken.Encoding("own", pat_str=default_pattern(), mergeable_ranks=read_ranks(default_path()), special_tokens={})


def test_corpus_equals_the_library(spark):
    rows = encode(spark.read.parquet("/root/testdata/sf0.001/documents.parquet")).collect()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    assert all(r["ids"] == REFERENCE.encode_ordinary(texts[r["doc_id"]]) for r in rows)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet="abethTHE'sll éßñ的🙂  \n\t\r\x0b  019²½.,!#", max_size=60))
def test_any_text_equals_the_library(text):
    got = encoder(default_path(), default_pattern()).encode(text).tolist()
    assert got == REFERENCE.encode_ordinary(text)


@settings(max_examples=200, deadline=None)
@given(st.binary(max_size=60))
def test_utf8_machine_equals_the_codec(data):
    m = Utf8Machine()
    text = "".join(m.feed(data[i:i + 3]) for i in range(0, len(data), 3)) + m.finish()
    try:
        assert text == data.decode() and not m.damaged
    except UnicodeDecodeError:
        assert m.damaged


def test_long_piece_streams():
    t = Transducer(read_ranks(default_path()))
    piece = b"ab" * 3000 + b"e" * 5000 + b"the" * 2000
    parts = list(t.stream(piece[i:i + 100] for i in range(0, len(piece), 100)))
    assert [i for p in parts for i in p] == REFERENCE.encode_ordinary(piece.decode())
    assert max(map(len, parts)) < 200      # nothing waits for the end


def test_round_trip_and_awkward_cases(spark):
    texts = awkward_texts()
    docs = documents(spark, texts).withColumnRenamed("kept", "decoded").withColumnRenamed("size", "ids")
    rows = decode(encode(docs)).collect()
    assert len(rows) == len(texts)
    for r in rows:
        assert bytes(r["decoded"]).decode() == (texts[r["doc_id"]] or "") and r["decoded_ok"]
        assert r["ids"] == REFERENCE.encode_ordinary(texts[r["doc_id"]] or "")
    assert decode(encode(docs.limit(0))).count() == 0
    both = sorted(map(str, round_trip(docs).select("doc_id", "ids", "decoded", "decoded_ok").collect()))
    assert both == sorted(map(str, decode(encode(docs)).select("doc_id", "ids", "decoded", "decoded_ok").collect()))


def test_damaged_ids_are_told(spark):
    half = REFERENCE.encode_ordinary("🙂")
    ids = spark.createDataFrame([(1, half), (2, half[:1]), (3, None), (4, [])], "k int, ids array<int>")
    got = {r["k"]: (bytes(r["decoded"]), r["decoded_ok"]) for r in decode(ids).collect()}
    assert got[1] == ("🙂".encode(), True) and got[2][1] is False and got[3] == (b"", True) and got[4] == (b"", True)
    assert "".join(decoder(default_path()).stream(half[:1])) == "�"
