"""WARC bundles, packing, the token store: round trips, and rows that are null, empty, repeated or missing."""

import base64
import hashlib
import os
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from kinlink.llm import packing, token_store, tokens, warc
from kinlink.llm.common import open_store, scratch

DATA = "/root/testdata/sf0.001"
CLASH = "page_id long, url string, html string, key string, payload string, sha1 string, leader string, size string"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], CLASH)


def test_warc_round_trip_and_revisits(spark):
    rows = [(1, "http://a/", "same"), (2, "http://b/\r\nX: y", "same"), (3, None, None), (4, "http://d/", ""), (5, "u", "é" * 400_000), (6, "u", "other"), (6, "u", "other"), (None, "u", "same")]
    index = warc.write_bundles(pages(spark, rows), scratch(spark, "t"), "page_id", "url", "html", frame_bytes=1 << 16)
    got = sorted(map(tuple, warc.read_bundles(index).collect()), key=str)
    by = defaultdict(list)
    for key, uri, size, digest, kind, refers, payload in got:
        by[key].append((size, digest, kind, refers, payload))
        assert uri is None or "\n" not in uri
    assert [x[2:4] for x in by[1]] == [("revisit", 2)] and by[2][0][2:] == ("response", None, b"same") and by[None][0][2:4] == ("revisit", 2)
    assert by[3][0][2:4] == ("revisit", 4) and by[4][0][2] == "response" and by[4][0][0] == 0
    assert [x[2] for x in by[6]] == ["response", "response"]
    for key, url, html in rows:
        raw = (html or "").encode()
        for size, digest, *_ in by[key]:
            assert size == len(raw) and digest == base64.b32encode(hashlib.sha1(raw).digest()).decode()
    found = warc.lookup(index, spark.createDataFrame([(5,), (77,)], "k long")).collect()
    assert [(r.key, r.payload.decode()) for r in found] == [(5, "é" * 400_000)]


def test_warc_frames_and_seek_table(spark):
    rows = [(i, f"http://h/{i}", random.Random(i).randbytes(2000).hex()) for i in range(200)]
    index = warc.write_bundles(pages(spark, rows).coalesce(1), scratch(spark, "t"), "page_id", "url", "html", frame_bytes=1 << 14, bundle_bytes=1 << 17, min_revisit_bytes=1)
    bundles = [r.bundle for r in index.select("bundle").distinct().collect()]
    assert len(bundles) > 1
    placed = {(r.bundle, r.frame): (r.frame_offset, r.frame_bytes) for r in index.collect()}
    for uri in bundles:
        store, path = open_store(uri)
        with store.open_input_file(path) as f:
            for k, (place, packed, plain) in enumerate(warc.seek_table(f)):
                assert placed[uri, k] == (place, packed) and plain <= (1 << 14) + 5000
    assert warc.read_bundles(index).count() == 200


def test_warc_of_nothing(spark):
    index = warc.write_bundles(pages(spark, []), scratch(spark, "t"), "page_id", "url", "html")
    assert index.count() == 0 and warc.read_bundles(index).count() == 0


TEXTS = ["", "a", "Hello, world. Über alles!", "a  b\n\nc \t d", " lead and trail ", "don't we've I'll 1,234.5", "日本語 のテキスト です。", "<|endoftext|> x", "a<|endoftext|>b", "<|startoftext|> y", "A <|ENDOFTEXT|> B  <|endoftext|>\n<|endoftext|>", "<|endof text|>", "<| x |>", "x\0y", "İstanbul ΑΣ", "foo!. bar,, baz.. qux."]


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json"])
def test_encoder_equals_the_library(name):
    from tokenizers import Tokenizer

    own, theirs = tokens.TextEncoder(name), Tokenizer.from_file(tokens.vocabulary(name))
    r = random.Random(5)
    mixed = ["".join(r.choice(["the", "Foo", "<|endoftext|>", "<|", "|>", "<|startoftext|>", "é", ",", ".", " ", "  ", "\n", "'s", "12", "ß", "-", "\xa0", "́"]) for _ in range(60)) for _ in range(200)]
    for text, ids in zip(TEXTS + mixed, own.encode(TEXTS + mixed)):
        assert ids == np.array([*theirs.encode(text, add_special_tokens=False).ids, 2], "<u4").tobytes(), text
    assert own.encode([None]) == [b"\2\0\0\0"]


def docs(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, text string, start long, ids string, key string")


def check_packing(pieces, whole):
    by, sequences = defaultdict(list), defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
        sequences[p.sequence_id].append((p.offset, p.length))
    for key, ids in whole.items():
        parts = sorted(by[key], key=lambda p: p.start)
        assert b"".join(p.ids for p in parts) == ids and {p.doc_tokens for p in parts} == {len(ids) // 4}
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at and length > 0
            at += length
        assert at & (at - 1) == 0 and at <= 4096
    return sequences


@pytest.mark.parametrize("pool", [1 << 10, 1 << 20])
def test_packing_keeps_every_id_and_needs_no_padding(spark, pool):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice(["one", "two", "seven"]) for _ in range(r.choice([0, 3, 200, 900, 3000, 9000])))) for i in range(60)] + [(60, None), (61, "")]
    encode = tokens.TextEncoder("word_bpe_49k.json").encode
    whole = dict(zip([k for k, _ in rows], encode([t for _, t in rows])))
    got = packing.pack_documents(docs(spark, rows).repartition(3), pool_tokens=pool).collect()
    check_packing(got, whole)
    loads = defaultdict(int)
    for p in got:
        loads[p.step_group] += p.length
    assert packing.pack_documents(docs(spark, [])).count() == 0
    assert packing.pack_documents(docs(spark, [(None, "a"), (1, "a"), (1, "a")])).count() == 3


def test_step_groups_are_even():
    groups = packing.step_groups([4096] * 5 + [1024] * 12 + [256] * 7, 8192)
    loads = defaultdict(int)
    for g, n in zip(groups, [4096] * 5 + [1024] * 12 + [256] * 7):
        loads[g] += n
    assert max(loads.values()) - min(loads.values()) <= 1024


def test_token_store_round_trip(spark):
    r = random.Random(2)
    rows = [(i, "word " * r.randrange(300)) for i in r.sample(range(1000), 120)] + [(5000, None), (-3, ""), (7777, "b"), (7777, "a")]
    folder = scratch(spark, "t")
    manifest = token_store.write_tokens(docs(spark, rows).repartition(5), folder, group_tokens=500, file_tokens=4000)
    got = sorted(token_store.read_tokens(manifest).collect(), key=lambda x: x.start)
    encode = tokens.TextEncoder("byte_bpe_50k.json").encode
    assert [x.doc_id for x in got] == sorted(k for k, _ in rows)
    whole = defaultdict(set)
    for k, t in rows:
        whole[k].add(encode([t])[0])
    at = 0
    for x in got:
        assert x.start == at and x.ids in whole[x.doc_id] and len(x.ids) == 4 * x.n_tokens
        at += x.n_tokens
    crc = {(x.start, x.ids_crc32) for x in token_store.read_tokens(manifest, ids="crc32").collect()}
    assert crc == {(x.start, zlib.crc32(x.ids)) for x in got}
    assert token_store.read_tokens(manifest, ids="none").columns == ["doc_id", "start", "n_tokens"]
    one = token_store.document_ids(spark, manifest, rows[0][0]).first()
    assert np.array(one.ids, "<u4").tobytes() in whole[rows[0][0]]
    empty = token_store.write_tokens(docs(spark, []), scratch(spark, "t"))
    assert token_store.read_tokens(empty).count() == 0


def test_token_files_have_small_groups_encodings_and_page_indexes(spark):
    import pyarrow.parquet as pq

    manifest = token_store.write_tokens(docs(spark, [(i, "some words here " * 40) for i in range(50)]).coalesce(1), scratch(spark, "t"), group_tokens=1000)
    store, path = open_store(manifest.first().file)
    with store.open_input_file(path) as f:
        meta = pq.ParquetFile(f).metadata
        assert meta.num_row_groups > 2
        column = {meta.row_group(0).column(i).path_in_schema: meta.row_group(0).column(i) for i in range(4)}
        assert "DELTA_BINARY_PACKED" in column["start"].encodings and any("DICTIONARY" in e for e in column["ids.list.element"].encodings)
        assert column["doc_id"].has_offset_index


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")
def test_warc_query_equals_sql(spark):
    import duckdb

    db = duckdb.connect()
    db.execute(f"CREATE VIEW pages AS SELECT * FROM '{DATA}/pages.parquet' UNION ALL SELECT page_id + 9000, url, html FROM '{DATA}/pages.parquet' WHERE page_id < 5")
    wanted = sorted(db.execute(warc.OP1_SQL).fetchall())
    own = spark.read.parquet(f"{DATA}/pages.parquet")
    more = own.where("page_id < 5").selectExpr("page_id + 9000 AS page_id", "url", "html")
    index = warc.write_bundles(own.unionByName(more), scratch(spark, "t"), "page_id", "url", "html")
    got = warc.read_bundles(index, payloads=False).select("key", "payload_bytes", "payload_digest", "record_type", "refers_to")
    assert sorted(map(tuple, got.collect())) == wanted
