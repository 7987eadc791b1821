import os
import struct
import zlib

import numpy as np
import pytest

from modsift.llm import queries_exact, queries_records, records
from modsift.llm.tokens import WordTokenizer, _Cache

PATH = queries_exact.tokenizer_path()


def encoded(text):
    from tokenizers import Tokenizer

    return [*Tokenizer.from_file(PATH).encode(text or "", add_special_tokens=False).ids, 2]


def plain_crc32c(data):
    state = 0xFFFFFFFF
    for b in data:
        state ^= b
        for _ in range(8):
            state = state >> 1 ^ (records.POLYNOMIAL if state & 1 else 0)
    return state ^ 0xFFFFFFFF


def test_checksum_matches_the_definition():
    assert records._crc.of(b"123456789") == 0xE3069283  # the published check value
    for n in (0, 1, 8, 63, 64, 511, 512, 513, 1024, 3001):
        data = os.urandom(n)
        assert records._crc.of(data) == records._crc.short(data) == plain_crc32c(data)
    many = [os.urandom(n) for n in (0, 3, 4, 700, 512, 5000, 1)]
    assert records.Crc32c(64, 256).of_many(many) == [plain_crc32c(m) for m in many]
    crc = plain_crc32c(b"abc")
    assert records.masked_checksum(b"abc") == ((crc >> 15) + (crc << 17) + 0xA282EAD8) % 2**32


def test_damage_is_found():
    texts = [b"some data " * 30, b"", b"abc", os.urandom(700)]
    raw = records.framed(texts[:1])
    assert records.framed(texts) == b"".join(records.framed([t]) for t in texts)
    assert records.unframed([records.framed([t]) for t in texts], list("abcd")) == texts
    for at in (0, 9, 12, 100, len(raw) - 1):
        bad = bytearray(raw)
        bad[at] ^= 4
        with pytest.raises(ValueError, match="x"):
            records.unframed([raw, bytes(bad)], ["good", "x"])
    for cut in (raw[:5], raw[:-1], raw + b"0"):
        with pytest.raises(ValueError):
            records.unframed([cut], ["x"])


def expected(texts):
    """doc_id, start, ids in the order of the files: no id first, equal ids by the hash of the text (any order here)."""
    at, out = 0, []
    for i, t in sorted(texts, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = encoded(t)
        out.append((i, at, ids))
        at += len(ids)
    return out, at


@pytest.mark.parametrize("file_bytes", [1 << 30, 20_000])
def test_round_trip_of_odd_documents(spark, odd, tmp_path, file_bytes):
    df, texts = odd
    folder = str(tmp_path / "records")
    records.write_records(df, PATH, folder, file_bytes=file_bytes)
    want, total = expected(texts)
    rows = sorted(records.read_records(spark, folder).collect(), key=lambda r: r.start)
    ids = [np.frombuffer(r.ids, "<u4").tolist() for r in rows]
    assert [r.doc_id for r in rows] == [i for i, _, _ in want]
    assert sorted((str(r.doc_id), x) for r, x in zip(rows, ids)) == sorted((str(i), x) for i, _, x in want)
    assert [r.start for r in rows] == np.concatenate([[0], np.cumsum([len(x) for x in ids])])[:-1].tolist()
    assert sum(r.n_tokens for r in rows) == total
    shuffled = records.read_records(spark, folder, seed=4).collect()
    assert sorted(map(tuple, shuffled), key=str) == sorted(map(tuple, rows), key=str)
    assert [r.start for r in shuffled] != [r.start for r in rows]
    # The files themselves: frame after frame, read without the index.
    index = records.read_index(spark, folder).orderBy("start").collect()
    raw = b"".join(open(f"{folder}/data/{name}", "rb").read() for name in dict.fromkeys(r.file for r in index))
    at, seen = 0, []
    while at < len(raw):
        (n,) = struct.unpack_from("<Q", raw, at)
        data = records.unframed([raw[at : at + n + records.FRAME]], ["file"])[0]
        seen.append(np.frombuffer(data, "<u2", offset=records.HEADER_BYTES).tolist())
        at += n + records.FRAME
    assert seen == ids


def test_a_damaged_file_fails_the_read(spark, docs_of, tmp_path):
    folder = str(tmp_path / "records")
    records.write_records(docs_of([(1, "some words here"), (2, None)]), PATH, folder)
    for name in os.listdir(f"{folder}/data"):
        with open(f"{folder}/data/{name}", "r+b") as f:
            f.seek(14)
            f.write(b"\x7f")
    with pytest.raises(Exception, match="damaged record"):
        records.read_records(spark, folder).collect()


def test_empty_table_and_missing_index_rows(spark, docs_of, tmp_path):
    records.write_records(docs_of([]), PATH, str(tmp_path / "none"))
    assert records.read_records(spark, str(tmp_path / "none")).count() == 0
    folder = str(tmp_path / "records")
    records.write_records(docs_of([(1, "a b")]), PATH, folder)
    open(f"{folder}/data/part-000000-lost.records", "wb").write(b"half a fra")  # of an attempt that failed
    assert [r.n_tokens for r in records.read_records(spark, folder).collect()] == [3]


def test_query_on_whole_documents(spark, documents):
    got = {r.doc_id: r for r in queries_records.op12_records(spark, "/root/testdata/sf0.001").collect()}
    at = 0
    for r in documents.orderBy("doc_id").collect():
        ids = encoded(r.text)
        crc = zlib.crc32(np.array(ids, "<u4").tobytes())
        assert tuple(got[r.doc_id]) == (r.doc_id, at, len(ids), crc)
        at += len(ids)


def test_cache_of_two_generations():
    made = []
    cache = _Cache(lambda k: made.append(k) or k.encode(), 3)
    for k in ["a", "b", "c", "d", "a", "x" * 65, "x" * 65]:
        assert cache[k] == k.encode()
    assert made == ["a", "b", "c", "d", "x" * 65, "x" * 65] and set(cache) | set(cache.old) == {"a", "b", "c", "d"}
    text = "Words, a\x00control d's it's 12 Ünï'cödé!! again Words, again"
    assert np.frombuffer(WordTokenizer(PATH, entries=2).ids(text), "<u2").tolist() + [2] == encoded(text)
