import zlib
from pathlib import Path

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from kerbsight.llm import token_files as T

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


TEXTS = [
    "", "\n", "a\n\nb", " a", "a ", "a  b", "a\tb c", "x\r\ny z\r\n", "a \n b", "it's 5.5,a ,b . 3.",
    " x y　z \x85 q", "a.\nB. C,,", "x" * 200 + " y", "a  b " * 3000, "don't. I'll, 's", "Ġ Ċ ĠĠ",
    "日本 語.\n😀, é!", "." , "..", " .", "a.b.c. d", "\n.\n",
]


@pytest.mark.parametrize("store", [0, 3, 10_000])
def test_words_give_the_ids_of_the_whole_text(library, store, monkeypatch):
    monkeypatch.setattr(T, "CACHE_WORDS", store)
    mine = T.CachedEncoder(PATH, 0)
    want = [x.ids + [0] for x in library.encode_batch(TEXTS, add_special_tokens=False)]
    for _ in range(3):
        ids, sizes = mine(pa.array(TEXTS))
        assert sizes.tolist() == [len(x) for x in want]
        assert ids.tolist() == [i for x in want for i in x]


def written(spark, ws, df, **kw):
    path = ws.path("tokens")
    index = T.commit_index(spark, T.write_token_files(df, path, PATH, **kw), path)
    return index, path


def test_files_hold_the_stream_in_order(spark, ws, odd, odd_rows, library):
    index, path = written(spark, ws, odd, seq_len=64, batch_rows=4)
    rows = T.read_documents(T.with_stream_start(index), path).collect()
    rows.sort(key=lambda r: r["start"])
    assert [r["doc_id"] is not None for r in rows] == [False, False] + [True] * 10
    assert [r["doc_id"] for r in rows[2:]] == sorted(r["doc_id"] for r in rows[2:])
    texts = {i: t or "" for i, t, *_ in odd_rows}
    at = 0
    for r in rows:
        ids = library.encode(texts[r["doc_id"]], add_special_tokens=False).ids + [0]
        assert (r["start"], r["n_tokens"]) == (at, len(ids))
        assert r["ids_crc32"] == zlib.crc32(np.array(ids, "<u4").tobytes())
        at += len(ids)


def test_layout_masks_and_zero_copy(spark, ws, odd):
    index, path = written(spark, ws, odd, seq_len=64, batch_rows=4)
    total = 0
    for f in {r["file"] for r in index.select("file").collect()}:
        file = T.SequenceFile(f"{path}/{f}")
        assert file.reader.schema.field("ids").type == pa.list_(pa.uint16(), 64)
        batches = file.reader.num_record_batches
        assert all(file.batch(k).num_rows == 4 for k in range(batches - 1))
        n = (batches - 1) * 4 + file.batch(batches - 1).num_rows
        bits = np.concatenate([np.unpackbits(file.sequence(k, "mask"), bitorder="little") for k in range(n)])
        own = index.where(index.file == f).agg(T.F.sum("n_tokens")).first()[0]
        assert bits.sum() == own and bits[:own].all()
        first, again = file.sequence(0), file.sequence(0)
        assert not first.flags.owndata and np.shares_memory(first, again)
        assert len(first) == 64
        total += own
    assert total == index.agg(T.F.sum("n_tokens")).first()[0]


def test_unnamed_files_of_lost_tasks_do_not_count(spark, ws, odd):
    index, path = written(spark, ws, odd)
    before = T.read_documents(T.with_stream_start(index), path).collect()
    folder = Path(path.removeprefix("file:").replace("//", "/"))
    (folder / "part-000000-lost.arrow").write_bytes(b"half a file")
    assert T.read_documents(T.with_stream_start(index), path).collect() == before


def test_nothing(spark, ws, nothing):
    index, path = written(spark, ws, nothing)
    assert T.read_documents(T.with_stream_start(index), path).collect() == []


def test_sequences_need_whole_mask_bytes():
    with pytest.raises(ValueError):
        T.SequenceWriter(pa.BufferOutputStream(), np.dtype("<u2"), 12, 4)
