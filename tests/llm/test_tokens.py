import zlib

import numpy as np
import pyarrow as pa
from hypothesis import example, given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from threadloom.llm import packing, rans, tokenfile, tokens
from threadloom.operators.cutting import Workspace

from . import cases


TOKENIZER = Tokenizer.from_file(tokens.vocabulary_path())


def whole(texts):
    return [np.array([*TOKENIZER.encode(t or "", add_special_tokens=False).ids, tokens.END_ID], "<u4") for t in texts]


PIECES = [*"abAB É éİΣσ'’.,!|*#<>\n\t\u00a0\u0301\u2028\u0338\u212a\u0958\u0915\u093c ßfi9٣😀ſ", "<|endoftext|>", "<|startoftext|>", "<|", "'s"]
FIXED = ["İ.", "xİ!", "<|endoftext|>", "<|startoftext|>", "a <|endoftext|> b", "x<|endoftext|>y.", "Don't<|startoftext|>!!", "<|ENDOFTEXT|>.",
         "\u0958!", "e\u0301.", "A.<|endoftext|>"]


@settings(max_examples=2000, deadline=None)
@example(FIXED)
@given(st.lists(st.lists(st.sampled_from(PIECES), max_size=25).map("".join), min_size=1, max_size=4))
def test_words_encode_like_whole_texts(texts):
    ends, ids = tokens.Encoder.of(tokens.vocabulary_path()).encode(pa.array(texts, pa.large_string()))
    for a, b, want in zip(ends, ends[1:], whole(texts)):
        assert ids[a:b].tolist() == want.tolist()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 500), max_size=900), st.integers(1, 40), st.integers(1, 9))
def test_blocks_round_trip_from_any_checkpoint(ids, lanes, stride):
    ids = np.array(ids, np.uint16)
    table = rans.Frequencies.of_counts(np.bincount(ids, minlength=600))
    block = rans.encode(ids, table, lanes, stride)
    assert rans.decode(block, table).tolist() == ids.tolist()
    marks = rans.HEADER.unpack_from(block)[4]
    parts = [rans.decode(block, table, m, m + 1) for m in range(marks)]
    assert np.concatenate([np.zeros(0), *parts]).tolist() == ids.tolist()


def test_damage_is_found():
    ids = np.arange(500, dtype=np.uint16)
    table = rans.Frequencies.of_counts(np.bincount(ids))
    block = bytearray(rans.encode(ids, table, 8))
    block[-1] ^= 1
    try:
        rans.decode(bytes(block), table)
    except ValueError:
        return
    raise AssertionError("damage went unseen")


def test_files_and_packing_hold_every_id_once(spark):
    docs = cases.documents(spark, [cases.prose(i, 40 * i) for i in range(30)])
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    want = dict(zip([d for d, _ in rows], whole([t for _, t in rows])))
    folder = Workspace(spark, "test").path("files")
    tokenfile.write(docs, folder)
    read = sorted(tokenfile.read(spark, folder, with_ids=True).collect(), key=lambda r: r.start)
    assert len(read) == len(rows) and [r.doc_id for r in read if r.doc_id] == sorted(d for d, _ in rows if d)
    at = 0
    for r in read:
        assert r.start == at and np.frombuffer(r.ids, "<u4").tolist() == want[r.doc_id].tolist()
        assert r.ids_crc32 == zlib.crc32(want[r.doc_id].tobytes())
        at += r.n_tokens
    pieces = packing.pack(docs, size=256, with_ids=True).collect()
    sequences = {}
    for p in pieces:
        assert p.doc_tokens == len(want[p.doc_id]) and p.length > 0
        assert tokens.unpack(p.ids).tolist() == want[p.doc_id][p.start:p.start + p.length].tolist()
        sequences.setdefault(p.sequence_id, []).append((p.offset, p.length))
    assert sum(p.length for p in pieces) == at
    for number, own in sequences.items():
        end = 0
        for offset, length in sorted(own):
            assert offset == end
            end += length
        assert end == 256 or number == max(sequences)
    for r in packing.padding(packing.pack(docs, size=256), 256).collect():
        assert r.n_ids + r.padding == 256 or r.n_ids & (r.n_ids - 1) == 0
    assert packing.pack(cases.empty(spark)).count() == 0
    empty = Workspace(spark, "test").path("files")
    tokenfile.write(cases.empty(spark), empty)
    assert tokenfile.read(spark, empty).count() == 0
