"""Operators 7 and 8, and the word-cached encoder below them."""

import io
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from ebbtide.llm import bitpack, packing, tokens
from tests.llm.conftest import rows

ENCODER = tokens.WordEncoder(cache_words=50)


def whole(texts):
    return [list(e.ids) for e in ENCODER._tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(max_size=40), st.text(alphabet="aéßÉ'’.,!st ve\n\t ́_0<|>endoftx", max_size=60)), max_size=8))
def test_words_give_the_ids_of_whole_texts(texts):
    ids, bounds = ENCODER.encode(pa.array(texts, pa.string()))
    assert [ids[a:b].tolist() for a, b in zip(bounds, bounds[1:])] == whole(texts)


@given(st.integers(2, 70000), st.integers(0, 100), st.randoms())
def test_bit_packing_round_trip(vocab, n, r):
    ids = np.array([r.randrange(vocab) for _ in range(n)], dtype="<u4")
    width = bitpack.bit_width(vocab)
    data = bitpack.pack(ids, width)
    assert len(data) == (n * width + 7) // 8 and bitpack.unpack(data, width, n).tolist() == ids.tolist()


def test_token_file_random_access():
    class File(io.BytesIO):
        def read_at(self, size, at):
            self.seek(at)
            return self.read(size)

    ids = np.arange(1000, dtype="<u4") % 300
    out = io.BytesIO()
    assert bitpack.write_ids(out, iter([(ids[:400], np.array([0, 400]), [5]), (ids[400:], np.array([0, 0, 600]), [None, 9])]), 300, block=64) == (3, 1000)
    tf = bitpack.TokenFile(File(out.getvalue()), len(out.getvalue()))
    assert tf.width == 9 and tf.documents["first"].tolist() == [0, 400, 400] and tf.documents["known"].tolist() == [1, 0, 1]
    for a, b in ((0, 0), (0, 1000), (63, 65), (999, 1000), (130, 700)):
        assert tf.ids(a, b).tolist() == ids[a:b].tolist()


def test_token_files_round_trip(docs, empty):
    want = sorted(((d is not None, d or 0, zlib.crc32(np.array(i + [1], "<u4").tobytes()), len(i) + 1) for (d, t, *_), i in zip(rows(), whole([r[1] for r in rows()]))))
    got = sorted(bitpack.token_files(docs).collect(), key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    assert [(r.doc_id is not None, r.doc_id or 0) for r in got] == [w[:2] for w in want]
    assert sorted((r.doc_id is not None, r.doc_id or 0, r.ids_crc32, r.n_tokens) for r in got) == want
    assert bitpack.token_files(empty).count() == 0


def test_differencing_covers_and_balances():
    sizes = np.array([8, 7, 6, 5, 4])
    assert sorted(np.bincount(packing.differencing(sizes, 2), sizes)) == [14, 16]  # the known result of the method
    many = np.random.default_rng(1).integers(1, 512, 500)
    loads = np.bincount(packing.differencing(many, 60), many, 60)
    assert loads.sum() == many.sum() and loads.max() - loads.min() <= 10
    assert np.bincount(packing.share_out(np.array([2048, 2048, 1]), 2048), [2048, 2048, 1]).max() <= 2048


def test_packing_holds_each_id_once(docs, empty):
    got = packing.pack(docs, group=8).collect()
    windows = defaultdict(list)
    for r in got:
        windows[r.sequence_id].append((r.offset, r.length))
        assert len(r.ids) == 4 * r.length > 0
    for held in windows.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 2048
    want = defaultdict(list)
    for (d, *_), ids in zip(rows(), whole([r[1] for r in rows()])):
        want[d].append(ids + [1])
    for d, texts in want.items():
        mine = [r for r in got if r.doc_id == d]
        assert sum(r.length for r in mine) == sum(map(len, texts)) and {r.doc_tokens for r in mine} == set(map(len, texts))
        if len(texts) == 1:
            assert b"".join(bytes(r.ids) for r in sorted(mine, key=lambda r: r.start)) == np.array(texts[0], "<u4").tobytes()
    assert packing.packed_digest(empty).count() == 0
