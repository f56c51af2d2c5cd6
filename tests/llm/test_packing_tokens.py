import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from paraspark.llm import packing as P
from paraspark.llm import range_coder as R
from paraspark.llm import token_output as O
from paraspark.llm import tokens
from tests.llm.helpers import docs, parquet_rows

TOK = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
ODD = ["", None, "It's the dog's, they'll've 'S 'T", "ÉÀ straße İstanbul ΣΑΣ", "é ́x Å", "tab\tnl\n\r\x0b\x0c\x1c\x1d x\x85y\xa0z w",
       "<|endoftext|> a<|startoftext|>b <|ENDOFTEXT|>", "12 ³ ½ 7x8 ×÷ ªº", "日本語 🙂🙂 emoji", "a" * 500, "!!??..,,'''", "x" * 3 + " " * 1000 + "y"]


def ids(t):
    return TOK.encode(t or "", add_special_tokens=False).ids + [2]


def test_chunked_ids_equal_the_library():
    of = tokens.Ids(tokens.default_path(), cache_entries=16)
    assert of.by_chunk
    for t in ODD:
        assert of.array(t, 2).tolist() == ids(t), repr(t)


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from("aZé'sS tmllrveçÖß.,!1²\n\t́<|>"), st.characters(codec="utf-8")), max_size=60))
def test_chunked_ids_random(t):
    assert tokens.shared(tokens.default_path()).array(t, 2).tolist() == ids(t)


def test_ids_of_many_texts(monkeypatch):
    """op6's CPU: a chunk is looked up once for many texts; the ids are those of
    each text alone, however the texts are sliced and whatever the cache holds."""
    import pyarrow as pa
    texts = [None, *ODD, *ODD, None, ""]
    want = [ids(t) for t in texts]
    for slice_bytes in (1, 40, 8 << 20):
        monkeypatch.setattr(tokens, "SLICE_BYTES", slice_bytes)
        for kind in (pa.string(), pa.large_string()):
            of = tokens.Ids(tokens.default_path(), cache_entries=16)
            assert [v.tolist() for v in of.arrays(pa.array(texts, kind), 2)] == want
            assert [v.tolist() for v in of.arrays(pa.array(["dropped", *texts], kind).slice(1), 2)] == want
            assert list(of.arrays(pa.array([], kind), 2)) == []
            assert [v.tolist() for v in of.arrays(pa.array([None, None], kind), 2)] == [[2], [2]]
    of = tokens.Ids(tokens.default_path())
    asked = []

    class Asked(type(of._chunks)):
        def __getitem__(self, chunk):
            asked.append(chunk)
            return super().__getitem__(chunk)
    of._chunks.__class__ = Asked
    list(of.arrays(pa.array(["one two one", "two\none"] * 50), 2))
    assert sorted(asked) == ["one", "two"]
    of.by_chunk = False
    assert [v.tolist() for v in of.arrays(pa.array(texts), 2)] == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(alphabet=st.one_of(st.sampled_from("aZé'sS ªµß×ÿ,1²\n\t<|>"), st.characters(codec="utf-8")), max_size=30)), max_size=6))
def test_ids_of_many_texts_random(texts):
    import pyarrow as pa
    of = tokens.shared(tokens.default_path())
    assert [v.tolist() for v in of.arrays(pa.array(texts, pa.string()), 2)] == [ids(t) for t in texts]


def check_pieces(rows, texts):
    """``texts``: list of (doc_id, text); every id in exactly one piece."""
    want = defaultdict(list)
    for i, t in texts:
        want[i].append(np.array(ids(t), "<u4"))
    windows = defaultdict(list)
    by_doc = defaultdict(list)
    for r in rows:
        windows[r.sequence_id].append(r)
        by_doc[r.doc_id].append(r)
    for w in windows.values():
        at = 0
        for r in sorted(w, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert 0 < at <= P.WINDOW
    for i, arrays in want.items():
        assert sum(r.length for r in by_doc[i]) == sum(map(len, arrays))
        if len(arrays) == 1:
            at = 0
            for r in sorted(by_doc[i], key=lambda r: r.start):
                assert r.start == at and r.doc_tokens == len(arrays[0])
                assert r.ids_crc32 == zlib.crc32(arrays[0][at:at + r.length].tobytes())
                at += r.length
    return windows


def test_packing_round_trip(spark, sf_small):
    rows = parquet_rows(spark, sf_small, "documents")
    windows = check_pieces(P.pack(rows).collect(), [(r.doc_id, r.text) for r in rows.collect()])
    full = [sum(r.length for r in w) for w in windows.values()]
    assert sum(P.WINDOW - f for f in full) <= P.WINDOW * max(1, rows.rdd.getNumPartitions())


def test_packing_edge_cases(spark):
    texts = list(enumerate(ODD)) + [(None, "no id"), (50, "twice"), (50, "twice"), (60, "word " * 30_000)]
    check_pieces(P.pack(docs(spark, texts, extra=True)).collect(), texts)
    assert P.pack(docs(spark, [])).count() == 0


def test_sum_of_squares_choice():
    """The chosen level adds least to the sum of squared counts (brute force)."""
    rng = np.random.default_rng(3)
    out = []
    p = P.Packer(64, 1000, out.append)
    for n in rng.integers(1, 64, 400):
        def squares(level, n=int(n)):
            c = p.count.copy()
            if level:
                c[level] -= 1
            if level + n < 64:
                c[level + n] += 1
            return int((c * c).sum())
        options = [0] + [h for h in range(1, 64 - int(n) + 1) if p.count[h]]
        got = p._level(int(n))
        assert got in options and squares(got) == min(map(squares, options))
        p.add(1, np.arange(int(n), dtype=np.uint16))
    p.close()
    assert sum(len(x[2]) for w in out for x in w) % 64 == sum(len(x[2]) for x in out[-1]) % 64
    assert sum(1 for w in out if sum(len(x[2]) for x in w) < 64) <= 1


def test_few_open_windows():
    out = []
    p = P.Packer(64, 3, out.append)
    rng = np.random.default_rng(4)
    sizes = rng.integers(1, 200, 300)
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype=np.uint16))
        assert p.n_open <= 4
    p.close()
    got = defaultdict(dict)
    for w in out:
        for i, start, x, n in w:
            got[i][start] = x
    for i, n in enumerate(sizes):
        assert np.concatenate([got[i][s] for s in sorted(got[i])]).tolist() == list(range(n))


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 70_000), min_size=1, max_size=300), min_size=1, max_size=6))
def test_range_coder_round_trip(blocks):
    data = R.encode_blocks([np.array(b) for b in blocks])
    assert [x.tolist() for x in R.decode_blocks(data)] == blocks
    assert [R.decode_blocks([d])[0].tolist() for d in data] == blocks  # each on its own


def test_range_coder_long_and_compressing():
    rng = np.random.default_rng(0)
    blocks = [np.tile(rng.integers(0, 49_000, 50), 200), rng.integers(0, 49_000, 3000), np.full(20_000, 7), np.array([0])]
    data = R.encode_blocks(blocks)
    assert all((a == b).all() for a, b in zip(R.decode_blocks(data), blocks))
    assert len(data[0]) < 0.4 * 2 * len(blocks[0]) and len(data[2]) < 1000
    assert R.encode_blocks([]) == [] and R.decode_blocks([]) == []


def test_range_coder_more_blocks_than_lanes():
    rng = np.random.default_rng(5)
    blocks = [rng.integers(0, 300, n) for n in rng.integers(1, 4, R.LANES + 500)]
    assert all((a == b).all() for a, b in zip(R.decode_blocks(R.encode_blocks(blocks)), blocks))


def test_range_coder_detects_damage():
    import pytest
    d = bytearray(R.encode_blocks([np.arange(100)])[0])
    d[-3] ^= 1
    with pytest.raises(ValueError):
        R.decode_blocks([bytes(d)])


def token_rows(spark, texts, tmp_path, **params):
    path = str(tmp_path / "ids")
    O.write_ids(docs(spark, texts, extra=True), path, **params)
    return O.read_documents(spark, path).collect()


def test_token_files(spark, tmp_path):
    texts = [(100 - i, t) for i, t in enumerate(ODD)] + [(200, "word other " * 9000), (7, "x y z")]
    got = {r.doc_id: r for r in token_rows(spark, texts, tmp_path, block_ids=40, wave_ids=100)}
    at = 0
    for i, t in sorted(texts):
        want = np.array(ids(t), "<u4")
        assert (got[i].start, got[i].n_tokens, got[i].ids_crc32) == (at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)


def test_token_files_null_and_repeated_ids(spark, tmp_path):
    texts = [(None, "a"), (3, "b c"), (3, "b c"), (1, "d")]
    got = sorted((r.start, r.doc_id, r.n_tokens) for r in token_rows(spark, texts, tmp_path))
    assert [x[1] for x in got] == [None, 1, 3, 3]
    assert [x[0] for x in got] == [0, 2, 4, 7]


def test_token_files_empty(spark, tmp_path):
    assert token_rows(spark, [], tmp_path) == []


def test_range_coder_long_block_beside_short_ones():
    """Memory follows the ids, not the longest block times the lanes."""
    import tracemalloc
    r = np.random.default_rng(5)
    blocks = [r.integers(0, 50, 300).astype(np.uint32) for _ in range(600)] + [r.integers(0, 50, 20_000).astype(np.uint32)]
    peaks = []
    for code, x in ((R.encode_blocks, blocks), (R.decode_blocks, R.encode_blocks(blocks))):
        tracemalloc.start()
        out = code(x)
        peaks.append(tracemalloc.get_traced_memory()[1])
        tracemalloc.stop()
    assert all((a == b).all() for a, b in zip(out, blocks))
    assert max(peaks) < 35_000_000, peaks
    for lengths in ([1_000_000, 900_000, 300_000] + [8192] * 3000 + [5], [1] * 5000, [CELLS := R.CELLS + 1, CELLS, 7], []):
        batches = R._batches(lengths)
        assert sorted(i for b in batches for i in b) == list(range(len(lengths)))
        assert all(len(b) == 1 or len(b) <= R.LANES and len(b) * max(lengths[i] for i in b) <= R.CELLS for b in batches)


def test_cache_bound_changes_no_piece(spark, monkeypatch):
    """op3's workers, which only pack, hold more words than the default bound;
    the bound changes no row."""
    texts = [(i, " ".join(f"w{i}x{j}, {ODD[j % len(ODD)] or ''}" for j in range(40))) for i in range(30)]
    d = docs(spark, texts).coalesce(1)
    few, many = (sorted(P.pack(d, cache_entries=n).collect()) for n in (16, P.PACK_CACHE))
    assert few == many
    check_pieces(few, texts)
    taken = {}
    monkeypatch.setattr(P, "table", lambda *_: d)
    monkeypatch.setattr(P, "pack", lambda df, **kw: taken.update(kw))
    P.op3_sum_of_squares_packing(spark, "")
    assert taken["cache_entries"] > tokens.CACHE_ENTRIES


def test_range_coder_steps_do_not_grow_with_the_ids(monkeypatch):
    """op6's CPU: a block's ids are coded many at a step, in lanes that share
    its models (before, one id of a block at a step)."""
    steps = []
    predict = R._Model.predict
    monkeypatch.setattr(R._Model, "predict", lambda self, *a: (steps.append(1), predict(self, *a))[1])
    r = np.random.default_rng(6)
    block = np.repeat(r.integers(0, 40_000, 30_000), 3)[: 60_011].astype(np.uint16)
    data = R.encode_blocks([block])
    assert (R.decode_blocks(data)[0] == block).all()
    assert len(steps) <= 2 * 1000


def test_range_coder_same_bytes_in_any_company():
    r = np.random.default_rng(7)
    blocks = [r.integers(0, r.integers(1, 70_000), n) for n in (1, 2, 15, 16, 17, 1000, 1023, 1500, 2000, 40_000)] + [np.array([2**32 - 1, 0])]
    together = R.encode_blocks(blocks)
    assert together == [R.encode_blocks([b])[0] for b in blocks]
    assert all((a == b).all() for a, b in zip(R.decode_blocks(together), blocks))


def test_token_files_read_in_bounded_waves(spark, tmp_path, monkeypatch):
    """Blocks of one Arrow batch are decoded a wave at a time."""
    path = str(tmp_path / "ids")
    texts = [(i, f"w{i} " * (i % 7 * 20)) for i in range(60)]
    O.write_ids(docs(spark, texts).coalesce(1), path, block_ids=100, wave_ids=400)
    want = sorted(map(tuple, O.read_documents(spark, path).collect()))
    monkeypatch.setattr(O, "WAVE_IDS", 150)
    held, decode = [], R.decode_blocks
    monkeypatch.setattr(R, "decode_blocks", lambda data: (held.append([R.HEADER.unpack_from(d)[1] for d in data]), decode(data))[1])
    monkeypatch.setattr(O, "map_arrow", lambda df, fn, schema: spark.createDataFrame(
        [tuple(x.values()) for b in fn(df.toArrow().to_batches()) for x in b.to_pylist()], schema))
    assert sorted(map(tuple, O.read_documents(spark, path).collect())) == want
    assert len(held) > 5 and all(len(h) == 1 or sum(h) <= 150 for h in held)
