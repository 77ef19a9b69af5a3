import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from siltstone.llm import packing, token_output
from siltstone.llm.bpe_words import WordBpe, word_bpe
from siltstone.llm.token_output import EliasFano

WORD, BYTE = (public_tokenizers.path(n) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
ODD = ["", " ", "\n", "a  b", "a\n b", " a\nb", "x\x1cy", "café É", "中文 ß x", "don't 12 $%& <|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>Y <|END", "('tis) 'S x's' -- \"Quoted,\" ÀÉ's!", "\n(a)\nb's 'll", "a\r\nb\tc", "a \n \nb", "ΣΑΣ İ", "é x", "long " * 4000]


LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}


def plain(path, text):
    return LIBRARY[path].encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_word_cache_is_the_tokenizer(path):
    ids, at = word_bpe(path).encode_column(pa.array([*ODD, None]))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [*(plain(path, t) for t in ODD), []]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="ab Z'\n\té́İΣ中\x1c\xa0.,$1 ", max_size=24), max_size=6))
def test_word_cache_on_any_text(texts):
    for path in (WORD, BYTE):
        ids, at = word_bpe(path).encode_column(pa.array(texts, pa.string()))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain(path, t) for t in texts]


def test_small_cache_and_slices(monkeypatch):
    monkeypatch.setattr("siltstone.llm.bpe_words.SLICE", 50)
    small = WordBpe(WORD, entries=2)
    ids, at = small.encode_column(pa.array(ODD))
    assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain(WORD, t) for t in ODD]


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 5000), max_size=700))
def test_elias_fano(steps):
    values = np.cumsum(steps, dtype=np.int64)
    code = EliasFano.from_bytes(EliasFano.encode(values).to_bytes())
    assert code.values().tolist() == values.tolist()
    assert [code.select(i) for i in range(len(values))] == values.tolist()
    with pytest.raises(IndexError):
        code.select(len(values))


def test_elias_fano_is_small():
    bounds = np.arange(0, 1_000_000, 997)
    assert len(EliasFano.encode(bounds).to_bytes()) < len(bounds) * 2


def documents(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, ids string, start string")


def test_tokens_round_trip(spark, monkeypatch):
    monkeypatch.setattr(token_output, "SEGMENT_IDS", 64)
    rows = [(i * 3, t, "x", "clash", "clash") for i, t in enumerate(ODD)] + [(500, None, "x", "", ""), (None, "no id", "x", "", "")]
    got = token_output.op1(spark, documents(spark, rows), WORD).collect()
    found = {r.doc_id: r for r in got}
    start = 0
    for doc_id, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0])):
        ids = np.array([*plain(WORD, text or ""), 1], "<u4")
        assert (found[doc_id].start, found[doc_id].n_tokens, found[doc_id].ids_crc32) == (start, len(ids), zlib.crc32(ids))
        start += len(ids)


def test_tokens_of_nothing_and_of_repeats(spark):
    assert token_output.op1(spark, documents(spark, []), WORD).count() == 0
    assert [r.start for r in token_output.op1(spark, documents(spark, [(1, "a", "", "", "")] * 3), WORD).orderBy("start").collect()] == [0, 2, 4]


def test_read_one_document(spark, tmp_path):
    path = f"file://{tmp_path}/tokens"
    token_output.write_tokens(documents(spark, [(1, "one two", "", "", ""), (2, "three", "", "", "")]).coalesce(1), path, WORD, 1)
    segments = [r.asDict() for r in token_output.read_segments(spark, path).orderBy("start").collect()]
    ids = [token_output.read_ids(s, i).tolist() for s in segments for i in range(len(s["doc_ids"]))]
    assert ids == [[*plain(WORD, "one two"), 1], [*plain(WORD, "three"), 1]]


@settings(max_examples=30, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=400))
def test_plan_holds_every_piece(lengths):
    counts = np.bincount(np.array(lengths, int), minlength=65)
    held = np.zeros(65, int)
    for config, copies in packing.plan(counts, 64, rounds=20):
        assert copies > 0 and sum(a * n for a, n in config) <= 64
        for a, n in config:
            held[a] += n * copies
    assert (held == counts).all()


def test_plan_is_near_the_bound():
    rng = np.random.default_rng(3)
    counts = np.bincount(np.clip(rng.lognormal(3.5, 1, 20_000).astype(int), 1, 256), minlength=257)
    total = int(counts @ np.arange(257))
    assert sum(n for _, n in packing.plan(counts, 256, rounds=100)) <= 1.005 * -(-total // 256)


def test_the_program_beats_best_fit():
    for k in (1, 10, 300):
        counts = np.zeros(101, np.int64)
        counts[[51, 27, 26, 23]] = [6 * k, 6 * k, 6 * k, 12 * k]
        assert sum(n for _, n in packing.best_fit(counts, 100)) == 11 * k or k > 1
        assert sum(n for _, n in packing.plan(counts, 100)) <= 9 * k + (k > 1)


@settings(max_examples=25, deadline=None)
@given(st.lists(st.integers(1, 12), max_size=7))
def test_plan_is_optimal_where_it_can_be_counted(lengths):
    def fewest(rest, rooms):
        if not rest:
            return len(rooms)
        options = {r for r in rooms if r >= rest[0]}
        tries = [fewest(rest[1:], tuple(sorted([*rooms[: rooms.index(r)], *rooms[rooms.index(r) + 1 :], r - rest[0]]))) for r in options]
        return min([*tries, fewest(rest[1:], (*rooms, 12 - rest[0]))])

    got = sum(n for _, n in packing.plan(np.bincount(np.array(lengths, int), minlength=13), 12, rounds=40))
    assert got == fewest(sorted(lengths, reverse=True), ())


def test_knapsack():
    value = np.zeros(11)
    value[[3, 4, 5]] = [4.0, 5.0, 6.9]
    assert packing.best_configuration(value, np.full(11, 9), 10) == {5: 2}
    assert sum(n * k for n, k in packing.best_configuration(value, np.full(11, 1), 10).items()) <= 10
    assert packing.best_configuration(np.zeros(11), np.full(11, 1), 10) == {}


def test_packing(spark):
    rows = [(i, t, "", "", "") for i, t in enumerate(ODD)] + [(90, None, "", "", ""), (91, "word " * 3000, "", "", ""), (91, "word " * 3000, "", "", "")]
    got = packing.pack(documents(spark, rows), BYTE, capacity=128).collect()
    texts = {}
    for doc_id, text, *_ in rows:
        texts[doc_id] = np.array([*plain(BYTE, text or ""), 0], "<u4")
    assert sum(r.length for r in got) == sum(len(texts[r[0]]) for r in rows)
    for r in got:
        assert zlib.crc32(texts[r.doc_id][r.start : r.start + r.length]) == r.ids_crc32
        assert r.length == 128 or r.piece == 0
    by: dict = {}
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == by.get(r.sequence_id, 0)
        by[r.sequence_id] = r.offset + r.length
    assert max(by.values()) <= 128 and len(by) <= 1.1 * -(-sum(by.values()) // 128) + 1
    assert packing.pack(documents(spark, []), BYTE).count() == 0
