import gc
import weakref
import zlib

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from sediment.llm import packing, tokens
from sediment.llm.common import lean
from sediment.llm.packing import best_fit, best_fit_classes, pack_documents
from sediment.llm.tokenfiles import TokenFile, TokenFileWriter, read_token_files, token_file_digest, write_token_files
from sediment.llm.tokens import UnitEncoder
from tokenizers import Tokenizer

from tests.llm.conftest import ROWS

FILES = ("word_bpe_49k.json", "byte_bpe_50k.json")


def whole(name, texts):
    t = Tokenizer.from_file(P.path(name))
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


ENCODERS = {f: UnitEncoder(P.path(f), 12_000) for f in FILES}
WHOLE = {f: Tokenizer.from_file(P.path(f)) for f in FILES}


@pytest.mark.parametrize("name", FILES)
def test_strings_of_special_tokens(name):
    texts = ["hello <|endoftext|> world", "a<|endoftext|>b <|startoftext|>", "<|ENDOFTEXT|>", "<|endoftext|> <|endoftext|>", "<|endo ftext|>"]
    assert ENCODERS[name].ids(texts) == [np.array(WHOLE[name].encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert 50256 in np.frombuffer(ENCODERS[FILES[1]].ids(texts[:1])[0], "<u4")


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=400, deadline=None)
@given(st.text(st.one_of(st.sampled_from("ab Z'sÉé.\n\t \r\x1c\x85ǰ1²½ªµ_漢ß\x01<|>endoftxĠ̌"), st.characters(codec="utf-8")), max_size=40))
def test_units_encode_as_the_whole_text(name, text):
    assert ENCODERS[name].ids([text])[0] == np.array(WHOLE[name].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


@pytest.mark.parametrize("name", FILES)
@settings(max_examples=60, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from("abZ'sÉéİKª.,!?\n\t 12²½_漢ẞ<|>̌"), max_size=30)), max_size=8))
def test_texts_of_a_batch_encode_each_for_itself(name, texts):
    assert ENCODERS[name].ids(texts) == [np.array(WHOLE[name].encode(t or "", add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_a_dropped_encoder_is_freed_at_once():
    gc.disable()
    try:
        held = weakref.ref(tokens.encoder(P.path(FILES[0])))
        tokens.forget()
        assert held() is None
    finally:
        gc.enable()


def test_a_packing_that_keeps_no_tokenizer_drops_it_after_each_task():
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([1, 2], pa.int64()), "text": ["one two three", None]})
    kept, dropped = (lean(packing._packer(P.path(FILES[0]), 1, 64), before=False, after=after) for after in (False, True))
    want = list(kept(iter([batch])))
    assert tokens._encoders and list(dropped(iter([batch]))) == want and not tokens._encoders


def test_a_packing_that_keeps_no_tokenizer_gets_small_batches(spark, monkeypatch):
    real = packing._packer

    def bounded(*given):
        def pack(batches):
            def seen():
                for b in batches:
                    assert b.nbytes < 1.5 * packing.SMALL, b.nbytes
                    yield b

            return real(*given)(seen())

        return pack

    docs = spark.range(0, 3000, 1, 1).selectExpr("id as doc_id", "repeat('some words ', 300) as text")
    rows = packing.pack_documents(docs, P.path(FILES[0]), keep=True).count()
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    own = spark.conf.get(key)
    monkeypatch.setattr(packing, "_packer", bounded)
    assert packing.pack_documents(docs, P.path(FILES[0]), keep=False).count() == rows == 3000 and spark.conf.get(key) == own


class Asked:
    def __init__(self, model):
        self.model, self.words = model, []

    def tokenize(self, word):
        self.words.append(word.strip("Ġ"))
        return self.model.tokenize(word)


@pytest.mark.parametrize("name", FILES)
def test_a_word_with_whatever_marks_is_encoded_once(name):
    encoder = UnitEncoder(P.path(name))
    encoder.model = asked = Asked(encoder.model)
    texts = ["so oddword, oddword. oddword; oddword? oddword! oddword: oddword", "so oddword... oddword, " * 3]
    assert encoder.ids(texts) == [np.array(i, "<u4").tobytes() for i in whole(name, texts)]
    assert asked.words.count("oddword") == 1


def test_words_that_come_again_are_remembered_before_those_that_came_once():
    room = tokens._Room(100_000)
    known = tokens._Known(str.encode, room)
    for k in range(2000):  # far more than there is room for
        known[f"once{k}"], known["a" * (max(0, k - 600) % 50 + 1)]
    assert all("a" * k in known for k in range(1, 51)) and room.held <= 65_000


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_fills_bins_without_gaps(sizes):
    bins, offsets, held = best_fit(np.array(sizes, np.int64), 64)
    for b, total in enumerate(held):
        inside = sorted((offsets[i], sizes[i]) for i in range(len(sizes)) if bins[i] == b)
        assert total <= 64 and sum(n for _, n in inside) == total
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
    assert sum(2 * h <= 64 for h in held) <= 1  # two half-empty bins would have been one


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(1, 64), max_size=200))
def test_best_fit_of_classes_is_best_fit(sizes):
    counts = {n: sizes.count(n) for n in sizes}
    rows = best_fit_classes(counts, 64)
    bins = {}
    for held, first, n, number, offset in rows:
        for k in range(n):
            bins.setdefault(number + k, []).append((offset, held, first + k))
    assert sorted((h, i) for b in bins.values() for _, h, i in b) == sorted((n, i) for n in counts for i in range(counts[n]))
    for b in bins.values():
        b.sort()
        assert [o for o, _, _ in b] == [sum(h for _, h, _ in b[:k]) for k in range(len(b))] and sum(h for _, h, _ in b) <= 64
    assert sorted(sum(h for _, h, _ in b) for b in bins.values()) == sorted(best_fit(np.array(sizes, np.int64), 64)[2].tolist())


def test_packing_over_many_tasks_ends_as_over_one(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(16)
    monkeypatch.setattr(packing, "ITEMS_PER_TASK", 5)
    rows = pack_documents(docs, P.path(FILES[0]), 4096, 1).collect()
    held, placed = {}, {}
    for r in rows:
        held[r["sequence_id"]] = held.get(r["sequence_id"], 0) + r["length"]
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in placed.values():
        inside.sort()
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))]
    low = sorted(held.values())
    assert max(low) <= 4096 and low[0] + low[1] > 4096  # no two fit together


def test_packing(spark, odd, nothing):
    rows = pack_documents(odd, P.path(FILES[0]), 64, 1).collect()
    ids = whole(FILES[0], [t for _, t in ROWS])
    want = sorted((d if d is not None else -1, k, a, len((i + [1])[a : a + 64]), zlib.crc32(np.array((i + [1])[a : a + 64], "<u4").tobytes())) for (d, _), i in zip(ROWS, ids) for k, a in enumerate(range(0, len(i) + 1, 64)))
    assert sorted((r["doc_id"] if r["doc_id"] is not None else -1, r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == want
    placed = {}
    for r in rows:
        placed.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for inside in placed.values():
        inside.sort()
        assert [o for o, _ in inside] == [sum(n for _, n in inside[:k]) for k in range(len(inside))] and sum(n for _, n in inside) <= 64
    assert pack_documents(nothing, P.path(FILES[0]), 64, 1).count() == 0


def test_packing_merges_over_partitions(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").repartition(16)
    rows = pack_documents(docs, P.path(FILES[0]), 4096, 1).collect()
    least = -(-sum(r["length"] for r in rows) // 4096)
    assert len({r["sequence_id"] for r in rows}) <= least + 2


def test_token_files_round_trip(spark, odd, nothing, tmp_path):
    manifest = write_token_files(odd, f"file://{tmp_path}/t", P.path(FILES[1]), 0)
    back = token_file_digest(manifest).collect()
    order = sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    ids = [i + [0] for i in whole(FILES[1], [t for _, t in order])]
    start = 0
    got = sorted((r["start"], r["doc_id"] if r["doc_id"] is not None else -1, r["n_tokens"], r["ids_crc32"]) for r in back)
    for (d, _), i, g in zip(order, ids, got, strict=True):
        assert g == (start, d if d is not None else -1, len(i), zlib.crc32(np.array(i, "<u4").tobytes()))
        start += len(i)
    only = read_token_files(manifest, [1, 10]).collect()
    assert {r["doc_id"] for r in only} == {1, 10}
    assert write_token_files(nothing, f"file://{tmp_path}/n", P.path(FILES[1]), 0).count() == 0


def test_token_file_layout(tmp_path):
    import zstandard

    path = str(tmp_path / "x.tok.zst")
    out = TokenFileWriter(path, 2)
    docs = [(5, [1, 2, 3]), (None, []), (7, list(range(65536)) * 20)]
    for d, i in docs:
        out.add(d, np.array(i, "<u4").tobytes())
    out.close()
    file = TokenFile(path)
    assert [d[0] for d in file.docs] == [5, None, 7] and file.docs[2][3] == 2
    assert all(file.ids(k).tolist() == i for k, (_, i) in enumerate(docs))
    raw = (tmp_path / "x.tok.zst").read_bytes()
    plain = zstandard.ZstdDecompressor().stream_reader(raw, read_across_frames=True).read()
    assert plain == b"".join(np.array(i, "<u2").tobytes() for _, i in docs)  # any decoder reads it
    first = int(file.starts[1])
    (tmp_path / "y").write_bytes(raw[: first + 12] + bytes([raw[first + 12] ^ 1]) + raw[first + 13 :])
    with pytest.raises(Exception):
        TokenFile(str(tmp_path / "y")).ids(0)
    with pytest.raises(ValueError):
        TokenFileWriter(str(tmp_path / "z"), 2).add(1, np.array([70000], "<u4").tobytes())
