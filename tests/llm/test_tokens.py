import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reconlake.llm.packing import OpenWindows, best_fit_decreasing, pack_documents, top_up
from reconlake.llm.token_counts import count_tokens
from reconlake.llm.token_files import token_files, write_token_files
from reconlake.llm.tokens import TextEncoder, WordEncoder, default_tokenizer_path, drops_white_space


def library_ids(text):
    return TextEncoder(default_tokenizer_path())._ids([text or ""])[0]


def lists(encoder, texts):
    return [ids[a:z].tolist() for ids, b in encoder.encode(pa.array(texts, pa.string())) for a, z in zip(b[:-1], b[1:], strict=True)]


def test_chunks_give_the_librarys_ids():
    path, rng = default_tokenizer_path(), random.Random(1)
    assert drops_white_space(path)
    points = [chr(c) for c in range(0x3000) if not 0xD800 <= c <= 0xDFFF]
    texts = [f"Ab{c}cD {c} x{c}9 '{c}s" for c in points]
    parts = ["a", "É", "'s", "'ll", "é", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", " ", "́", "Σ", "9", "²", "!!", "\t", "\x0b", "\x1c", "\x85", "İ", "ẞ", "你", "😀", "’"]
    texts += ["".join(rng.choice(parts) for _ in range(rng.randint(0, 30))) for _ in range(3000)] + [None, ""]
    for most in (600_000, 50):  # also with a table that is forgotten again and again
        assert lists(WordEncoder(path, most), texts) == lists(TextEncoder(path), texts)
    assert WordEncoder(path).count(pa.array(texts)).tolist() == TextEncoder(path).count(pa.array(texts)).tolist()


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_counts_of_awkward_rows(awkward, name):
    import public_tokenizers

    path = public_tokenizers.path(name)
    encoder = TextEncoder(path)
    got = sorted(map(str, map(tuple, count_tokens(awkward, path, limit=40).collect())))
    want = []
    for r in awkward.collect():
        n = len(encoder._ids([r.text or ""])[0])
        want.append(str((r.doc_id, len((r.text or "").encode()), n, n > 40)))
    assert got == sorted(want)


def test_empty_tables(empty):
    assert count_tokens(empty).count() == 0
    assert token_files(empty).count() == 0
    assert pack_documents(empty).count() == 0


@pytest.mark.parametrize("per_file", [4096, 5])
def test_token_files_round_trip(awkward, per_file):
    got = sorted((r.start, r.doc_id, r.n_tokens, r.ids_crc32) for r in token_files(awkward, docs_per_file=per_file).collect())
    rows = sorted(awkward.collect(), key=lambda r: (r.doc_id is not None, r.doc_id or 0))
    assert [g[1] for g in got] == [r.doc_id for r in rows]
    assert [g[0] for g in got] == np.cumsum([0, *[g[2] for g in got[:-1]]]).tolist()
    coded = lambda r: np.array([*library_ids(r.text), 2], "<u4")
    assert sorted((str(r.doc_id), len(coded(r)), zlib.crc32(coded(r))) for r in rows) == sorted((str(g[1]), g[2], g[3]) for g in got)


def test_writing_again_gives_the_same_files(awkward, tmp_path):
    first = write_token_files(awkward, f"file://{tmp_path}/a", docs_per_file=5)
    assert first == write_token_files(awkward, f"file://{tmp_path}/a", docs_per_file=5)
    assert len(list((tmp_path / "a").iterdir())) == 2 * len(first)


def test_tightest_window():
    rng = random.Random(2)
    tree, plain = OpenWindows(64), []
    for step in range(3000):
        if rng.random() < 0.6:
            capacity = rng.randint(1, 64)
            tree.add(step, capacity)
            plain.append(capacity)
        else:
            need = rng.randint(1, 64)
            fits = [c for c in plain if c >= need]
            found = tree.take(need)
            assert (found is None) == (not fits)
            if found:
                assert found[1] == min(fits)
                plain.remove(found[1])


def test_best_fit_decreasing_and_top_up():
    rng = random.Random(3)
    for _ in range(50):
        lengths = [rng.randint(1, 32) for _ in range(rng.randint(0, 60))]
        windows = best_fit_decreasing(lengths, 32)
        assert sorted(i for w in windows for i in w) == list(range(len(lengths)))
        assert all(sum(lengths[i] for i in w) <= 32 for w in windows)
        topped = top_up([[(i, 0, lengths[i]) for i in w] for w in windows], 32, 3)
        pieces = defaultdict(list)
        for w in topped:
            total = sum(x[2] for x in w)
            assert 32 - total < 3 or total & (total - 1) == 0
            for item, start, length in w:
                pieces[item].append((start, length))
        for item, length in enumerate(lengths):
            at = 0
            for start, n in sorted(pieces[item]):
                assert start == at
                at += n
            assert at == length


@pytest.mark.parametrize("per_block", [4096, 4])
def test_packing_keeps_every_id_once(awkward, per_block):
    pieces = pack_documents(awkward, sequence_tokens=64, least_gap=8, docs_per_block=per_block, keep_ids=True).collect()
    by_sequence = defaultdict(list)
    for p in pieces:
        by_sequence[p.sequence_id].append(p)
        assert zlib.crc32(p.ids) == p.ids_crc32 and len(p.ids) == 4 * p.length
    for ps in by_sequence.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 64 and {p.padding for p in ps} == {0 if at & (at - 1) == 0 else 64 - at} and max(p.padding for p in ps) < 8
    want = sorted((str(r.doc_id), np.array([*library_ids(r.text), 1], "<u4").tobytes()) for r in awkward.collect() if r.doc_id not in (2, 7))
    got = defaultdict(list)
    for p in pieces:
        if p.doc_id not in (2, 7):
            got[p.doc_id].append(p)
    assert sorted((str(d), b"".join(p.ids for p in sorted(ps, key=lambda p: p.start))) for d, ps in got.items()) == want
    assert sum(p.length for p in pieces) == sum(len(library_ids(r.text)) + 1 for r in awkward.collect())


@pytest.mark.parametrize("per_block", [4096, 3])
def test_pieces_sum_up_to_the_librarys_ids(spark, awkward, per_block):
    """Checksums of full windows come from the map over the texts, those of the rest from the packing."""
    docs = awkward.unionByName(awkward.where("doc_id = 2 OR doc_id IS NULL")).unionByName(spark.createDataFrame([(None, None)] * 30, "doc_id long, text string"), allowMissingColumns=True)
    pieces = defaultdict(list)
    for p in pack_documents(docs, sequence_tokens=64, least_gap=8, docs_per_block=per_block).collect():
        pieces[p.doc_id, p.doc_tokens].append((p.start, p.length, p.ids_crc32))
    coded = [(r.doc_id, np.array([*library_ids(r.text), 1], "<u4")) for r in docs.collect()]
    assert sum(n for ps in pieces.values() for _, n, _ in ps) == sum(len(c) for _, c in coded)
    for doc, ids in coded:
        assert all(any(zlib.crc32(c[s : s + n]) == crc for d, c in coded if d == doc and len(c) == len(ids)) for s, n, crc in pieces[doc, len(ids)])
        assert sum(n for _, n, _ in pieces[doc, len(ids)]) == sum(len(c) for d, c in coded if d == doc and len(c) == len(ids))


def test_rows_of_a_hot_id_are_dealt_to_several_parts(spark, tmp_path):
    docs = spark.createDataFrame([(None if i % 2 else 7 if i % 4 else i, f"w{i} x") for i in range(60)], "doc_id long, text string")
    parts = write_token_files(docs, f"file://{tmp_path}/hot", docs_per_file=5)
    assert len(parts) >= 10 and max(n for _, n, _, _ in parts) < 30
    got = token_files(docs, docs_per_file=5).orderBy("start").collect()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda d: (d is not None, d or 0)) and sorted(map(str, ids)) == sorted(str(r.doc_id) for r in docs.collect())


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "piece_bpe_32k.model"])
def test_pre_tokens_count_like_whole_texts(name):
    import public_tokenizers

    rng, encoder = random.Random(6), TextEncoder(public_tokenizers.path(name), max_pieces=40)
    parts = ["a", " the", "  ", " ", "\n", "\t", "É", "你好", "<|endoftext|>", "<s>", "▁", "x▁y", "12", "'s", "😀", "\u00a0", "word ", "\x00", "<unk>"]
    texts = ["".join(rng.choice(parts) for _ in range(rng.randint(0, 25))) for _ in range(1500)] + ["", " ", "▁", None]
    assert encoder.count(pa.array(texts, pa.string())).tolist() == [len(encoder._ids([t or ""])[0]) for t in texts]
