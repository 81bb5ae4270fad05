import zlib

import numpy as np

from churnforge.llm import packing
from churnforge.llm.tokens import word_bpe


def check_places(rows, size):
    by = {}
    for r in rows:
        by.setdefault(r.sequence_id, []).append(r)
    for g in by.values():
        end = 0
        for r in sorted(g, key=lambda r: r.offset):
            assert r.offset == end
            end += r.length
        assert end <= size
    return len(by)


def test_pieces_and_places(spark, docs_of, odd_rows):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(word_bpe())
    rows = packing.pack_documents(docs_of(odd_rows), word_bpe(), size=512).collect()
    want = []
    for i, t in odd_rows:
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [0], "<u4")
        want += [(str(i), k, a, len(ids[a:a + 512]), zlib.crc32(ids[a:a + 512].tobytes())) for k, a in enumerate(range(0, len(ids), 512))]
    assert sorted((str(r.doc_id), r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(want)
    check_places(rows, 512)
    assert packing.pack_documents(docs_of(odd_rows).limit(0), word_bpe()).count() == 0


def test_few_sequences(spark):
    rng = np.random.default_rng(0)
    lengths = np.minimum(2047, np.maximum(1, rng.lognormal(6.4, 0.9, 6000).astype(int)))
    sequence, offset = packing.sum_of_squares(lengths, 2048)
    assert len(set(sequence.tolist())) <= 1.01 * -(-lengths.sum() // 2048)
    for s in range(50):
        own = sequence == s
        order = np.argsort(offset[own])
        assert (offset[own][order] == np.cumsum(lengths[own][order]) - lengths[own][order]).all()


def test_each_choice_has_the_smallest_sum_of_squares():
    rng = np.random.default_rng(1)
    lengths = np.sort(rng.integers(1, 40, 120))[::-1].copy()
    sequence, _ = packing.sum_of_squares(lengths, 40)
    used = {}
    for s, q in zip(lengths.tolist(), sequence.tolist()):
        def squares(to):
            gaps = [40 - u - (s if k == to else 0) for k, u in used.items()] + ([40 - s] if to not in used else [])
            return sum(gaps.count(g) ** 2 for g in set(gaps) if g)
        fits = [k for k, u in used.items() if u + s <= 40]
        assert (q not in used) == (not fits)
        if fits:
            assert squares(q) == min(squares(k) for k in fits)
        used[q] = used.get(q, 0) + s


def test_blocks(spark, docs_of):
    rows = [(i, "word " * (i % 50 + 1)) for i in range(300)]
    pieces = packing.cut_pieces(docs_of(rows), word_bpe(), 0, 64)
    n = check_places(packing.pack(pieces, 64, block=100).collect(), 64)
    assert n <= 1.1 * check_places(packing.pack(pieces, 64).collect(), 64)


def test_ids_on_request(spark, docs_of):
    r = packing.pack_documents(docs_of([(1, "two words")]), word_bpe(), with_ids=True).first()
    assert r.ids[-1] == 0 and len(r.ids) == r.length
