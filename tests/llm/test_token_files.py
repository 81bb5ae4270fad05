import zlib

import numpy as np
from hypothesis import given, settings, strategies as st

from churnforge.llm import token_files
from churnforge.llm.token_files import EliasFano, TokenFile
from churnforge.llm.tokens import Encoder, word_bpe


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2 ** 40), max_size=900), st.data())
def test_elias_fano_gives_every_value_back(values, data):
    values = sorted(values)
    code = EliasFano.of(np.array(values, dtype=np.int64))
    assert code.span(0, len(values)).tolist() == values
    if values:
        a = data.draw(st.integers(0, len(values) - 1))
        b = data.draw(st.integers(a, len(values)))
        assert code.span(a, b).tolist() == values[a:b] and code[a] == values[a]
        bits = 8 * (len(code.low) + len(code.high))
        assert bits <= len(values) * (3 + max(0, (values[-1] // len(values)).bit_length())) + 24


def test_encoder_matches_the_library(odd_rows):
    import pyarrow as pa
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(word_bpe())
    texts = [t or "" for _, t in odd_rows] + ["it's I'LL don't <|endoftext|> foo<|endoftext|>Bar 'S 123 ½x ² soft­hyphen", "a\x00b\x85c\xa0d　e", "Σας ΣΑΣ naïve İstanbul é"]
    ids, n = Encoder(word_bpe()).encode(pa.array(texts))
    ends = np.cumsum(n)
    for t, a, b in zip(texts, ends - n, ends):
        assert ids[a:b].tolist() == full.encode(t, add_special_tokens=False).ids


def test_files_read_back(spark, docs_of, odd_rows):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(word_bpe())
    files = token_files.write_token_files(docs_of(odd_rows).repartition(4), word_bpe(), end_id=1)
    got = token_files.read_token_files(files).collect()
    want = {}
    for i, t in odd_rows:
        ids = np.array(full.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    have = {}
    for r in got:
        have.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in have.items()} == {k: sorted(v) for k, v in want.items()}
    in_order = sorted(got, key=lambda r: r.start)
    assert [r.start for r in in_order] == np.cumsum([0] + [r.n_tokens for r in in_order])[:-1].tolist()
    ids = [r.doc_id for r in in_order]
    assert ids == [None] * 2 + sorted(i for i in ids if i is not None)
    row = next(r for r in got if r.doc_id == 12)
    f = TokenFile(row.path)
    assert f.document(row.place).tolist() == full.encode("two words").ids + [1]


def test_empty_table(spark, docs_of):
    assert token_files.read_token_files(token_files.write_token_files(docs_of([(1, "a")]).limit(0), word_bpe(), end_id=1)).count() == 0
