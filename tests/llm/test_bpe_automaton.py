import hashlib
import json
import random

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st

from churnforge.llm import bpe_automaton
from churnforge.llm.bpe_automaton import START, Automaton
from churnforge.llm.tokens import word_bpe

ODD = ["it's I'LL don't <|endoftext|> foo<|endoftext|>Bar 'S 123 ½x ² soft­hyphen", "a\x00b\x85c\xa0d　e", "Σας ΣΑΣ naïve İstanbul é",
       "<|startoftext|><|endoftext|>", "x" * 3000 + " " + "ab" * 300, "llllmente ciónrrrrbo ........ !!!!!!!", "\U0001f600" * 40, "'s"]


def merge_all(symbols, merges):
    """BPE by its definition: the merges in their order, each from left to right."""
    for u, v in merges:
        out = []
        for s in symbols:
            if out and out[-1] == u and s == v:
                out[-1] = u + v
            else:
                out.append(s)
        symbols = out
    return symbols


def explicit(base, merges):
    """The automaton with all its states and arcs, gadget by gadget: (arcs of every state, state behind each token)."""
    arcs, to = [set(base)], {b: 0 for b in base}
    for u, v in merges:
        if u not in to or v not in arcs[to[u]]:
            continue
        q = to[u]
        with_u = [p for p in range(len(arcs)) if u in arcs[p]]
        behind_v = to[v]
        arcs.append(arcs[q] - {v})
        if u in arcs[q] and u != v:
            with_u.append(len(arcs) - 1)
        for p in with_u:
            arcs[p].add(u + v)
        to[u], to[u + v] = len(arcs) - 1, behind_v
    return arcs, to


@st.composite
def vocabularies(draw):
    base = ["a", "b", "c", "a$", "b$", "c$"]
    tokens, merges = list(base), []
    for _ in range(draw(st.integers(0, 14))):
        u = draw(st.sampled_from([t for t in tokens if not t.endswith("$")]))
        v = draw(st.sampled_from(tokens))
        if u + v not in tokens:
            tokens.append(u + v)
            merges.append((u, v))
    return base, tokens, merges


@settings(max_examples=150, deadline=None)
@given(vocabularies(), st.lists(st.text("abc", min_size=1, max_size=14), min_size=1, max_size=12))
def test_gadgets_and_encoding(vocabulary, words):
    base, tokens, merges = vocabulary
    number = {t: i for i, t in enumerate(tokens)}
    own = Automaton(number, merges, "$")
    arcs, to = explicit(base, merges)
    made = [t for t in tokens if t in to]
    for t in [t for t in made if not t.endswith("$")]:
        for y in made:
            assert own.has_arc(number[t], number[y]) == (y in arcs[to[t]])
        assert own.has_arcs(np.full(len(made), number[t]), np.array([number[y] for y in made])).tolist() == [y in arcs[to[t]] for y in made]
    assert all(own.has_arc(START, number[y]) == (y in arcs[0]) for y in made)
    ids, n = own.encode_words([w.encode() for w in words])
    for w, a, b in zip(words, np.cumsum(n) - n, np.cumsum(n)):
        want = merge_all([*w[:-1], w[-1] + "$"], merges)
        assert [tokens[i] for i in ids[a:b]] == want
        assert [tokens[i] for i in own.encode_word(own.symbols([w.encode()])[0].tolist())] == want


def test_same_ids_as_the_library(odd_rows, monkeypatch):
    from tokenizers import Tokenizer

    full = Tokenizer.from_file(word_bpe())
    own = bpe_automaton.encoder(word_bpe())
    assert len(own.automaton.gadget) == len(json.load(open(word_bpe()))["model"]["merges"])
    rng = random.Random(5)
    random_words = ["".join(rng.choice("abelmnorst'é1!.-") for _ in range(rng.randint(1, 20))) for _ in range(3000)]
    texts = [t or "" for _, t in odd_rows] + ODD + [" ".join(random_words)]
    for long_word in (bpe_automaton.LONG_WORD, 3):
        monkeypatch.setattr(bpe_automaton, "LONG_WORD", long_word)
        own._clear()
        ids, n = own.encode(pa.array(texts))
        for t, a, b in zip(texts, np.cumsum(n) - n, np.cumsum(n)):
            assert ids[a:b].tolist() == full.encode(t, add_special_tokens=False).ids


def test_whole_query_against_the_library(spark, docs_of, odd_rows):
    from tokenizers import Tokenizer
    from churnforge.llm.queries import digest_tokens

    full = Tokenizer.from_file(word_bpe())
    rows = [*odd_rows, *enumerate(ODD, 100)]
    got = sorted(map(tuple, digest_tokens(docs_of(rows).repartition(3)).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for i, t in rows:
        ids = full.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(),
                     hashlib.sha256(full.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=str)
    assert digest_tokens(docs_of(rows).limit(0)).count() == 0


def test_wrong_order_of_merges_is_refused():
    with pytest.raises(ValueError):
        Automaton({"a": 0, "b": 1, "c": 2, "ab": 3, "abc": 4}, [("ab", "c"), ("a", "b")], "")
