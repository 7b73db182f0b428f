import math
import random

import pytest
from hypothesis import example, given, settings
from hypothesis import strategies as st

from weftline.llm import pieces, wordpiece
from weftline.llm.queries import PIECES, TOKENIZERS

PATH = f"{TOKENIZERS}/{PIECES}"


def greedy(word, begin, inside):
    at, count = 0, 0
    while at < len(word):
        end = next((e for e in range(len(word), at, -1) if word[at:e] in (begin if at == 0 else inside)), None)
        if end is None:
            return wordpiece.UNKNOWN + 1
        at, count = end, count + 1
    return count


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.lists(st.text("abc", min_size=1, max_size=5), max_size=12), st.text("abcd", min_size=1, max_size=14))
def test_automaton_is_greedy_longest_match(begin, inside, word):
    machine = wordpiece.automaton(begin, inside)
    assert wordpiece.count_word(word, *machine) == greedy(word, set(begin), set(inside))


def test_counts_match_the_tokenizers_library(documents):
    from tokenizers import Tokenizer
    from tokenizers.models import WordPiece
    from tokenizers.pre_tokenizers import WhitespaceSplit

    begin, inside = wordpiece.vocabulary(PATH)
    vocab = {"[UNK]": 0}
    for t in [*begin, *("##" + p for p in inside)]:
        vocab.setdefault(t, len(vocab))
    tokenizer = Tokenizer(WordPiece(vocab, unk_token="[UNK]", max_input_chars_per_word=100_000))
    tokenizer.pre_tokenizer = WhitespaceSplit()
    texts = dict(documents.select("doc_id", "text").collect())
    for r in wordpiece.count_tokens(documents, begin, inside).collect():
        assert r.n_tokens == len(tokenizer.encode(texts[r.doc_id] or "").ids)


def test_odd_documents_counts(odd_docs, make_docs):
    begin, inside = wordpiece.vocabulary(PATH)
    rows = {r.doc_id: r for r in wordpiece.count_tokens(odd_docs, begin, inside).collect()}
    assert rows[1].n_tokens == rows[2].n_tokens == rows[3].n_words == 0
    assert rows[5].n_words == 60_000 and rows[5].n_tokens == 60_000 * wordpiece.count_word("word", *wordpiece.automaton(begin, inside))
    assert wordpiece.count_tokens(make_docs(), begin, inside).count() == 0


def brute_viterbi(part, pieces_scores, fallback):
    best = [0.0] + [-math.inf] * len(part)
    for end in range(1, len(part) + 1):
        for start in range(end):
            if part[start:end] in pieces_scores:
                best[end] = max(best[end], best[start] + pieces_scores[part[start:end]])
        if part[end - 1] not in pieces_scores:
            best[end] = max(best[end], best[end - 1] + fallback)
    return best[-1]


def small_model(vocabulary):
    rng = random.Random(2)
    names = ["<unk>", *vocabulary]
    scores = [0.0, *(-rng.random() * 5 - 0.1 for _ in vocabulary)]
    return [""] + vocabulary + [""] * 256, scores + [0.0] * 256, list(range(len(names), len(names) + 256))


@settings(max_examples=200, deadline=None)
@example(["▁▁"], " ")
@given(st.lists(st.text("ab▁", min_size=1, max_size=4), max_size=10, unique=True), st.text("abc \n▁é", max_size=20))
def test_best_score_and_round_trip(vocabulary, text):
    model = small_model(vocabulary)
    encoder = pieces.Encoder(*model)
    ids = encoder.encode(text)
    assert encoder.decode(ids) == text
    if text and "▁" not in text:
        table = dict(zip(model[0], model[1])) if model[0] else {}
        table.pop("", None)
        marked = "▁" + text.replace(" ", "▁")
        want = brute_viterbi(marked, table, encoder.fallback)
        got, names, at = 0.0, {i: p for i, p in enumerate(model[0]) if p}, 0
        while at < len(ids):
            if ids[at] in names:
                got, at = got + table[names[ids[at]]], at + 1
            else:
                lead = encoder.raw[ids[at]][0]
                got, at = got + encoder.fallback, at + (1 if lead < 128 else 2 if lead < 224 else 3 if lead < 240 else 4)
        assert got == pytest.approx(want)


def test_documents_round_trip(documents, odd_docs, make_docs):
    model = pieces.load_model(PATH)
    for docs in (documents, odd_docs):
        rows = pieces.encode_documents(docs, model)
        assert rows.filter("not round_trip or n_pieces <> size(piece_ids)").count() == 0
    texts = dict(documents.select("doc_id", "text").collect())
    for r in pieces.decode_documents(pieces.encode_documents(documents, model), model).collect():
        assert r.text == texts[r.doc_id]
    assert pieces.encode_documents(make_docs(), model).count() == 0


def test_ties_take_the_longer_last_piece():
    names = ["", "▁", "a", "b", "ab", "▁a", "▁ab"]
    scores = [0.0, 0.0, -1.0, -1.0, -2.0, -1.0, -2.0]
    encoder = pieces.Encoder(names + [""] * 256, scores + [0.0] * 256, list(range(7, 263)))
    first = encoder.encode("ab")
    assert [names[i] for i in first] == ["▁ab"] and encoder.encode("ab") == first and encoder.decode(first) == "ab"


def test_clashing_columns_of_token_operators(odd_docs):
    model, vocab = pieces.load_model(PATH), wordpiece.vocabulary(PATH)
    odd = odd_docs.selectExpr("1 as raw", "2 as n_tokens", "3 as piece_ids", "text", "4 as words", "doc_id")
    same = lambda a, b: sorted(map(str, a.collect())) == sorted(map(str, b.collect()))
    assert same(pieces.encode_documents(odd, model), pieces.encode_documents(odd_docs, model))
    assert same(wordpiece.count_tokens(odd, *vocab), wordpiece.count_tokens(odd_docs, *vocab))
