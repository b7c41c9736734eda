import numpy as np
import public_tokenizers
import pytest

from kerbsight.llm import pieces as P
from kerbsight.llm.common import rows_of

MODEL = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return P.Pieces(MODEL)


def brute(model, text):
    """All segmentations, best first."""
    norm = model.model.normalize(text) if text else ""
    out = []

    def go(i, score, ids):
        if i == len(norm):
            out.append((score, tuple(np.frombuffer(b"".join(ids), np.int32).tolist())))
            return
        s, x = model.known.get(norm[i]) or model.unknown(norm[i])
        go(i + 1, score + s, [*ids, x])
        for j in range(i + 2, len(norm) + 1):
            if norm[i:j] in model.known:
                s, x = model.known[norm[i:j]]
                go(j, score + s, [*ids, x])

    go(0, 0.0, [])
    return sorted(out, key=lambda x: -x[0])


TEXTS = [
    "", "a", "hello", "a b", "then a. x", "  q", "thé\nab", " the the", "日 x", "a\tb", "it's", "so.so,", "a  b ",
]


@pytest.mark.parametrize("n", [1, 2, 5, 9])
def test_n_best_are_the_n_best(model, n):
    for text, found in zip(TEXTS, model.n_best(TEXTS, n), strict=True):
        want = brute(model, text)
        got = [(s, tuple(ids.tolist())) for s, ids in found]
        assert [s for s, _ in got] == [s for s, _ in want[:n]], text
        assert len(set(got)) == len(got) and set(got) <= set(want), text


def test_search_leaves_the_queue_in_order(model):
    text = "▁internationalisation"
    found = P.Lattice(model, text).n_best(50)
    scores = [s for s, _ in found]
    assert len(set(found)) == 50 and scores == sorted(scores, reverse=True)
    assert found[0][0] == model.solve(text)[0]
    assert scores[0] - scores[1] == model.solve(text)[2]


def test_a_unigram_twin_of_the_library_agrees(model, tmp_path):
    """The library's own N-best, for the same vocabulary declared as a unigram model."""
    import sentencepiece

    data = bytearray(open(MODEL, "rb").read())
    twin = unigram(bytes(data))
    try:
        sp = sentencepiece.SentencePieceProcessor(model_proto=twin)
        theirs = sp.nbest_encode_as_ids("hello there friend", 4)
    except Exception as e:  # the library may refuse a vocabulary that it didn't train so
        pytest.skip(f"no twin: {e}")
    # the library sums in single precision: compare scores of its answers, not their order
    score = {x: s for s, x in brute(model, "hello there friend")}
    mine = [s for s, _ in model.n_best(["hello there friend"], 4)[0]]
    assert [score[tuple(x)] for x in theirs] == mine


def varint(data, i):
    value = shift = 0
    while True:
        b = data[i]
        value |= (b & 127) << shift
        i, shift = i + 1, shift + 7
        if not b & 128:
            return value, i


def unigram(proto):
    """The serialized model with trainer_spec.model_type set to unigram."""
    out, i = bytearray(), 0
    while i < len(proto):
        start = i
        key, i = varint(proto, i)
        size, i = varint(proto, i)
        body = proto[i : i + size]
        i += size
        if key >> 3 == 2:  # trainer_spec; a later field of the same number wins
            body += bytes([3 << 3, 1])
            length, n = bytearray(), len(body)
            while n > 127:
                length.append(n & 127 | 128)
                n >>= 7
            length.append(n)
            out += bytes([2 << 3 | 2]) + length + body
        else:
            out += proto[start:i]
    return bytes(out)


def test_documents_round_trip(spark, odd, odd_rows):
    got = P.encode_documents(odd).collect()
    assert all(r["decodes"] for r in got)
    best = [r for r in got if r["rank"] == 1]
    assert len(best) == len(odd_rows)
    empty = [r for r in got if r["doc_id"] in (1, 2)]
    assert [(r["rank"], r["score"], r["n_pieces"]) for r in empty] == [(1, 0, 0)] * 2
    longest = [r for r in got if r["doc_id"] == 4]
    assert [r["rank"] for r in longest] == [1, 2, 3]
    scores = [r["score"] for r in longest]
    assert scores == sorted(scores, reverse=True)


def test_replaced_spaces_come_back_as_spaces(model):
    (found,) = model.n_best(["a▁b"], 1)
    assert P.Decoder(MODEL).decode(found[0][1], np.array([len(found[0][1])])) == ["a b"]


def test_nothing_and_other_columns(spark, nothing, odd):
    assert P.encode_documents(nothing).collect() == []
    rows = rows_of(odd, "doc_id", "text").withColumn("rank", P.F.lit("r"))
    assert P.encode(rows, MODEL, 2).columns == ["_id", "rank", "n_best"]


def test_a_small_store_gives_the_same(monkeypatch, model):
    texts = ["alpha beta gamma alpha", "beta. gamma, delta", "delta alpha"] * 3
    want = [[(s, x.tolist()) for s, x in y] for y in model.n_best(texts, 3)]
    monkeypatch.setattr(P, "STORE", 2)
    small = P.Pieces(MODEL)
    for _ in range(3):
        assert [[(s, x.tolist()) for s, x in y] for y in small.n_best(texts, 3)] == want
