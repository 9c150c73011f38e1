import hashlib
import random

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from sentencepiece import sentencepiece_model_pb2 as pb

from quirespark.llm import pieces as P

from .conftest import DOCUMENTS

LIB = sentencepiece.SentencePieceProcessor(model_file=P.MODEL)
ODD = ["", " ", "  a  b ", "\n\n\tx\n", "é😀ß中文", "<s> <0x0A> </s>", "▁▁x ▁y", "x" * 3000, "ab" * 900 + " " * 70 + "q", "\0a\0", "https://example.com/a?b=c " * 9, "İı", "12345 3.14"]


@pytest.fixture(scope="module")
def encoder():
    return P.Encoder(P.load())


def test_ids_and_texts_are_the_library_s(encoder):
    rng = random.Random(4)
    texts = ODD + ["".join(rng.choice("abcdefgh \n.é▁THEthe 0189_-") for _ in range(rng.randint(0, 300))) for _ in range(150)]
    got = encoder.encode(texts)
    assert [x.tolist() for x in got] == LIB.encode(texts)
    assert encoder.decode(got) == LIB.decode(LIB.encode(texts))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(max_size=40), max_size=6))
def test_any_text(encoder, texts):
    got = encoder.encode(texts)
    assert [x.tolist() for x in got] == LIB.encode(texts)
    assert encoder.decode(got) == [t.replace("▁", " ") for t in texts]


def test_long_words_take_another_way_to_the_same_ids(encoder, monkeypatch):
    texts = ["themselves understanding internationalisation " * 3, "aaaaaaaaaaaaaaaaaaaaaaaabbbbbbbb"]
    want = [x.tolist() for x in P.Encoder(encoder.model).encode(texts)]
    monkeypatch.setattr(P, "LONG", 3)
    monkeypatch.setattr(P, "INDEX", 20)
    assert [x.tolist() for x in P.Encoder(encoder.model).encode(texts)] == want == LIB.encode(texts)


def test_one_very_long_word(encoder):
    """Half a million characters without a cut, in arrays and not in an object for each."""
    text = "".join(random.Random(9).choices("etaoinshrdlu", k=200_000)) + "ab" * 150_000
    assert encoder.encode([text])[0].tolist() == LIB.encode(text)


def unigram(seed, byte_pieces=False):
    """A small unigram model made by hand: (path-less) bytes of its file."""
    rng = random.Random(seed)
    m = pb.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.byte_fallback = P.UNIGRAM, byte_pieces
    m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces, m.normalizer_spec.escape_whitespaces = True, False, True
    m.normalizer_spec.name = "identity"
    for piece, kind in (("<unk>", 2), ("<s>", 3), ("</s>", 3)):
        m.pieces.add(piece=piece, score=0, type=kind)
    if byte_pieces:
        for i in range(256):
            m.pieces.add(piece=f"<0x{i:02X}>", score=0, type=P.BYTE)
    own = {"".join(rng.choices("abcde", k=rng.randint(1, 6))) for _ in range(60)} | {P.SPACE, P.SPACE + "a", P.SPACE + "bc", "ab", "ba"}
    for x in sorted(own):
        m.pieces.add(piece=x, score=round(-rng.uniform(1, 12), 1), type=1)
    return m.SerializeToString()


@pytest.mark.parametrize(("seed", "byte_pieces"), [(1, False), (2, False), (3, True), (4, True), (5, False)])
def test_unigram_models_give_the_library_s_ids(tmp_path, seed, byte_pieces):
    raw = unigram(seed, byte_pieces)
    (tmp_path / "m.model").write_bytes(raw)
    lib, mine = sentencepiece.SentencePieceProcessor(model_proto=raw), P.Encoder(P.load(str(tmp_path / "m.model")))
    rng = random.Random(seed)
    texts = ["", " ", "abc", "zz abz", "  a  bc ", "é\né", *("".join(rng.choices("aabbccdde  zé", k=rng.randint(0, 120))) for _ in range(200))]
    got = mine.encode(texts)
    assert [x.tolist() for x in got] == lib.encode(texts)
    if byte_pieces:
        assert mine.decode(got) == texts


def test_best_paths_equal_a_search_of_all(tmp_path):
    """The score of the path taken is the largest of all segmentations."""
    (tmp_path / "m.model").write_bytes(unigram(7))
    m = P.load(str(tmp_path / "m.model"))
    ids, score = {p: i for i, p in enumerate(m.pieces)}, m.score
    worst = score[m.rank >= 0].min() - P.PENALTY

    def best(t):
        if not t:
            return 0.0
        ways = [score[ids[t[:n]]] + best(t[n:]) for n in range(1, len(t) + 1) if m.kinds[ids.get(t[:n], 0)] == P.NORMAL]
        return max(ways if t[0] in ids else [*ways, worst + best(t[1:])])

    rng = random.Random(1)
    for _ in range(40):
        t = "".join(rng.choices("abcdez", k=rng.randint(1, 9)))
        got, _ = P.encode_words(m, [t])
        assert abs(sum(score[i] if i != m.unknown else worst for i in got.tolist()) - best(t)) < 1e-3


def test_other_models_are_refused(tmp_path):
    m = pb.ModelProto()
    m.ParseFromString(unigram(1))
    m.trainer_spec.model_type = 3
    (tmp_path / "m.model").write_bytes(m.SerializeToString())
    with pytest.raises(ValueError, match="unigram and byte-pair"):
        P.load(str(tmp_path / "m.model"))


def test_occurrences_equal_a_scan(encoder):
    m = encoder.model
    words = ["▁thethe", "▁banana", "in", "▁"]
    code = m.table[np.frombuffer(("\0".join(words) + "\0").encode("utf-32-le"), np.uint32)].copy()
    joined = "\0".join(words) + "\0"
    code[[i for i, c in enumerate(joined) if c == "\0"]] = 0
    start, piece = P.edges(m, code)
    want = {(i, n) for n, p in enumerate(m.longer) for i in range(len(joined)) if joined.startswith(m.pieces[p], i)}
    assert set(zip(start.tolist(), piece.tolist(), strict=True)) == want and len(start) == len(want)


def test_unknown_characters_without_bytes():
    m = P.load()
    bare = P.Model(m.pieces, m.rank, [k if k != P.BYTE else 3 for k in m.kinds], 0, True)
    ids = P.Encoder(bare).encode(["a\n\n\nb"])[0].tolist()
    assert ids.count(0) == 1


def test_query(spark, small):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate(ODD)] + [(900, None, None, None, None), (None, "word " * 30_000, "", "", 0), (3, "again", "", "", 0), (3, "again", "", "", 0)]
    where = small(documents=(rows, DOCUMENTS))
    out = P.op4_suffix_pieces(spark, where).collect()
    want = [(str(i), len(x := LIB.encode(t or "")), hashlib.sha256(np.array(x, "<i4").tobytes()).hexdigest(), True) for i, t, *_ in rows]
    assert sorted((str(r.doc_id), r.n_tokens, r.ids_sha256, r.round_trip) for r in out) == sorted(want)
    back = P.decode(P.encode(spark.read.parquet(f"{where}/documents.parquet").where("doc_id < 100"))).collect()
    assert {(r.doc_id, r.text) for r in back} == {(i, t.replace("▁", " ")) for i, t, *_ in rows if i is not None and i < 100}
    assert P.op4_suffix_pieces(spark, small(documents=([], DOCUMENTS))).count() == 0


def test_query_returns_the_ids(spark, small):
    rows = [(i, t, "en", "s", 0) for i, t in enumerate([*ODD, None])] + [(1, "another text", "en", "s", 0)]
    out = P.op4_suffix_pieces(spark, small(documents=(rows, DOCUMENTS))).collect()
    assert sorted((r.doc_id, r.ids) for r in out) == sorted((i, LIB.encode(t or "")) for i, t, *_ in rows)
    assert all(r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(np.array(r.ids, "<i4").tobytes()).hexdigest() for r in out)
