"""Piece encoding against the library, with offsets, odd texts and character maps."""

import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece

from lacuna.llm import piece_encoding as pe
from lacuna.llm import piece_model as pm
from tests.llm.texts import corpus, frame

PATH = public_tokenizers.path("piece_bpe_32k.model")
ODD = ["", " ", "  ", "\n", "▁", "▁▁a", " ▁", "a\n b  ▁c\x00", "<s>x</s>", "<0x41>", "\U0001f600é 一\t", "�", "q" * 70_000, "​　 \xa0x"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def random_texts(n=1500, alphabet="ab \n\t▁é一\U0001f600\x00<s>th e  ing"):
    rng = random.Random(1)
    return ["".join(rng.choice(alphabet) for _ in range(rng.randrange(40))) for _ in range(n)]


def test_ids_spans_and_texts_are_the_librarys(spark, library):
    rows = [*corpus(), *((1000 + i, t) for i, t in enumerate(ODD + random_texts(300))), (1000, ""), (None, "no id")]
    got = pe.encode(frame(spark, rows), pe.read_model(PATH)).collect()
    assert len(got) == len(rows) - 1
    text = {i: t or "" for i, t in rows}
    for r in got:
        t = text[r.doc_id]
        assert r.ids == library.encode(t) and r.decoded == library.decode(r.ids)
        raw = t.encode()
        want = [(p.begin, p.end) for p in library.encode(t, return_type="proto").pieces]
        assert list(zip(r.begins, r.ends)) == want
        assert b"".join(raw[a:b] for a, b in want) == raw
    assert pe.encode(frame(spark, []), pe.read_model(PATH)).count() == 0


def test_query_over_documents(spark, library):
    from lacuna.llm.queries import op13_piece_encoding

    sf = "/root/testdata/sf0.001"
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = op13_piece_encoding(spark, sf).collect()
    assert {r.doc_id for r in got} == {*docs}
    for r in got:
        ids = library.encode(docs[r.doc_id])
        assert tuple(r)[1:] == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


def test_decoding_of_any_ids(spark, library):
    rng = random.Random(2)
    rows = [(k, [rng.randrange(32000) if rng.random() < 0.5 else rng.randrange(260) for _ in range(rng.randrange(8))]) for k in range(800)] + [(-1, None)]
    df = pe.decode(spark.createDataFrame(rows, "k int, ids array<int>"), pe.read_model(PATH))
    for r in df.collect():
        assert r.decoded == (None if r.ids is None else library.decode(r.ids))


def test_words_kept_do_not_change_ids(library, monkeypatch):
    monkeypatch.setattr(pm, "KEPT_PIECES", 50)
    model, texts = pm.PieceModel(pe.read_model(PATH)), random_texts(200)
    for k in range(0, 200, 7):
        ids, _, _, first = model.encode(t.encode() for t in texts[k : k + 7])
        assert [ids[a:b].tolist() for a, b in zip(first[:-1], first[1:])] == library.encode(texts[k : k + 7])


def test_long_and_short_words_merge_alike(monkeypatch):
    rng, model = random.Random(3), pm.PieceModel(pe.read_model(PATH))
    for _ in range(500):
        word = "".join(rng.choice("▁thehinganodé.,aa ") for _ in range(rng.randrange(1, 64)))
        assert model._merged_short(word) == model._merged_long(word)


def test_character_map_with_offsets():
    """Longest-prefix rules of a compiled map of some 200 kB, with and without extra spaces."""
    library = sentencepiece.SentencePieceNormalizer(rule_name="nmt_nfkc")
    own = pm.Normalizer(dict(pm.fields(library.serialized_model_proto()))[pm.NORMALIZER])
    assert own.chars and own.no_extra_space
    for x in random_texts(3000, "ab  \n\t▁éﬁＫ①㌔　À가\U0001f600Åﷺ̀A ") + ODD[:-2]:
        norm, source = own(x.encode())
        want, places = library.normalize(x, with_offsets=True)
        assert norm == want
        if norm:
            ends = [0]
            for c in norm:
                ends.append(ends[-1] + len(c.encode()))
            assert [len(x.encode()[: source[i]].decode()) for i in ends] == places


def test_bytes_of_no_character_and_other_models():
    norm, source = pm.Normalizer(b"")(b"a\xff\xe4\xb8 b")
    assert norm == "▁a���▁b" and source[0] == 0 and source[-1] == 6
    with pytest.raises(ValueError, match="pair-merging"):
        pm.PieceModel(b"")
