"""Models with a compiled character map, trimming and no dummy mark, against the library."""

import random

import pytest
import sentencepiece

from tessera.llm.sentencepiece_codec import Codec, _fields, default_model


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def field(number, value):
    if isinstance(value, bytes):
        return varint(number << 3 | 2) + varint(len(value)) + value
    return varint(number << 3) + varint(value)


def character_map(rule):
    """The compiled map of a rule that comes with the library."""
    model = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
    spec = next(v for n, v in _fields(model) if n == 3)
    return next(v for n, v in _fields(spec) if n == 2)


def texts():
    rng = random.Random(8)
    signs = ["a", "the ", " ", "  ", "\t", "\n", "é", "é", "ﬁ", "Ａ", "　", "①", "…", "ß", "漢", "한", "​", "½", "Ⅳ", "▁", "😀", "x", " ", "ｶﾞ"]
    return ["", " ", "   ", "a", " a ", "ﬁ", "　", "éé"] + ["".join(rng.choice(signs) for _ in range(rng.randint(1, 40))) for _ in range(400)]


@pytest.mark.parametrize("rule", ["identity", "nfkc", "nmt_nfkc", "nmt_nfkc_cf"])
@pytest.mark.parametrize("dummy, trim", [(1, 1), (1, 0), (0, 1), (0, 0)])
def test_codec_with_a_character_map(tmp_path, rule, dummy, trim):
    with open(default_model(), "rb") as f:
        model = f.read()
    # a later field of a message overrides an earlier one
    model += field(3, field(2, character_map(rule) if rule != "identity" else b"") + field(3, dummy) + field(4, trim) + field(5, 1))
    path = tmp_path / "m.model"
    path.write_bytes(model)
    lib, own = sentencepiece.SentencePieceProcessor(model_proto=model), Codec(str(path))
    assert (own.map is None) == (rule == "identity")
    for t in texts():
        ids = lib.encode(t)
        assert own.encode(t) == ids, repr(t)
        assert own.decode(ids) == lib.decode(ids), repr(t)
        got = own.encode_digest(t)
        assert got[0].tolist() == ids
        begins, ends, size = got[1].tolist(), got[2].tolist(), len(t.encode())
        assert all(0 <= a <= b <= size for a, b in zip(begins, ends)) and begins == sorted(begins)
        # each piece that stands for itself is the text of its span
        for i, a, b in zip(ids, begins, ends):
            piece = lib.id_to_piece(i)
            if piece.isascii() and piece.isalpha() and t.isascii():
                assert t.encode()[a:b].decode() == piece or rule == "nmt_nfkc_cf"
