"""Properties over generated texts, against the tokenizer libraries and plain Python."""

import re

import numpy as np
import public_tokenizers
import sentencepiece
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from cloneframe.llm import bpe_codec, media, near_dedup, packing, secrets
from cloneframe.llm.bpe import HeapCounter

CODEC = bpe_codec.Codec(public_tokenizers.path("byte_bpe_50k.json"))
OWN = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
WORDS = packing.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
COUNTER = HeapCounter(public_tokenizers.path("piece_bpe_32k.model"))
MODEL = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
texts = st.text(st.characters(exclude_categories=["Cs"]), max_size=80) | st.text("ab the.,'s\n\t ▁é#$0", max_size=120)


@settings(max_examples=150, deadline=None)
@given(texts)
def test_tokenizers(t):
    (ids,) = CODEC.encode([t])
    assert ids.tolist() == OWN.encode(t, add_special_tokens=False).ids and CODEC.decode(ids) == t
    (packed,) = WORDS.encode([t])
    assert np.frombuffer(packed, "<u4").tolist() == WORDS.own.encode(t, add_special_tokens=False).ids
    assert COUNTER.count(t) == len(MODEL.encode(t))


@settings(max_examples=80, deadline=None)
@given(texts, texts)
def test_shingles(a, b):
    def plain(t):
        w = t.encode().lower().split()
        return {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    x, y = near_dedup.shingle_sets([a, b])
    assert (len(x), len(y)) == (len(plain(a)), len(plain(b)))
    assert len(np.intersect1d(x, y)) == len(plain(a) & plain(b))


@settings(max_examples=80, deadline=None)
@given(st.lists(st.sampled_from(["token", "Secret", "=", ":", " ", '"', "a1B2c3D4e5F6", "AKIA", "0123456789abcdef", "x", "İ", "api_key", "ghp_"]), max_size=14).map("".join))
def test_spans(t):
    found = secrets.Scanner().spans(t)
    for kind in secrets.BASE:
        own = [(a, b) for a, b, k in found if k == kind]
        assert all(b <= c for (_, b), (c, _) in zip(own, own[1:]))
    want = [(m.start(), m.end()) for m in re.finditer("[0-9a-f]+", t) if m.end() - m.start() >= 16]
    assert [(a, b) for a, b, k in found if k == "hex"] == want
    assert not [s for s in secrets.Scanner().spans(secrets.redacted(t, found)) if s[2] in ("access", "hex")]


@settings(max_examples=40, deadline=None)
@given(st.binary(max_size=900))
def test_media_is_lossless(raw):
    assert media.load(media.store(raw))[0] == raw
