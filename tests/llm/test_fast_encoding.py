"""Pieces are encoded without offsets, with the ids of the plain form."""

from __future__ import annotations

from array import array

from palimpsest.llm import common as C
from palimpsest.llm import queries

TEXTS = ["", " ", "Água, pão e\tvinho.\n\n  Fim!", "a" * 5000, "x́ \U0001f600 <|endoftext|> don't 12345"]


def test_ids_without_offsets(monkeypatch):
    for name, spaced in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        own = C.PieceEncoder(queries.tokenizer(name), spaced)
        plain = [array("I", own.tokenizer.encode(t, add_special_tokens=False).ids).tobytes() for t in TEXTS]
        fast = own.tokenizer.encode_batch_fast

        class OnlyFast:
            def encode_batch_fast(self, pieces, add_special_tokens):
                return fast(pieces, add_special_tokens=add_special_tokens)

        monkeypatch.setattr(own, "tokenizer", OnlyFast())
        assert list(own.packed(TEXTS)) == plain
