"""A public SentencePiece vocabulary as a table of pieces; the model file's path is a parameter."""

from __future__ import annotations

import os

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE_MARK = "▁"


class Vocabulary:
    """Pieces by id. ``ids`` has ordinary pieces only; ``bytes_`` has the byte pieces, for anything no piece covers.

    Pickles as two lists, so that executors need no model file.
    """

    def __init__(self, pieces: list[str], special: list[bool]):
        self.pieces, self.special = pieces, special
        self._index()

    def _index(self):
        self.bytes_ = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if len(p) == 6 and p.startswith("<0x")}
        self.ids = {p: i for i, p in enumerate(self.pieces) if not self.special[i]}
        self.longest = max(map(len, self.ids), default=1)
        if any(SPACE_MARK in p.lstrip(SPACE_MARK) for p in self.ids):
            raise ValueError("a piece spans words; texts can't be cut before their spaces")

    def __getstate__(self):
        return self.pieces, self.special

    def __setstate__(self, state):
        self.pieces, self.special = state
        self._index()


def load(path: str | None = None) -> Vocabulary:
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=path or os.environ.get("PIECE_MODEL", MODEL))
    n = m.get_piece_size()
    return Vocabulary([m.id_to_piece(i) for i in range(n)], [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)])
