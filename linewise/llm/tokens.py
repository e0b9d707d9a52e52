"""Token ids of whole texts from a public tokenizer file.

The word-level BPE never forms a token across white space, so the ids of a text are the
ids of its white-space-separated pieces one after the other. A worker remembers the ids
of pieces it has seen (a bounded memory: past ``limit`` pieces it starts anew) and asks
the tokenizers library only about new ones. Two facts make that cheap and stay exact:

* the tokenizer lower-cases, so A-Z is folded first (unless the text holds ``<|``, with
  which special tokens begin: those are matched before lower-casing);
* a run of Latin-1 letters, alone or before a run of ASCII marks (no apostrophe), is split
  by the tokenizer into just these two runs, so the library's BPE model is asked directly
  for the letters, written as the tokenizer's byte-level step writes them.

All other pieces go through the whole tokenizer. The tests compare with whole-text encoding.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

DEFAULT_FILE = "word_bpe_49k.json"
_LETTERS = "abcdefghijklmnopqrstuvwxyz" + "".join(map(chr, range(0xDF, 0x100))).replace("÷", "")
_SIMPLE = re.compile(f"([{_LETTERS}]+)([!-&(-/:-@\\[-`{{-~]*)")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path(DEFAULT_FILE)


class PieceEncoder:
    """Ids (little-endian uint32 bytes) of texts; ``path`` None means the default file."""

    def __init__(self, path: str | None = None, limit: int = 1_200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel

        self.tok = Tokenizer.from_file(path or default_path())
        self.model = self.tok.model
        byte_level = ByteLevel(add_prefix_space=False, use_regex=False)
        self.written = str.maketrans(
            {c: byte_level.pre_tokenize_str(c)[0][0] for c in _LETTERS})
        self.limit = limit
        self.pieces: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _whole(self, text: str) -> bytes:
        ids = self.tok.encode(text, add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _piece(self, piece: bytes) -> bytes:
        text = piece.decode("utf-8", "replace")
        simple = _SIMPLE.fullmatch(text.lower())
        if simple is None:
            return self._whole(text)
        word, marks = simple.groups()
        ids = self.words.get(word)
        if ids is None:
            found = self.model.tokenize(word.translate(self.written))
            ids = self.words[word] = array("I", [t.id for t in found]).tobytes()
        if not marks:
            return ids
        tail = self.words.get(marks)
        if tail is None:
            tail = self.words[marks] = self._whole(marks)
        return ids + tail

    def _learn(self, pieces: list[bytes]) -> None:
        for p in set(pieces).difference(self.pieces):
            self.pieces[p] = self._piece(p)

    def encode(self, texts) -> list[bytes]:
        """Ids of each text (None: empty), as bytes."""
        out = []
        for text in texts:
            if not text:
                out.append(b"")
                continue
            data = text.encode("utf-8", "replace")
            pieces = (data if b"<|" in data else data.lower()).split()
            parts = []
            for at in range(0, len(pieces), self.limit):  # one round but for huge texts
                part = pieces[at:at + self.limit]
                ids = list(map(self.pieces.get, part))
                if None in ids:
                    if len(self.pieces) + len(self.words) > self.limit:
                        self.pieces, self.words = {}, {}
                    self._learn(part)
                    ids = list(map(self.pieces.__getitem__, part))
                parts += ids
            out.append(b"".join(parts))
        return out


_ENCODERS: dict[str | None, PieceEncoder] = {}


def encoder(path: str | None = None) -> PieceEncoder:
    """The encoder of this Python worker (workers are reused across tasks)."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]
