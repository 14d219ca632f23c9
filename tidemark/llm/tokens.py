"""Whole-text token ids from a public tokenizer file, with repeated pieces of text encoded once.

Both supported files split text before any merge: at white space, and between a letter and ASCII punctuation. What
lies between two such places is encoded alike wherever it stands. So texts are cut there, each distinct piece is
encoded once through the tokenizers library, and the ids are laid out by a gather. A piece that is one word goes
straight to the library's merge model; any other goes through its whole chain. The ids equal those of the whole text;
tests/llm/test_tokens.py holds the two against each other. A file with other rules is encoded text by text by the library.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache
from itertools import repeat

import numpy as np

from tidemark.llm.spans import Block, distinct, spread

#: Distinct pieces that one Python worker keeps; beyond this the store starts anew.
KEPT_PIECES = 400_000
#: Texts that are joined before pieces are looked for, in bytes.
BLOCK_BYTES = 4 << 20

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A piece may end after these: printable ASCII. The letters U+00C0 to U+00FF are tested by their first byte.
_SOLID = np.zeros(256, bool)
_SOLID[33:127] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
#: ASCII punctuation but for the apostrophe, which the split pattern joins to letters.
_MARK = _SOLID & ~_LETTER
_MARK[48:58] = _MARK[39] = False
_WORD = re.compile(rb"[ \n]?((?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)")


#: Rules of normalising and splitting that allow those cuts, as the tokenizers library writes them; fixed values.
_KNOWN_RULES = [
    (
        None,
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True},
    ),
    (
        {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
        {
            "type": "Sequence",
            "pretokenizers": [
                {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
                {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
            ],
        },
    ),
]


def _byte_symbols() -> str:
    """The character that stands for each byte in byte-level vocabularies: itself if printable, else 256 and up."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(rest)) for b in range(256))


class PieceEncoder:
    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self._library = Tokenizer.from_file(path)
        self._model = self._library.model
        rules = json.loads(self._library.to_str())
        special = all(t["content"].startswith("<|") and not (t["lstrip"] or t["rstrip"] or t["normalized"]) for t in rules["added_tokens"])
        #: Whether texts may be cut into pieces.
        self.cuts = special and rules["model"]["type"] == "BPE" and not rules["model"]["dropout"] and (rules["normalizer"], rules["pre_tokenizer"]) in _KNOWN_RULES
        self.vocabulary = self._library.get_vocab_size()
        self._symbols = dict(enumerate(_byte_symbols()))
        ids = lambda x: self._library.encode(x, add_special_tokens=False).ids
        self._folds, self._drops_space = ids("A") == ids("a"), ids("\n a") == ids("a")
        self._clear()

    def _clear(self) -> None:
        self._known: dict[bytes, int] = {}
        self._flat = np.zeros(1 << 20, np.uint32)
        self._at = np.zeros(1 << 16, np.int64)
        self._len = np.zeros(1 << 16, np.int64)
        self._used = 0

    def _word(self, piece: bytes) -> list[int] | None:
        """Ids of a piece that is one word and so one unit for the merges; None for any other."""
        found = _WORD.fullmatch(piece)
        if not found or len(piece) > 64 or (piece[:1] == b"\n" and not self._drops_space):
            return None
        text = found[1] if self._drops_space else piece
        if self._folds:
            text = text.decode().lower().encode()
        return [t.id for t in self._model.tokenize(text.decode("latin-1").translate(self._symbols))]

    def _add(self, pieces: list[bytes]) -> None:
        ids = [self._word(p) for p in pieces]
        rest = [i for i, x in enumerate(ids) if x is None]
        for i, e in zip(rest, self._library.encode_batch_fast([pieces[i].decode() for i in rest], add_special_tokens=False), strict=True):
            ids[i] = e.ids
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        n, total = len(self._known), int(lengths.sum())
        while self._used + total > len(self._flat):
            self._flat = np.concatenate((self._flat, np.zeros_like(self._flat)))
        while n + len(pieces) > len(self._at):
            self._at, self._len = (np.concatenate((x, np.zeros_like(x))) for x in (self._at, self._len))
        self._flat[self._used : self._used + total] = np.fromiter((t for one in ids for t in one), np.uint32, total)
        self._at[n : n + len(pieces)] = self._used + np.cumsum(lengths) - lengths
        self._len[n : n + len(pieces)] = lengths
        self._used += total
        self._known.update(zip(pieces, range(n, n + len(pieces)), strict=True))

    def encode(self, texts: list[bytes], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, each followed by end_id, and the number of ids of each text."""
        if not self.cuts:
            found = [[*e.ids, end_id] for e in self._library.encode_batch_fast([t.decode() for t in texts], add_special_tokens=False)]
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return np.fromiter((i for one in found for i in one), np.uint32, int(counts.sum())), counts
        if len(self._known) > KEPT_PIECES:
            self._clear()
        block = Block(texts, b"\n")
        data = block.data[: block.size]
        space = _SPACE[data]
        solid = _SOLID[data]
        letter = _LETTER[data]
        latin = (data[:-1] == 0xC3) & (data[1:] >= 0x80)
        solid[1:] |= latin
        letter[1:] |= latin & (data[1:] != 0x97) & (data[1:] != 0xB7)  # the two signs among these letters
        cut = np.zeros(block.size, bool)
        cut[1:] = (space[1:] & solid[:-1]) | (_MARK[data[1:]] & letter[:-1])
        for i, text in enumerate(texts):
            if b"<|" in text:  # it may hold a special token, which the library finds before it splits
                cut[block.starts[i] : block.ends[i]] = False
        cut[block.starts] = True
        cut[block.ends] = False  # the separators; an empty text has no piece
        start = np.flatnonzero(cut)
        owner = np.repeat(np.arange(len(texts)), np.add.reduceat(cut, block.starts, dtype=np.int64))
        stop = np.append(start[1:], block.size)
        stop = np.minimum(stop, block.ends[owner])
        length = stop - start
        codes, first = distinct(block, start, length) if len(start) else (start, start)
        raw = block.raw
        pieces = [raw[a:b] for a, b in zip(start[first].tolist(), stop[first].tolist(), strict=True)]
        place = np.array(list(map(self._known.get, pieces, repeat(-1))), np.int64)
        new = np.flatnonzero(place < 0)
        if len(new):
            place[new] = len(self._known) + np.arange(len(new))
            self._add([pieces[i] for i in new.tolist()])
        place = place[codes]
        counts = self._len[place]
        totals = np.bincount(owner, counts, len(texts)).astype(np.int64)
        out = np.empty(int(totals.sum()) + len(texts), np.uint32)
        ends = np.cumsum(totals + 1) - 1
        body = np.ones(len(out), bool)
        body[ends] = False
        out[ends] = end_id
        out[body] = self._flat[spread(self._at[place], counts)]
        return out, totals + 1


@lru_cache(maxsize=4)
def encoder(path: str) -> PieceEncoder:
    """One encoder a Python worker and file; it outlives tasks where workers are reused."""
    return PieceEncoder(path)


def public_path(name: str) -> str:
    """Place of a public tokenizer file on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)
