"""Token ids of whole texts, by a public tokenizer file.

The lower-casing word tokenizer spends most of its time splitting texts.  For
texts of plain Latin characters the same split is one regular expression over
the lower-cased text, and each piece's ids are looked up; new pieces go to the
tokenizer itself.  Any other text goes to the tokenizer whole, so ids are the
tokenizer's own in every case.
"""

from __future__ import annotations

import re

import numpy as np

VOCABULARY = "word_bpe_49k.json"
END = 2
#: Texts encoded at once; new pieces are learned once a slice.
SLICE_BYTES = 4 << 20
#: Pieces of which a worker keeps the ids, about 250 bytes each; longer ones than LONGEST aren't kept.
CACHE, LONGEST = 1_000_000, 64


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.plain = re.compile(r"[\t\n\r -~¡-įĲ-ňŊ-ž]*").fullmatch
        self.split = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªºµß-öø-ž]+|[0-9²³¹¼-¾]|[!-/:-@\[-`{-~¡-©«-±´¶-¸»¿×÷]+").findall
        self.number: dict[str, int] = {}
        self.cache = CACHE
        self._reset()
        spec = self.tokenizer.to_str()
        self.fast = '"Lowercase"' in spec and "'s|'t|'re|'ve|'m|'ll|'d|[\\\\p{L}]+|[\\\\p{N}]|[^\\\\s\\\\p{L}\\\\p{N}]+" in spec

        size = self.tokenizer.get_vocab_size()
        self.is_end = np.array([str(self.tokenizer.id_to_token(i)).endswith("</w>") for i in range(size)])

    def _reset(self) -> None:
        self.number.clear()
        self.ids = np.zeros(1 << 16, np.uint32)
        self.begin = np.zeros(1 << 12, np.int64)
        self.used = 0

    def _learn(self, pieces: list[str]) -> None:
        """Ids of new pieces, encoded as one text; the last id of each piece is one of a word's end."""
        ids = np.array(self.tokenizer.encode_batch_fast([" ".join(pieces)], add_special_tokens=False)[0].ids, np.uint32)
        ends = np.flatnonzero(self.is_end[ids]) + 1
        if len(ends) != len(pieces):
            raise ValueError("the vocabulary doesn't mark the ends of words")
        k = len(self.number)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.r_[self.ids, np.zeros_like(self.ids)]
        while k + len(pieces) + 1 > len(self.begin):
            self.begin = np.r_[self.begin, np.zeros_like(self.begin)]
        self.ids[self.used : self.used + len(ids)] = ids
        self.begin[k + 1 : k + len(pieces) + 1] = self.used + ends
        self.used += len(ids)
        self.number.update(zip(pieces, range(k, k + len(pieces))))

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null and empty texts have none.  Meant for batches of a few MB."""
        slow = [i for i, t in enumerate(texts) if t and not (self.fast and self.plain(t) and "<|" not in t)]
        whole = dict(zip(slow, self.tokenizer.encode_batch([texts[i] for i in slow], add_special_tokens=False))) if slow else {}
        if len(self.number) > self.cache:
            self._reset()
        split, get = self.split, self.number.get
        pieces = [() if i in whole or not t else split(t.lower()) for i, t in enumerate(texts)]
        known = self.number.keys()
        new = set().union(*pieces) - known
        long = {p for p in new if len(p) > LONGEST}
        if long:  # their texts go to the tokenizer whole
            for i, own in enumerate(pieces):
                if not long.isdisjoint(own):
                    whole[i], pieces[i] = self.tokenizer.encode(texts[i], add_special_tokens=False), ()
            new = set().union(*pieces) - known
        if new:
            self._learn(list(new))
        out: list[np.ndarray] = []
        for i, own in enumerate(pieces):
            if i in whole:
                out.append(np.array(whole[i].ids, np.uint32))
                continue
            k = np.fromiter(map(get, own), np.int64, len(own))
            first = self.begin[k]
            size = self.begin[k + 1] - first
            at = np.cumsum(size)
            total = int(at[-1]) if len(at) else 0
            out.append(self.ids[np.repeat(first - (at - size), size) + np.arange(total)])
        return out


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str, cache: int = CACHE) -> Encoder:
    """One for each worker process."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    _ENCODERS[path].cache = cache
    return _ENCODERS[path]
