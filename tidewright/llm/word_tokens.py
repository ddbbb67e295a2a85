"""Token ids of the tokenizers library, memoised by word.

The word vocabulary's normaliser and splitter never join characters across
ASCII white space: canonical composition and the special-token search do not
cross it and no pre-token holds any. So the ids of a text are the ids of its
white-space separated words, one after another, and each word needs the library
only once as long as it stays in the (bounded) memo.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tidewright.llm.workspace import hold

END = (1).to_bytes(4, "little")
# Texts without these characters are stable under composition, have one lower-case form a
# character and no special token; below, how the vocabulary splits them once they are in lower case.
_ODD = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xff]|<\|")
#: The ASCII characters of a plain text, deleted before the rest is looked at.
_COMMON = bytes([*range(9, 14), *range(0x20, 0x7F)])
_PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zªµºß-öø-ÿ]+|[0-9²³¹¼½¾]|[^\sa-zªµºß-öø-ÿ0-9²³¹¼½¾]+")


class _Memo(dict):
    """A dict that fills itself and starts anew at ``most`` entries; keys over ``long`` are not kept."""

    def __init__(self, make, most: int, long: int = 256) -> None:
        super().__init__()
        self.make, self.most, self.long = make, most, long

    def __missing__(self, key):
        if len(key) > self.long:
            return self.make(key)
        if len(self) >= self.most:
            self.clear()
        value = self[key] = self.make(key)
        return value


class WordEncoder:
    """UTF-8 bytes of texts to their ids as little-endian unsigned 32-bit integers.

    Plain texts are split here, and each piece has a memo. Pieces that are new go
    to the library many at a time, as strings with blanks between, and past its
    normaliser and splitter, whose work is done; each ends with a token that closes
    a word. A text with any other character is cut at
    white space, and the words that hold one go to the library whole.

    Most pieces of a corpus never come again, so the memo has two ages: at
    ``pieces`` entries it becomes the older one, which gives back what is asked
    for and goes at the next change. Pieces over ``long`` characters stay for
    their slice of texts only.
    """

    def __init__(self, path: str, pieces: int = 500_000, words: int = 50_000, block: int = 512, long: int = 256) -> None:
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        self.split = Tokenizer(self.library.model)
        self.split.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        vocabulary = self.library.get_vocab(with_added_tokens=True)
        self.closing = np.zeros(max(vocabulary.values()) + 1, bool)
        self.closing[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.most, self.block, self.long = pieces, block, long
        self._pieces: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._words = _Memo(lambda word: self._ids(word).tobytes(), words)

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4")

    def _learn(self, new: list[str]) -> None:
        blocks = [new[at : at + self.block] for at in range(0, len(new), self.block)]
        found = self.split.encode_batch_fast([" ".join(own) for own in blocks], add_special_tokens=False)
        for own, encoding in zip(blocks, found):
            ids = np.array(encoding.ids, "<u4")
            data, ends = ids.tobytes(), (4 * (np.flatnonzero(self.closing[ids]) + 1)).tolist()
            if len(ends) == len(own):
                self._pieces.update(zip(own, map(data.__getitem__, map(slice, [0, *ends], ends))))
            else:
                self._pieces.update((x, self._ids(x).tobytes()) for x in own)

    def _plain(self, texts: list[str]) -> list[bytes]:
        split = [_PIECES.findall(x.lower()) for x in texts]
        if len(self._pieces) > self.most:
            self._older, self._pieces = self._pieces, {}
        get, made, unseen = self._pieces.__getitem__, [], []
        for at, own in enumerate(split):
            try:
                made.append(b"".join(map(get, own)))
            except KeyError:
                made.append(b"")
                unseen.append(at)
        if unseen:
            new = set().union(*(split[at] for at in unseen)).difference(self._pieces)
            known = new.intersection(self._older)
            self._pieces.update(zip(known, map(self._older.__getitem__, known)))
            self._learn(list(new - known))
            for at in unseen:
                made[at] = b"".join(map(get, split[at]))
            for x in new:
                if len(x) > self.long:
                    del self._pieces[x]
        return made

    def _odd(self, text: bytes) -> bytes:
        words = [x.decode() for x in text.split()]
        plain = [x for x in words if not _ODD.search(x)]
        known = iter(self._plain(plain))
        return b"".join(self._words[x] if _ODD.search(x) else next(known) for x in words)

    def many(self, texts: list[bytes]) -> list[bytes]:
        decoded = [x.decode() for x in texts]
        odd = [b"<|" in x or _ODD.search(x.translate(None, _COMMON).decode()) is not None for x in texts]
        known = iter(self._plain([x for x, o in zip(decoded, odd) if not o]))
        return [self._odd(x) if o else next(known) for x, o in zip(texts, odd)]

    def __call__(self, text: bytes) -> bytes:
        return self.many([text])[0]


def texts(batches: Iterator[pa.RecordBatch], rows: int = 256, size: int = 2 << 20) -> Iterator[tuple[list, list[bytes]]]:
    """Slices of (doc_id, text) batches as ids and UTF-8 bytes; null is empty.

    A slice has ``rows`` texts or about ``size`` bytes at most, but one text at least.
    """
    for batch in batches:
        data = batch.column(1).cast(pa.binary())
        lengths = pc.fill_null(pc.binary_length(data), 0).to_numpy(zero_copy_only=False)
        at = 0
        while at < batch.num_rows:
            fits = int(np.searchsorted(lengths[at : at + rows].cumsum(), size, side="right"))
            n = max(1, fits)
            yield batch.column(0).slice(at, n).to_pylist(), [x or b"" for x in data.slice(at, n).to_pylist()]
            at += n


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def word_encoder(path: str) -> WordEncoder:
    """The Python worker's encoder for a vocabulary."""
    hold("word tokens", _encoder.cache_clear)
    return _encoder(path)
