"""Token ids of whole texts by the tokenizers library, through a bounded cache of words.

The word tokenizer drops white space and no token crosses it, so a text's ids are the
ids of its words in order.  Words are cut at ASCII white space only (a subset of the
tokenizer's own), and the library encodes each distinct word once per worker while the
cache holds it; special strings inside a word are handled as the library does.  ASCII
letters are lowered first, as the tokenizer lowers them, unless the text holds what that
could touch: special strings, or combining marks, whose composition depends on case.
"""

from __future__ import annotations

import os
import re

import numpy as np
import regex

#: Words one worker keeps (about 0.2 KB each).
CACHE = 1_000_000
#: Words that the library gets in one string.
JOINED = 500
#: Letters of one script block, and marks after them: the split pattern makes one or two
#: parts of such a word, and the last token of each part is a word end.
_SIMPLE = re.compile(rb"((?:[a-zA-Z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+)[!-&(-/:;=>?@\[-`{-~]*")
_COMBINING = regex.compile(r"\p{M}")
_LOADED: dict[str, "WordIds"] = {}


class WordIds:
    """word (bytes) -> ids as little-endian unsigned 32-bit numbers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.seen: dict[bytes, bytes] = {}

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(x.ids, "<u4") for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encode_joined(self, words: list[bytes], parts: list[int]) -> bool:
        """Learn simple words from one string of them; False if its parts don't add up."""
        ids, = self._encode([b" ".join(words).decode()])
        ends, wanted = np.flatnonzero(self.ends[ids]) + 1, np.cumsum(parts)
        if len(ends) != wanted[-1] or ends[-1] != len(ids):
            return False
        buf, upto = ids.tobytes(), (4 * ends[wanted - 1]).tolist()
        self.seen.update(zip(words, [buf[a:b] for a, b in zip([0, *upto], upto)]))
        return True

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        missing = [w for w in words if w not in self.seen]
        if len(self.seen) + len(missing) > CACHE:
            self.seen.clear()
            missing = list(words)
        simple, parts, other = [], [], []
        for w in missing:
            found = _SIMPLE.fullmatch(w)
            if found:
                simple.append(w)
                parts.append(1 + (found.end(1) < len(w)))
            else:
                other.append(w)
        for at in range(0, len(simple), JOINED):
            own = simple[at:at + JOINED]
            if not self._encode_joined(own, parts[at:at + JOINED]):
                other += own
        for word, ids in zip(other, self._encode([w.decode() for w in other])):
            self.seen[word] = ids.tobytes()
        return self.seen

    @staticmethod
    def split(text: str) -> list[bytes]:
        """Words of a text, ASCII letters lowered where that changes no id."""
        data = text.encode()
        if b"<|" in data or not (text.isascii() or not _COMBINING.search(text)):
            return data.split()
        return data.lower().split()

    def ids(self, texts: list[str]) -> list[bytes]:
        """Ids of each whole text, as little-endian unsigned 32-bit numbers."""
        split = [self.split(t) for t in texts]
        known = self._learn(set().union(*split))
        return [b"".join(map(known.__getitem__, words)) for words in split]

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.ids(texts)]


def word_ids(path: str) -> WordIds:
    """The worker's tokenizer for this file, loaded once."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
