"""Token ids of whole texts by the tokenizers library, with a cache of words that each worker process keeps.

A byte-level BPE tokenizer without normaliser or prefix space never joins a single space and the non-space after it to what
stands before. So a text is cut before each such space and its words are looked up; words not seen before are encoded: runs
of Latin letters, the marks after them and line ends by the tokenizer's model (each is one pre-token), all others by the whole
tokenizer. A text with white space before a space, or with ``<|`` (which may begin a special token), is encoded in one
piece, as is every text if the tokenizer is of another kind. The cache is bounded; beyond the bound, words are encoded anew.
Words seen once are kept in two generations, so that only those not met for a whole generation are forgotten.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

#: Words that a worker process keeps for good, once they have been seen twice, and words seen once in each of two generations: some 200 bytes each.
CACHE_WORDS, CACHE_LATE = 500_000, 250_000
_WHOLE = re.compile(r"\s |<\|")
_MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
#: White space other than a space and a line feed.
_ODD = tuple("\t\v\f\r\x1c\x1d\x1e\x1f\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


@lru_cache(maxsize=1)
def _shown() -> dict[int, str]:
    """For ``translate``: what byte-level BPE shows for each character below U+0250. Bytes of printable Latin-1 are shown as themselves, others from U+0100 on."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    shown = [chr(b) if b in printable else chr(next(rest)) for b in range(256)]
    return {c: "".join([shown[b] for b in chr(c).encode()]) for c in range(0x250)}


class Encoder:
    """``ids(texts)`` gives little-endian unsigned 32-bit ids of each text as bytes."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = json.loads(self.tokenizer.to_str())
        pre = kind.get("pre_tokenizer") or {}
        self.by_word = kind["model"]["type"] == "BPE" and kind.get("normalizer") is None and pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
        ids = np.arange(self.tokenizer.get_vocab_size(with_added_tokens=True), dtype="<u4").tobytes()
        self.bytes_of = [ids[i : i + 4] for i in range(0, len(ids), 4)]
        self.tokenize = self.tokenizer.model.tokenize
        self.known: dict[str, bytes] = {}
        self.late: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {"": b""}

    def whole(self, text: str) -> bytes:
        return b"".join([self.bytes_of[i] for i in self.tokenizer.encode(text, add_special_tokens=False).ids])

    def _run(self, run: str) -> bytes:
        """Ids of one pre-token, in the characters that show its bytes."""
        own = self.bytes_of
        return b"".join([own[t.id] for t in self.tokenize(run)])

    def _letters(self, lead: str, body: str) -> bytes:
        if not body.isascii():
            body = body.translate(_shown())
        return self._run(lead + body)

    def _keep(self, key: str, ids: bytes) -> None:
        self.late[key] = ids
        if len(self.late) > CACHE_LATE:
            self.late, self.older = {}, self.late

    def _new(self, word: str, lead: str = "Ġ") -> bytes:
        """Ids of ``lead`` (a space, shown as Ġ, or nothing) and ``word``."""
        late, older, known = self.late, self.older, self.known
        key = word if lead else " " + word  # no word holds a space
        if ids := late.get(key) or older.get(key):
            if len(known) < CACHE_WORDS:
                known[key] = ids
            elif key not in late:
                self._keep(key, ids)
            return ids
        if word.isalpha() and (word.isascii() or max(word) <= "ɏ"):
            ids = self._letters(lead, word)
        elif (body := word.rstrip(_MARKS)).isalpha() and (body.isascii() or max(body) <= "ɏ"):
            own, mark = body if lead else " " + body, word[len(body) :]
            if (ids := known.get(own) or late.get(own) or older.get(own)) is None:
                ids = self._letters(lead, body)
                if len(own) < 40:
                    self._keep(own, ids)
            if (after := self.marks.get(mark)) is None:
                after = self._run(mark)
                if len(self.marks) < 10_000:
                    self.marks[mark] = after
            ids += after
        elif "\n" in word and not (parts := word.partition("\n"))[0].isspace() and parts[0] and parts[2][:1].isalpha():
            return self._word(parts[0], lead) + self._mark_line() + self._word(parts[2], "")
        else:
            ids = self.whole((" " if lead else "") + word)
        if len(word) < 40:
            self._keep(key, ids)
        return ids

    def _mark_line(self) -> bytes:
        if (ids := self.marks.get("\n")) is None:
            ids = self.marks["\n"] = self._run("Ċ")
        return ids

    def _word(self, word: str, lead: str) -> bytes:
        return self.known.get(word if lead else " " + word) or self._new(word, lead)

    def ids(self, texts: list[str | None]) -> list[bytes]:
        out = []
        get, new = self.known.get, self._new
        for text in texts:
            if not text:
                out.append(b"")
                continue
            first, *rest = text.split(" ")
            if not self.by_word or "" in rest or "\n " in text or "<|" in text or any(map(text.__contains__, _ODD)) and _WHOLE.search(text):
                out.append(self.whole(text))
                continue
            got = list(map(get, rest))
            if None in got:
                got = [new(w) if x is None else x for x, w in zip(got, rest, strict=True)]
            out.append((self._word(first, "") if first else b"") + b"".join(got))
        return out


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
