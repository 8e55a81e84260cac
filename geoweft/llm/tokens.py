"""Whole-text encoding with a public tokenizer file.

For a vocabulary that drops white space and marks word ends, a text is encoded as the concatenation
of its blank-separated chunks: white space never joins two pre-tokens, and ASCII lower-casing
commutes with the normalizer.  Chunk encodings are remembered per Python worker, in two generations
of ``memo_entries`` each, of which the younger outlives a task, so memory is bounded.  A chunk that is not remembered goes through the
library's BPE model by pre-token where its characters make normalization plain (ASCII and Latin
letters), which takes a third of the time, and through the library's whole encoder otherwise.  Other vocabularies encode each text in
one call.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from functools import lru_cache

from ._memory import hold

MEMO_ENTRIES = 150_000

# The pre-token pattern and the normalizer for which the chunk path is exact.
PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
NORMALIZERS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]

#: Characters whose lower case and class need no context: visible ASCII and Latin letters.
PLAIN = re.compile("[!-~À-įı-ɏ]+").fullmatch


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: visible bytes stand for themselves, the others for 256, 257, ..."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class _Memo(dict):
    """chunk -> packed ids; the older generation is dropped when the younger is full."""

    def __init__(self, learn, entries: int):
        super().__init__()
        self.learn, self.entries, self.old = learn, entries, {}

    def forget(self) -> None:
        """Only the younger generation stays for the next task."""
        self.old = {}

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            found = self.learn(chunk)
        if len(self) >= self.entries:
            self.old = dict(self)
            self.clear()
        self[chunk] = found
        return found


class ChunkEncoder:
    """text -> little-endian unsigned ids as bytes, ``width`` bytes an id."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES):
        import regex
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.model = self.tok.model
        self.width = 2 if self.tok.get_vocab_size(with_added_tokens=True) <= 65536 else 4
        self.dtype = "<u2" if self.width == 2 else "<u4"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        steps = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        self.chunked = (
            (spec.get("normalizer") or {}).get("normalizers") == NORMALIZERS
            and [s.get("type") for s in steps] == ["Split", "ByteLevel"]
            and steps[0].get("pattern") == {"Regex": PATTERN}
            and not steps[1].get("add_prefix_space")
            and not steps[1].get("use_regex")
            and spec.get("post_processor") is None
        )
        self.special = [t["content"].encode() for t in spec.get("added_tokens", [])]
        self.letters, self.cut = _byte_letters(), regex.compile(PATTERN).findall
        self.memo = _Memo(self._learn, memo_entries)

    def _pack(self, ids) -> bytes:
        return array("H" if self.width == 2 else "I", ids).tobytes()

    def _word(self, piece: str) -> bytes:
        shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(self.letters)
        return self._pack([t.id for t in self.model.tokenize(shown)])

    def _learn(self, chunk: bytes) -> bytes:
        if chunk.isalpha():
            return self._word(chunk.decode())
        if chunk[-1:] in (b".", b",") and chunk[-2:-1].isalpha():  # a letter never joins a following mark
            return self.memo[chunk[:-1]] + self.memo[chunk[-1:]]
        text = chunk.decode("utf-8", "surrogatepass")
        if PLAIN(text) and unicodedata.is_normalized("NFC", text):
            return b"".join([self._word(p) for p in self.cut(text.lower())])
        return self._pack(self.tok.encode(text, add_special_tokens=False).ids)

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text; None counts as the empty text."""
        if not self.chunked:
            return [self._pack(e.ids) for e in self.tok.encode_batch_fast([t or "" for t in texts], add_special_tokens=False)]
        out, get = [], self.memo.__getitem__
        for text in texts:
            raw = (text or "").encode("utf-8", "surrogatepass")
            if any(s in raw for s in self.special):
                out.append(self._pack(self.tok.encode(text, add_special_tokens=False).ids))
            else:
                out.append(b"".join(map(get, raw.lower().replace(b"\n", b" ").split(b" "))))
        return out


@lru_cache(maxsize=2)
def _loaded(path: str) -> ChunkEncoder:
    return ChunkEncoder(path)


def encoder(path: str) -> ChunkEncoder:
    """One encoder a worker process, kept between tasks."""
    hold("tokens", _loaded.cache_clear)
    return _loaded(path)
