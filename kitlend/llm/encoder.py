"""Library tokenizers inside tasks, with a memo of encoded words.

``Encoder`` loads a tokenizers .json file once a worker. Two facts about a
vocabulary are read from its file, not assumed:

* ``drops_space``: its normalizer is NFC, white space folding and lower case,
  and its pre-tokenizer keeps only matches of a pattern that holds no white
  space. White space then never reaches a token, and no token crosses it: the
  ids of a text are the ids of its words, one word after another. (NFC joins
  nothing across a space, and lower case is taken character by character.)
  Words repeat, so each distinct word is encoded by the library once a task.
* otherwise texts are encoded whole by the library; the position before a white
  space that follows a non-space is still a boundary of the byte-level patterns.
"""

from __future__ import annotations

import functools
import json
import os
from array import array

import numpy as np

#: Distinct words kept by a worker; the memo starts afresh beyond that.
MEMO_WORDS = 500_000


def _drops_space(spec: dict) -> bool:
    parts = lambda x: (x or {}).get("normalizers") or (x or {}).get("pretokenizers") or ([x] if x else [])
    norm = parts(spec.get("normalizer"))
    plain = all(n["type"] in ("NFC", "Lowercase") or n["type"] == "Replace"
                and n["pattern"] == {"Regex": r"\s+"} and n["content"] == " " for n in norm)
    pre = parts(spec.get("pre_tokenizer"))
    first = pre[0] if pre else {}
    pattern = first.get("pattern", {}).get("Regex", r"\s")
    kept = (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")
            and r"\s" not in pattern.replace(r"[^\s", "[^") and " " not in pattern)
    return bool(plain and kept and spec.get("post_processor") is None
                and not any(t["lstrip"] or t["rstrip"] or set(t["content"]) & set(" \t\n\r\v\f")
                            for t in spec.get("added_tokens", [])))


class Encoder:
    """One vocabulary file in one worker."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer
        self.lib = Tokenizer.from_file(path)
        self.lib.no_truncation()
        self.lib.no_padding()
        with open(path, encoding="utf-8") as f:
            self.drops_space = _drops_space(json.load(f))
        self.kind = np.uint16 if self.lib.get_vocab_size() <= 1 << 16 else np.uint32
        self._code = "H" if self.kind is np.uint16 else "I"
        self.memo: dict[bytes, bytes] = {}

    def _pack(self, ids: list[int]) -> bytes:
        return array(self._code, ids).tobytes()

    def learn(self, words: set[bytes]) -> None:
        """Encode words that the memo doesn't hold."""
        if len(self.memo) > MEMO_WORDS:
            self.memo.clear()
        new = list(words)
        for a in range(0, len(new), 20_000):
            part = new[a:a + 20_000]
            done = self.lib.encode_batch_fast([w.decode("utf-8", "replace") for w in part],
                                              add_special_tokens=False)
            self.memo.update(zip(part, (self._pack(e.ids) for e in done), strict=True))

    def packed(self, text: bytes) -> bytes:
        """Ids of a text, packed as ``kind``."""
        if not self.drops_space:
            return self._pack(self.lib.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids)
        words = text.split()
        known = list(map(self.memo.get, words))
        if None in known:
            self.learn({w for w, k in zip(words, known, strict=True) if k is None})
            memo = self.memo
            known = [memo[w] if k is None else k for w, k in zip(words, known, strict=True)]
        return b"".join(known)

    def ids(self, text: bytes) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.kind)

    def count(self, text: bytes) -> int:
        return len(self.packed(text)) // self.kind().itemsize


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
