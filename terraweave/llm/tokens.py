"""Token ids of texts by a vocabulary file of the tokenizers library.

A byte-level BPE file whose ids are its merge order is also run by tiktoken, which gives the same
ids three to four times as fast; each process compares the two on a probe before it relies on
that. Any other file, and any text that spells a special token, goes to tokenizers itself. Where no two white-space characters
stand together, a pattern without look-ahead cuts a text alike, in less time.
"""

from __future__ import annotations

import json
from functools import lru_cache

import numpy as np
import tiktoken
from tokenizers import Tokenizer

GPT2 = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"
#: GPT2 for texts in which no two white-space characters stand together.
LONE = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s"
#: All white space beyond ASCII begins with one of these.
WIDE = (b"\xc2\x85", b"\xc2\xa0", b"\xe1\x9a\x80", b"\xe2\x80", b"\xe2\x81\x9f", b"\xe3\x80\x80")
BLANK = bytes.maketrans(b"\t\n\v\f\r", b" " * 5)
PROBE = "It's 12 o'clock -- déjà vu,\n\n  naïve  ½ЖжΩ漢字🙂 \t\tend_of(test)!!  we'll they've   \r\n x٣٤   z"


def _bytes_of() -> dict[str, int]:
    """The character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


def lone(text: str) -> bool:
    """Whether white space is ASCII and no two of it stand together."""
    data = text.encode()
    return b"  " not in data.translate(BLANK) and not any(w in data for w in WIDE)


class Encoder:
    def __init__(self, path: str):
        self.plain = Tokenizer.from_file(path)
        self.size = self.plain.get_vocab_size(with_added_tokens=True)
        spec = json.loads(self.plain.to_str())
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        self.fast = self._fast(spec, GPT2, PROBE)
        self.lone = self.fast and self._fast(spec, LONE, " ".join(PROBE.split()))

    def _fast(self, spec: dict, pattern: str, probe: str) -> tiktoken.Encoding | None:
        pre = spec.get("pre_tokenizer") or {}
        if spec["model"].get("type") != "BPE" or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space"):
            return None
        back = _bytes_of()
        try:
            ranks = {bytes(back[c] for c in t): i for t, i in spec["model"]["vocab"].items() if t not in self.special}
            fast = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
            same = fast.encode_ordinary(probe) == self.plain.encode(probe, add_special_tokens=False).ids
        except (KeyError, ValueError):
            return None
        return fast if same else None

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.uint32)
        fast = self.lone if self.lone and lone(text) else self.fast
        return fast.encode_to_numpy(text).astype(np.uint32, copy=False)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
