"""Exact ids of byte-level BPE tokenizers (the tokenizers library), with recurring segments remembered.

The pre-tokenizer's pattern always parts a space from a character before it that is no white space, and what it
makes of a segment that begins there doesn't depend on its surroundings up to the next such place. So a
text is the concatenation of its segments' ids. Texts with a special token's string, or with a space
between other white space, are encoded whole or cut with more care.
"""

from __future__ import annotations

import json
import os
import re
from array import array

import numpy as np

from flipside.llm.common import worker_memo

#: White space of the pattern: the characters with the Unicode property White_Space.
_WS = "\t-\r " + "".join(map(chr, (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)))
_RISKY = re.compile(f" (?:[{_WS}]|\\Z)")
_CAREFUL = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")
#: Letters and marks that all versions of Unicode class alike; a letter run and a run of marks are pre-tokens.
_PLAIN = re.compile("([A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f]*)([!-&(-/:-@\\[-`{-~]*)").fullmatch
_LINES = re.compile(f"([^{_WS}]+)\n([^{_WS}]+)").fullmatch
#: White space other than spaces and line breaks.
_OTHER = [c for c in map(chr, (*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)) if c != "\n"]
LONG = 200


def byte_letters() -> dict[int, int]:
    """The character that byte-level models have for each byte that is no printable character of its own."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    return {b: chr(0x100 + i) for i, b in enumerate(b for b in range(256) if b not in own)}


class TokenMemo:
    def __init__(self, path: str, memo: int):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path) as file:
            rule = json.load(file)
        self.tokenizer, self.limit = Tokenizer.from_file(path), memo
        self.special = [t["content"] for t in rule["added_tokens"]]
        split = rule.get("pre_tokenizer") or {}
        self.parts = rule.get("normalizer") is None and split.get("type") == "ByteLevel" and split.get("use_regex") \
            and not split.get("add_prefix_space") and not any(t["lstrip"] or t["rstrip"] for t in rule["added_tokens"])
        self.plain = self.parts and rule["model"]["type"] == "BPE"
        self.letters = byte_letters()
        #: Segments without a leading space, and those with one, which is left out of the key.
        self.bare: dict[str, bytes] = {"": b""}
        self.spaced: dict[str, bytes] = {}
        self.marks: dict[str, bytes] = {}

    def _encode(self, segments: list[str], lead: str) -> dict[str, bytes]:
        """The ids of segments, each with ``lead`` before it."""
        out, rest, broken = {}, [], []
        if self.plain and lead:
            model, known = self.tokenizer.model.tokenize, self.spaced
            for s in segments:
                found = _PLAIN(s) if s else None
                if not found:
                    if s.count("\n") == 1 and (lines := _LINES(s)):
                        broken.append((s, *lines.groups()))
                    else:
                        rest.append(s)
                    continue
                word, marks = found.groups()
                ids = known.get(word) or out.get(word) if word else b""
                if ids is None:
                    ids = out[word] = array("I", [t.id for t in model(self._letters(lead + word))]).tobytes()
                if marks:
                    if (after := self.marks.get(key := (lead + marks, marks)[bool(word)])) is None:
                        after = self.marks[key] = array("I", [t.id for t in model(self._letters(key))]).tobytes()
                    out[s] = ids + after
        else:
            rest = segments
        for at in range(0, len(rest), 20_000):
            some = rest[at:at + 20_000]
            found = self.tokenizer.encode([lead + s for s in some], is_pretokenized=True, add_special_tokens=False)
            cuts = np.searchsorted(np.array(found.word_ids, np.int64), np.arange(len(some) + 1)) * 4
            raw = np.array(found.ids, "<u4").tobytes()
            out.update((s, raw[a:b]) for s, a, b in zip(some, cuts[:-1], cuts[1:]))
        if broken:  # a line break between characters that aren't white space is a pre-token
            ends = self._look(self.spaced, [[end for _, end, _ in broken]], lead)[0]
            starts = self._look(self.bare, [[start for _, _, start in broken] + ["\n"]], "")[0]
            out.update((s, end + starts[-1] + start) for (s, _, _), end, start in zip(broken, ends, starts))
        return out

    def _letters(self, text: str) -> str:
        if text.isascii() and text[0] == " ":
            return self.letters[0x20] + text[1:]
        return text.encode().decode("latin-1").translate(self.letters)

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _cut(self, text: str) -> tuple[str, list[str]] | list[str] | None:
        """A bare segment and spaced ones; or segments as they stand; or None: not to be cut."""
        if not self.parts or any(s in text for s in self.special):
            return None
        if ("  " in text or " \n" in text or text[-1] == " " or any(c in text for c in _OTHER)) and _RISKY.search(text):
            return _CAREFUL.findall(text)
        first, *rest = text.split(" ")
        return first, rest

    def _look(self, memo: dict[str, bytes], wanted: list[list[str]], lead: str) -> list[list[bytes]]:
        """For each list of segments their ids; new segments are encoded once."""
        found = [list(map(memo.get, segments)) for segments in wanted]
        lacking = [i for i, ids in enumerate(found) if None in ids]
        new = {s for i in lacking for s, ids in zip(wanted[i], found[i]) if ids is None}
        fresh = self._encode(list(new), lead)
        for i in lacking:
            found[i] = [fresh[s] if ids is None else ids for s, ids in zip(wanted[i], found[i])]
        memo.update((s, ids) for s, ids in fresh.items() if len(s) <= LONG)
        return found

    def ids(self, batch: list[str]) -> list[bytes]:
        """For each text its ids as little-endian unsigned 32-bit integers."""
        cut = [self._cut(t) if t else [] for t in batch]
        if len(self.bare) + len(self.spaced) > self.limit:
            self.bare = {"": b""}
            self.spaced.clear()
            self.marks.clear()
        bare = iter(self._look(self.bare, [[c[0]] if type(c) is tuple else c for c in cut if c is not None], ""))
        spaced = iter(self._look(self.spaced, [c[1] for c in cut if type(c) is tuple], " "))
        return [self.whole(t) if c is None else b"".join(next(bare) + next(spaced) if type(c) is tuple else next(bare))
                for t, c in zip(batch, cut)]


@worker_memo
def token_memo(path: str, memo: int) -> TokenMemo:
    return TokenMemo(path, memo)
