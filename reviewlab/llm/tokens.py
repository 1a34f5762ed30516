"""Words and token ids of byte-level BPE vocabularies, for use inside tasks.

A space between two characters that are no white space always starts a new
word of the splitting pattern, so the text between two such spaces (with the
space before it) can be encoded on its own.
"""

from __future__ import annotations

import json
import re

import numpy as np

#: A space between two non-space characters.
CUT = re.compile(r" (?=\S)(?<=\S )")
#: Spaces next to white space are rare; without them a plain split does.
UNSAFE = re.compile(r" (?:\s|(?<=\s ))")
#: Words kept in a task's cache before it starts anew.
CACHED_WORDS = 300_000


def words_of(text: str) -> list[str]:
    """The text's words; each but the first lacks the space before it."""
    if text[0] == " " or text[-1] == " " or UNSAFE.search(text):
        return CUT.split(text)
    return text.split(" ")


def pieces_of(path: str) -> list[bytes]:
    """Bytes of each id of a tokenizers file of the byte-level kind, special tokens included."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    # the byte-level alphabet: printable bytes stand for themselves, the others for U+0100 on
    plain = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    letter = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
    vocab = spec["model"]["vocab"]
    special = {t["id"]: t["content"] for t in spec.get("added_tokens", [])}
    out = [b""] * (1 + max([*vocab.values(), *special]))
    for token, i in vocab.items():
        out[i] = bytes(letter[c] for c in token) if all(c in letter for c in token) else token.encode()
    for i, content in special.items():
        out[i] = content.encode()
    return out


class WordIds(dict):
    """word -> its ids as little-endian unsigned 32-bit numbers, encoded when first met."""

    def __init__(self, encode, before: str):
        super().__init__()
        self.encode, self.before = encode, before

    def __missing__(self, word: str) -> bytes:
        if len(self) >= CACHED_WORDS:
            self.clear()
        ids = self[word] = np.array(self.encode(self.before + word), "<u4").tobytes()
        return ids


class Encoder:
    """Whole texts to ids, as the tokenizers file does without adding special tokens."""

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        pieces = pieces_of(path)
        simple = (spec["model"]["type"] == "BPE" and not spec.get("normalizer") and (spec.get("pre_tokenizer") or {}).get("type") == "ByteLevel"
                  and not spec["pre_tokenizer"].get("add_prefix_space") and spec["pre_tokenizer"].get("use_regex", True)
                  and not any(t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens", [])))
        if simple and self.ranked(spec, pieces, special):
            # merges in the order of ids: the same ids, several times faster
            self.core = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks={p: i for i, p in enumerate(pieces) if i not in special.values()}, special_tokens=special)
            self.special, self.encode = set(special), self.whole
        else:
            self.core = Tokenizer.from_file(path)
            self.core.no_truncation()
            self.core.no_padding()
            encode = lambda w: self.core.encode(w, add_special_tokens=False).ids
            self.first, self.rest = WordIds(encode, ""), WordIds(encode, " ")
            self.encode = self.by_words

    @staticmethod
    def ranked(spec: dict, pieces: list[bytes], special: dict) -> bool:
        """Whether each merge's result has the next id, so that ids are ranks."""
        vocab = spec["model"]["vocab"]
        ids = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "", 1)] for m in spec["model"]["merges"]]
        return ids == sorted(ids) and len(set(pieces)) == len(pieces) and len(ids) + 256 + len(special) == len(pieces)

    def __call__(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers; none for null or empty text."""
        return self.encode(text) if text else b""

    def whole(self, text: str) -> bytes:
        """Real texts hold too many distinct words for a cache to beat the core on the whole text.
        Special tokens are looked for only in texts that hold one."""
        found = {s for s in self.special if s in text}
        return self.core.encode_to_numpy(text, allowed_special=found, disallowed_special=()).astype("<u4", copy=False).tobytes()

    def by_words(self, text: str) -> bytes:
        head, *tail = words_of(text)
        return self.first[head] + b"".join(map(self.rest.__getitem__, tail))


#: Fixed value: the published pattern that splits text before byte-level merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This worker's encoder of a file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def vocabulary_path(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)
