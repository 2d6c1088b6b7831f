"""Token ids of whole texts as the tokenizers library gives them, at several times its speed.

A byte-pair model never merges across words and always merges the adjacent pair that makes the
lowest id, so tiktoken's merging core, loaded with the vocabulary of the same tokenizer file,
gives the same ids. The file's own normaliser and word expression are applied first.

The library itself encodes texts with characters outside ``SETTLED`` (where Unicode versions of
the two expression engines might disagree on what a letter is) and files of any other kind.
Special tokens' strings in a text get their special id, as in the library.
"""

from __future__ import annotations

import json
import os
import unicodedata
from array import array

import numpy as np
import regex

# The word expression of byte-level tokenizer files, which those files imply.
BYTE_LEVEL_WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)

#: Inclusive code point ranges in which letters, digits and blanks have long been settled.
SETTLED = (
    (0x0002, 0x03A2),  # from after the word end mark to before the capital sigma, whose
    (0x03A4, 0x052F),  # lower case depends on its place
    (0x1E00, 0x1EFF),
    (0x2000, 0x206F),
    (0x20A0, 0x20B9),
    (0x2190, 0x22FF),
    (0x3040, 0x3096),
    (0x30A0, 0x30FF),
    (0x4E00, 0x9FA5),
    (0xAC00, 0xD7A3),
)
UNSETTLED = regex.compile("[^" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in SETTLED) + "]")
WORD_END = "\x01"  # closes a word where the vocabulary marks word ends; never in a settled text
END_MARK = "</w>"
RUNS_KNOWN = 300_000  # some 200 bytes each; forgotten all at once
LONG_RUN = 32  # longer ones are not remembered


def default_path(name: str) -> str:
    """Place of a public tokenizer file on this machine; pass another path to use another file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_symbol() -> dict[str, int]:
    """Byte-level vocabularies write printable bytes as themselves and the n-th other byte as chr(256 + n)."""
    printable = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + n): b for n, b in enumerate(others)}


def word_rule(config: dict):
    """(normaliser or None, word expression, mark of word ends) of a tokenizer file, or None for other kinds."""
    model = config["model"]
    if model["type"] != "BPE" or model.get("ignore_merges") or model.get("continuing_subword_prefix"):
        return None
    if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in config["added_tokens"]):
        return None
    norm, pre, end = config.get("normalizer"), config.get("pre_tokenizer") or {}, model.get("end_of_word_suffix")
    if norm is None and pre.get("type") == "ByteLevel" and pre["use_regex"] and not pre["add_prefix_space"]:
        return None if end else (None, BYTE_LEVEL_WORDS, "")
    steps = (norm or {}).get("normalizers", [])
    blanks = {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}
    parts = pre.get("pretokenizers", [])
    if [s["type"] for s in steps] == ["NFC", "Replace", "Lowercase"] and steps[1] == blanks and end == END_MARK:
        if [p["type"] for p in parts] == ["Split", "ByteLevel"] and not parts[1]["use_regex"]:
            if parts[0]["behavior"] == "Removed" and parts[0]["invert"] and not parts[1]["add_prefix_space"]:
                return (lambda t: unicodedata.normalize("NFC", t).lower()), parts[0]["pattern"]["Regex"], WORD_END
    return None


def unsettled(text: str) -> bool:
    if "\x00" in text or "\x01" in text:
        return True
    if text.isascii() or int(np.frombuffer(text.encode("utf-32-le"), "<u4").max()) <= SETTLED[0][1]:
        return False
    return bool(UNSETTLED.search(text))


class RunIds(dict):
    """Ids, as bytes, of runs of words between blanks; each run is split and merged once while it is remembered."""

    def __init__(self, core, words):
        super().__init__()
        self.core, self.words = core, words

    def __missing__(self, run: str) -> bytes:
        if not run:
            return b""
        # Letters alone are one word; else every word is closed, the last one too.
        text = run + WORD_END if run.isascii() and run.isalpha() else WORD_END.join([*self.words.findall(run), ""])
        ids = array("I", self.core.encode_ordinary(text)).tobytes()
        if len(run) <= LONG_RUN:
            if len(self) >= RUNS_KNOWN:
                self.clear()
            self[run] = ids
        return ids


class Encoder:
    """Encodes texts to arrays of unsigned 32-bit ids."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        config = json.loads(self.library.to_str())
        self.special = {t["content"]: t["id"] for t in config["added_tokens"]}
        marks = sorted(self.special, key=len, reverse=True)
        self.special_split = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")") if marks else None
        self.core, self.normalise, self.words = None, None, None
        if rule := word_rule(config):
            self._load_core(config["model"]["vocab"], *rule)

    def _load_core(self, vocab: dict[str, int], normalise, words: str, end: str) -> None:
        import tiktoken

        symbols, ranks = byte_of_symbol(), {}
        for token, i in vocab.items():
            if token in self.special:
                continue
            ends = bool(end) and token.endswith(END_MARK) and token != END_MARK
            raw = bytes(symbols[c] for c in (token[: -len(END_MARK)] if ends else token))
            if ends:
                raw += end.encode()
            elif end and end.encode() in raw and len(raw) > 1:
                continue  # holds the mark as text, which settled texts never do
            ranks[raw] = i
        pattern = rf"[^{end}]+{end}" if end else words
        self.core = tiktoken.Encoding("file", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.normalise, self.words = normalise, regex.compile(words) if end else None
        self.known = RunIds(self.core, self.words)

    def library_ids(self, text: str) -> np.ndarray:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def plain(self, text: str) -> np.ndarray:
        """Ids of a text without special tokens' strings."""
        if self.core is None or unsettled(text):
            return self.library_ids(text)
        if self.normalise:
            text = self.normalise(text)
        if self.words:
            runs = text.replace("\n", " ").split(" ")  # no word holds a blank
            return np.frombuffer(b"".join(map(self.known.__getitem__, runs)), "I").astype("<u4", copy=False)
        return self.core.encode_to_numpy(text).astype("<u4", copy=False)

    def encode(self, text: str) -> np.ndarray:
        if not any(mark in text for mark in self.special):
            return self.plain(text)
        ids = [
            np.array([self.special[p]], "<u4") if p in self.special else self.plain(p)
            for p in self.special_split.split(text)
            if p
        ]
        return np.concatenate(ids)


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for ``path``, loaded once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
