"""Tokenizing whole texts with public tokenizer files, remembering the words already seen.

Both supported kinds cut texts before any token crosses certain spaces, so a text is encoded as
the concatenation of its chunks:
- word BPE (white space dropped): chunks between spaces;
- byte-level BPE: chunks that begin at a space which has no white space on either side.
Chunks of Latin letters, plain punctuation and single line breaks are made of pre-tokens as they stand, so the model is asked
directly; every other chunk goes through the whole tokenizer. Tests hold both against encode().
"""

from __future__ import annotations

import array
import os
import re

import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Chunks remembered by a Python worker, twice over (about 250 MB).
REMEMBERED = 600_000

#: Chunks of a text looked up at a time, and marks remembered.
STEP = 200_000

_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
_MARKED = rf"[{_LETTERS}.,;:!?()*$%&#|]+"
_PLAIN = re.compile(rf"{_MARKED}(?:\n{_MARKED})*")
_PARTS = re.compile(rf"[{_LETTERS}]+|\n|[^{_LETTERS}\n]+")
_SIMPLE = re.compile(rf"([{_LETTERS}]+)([.,;:!?]*)")
_INNER_SPACE = re.compile(r"(?<=\S)(?= \S)")


def byte_letters() -> dict[int, str]:
    """The public byte-level alphabet: printable bytes stand for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}

#: The two layouts that chunks are right for: fixed values of the public files.
BYTE_LAYOUT = (None, {**_BYTE_LEVEL, "use_regex": True}, None)
WORD_LAYOUT = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
        {**_BYTE_LEVEL, "use_regex": False},
    ]},
    "</w>",
)


class _Memory(dict):
    """Chunk -> ids. What was used since the last turn stays for another turn; the rest is forgotten."""

    def __init__(self, learn, before: dict[str, bytes]):
        super().__init__()
        self.learn, self.before = learn, before

    def __missing__(self, key: str) -> bytes:
        ids = self.before.get(key)
        if ids is None:
            ids = self.learn(key)
        self[key] = ids
        return ids


class TokenEncoder:
    """Texts to little-endian unsigned 32-bit ids, as the library's encode() gives them without adding special tokens.

    Files of another layout than the two known ones, and texts that hold one of the file's added
    tokens, go to encode() whole.
    """

    _shared: dict[str, TokenEncoder] = {}

    def __init__(self, path: str):
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            kind = json.load(f)
        model = kind["model"]
        layout = (kind.get("normalizer"), kind.get("pre_tokenizer"), model.get("end_of_word_suffix"))
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "byte_fallback", "ignore_merges", "continuing_subword_prefix", "unk_token"))
        self.in_chunks = plain and layout in (BYTE_LAYOUT, WORD_LAYOUT) and not any(t[k] for t in kind["added_tokens"] for k in ("single_word", "lstrip", "rstrip", "normalized"))
        added = [re.escape(t["content"]) for t in kind["added_tokens"]]
        self.added = re.compile("|".join(added)).search if added else None
        self.drops_space = layout == WORD_LAYOUT
        self.model_tokens = self.tokenizer.model.tokenize  # the attribute makes a new wrapper each time
        self.alphabet = byte_letters()
        self.space = self.alphabet[32]
        self.memory = _Memory(self._learn, {})
        # A line break between marks or letters is a pre-token of its own, or dropped with other white space.
        self.newline = array.array("I", self.tokenizer.encode("\n", add_special_tokens=False).ids).tobytes()
        self.parts = {"\n": self.newline}

    @classmethod
    def shared(cls, path: str) -> TokenEncoder:
        """One for each Python worker process."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _whole(self, text: str) -> bytes:
        return array.array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def _tokens(self, pre_token: str) -> bytes:
        """A pre-token (with its space, if any) of Latin letters or plain marks, by the model alone."""
        if pre_token.isascii():  # letters and marks stand for themselves
            mapped = self.space + pre_token[1:] if pre_token[:1] == " " else pre_token
        else:
            mapped = "".join(map(self.alphabet.__getitem__, pre_token.encode()))
        return array.array("I", [t.id for t in self.model_tokens(mapped)]).tobytes()

    def _part(self, pre_token: str) -> bytes:
        ids = self.parts.get(pre_token)
        if ids is None:
            if len(self.parts) >= STEP:
                self.parts = {"\n": self.newline}
            ids = self.parts[pre_token] = self._tokens(pre_token)
        return ids

    def _learn(self, key: str) -> bytes:
        """The ids of a chunk's key."""
        drops = self.drops_space
        body = key.lower() if drops else key
        found = _SIMPLE.fullmatch(body)
        if found:
            word, marks = found.groups()
            if marks or word != key:  # the word by itself is a key too
                return self.memory[word] + self._part(marks) if marks else self.memory[word]
            return self._tokens(word if drops else " " + word)
        first = not drops and key[:1] == " "
        if first:
            body = body[1:]
        if _PLAIN.fullmatch(body):
            parts = _PARTS.findall(body)
            if drops or first:
                return b"".join(map(self._part, parts))
            start = self.memory[parts[0]] if parts[0].isalpha() else self._part(" " + parts[0])
            return start + b"".join(map(self._part, parts[1:]))
        return self._whole(key if drops else body if first else " " + body)

    def _keys(self, text: str) -> list[str]:
        """Keys of a text's chunks: a chunk itself or, if spaces count, what follows its space; the first chunk's then begins with a space."""
        if self.drops_space:
            return text.split(" ")
        if text[:1] != " " and text[-1:] != " " and "  " not in text:
            if text.isprintable() or " \n" not in text and "\n " not in text and text.replace("\n", "").isprintable():
                keys = text.split(" ")  # every space has letters or marks on either side
                keys[0] = " " + keys[0]
                return keys
        first, *others = _INNER_SPACE.split(text)
        return [" " + first, *[c[1:] for c in others]]

    def _ids(self, chunks: list[str]) -> bytes:
        if len(self.memory) >= REMEMBERED:
            self.memory.before = {}
            self.memory = _Memory(self._learn, self.memory)
        return b"".join(map(self.memory.__getitem__, chunks))

    def encode_text(self, text: str) -> bytes:
        if not self.in_chunks or self.added and self.added(text):
            return self._whole(text)
        chunks = self._keys(text)
        if len(chunks) <= STEP:
            return self._ids(chunks)
        # A very long text, in steps that the memory can hold.
        return b"".join(self._ids(chunks[at : at + STEP]) for at in range(0, len(chunks), STEP))

    def encode(self, texts: pa.Array) -> list[bytes]:
        """The ids of each text (null: empty), four bytes each."""
        return [self.encode_text(t.as_py() or "") for t in texts]


def public_path(name: str, folder: str | None = None) -> str:
    """A public tokenizer's file: in `folder`, or where the installed package of them has it."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)
