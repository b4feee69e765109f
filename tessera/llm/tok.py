"""Token ids of whole texts, by the tokenizers library."""

from __future__ import annotations

import os
import re
import unicodedata

#: Entries kept per process, and the longest chunk and word kept: short ones recur, long ones rarely do.
CACHE_ENTRIES, CHUNK_CHARS, WORD_CHARS = 200_000, 9, 11

#: A word with marks after it. Such chunks need no normalizer or splitter, so the model alone encodes them.
PLAIN = re.compile(r"([^\W\d_]*)([.,!#$%&*|;:?()]*)")


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Encodes texts piece by piece between spaces and line feeds, with a bounded memory of pieces.

    The tokenizer's normalizer, splitter and special tokens never look across a space or a line feed, so the
    ids of a text are those of its pieces in order; tests hold this against encoding whole texts. Ids are
    returned as little-endian bytes of ``width`` each. The way through the model alone is taken only where
    the tokenizer's file declares the steps that it stands for.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import json

        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.width = 2 if self.tok.get_vocab_size() <= 1 << 16 else 4
        told = json.loads(self.tok.to_str())
        steps = [x["type"] for part in ("normalizer", "pre_tokenizer") for x in ((told[part] or {}).get("normalizers") or (told[part] or {}).get("pretokenizers") or [])]
        simple = steps == ["NFC", "Replace", "Lowercase", "Split", "ByteLevel"] and not told["model"]["dropout"]
        model, whole, letters = self.tok.model.tokenize, self.tok.encode, {ord(chr(b)): x for b, x in byte_letters().items()}
        width = self.width

        table = [i.to_bytes(width, "little") for i in range(self.tok.get_vocab_size())]

        class Parts(dict):
            """Ids of lower-case words and of runs of marks."""

            def __missing__(self, part: str) -> bytes:
                ids = b"".join([table[t.id] for t in model(part if part.isascii() else part.encode().decode("latin-1").translate(letters))]) if part else b""
                if len(part) <= WORD_CHARS:
                    if len(self) >= CACHE_ENTRIES:
                        self.clear()
                    self[part] = ids
                return ids

        parts = Parts()

        class Chunks(dict):
            def __missing__(self, chunk: str) -> bytes:
                if simple and chunk.isascii() and chunk.isalpha():
                    ids = parts[chunk.lower()]
                else:
                    word, marks = m.groups() if simple and (m := PLAIN.fullmatch(chunk)) else ("", "")
                    low = word.lower()
                    if (word or marks) and (not word or low.isalpha() and (word.isascii() or word.isalpha() and "Σ" not in word and unicodedata.is_normalized("NFC", word))):
                        ids = parts[low] + parts[marks] if marks else parts[low]
                    else:
                        ids = b"".join([table[i] for i in whole(chunk, add_special_tokens=False).ids])
                if len(chunk) <= CHUNK_CHARS:
                    if len(self) >= CACHE_ENTRIES:
                        self.clear()
                    self[chunk] = ids
                return ids

        self.memory = Chunks({"": b""})

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        return b"".join(map(self.memory.__getitem__, text.replace("\n", " ").split(" ")))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")
