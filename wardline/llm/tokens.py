"""Token ids by the tokenizers library, with each distinct chunk of text encoded once per worker."""

from __future__ import annotations

import codecs
import os
import re

import numpy as np

VOCAB = "byte_bpe_50k.json"
END_ID = 0
#: A byte-level BPE splits text into words before it merges, and gives the last space before a visible character to the word after it.
#: Cutting there, around a line end between visible characters, or between letters and other signs at the end leaves all ids as they are.
_CUT = re.compile(r" (?=[!-~¡-ɏ])")
_ODD = re.compile(r" (?![!-~¡-ɏ])")
_LINE = re.compile(r"(?<=[!-~¡-ɏ])\n(?=[!-~¡-ɏ])")
#: A line end that is not between visible characters.
_BREAK = re.compile(r"\n(?:(?![!-~¡-ɏ])|(?<![!-~¡-ɏ]\n))")
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)\Z")


def vocabulary_path(name: str = VOCAB) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_alphabet() -> str:
    """How byte-level vocabularies write bytes, by byte: visible Latin-1 as themselves, the others from U+0100 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    at = {b: b for b in shown} | {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in shown)}
    return "".join(chr(at[b]) for b in range(256))


class _Known(dict):
    """Ids of chunks that stand after `prefix`, as bytes; unknown ones are encoded when they are asked for. Two generations of at
    most `most` chunks are kept, so chunks that keep coming stay. After the prefix " ", a chunk that begins with a line end stands
    for that line end and its word, without a space."""

    def __init__(self, encode, prefix: str, most: int):
        super().__init__()
        self.encode, self.prefix, self.most, self.old = encode, prefix, most, {}

    def __missing__(self, chunk: str) -> bytes:
        got = self.old.get(chunk)
        if got is None:
            got, rare = self.encode(self, chunk)
            if rare:
                return got
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[chunk] = got
        return got

    def knows(self, chunk: str) -> bool:
        return chunk in self or chunk in self.old


class Encoder:
    """encode(texts) gives per text the ids of the whole text as uint16 (uint32 for vocabularies over 65,536), end id included.

    Ids equal Tokenizer.encode(text, add_special_tokens=False) of the byte-level tokenizer at `path`. A text that holds the literal of an
    added token (such as `<|endoftext|>`, which that call gives its one id) is encoded by that call. Empty texts give the end id alone. Up to about twice `max_chunks` recent chunks are remembered.
    """

    def __init__(self, path: str | None = None, end_id: int = END_ID, max_chunks: int = 600_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path or vocabulary_path())
        self.added = [a.content for a in self.tok.get_added_tokens_decoder().values()]
        top = max(end_id, *self.tok.get_vocab().values()) + 1
        self.kind = np.dtype("<u2" if top <= 65_536 else "<u4")
        self.raw = [i.tobytes() for i in np.arange(top, dtype=self.kind)]
        self.end_id, self.end = end_id, self.raw[end_id]
        self.alphabet, self.model = _byte_alphabet(), self.tok.model
        self.after_space, self.bare = _Known(self._fresh, " ", max_chunks), _Known(self._fresh, "", max_chunks // 8)

    def _word(self, word: str) -> bytes:
        """Ids of what is one word for the splitter: only the merges are left to do."""
        raw = self.raw
        return b"".join([raw[t.id] for t in self.model.tokenize(codecs.charmap_decode(word.encode(), "strict", self.alphabet)[0])])

    def _fresh(self, known: _Known, chunk: str) -> tuple[bytes, bool]:
        """The ids of a chunk, and whether it is not worth remembering: it has a word that was unknown so far, which is remembered by itself."""
        if chunk.isascii() and chunk.isalpha():
            return self._word(known.prefix + chunk), False
        if known.prefix and chunk[0] == "\n":
            rare = not self.bare.knows(chunk[1:])
            return self.bare["\n"] + self.bare[chunk[1:]], rare
        plain = _PLAIN.match(chunk)
        if plain and plain[2]:
            rare = not known.knows(plain[1])
            return known[plain[1]] + self.bare[plain[2]], rare
        if plain:
            return self._word(known.prefix + chunk), False
        lines = _LINE.split(chunk) if "\n" in chunk else [chunk]
        if len(lines) > 1:
            return known[lines[0]] + b"".join([self.bare["\n"] + self.bare[x] for x in lines[1:]]), False
        return np.array(self.tok.encode(known.prefix + chunk, add_special_tokens=False).ids, self.kind).tobytes(), False

    def encode(self, items: list[str]) -> list[np.ndarray]:
        out = []
        of = self.after_space.__getitem__
        for t in items:
            if any(a in t for a in self.added):
                out.append(np.array([*self.tok.encode(t, add_special_tokens=False).ids, self.end_id], self.kind))
                continue
            if _ODD.search(t):
                parts = iter(_CUT.split(t))
            else:
                parts = iter((t if _BREAK.search(t) else t.replace("\n", " \n")).split(" "))
            out.append(np.frombuffer(b"".join((self.bare[next(parts)], *map(of, parts), self.end)), self.kind))
        return out


_SHARED: dict[tuple, Encoder] = {}


def shared_encoder(path: str | None = None, end_id: int = END_ID) -> Encoder:
    """One encoder per worker process, so that all its tasks profit from the chunks it knows."""
    key = (path, end_id)
    if key not in _SHARED:
        _SHARED[key] = Encoder(path, end_id)
    return _SHARED[key]
