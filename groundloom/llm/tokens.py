"""Token ids of whole texts, put together from the ids of their space-separated chunks."""

from __future__ import annotations

import struct
import sys

import numpy as np

#: Chunks that one Python worker remembers for a tokenizer, and the longest that it does.
CACHE_CHUNKS, CACHE_LONGEST = 800_000, 64
#: Marks that may be cut off a chunk's end where they touch a Latin letter: no tokenizer here merges the two.
MARKS = ".,;:!?()*#&$%|-"


def _byte_marks() -> str:
    """The character by which byte-level models stand for each byte: printable Latin-1 bytes for themselves, the others 256 and up in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = iter(range(256, 512))
    return "".join(chr(b if b in plain else next(others)) for b in range(256))


class _Known(dict):
    """Ids of chunks as bytes; an unknown chunk is encoded by the library. ``lead`` goes before chunks that don't start with a line feed.

    When half of ``CACHE_CHUNKS`` are there, they become the older half, of which only those that are asked for again stay.
    """

    def __init__(self, tokenizer, dtype: np.dtype, lead: str):
        super().__init__()
        self.tokenizer, self.dtype, self.lead = tokenizer, dtype, lead
        self.model, self.marks, self.tails, self.older = tokenizer.model, _byte_marks(), {}, {}
        self.space, self.code = self.marks[32], "H" if dtype.itemsize == 2 else "I"

    def ids(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def word(self, word: str, lead: str) -> bytes:
        """Ids of a chunk without its end marks. Latin letters alone are one word of either tokenizer, so its model takes them at once."""
        if not word.isalpha():
            return self.ids(lead + word)
        if word.isascii():
            # Each letter stands for itself.
            form = (self.space + word if lead else word) if self.lead else word.lower()
        elif max(word) < "\u0130":
            form = (lead + word if self.lead else word.lower()).encode().decode("latin-1").translate(self.marks)
        else:
            return self.ids(lead + word)
        ids = [t.id for t in self.model.tokenize(form)]
        return struct.pack(f"<{len(ids)}{self.code}", *ids)

    def tail(self, marks: str) -> bytes:
        return self.tails.get(marks) or self.tails.setdefault(marks, self.ids(marks)) if len(marks) < 4 else self.ids(marks)

    def __missing__(self, chunk: str) -> bytes:
        got = self.older.get(chunk)
        if got is None:
            got = self.encoded(chunk)
        if len(chunk) <= CACHE_LONGEST:
            if len(self) >= CACHE_CHUNKS // 2:
                self.older = dict(self)
                self.clear()
            self[chunk] = got
        return got

    def encoded(self, chunk: str) -> bytes:
        core = chunk.rstrip(MARKS)
        if core and len(core) < len(chunk) and core[-1].isalpha() and core[-1] < "\u0130":
            return self[core] + self.tail(chunk[len(core) :])
        if chunk[:1] != "\n":
            return self.word(chunk, self.lead)
        if chunk[1:2].isalpha():
            return self.tail("\n") + self.word(chunk[1:], "")
        return self.ids(chunk)


class ChunkEncoder:
    """Ids of texts as little-endian bytes (two bytes an id for vocabularies up to 65,536, else four), each text's end id included.

    Both public tokenizers split texts into words before they merge, and never across the place between a character that isn't
    white space and a following space or line feed. So the ids of a text are those of its chunks between such places in a row.
    A worker encodes each new chunk once with the library and remembers a bounded number of them. Texts with two of those
    separators side by side, where a tokenizer keeps white space, go to the library whole.
    """

    def __init__(self, path: str, end_id: int):
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        self.dtype = np.dtype("<u2" if tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        self.end = np.array([end_id], self.dtype).tobytes()
        self.spaced = tokenizer.encode(" a", add_special_tokens=False).ids != tokenizer.encode("a", add_special_tokens=False).ids
        self.known = _Known(tokenizer, self.dtype, " " if self.spaced else "")

    @classmethod
    def shared(cls, path: str, end_id: int) -> ChunkEncoder:
        """The encoder that all tasks of one Python worker share. This module's code travels with each task, so it is kept in ``sys``."""
        held = vars(sys).setdefault("_groundloom_encoders", {})
        return held.get((path, end_id)) or held.setdefault((path, end_id), cls(path, end_id))

    def encode(self, texts: list[str]) -> list[bytes]:
        out, known, whole = [], self.known.__getitem__, self.known.ids
        for text in texts:
            if not self.spaced:
                ids = b"".join(map(known, filter(None, text.replace("\n", " ").split(" "))))
            elif "  " in text or "\n\n" in text or "\n " in text or " \n" in text:
                ids = whole(text)
            else:
                first, *rest = text.replace("\n", " \n").split(" ")
                ids = whole(first) + b"".join(map(known, rest))
            out.append(ids + self.end)
        return out


def text_lists(batch, column: str, step: int = 512):
    """Slices of an Arrow batch with their texts as a list, null as empty."""
    for at in range(0, batch.num_rows, step):
        part = batch.slice(at, step)
        yield part, [t or "" for t in part.column(column).to_pylist()]
