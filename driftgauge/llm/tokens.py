"""Tokenizing with memory: the library is asked once for each piece of text between proven boundaries."""

from __future__ import annotations

import os
import re

import numpy as np

#: Characters that some engine takes for white space and ASCII rules do not.
ODD_SPACE = re.compile(
    rb"[\x1c-\x1f]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe1\xa0\x8e|\xe2\x80[\x80-\x8f\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\xef\xbb\xbf"
)
#: White space with the word behind it; white space at the end stands alone.
SPACED_WORD = re.compile(rb"\s*\S+|\s+\Z")
#: Between an ASCII letter and ASCII punctuation.
LETTER_EDGE = re.compile(rb"(?<=[A-Za-z])(?=[!-/:-@\[-`{-~])|(?<=[!-/:-@\[-`{-~])(?=[A-Za-z])")


#: Marks that end most words that don't end in a letter.
MARKS = b".,!?;:|"


class PieceMemory:
    """What ``value`` makes of the ids of each piece, for pieces seen of late.

    Two generations of at most ``limit`` pieces: when the young one is full it becomes the
    old one, and what is used again moves back. A piece is cut further at the edge of
    letters and punctuation, a boundary in both tokenizers' patterns unless an apostrophe
    (contractions) or the opening of a special string is near; such pieces stay whole.

    New words of letters alone go to the library many in one text. ``lead`` is the mark of a
    vocabulary whose tokens begin a word with it, ``tail`` that of one whose tokens end a word
    with it; where the marks don't count as many words as went in, each goes alone.
    """

    def __init__(self, path: str, value, join, lead: str = "", tail: str = "", limit: int = 280_000, longest: int = 40):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.value, self.join, self.limit, self.longest = value, join, limit, longest
        self.young: dict = {}
        self.old: dict = {}
        entries = self.tokenizer.get_vocab()
        self.marked = np.zeros(max(entries.values()) + 1, bool)
        self.marked[[i for t, i in entries.items() if (t.endswith(tail) if tail else t.startswith(lead))]] = True
        self.first, self.space = (0 if tail else 1), (" " if tail else "")

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.asarray(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, pieces: list[bytes], together: int = 200) -> list:
        texts = [p.decode() for p in pieces]
        out: list = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if t[self.first :].isalpha() and (not self.first or t[0] == " ")]
        groups = [plain[a : a + together] for a in range(0, len(plain), together)]
        alone = []
        for group, ids in zip(groups, self.ids([self.space.join(texts[i] for i in g) for g in groups])):
            edges = np.flatnonzero(self.marked[ids]) + (1 - self.first)
            bounds = (np.append(edges, len(ids)) if self.first else np.append(0, edges)).tolist()
            if len(bounds) == len(group) + 1 and bounds[0] == 0 and bounds[-1] == len(ids):
                for i, a, b in zip(group, bounds, bounds[1:]):
                    out[i] = self.value(ids[a:b])
            else:
                alone += group
        others = [i for i, v in enumerate(out) if v is None] if alone or len(plain) < len(texts) else []
        for i, ids in zip(others, self.ids([texts[i] for i in others])):
            out[i] = self.value(ids)
        return out

    def _cut(self, p: bytes) -> list[bytes]:
        """The parts of a piece."""
        return [p] if b"'" in p or b"<|" in p else LETTER_EDGE.split(p)

    def learn(self, pieces: set[bytes]) -> dict:
        """Values of all ``pieces``; those too long to keep are only in the returned table."""
        young, old, first, longest = self.young, self.old, self.first, self.longest
        new, cut, marked = set(), {}, []
        for p in pieces.difference(young):
            if p in old:
                young[p] = old[p]
            elif p[first:].isalpha():
                new.add(p)
            elif p[-1] in MARKS and p[first:-1].isalpha():  # the commonest kind: a word with a mark behind it
                marked.append(p)
                word = p[:-1]
                if word not in young:
                    if word in old:
                        young[word] = old[word]
                    else:
                        new.add(word)
            else:
                parts = self._cut(p)
                if len(parts) == 1:
                    new.add(p)
                    continue
                cut[p] = parts
                for q in parts:
                    if q not in young:
                        if q in old:
                            young[q] = old[q]
                        else:
                            new.add(q)
        for mark in {p[-1:] for p in marked}.difference(young):
            if mark in old:
                young[mark] = old[mark]
            else:
                new.add(mark)
        asked = list(new)
        fresh = dict(zip(asked, self.encode(asked))) if asked else {}
        out = {p: v for p, v in fresh.items() if len(p) > longest}
        young.update(fresh if not out else {p: v for p, v in fresh.items() if len(p) <= longest})
        join = self.join
        for p in marked:
            word = p[:-1]
            (young if len(p) <= longest else out)[p] = join((young[word] if word in young else out[word], young[p[-1:]]))
        for p, parts in cut.items():
            value = join([young[q] if q in young else out[q] for q in parts])
            (young if len(p) <= longest else out)[p] = value
        return out

    def turn(self) -> None:
        if len(self.young) > self.limit:
            self.old, self.young = self.young, {}


def values_of(memory: PieceMemory, texts: list[list[bytes]]) -> list[list]:
    """The pieces' values, text by text."""
    long = memory.learn(set().union(*texts)) if texts else {}
    get = memory.young.__getitem__
    if long:
        young = memory.young
        out = [[young[p] if p in young else long[p] for p in pieces] for pieces in texts]
    else:
        out = [list(map(get, pieces)) for pieces in texts]
    memory.turn()
    return out
