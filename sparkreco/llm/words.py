"""Words with the blanks before them: the stretches that two kinds of tokenizers encode one by one.

A piece of a vocabulary in which no piece has a marker (a blank) behind another character never crosses the place where a run of
blanks begins, so the text may be cut there. A pattern that pre-tokenises bytes ends a match there too, if what stands before
the blanks is no white space.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from itertools import chain

import numpy as np

from sparkreco.llm.blocks import Block

MARK = "▁"
_WORD = re.compile(" +[^ ]*")
#: White space, by any of the libraries' notions, before a blank.
_SPACED = re.compile("[\t-\r\x1c-\x1f\x85\xa0  -     　] ")
_LAST = re.compile("[\t-\r\x1c-\x1f\x85\xa0  -     　]\\Z")


def marked_words(text: str) -> list[str]:
    """A blank and the text, cut before each run of blanks; a marker in the text is a blank, as it is to the pieces. Empty: none."""
    return _WORD.findall(" " + text.replace(MARK, " ")) if text else []


def plain_words(text: str) -> list[str]:
    """A blank and the text, cut before each run of blanks that no other white space precedes. Empty: none."""
    if not text:
        return []
    words = _WORD.findall(" " + text)
    if not _SPACED.search(text):
        return words
    out, open_ = [], False
    for w in words:
        if open_:
            out[-1] += w
        else:
            out.append(w)
        open_ = _LAST.search(w) is not None
    return out


class Numbering(dict):
    """Numbers 0, 1, ... of keys, in the order in which they are asked for."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def numbered_words(block: Block, cut: Callable[[str], list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words of a block in the order in which they are met, the number of each occurrence, and where each document's occurrences start."""
    numbers = Numbering()
    codes, at = [], np.zeros(len(block) + 1, np.int64)
    for i in range(len(block)):
        own = list(map(numbers.__getitem__, cut(block.text(i).decode())))
        codes.append(own)
        at[i + 1] = at[i] + len(own)
    return list(numbers), np.fromiter(chain.from_iterable(codes), np.int64, int(at[-1])), at


def gathered(starts: np.ndarray, sizes: np.ndarray, which: np.ndarray) -> np.ndarray:
    """The places of the stretches `which`, one after the other; stretch k has sizes[k] places from starts[k] on."""
    n = sizes[which].astype(np.int64)
    ends = np.cumsum(n)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(starts[which] - (ends - n), n)


def sums(values: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The sum of values[at[i] : at[i + 1]] for each i, in whole numbers."""
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]
