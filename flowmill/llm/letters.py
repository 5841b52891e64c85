"""Words made of letters in batches of text, in lower case."""

from __future__ import annotations

import numpy as np

from flowmill.llm import encoder, textbuf

_WORD = np.zeros(256, bool)
_WORD[65:91] = _WORD[97:123] = _WORD[128:] = True


def words(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(padded lower-case bytes, starts, lengths, index of the text) of runs of ASCII letters and other characters."""
    buf = encoder.lowered(textbuf.padded(raw))
    starts, ends = textbuf.runs(_WORD[buf[: len(raw)]], offsets)
    return buf, starts, ends - starts, np.searchsorted(offsets, starts, side="right") - 1
