"""Content-defined segments: where a text's long substrings must be looked up to find equal ones elsewhere.

A string of ``length`` bytes is keyed by the smallest hash among its grams of some bytes (``GRAM`` at first).  The key depends on the string
alone, so equal strings meet under equal keys wherever they are.  Neighbouring strings mostly share their key; a run of
them is a segment: one row for some seventy strings.
"""

from __future__ import annotations

import numpy as np

from lumenledger.llm.common import mix64
from lumenledger.llm.shingles import _BASE_INVERSE, SpanDigests, powers, prefix_hash

GRAM = 64
#: Strings in a segment at most.
MOST = 256


def _slide_min(x: np.ndarray, w: int) -> np.ndarray:
    """Minimum of each w neighbours, by minima from both ends of blocks of w."""
    n = len(x) - w + 1
    pad = np.full(-(-len(x) // w) * w, np.iinfo(np.uint64).max, np.uint64)
    pad[: len(x)] = x
    grid = pad.reshape(-1, w)
    ahead = np.minimum.accumulate(grid, axis=1).ravel()
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[w - 1 : w - 1 + n])


def segments(raw: np.ndarray, at: np.ndarray, length: int = 200, gram: int = GRAM) -> dict[str, np.ndarray]:
    """Segments of texts laid end to end: key, digest (of the bytes covered), text, start (in its text), strings, and
    twice: whether the key's gram lies in the segment more than once, so that its own strings may be equal."""
    empty = {k: np.zeros(0, np.int64) for k in ("key", "digest", "text", "start", "strings", "twice")}
    n = len(raw) - length + 1
    if n <= 0:
        return empty
    prefix = prefix_hash(raw)
    back = powers(_BASE_INVERSE, len(raw))
    # another size of gram has another order, not only another window
    grams = mix64((prefix[gram:] - prefix[:-gram]) * back[: len(raw) - gram + 1] + np.uint64(gram))
    window = length - gram + 1
    key = _slide_min(grams, window)[:n]
    inside = np.zeros(n + 1, np.int64)
    lengths = np.diff(at)
    good = lengths >= length
    np.add.at(inside, at[:-1][good], 1)
    np.add.at(inside, np.minimum(at[1:][good] - length + 1, n), -1)
    live = np.cumsum(inside[:-1]) > 0
    if not live.any():
        return empty
    # runs of one key within one text, cut to MOST strings
    new = np.empty(n, bool)
    new[0] = True
    new[1:] = (key[1:] != key[:-1]) | ~live[:-1]
    starts_of_texts = at[:-1][good]
    new[starts_of_texts] = True
    begin = np.flatnonzero(new & live)
    stop_mark = np.flatnonzero(~live | new)
    end = np.append(stop_mark, n)[np.searchsorted(stop_mark, begin, side="right")]
    size = end - begin
    parts = -(-size // MOST)
    if parts.max() > 1:
        order = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        last = np.repeat(end, parts)
        begin = np.repeat(begin, parts) + order * MOST
        end = np.minimum(begin + MOST, last)
        size = end - begin
    text = np.searchsorted(at, begin, side="right") - 1
    # grams that are the smallest of some string; two equal ones within reach are neighbours among them
    top = np.full(len(grams), False)
    top[: n] |= grams[:n] == key  # at the first place of a string
    low = _reach_max(key, live, window, len(grams))
    spots = np.flatnonzero(grams == low)
    values = grams[spots]
    pair = np.flatnonzero((values[1:] == values[:-1]) & (np.diff(spots) < window))
    a, b = spots[pair], spots[pair + 1]
    twice = np.zeros(len(begin), bool)
    for x, y in zip(a.tolist(), b.tolist()):
        # segments whose strings' grams reach both places
        lo = np.searchsorted(end, x - window + 2)
        while lo < len(begin) and begin[lo] <= x:
            if end[lo] - 1 + window - 1 >= y and key[begin[lo]] == grams[x]:
                twice[lo] = True
            lo += 1
    twice |= size > window
    return {
        "key": key[begin].view(np.int64),
        "digest": SpanDigests(raw).of(begin, end + length - 1).view(np.int64),
        "text": text,
        "start": begin - at[text],
        "strings": size,
        "twice": twice,
    }


def _reach_max(key: np.ndarray, live: np.ndarray, window: int, grams: int) -> np.ndarray:
    """For each gram the largest key of the strings that contain it: its own hash iff it is some string's key."""
    turned = np.full(grams + window - 1, np.iinfo(np.uint64).max, np.uint64)
    turned[window - 1 : window - 1 + len(key)] = np.where(live, ~key, np.iinfo(np.uint64).max)
    return ~_slide_min(turned, window)[:grams]
