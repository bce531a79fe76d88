"""Deep-shallow sorting of suffixes up to a given depth, on numpy arrays.

A multikey quicksort orders the suffixes word by word to a shallow depth: suffixes with equal
words stay together and only they take part in the next step. Groups that still agree then go
through blind tries: one suffix of a group stands for it, each other one is compared with it once,
and the place and the byte where it leaves decide the branch it belongs to. All groups take a
step at once.
"""

from __future__ import annotations

import numpy as np

WORD = 8
#: Words compared by the multikey quicksort before the blind tries take over.
SHALLOW = 4


def words_at(data: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on, as one number whose order is that of the bytes."""
    padded = np.concatenate([data, np.zeros(WORD, np.uint8)]).astype(np.uint64)
    n = len(data)
    out = np.zeros(n, np.uint64)
    for i in range(WORD):
        out = (out << np.uint64(8)) | padded[i : n + i]
    return out


def split_runs(groups: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order that sorts rows by group and key, and the number of the run of equal ones for each."""
    order = np.lexsort((key, groups))
    g, k = groups[order], key[order]
    new = np.ones(len(order), bool)
    new[1:] = (g[1:] != g[:-1]) | (k[1:] != k[:-1])
    return order, np.cumsum(new) - 1


def equal_groups(data: np.ndarray, starts: np.ndarray, groups: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Sort the suffixes of each group to a depth and find those that are equal so far.

    ``starts`` are places in ``data`` with ``depth`` bytes after them. Returns indexes of suffixes and a
    run number for each; a run holds two suffixes or more, of one group, that agree in ``depth`` bytes.
    """
    words = words_at(data)
    at, run = shared(np.arange(len(starts)), groups, np.zeros(len(starts), np.int64))
    for step in range(min(SHALLOW, depth // WORD)):
        at, run = shared(at, run, words[starts[at] + WORD * step])
        if not len(at):
            return at, run
    return blind_tries(data, words, starts, at, run, min(SHALLOW, depth // WORD) * WORD, depth)


def shared(at: np.ndarray, run: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sort by run and key, number the runs anew, and keep those of two suffixes or more."""
    order, fresh = split_runs(run, key)
    size = np.bincount(fresh, minlength=1)
    keep = size[fresh] > 1
    return at[order[keep]], fresh[keep]


def agreement(words: np.ndarray, a: np.ndarray, b: np.ndarray, done: int, depth: int) -> np.ndarray:
    """In how many bytes suffixes agree, up to ``depth``, if they agree in the first ``done``."""
    out = np.full(len(a), done, np.int64)
    open_ = np.arange(len(a))
    for place in range(done, depth, WORD):
        # The last word may reach past the depth; what lies there is cut off below.
        differ = words[a[open_] + place] ^ words[b[open_] + place]
        same = differ == 0
        left = np.zeros(len(open_), np.int64)
        d = differ[~same]
        left[~same] = (64 - bit_length(d)) // 8
        out[open_] = place + np.where(same, WORD, left)
        open_ = open_[same]
        if not len(open_):
            break
    return np.minimum(out, depth)


def bit_length(x: np.ndarray) -> np.ndarray:
    """Bits of numbers above zero."""
    high = (x >> np.uint64(32)).astype(np.float64)
    low = (x & np.uint64(0xFFFFFFFF)).astype(np.float64)
    return np.where(high > 0, 32 + np.frexp(high)[1], np.frexp(low)[1]).astype(np.int64)


def blind_tries(
    data: np.ndarray, words: np.ndarray, starts: np.ndarray, at: np.ndarray, run: np.ndarray, done: int, depth: int
) -> tuple[np.ndarray, np.ndarray]:
    """Take groups that agree in ``done`` bytes apart until what is left agrees in ``depth``."""
    found_at, found_run, used = [], [], 0
    while len(at):
        new = np.concatenate([[True], run[1:] != run[:-1]])
        number = np.cumsum(new) - 1
        stand = at[np.flatnonzero(new)][number]
        agree = agreement(words, starts[at], starts[stand], done, depth)
        whole = agree >= depth
        # Those that agree to the depth are a leaf of the trie, the standing suffix among them.
        leaf_size = np.bincount(number[whole], minlength=number[-1] + 1)
        leaf = whole & (leaf_size[number] > 1)
        found_at.append(at[leaf])
        found_run.append(number[leaf] + used)
        used += int(number[-1]) + 1
        # The others branch off where they leave the standing suffix, by the byte they go on with.
        rest = np.flatnonzero(~whole)
        branch = agree[rest] * 256 + data[starts[at[rest]] + agree[rest]]
        at, run = shared(at[rest], number[rest], branch)
    if not found_at:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_at), np.concatenate(found_run)
