"""Re-Pair grammar compression of id arrays, with expansion lengths for random access."""

from __future__ import annotations

import struct
from dataclasses import dataclass

import numpy as np

MAGIC = b"GLR1"
#: A pair is replaced while it occurs this often: a rule costs about as much as three symbols, so rarer pairs make a block larger.
LEAST = 4


@dataclass
class Grammar:
    """``base``: ids of the first codes; ``rules`` (r, 2): codes of nonterminals len(base) + k; ``seq``: the codes."""

    base: np.ndarray
    rules: np.ndarray
    lengths: np.ndarray
    seq: np.ndarray


def _dense(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct ids in order, and the array in terms of their places."""
    if not len(ids) or ids.max() >= 1 << 20:
        base, seq = np.unique(ids, return_inverse=True)
        return base, seq.ravel().astype(np.uint32)
    there = np.zeros(int(ids.max()) + 1, bool)
    there[ids] = True
    return np.flatnonzero(there), (np.cumsum(there, dtype=np.uint32) - np.uint32(1))[ids]


def compress(ids: np.ndarray, least: int = LEAST) -> Grammar:
    """Replace frequent pairs by nonterminals until no pair can be replaced ``least`` times.

    Pairs are replaced in batches, an approximation of replacing the most frequent one each time: a round counts all adjacent pairs and replaces, left to right, every pair at least a sixteenth as frequent as the
    most frequent one (later rounds go on from there), so a few rounds do what one pair at a time would; where
    chosen pairs overlap the left one wins. Rules refer to earlier codes only.

    Once a round has replaced all pairs that occur ``least`` times, only pairs with a new code and those that it chose
    and left in part can occur so often, so the next round looks at their places alone.
    """
    base, seq = _dense(ids)
    rules, n_codes = [], len(base)
    bar = places = None  # places: where pairs that may be replaced begin; None: everywhere
    while len(seq) > 1 and (places is None or len(places)):
        wide = n_codes > 1 << 16
        t = np.uint64 if wide else np.uint32
        left, right = (seq[:-1], seq[1:]) if places is None else (seq[places], seq[places + 1])
        pair = (left.astype(t) << t(32 if wide else 16)) | right.astype(t)
        s = np.sort(pair)
        first = np.r_[0, np.flatnonzero(s[1:] != s[:-1]) + 1, len(s)]
        counts = np.diff(first)
        bar = max(least, (counts.max() + 15) // 16) if bar is None or bar > least else least
        chosen = s[first[:-1][counts >= bar]]
        if not len(chosen):
            if counts.max() < least:
                break
            continue
        # Few positions pass the hashed table, which names the chosen pair; those that met another there are looked up.
        h = lambda x: (x * t(0x9E3779B97F4A7C15 & ((1 << 64) - 1 if wide else (1 << 32) - 1))) >> t(46 if wide else 14)
        there, which, hashed = np.zeros(1 << 18, bool), np.zeros(1 << 18, np.int32), h(pair)
        there[h(chosen)], which[h(chosen)] = True, np.arange(len(chosen), dtype=np.int32)
        at = np.flatnonzero(there[hashed])
        mine, k = pair[at], which[hashed[at]]
        ok = chosen[k] == mine
        other = np.flatnonzero(~ok)
        found = np.minimum(np.searchsorted(chosen, mine[other]), len(chosen) - 1)
        k[other], ok[other] = found, chosen[found] == mine[other]
        at, k = at[ok], k[ok]
        at = at if places is None else places[at]
        met = at
        starts = np.r_[True, np.diff(at) != 1]
        run = np.flatnonzero(starts)[np.cumsum(starts) - 1]
        take = (np.arange(len(at)) - run) % 2 == 0
        at, k = at[take], k[take]
        used = np.bincount(k, minlength=len(chosen)) > 1
        ok = used[k]
        at, k = at[ok], k[ok]
        if not len(at):
            if bar <= least:
                break
            continue
        code = np.cumsum(used) - 1 + n_codes
        shift = t(32 if wide else 16)
        kept = chosen[used]
        rules.append(np.stack([kept >> shift, kept & t((1 << int(shift)) - 1)], axis=1).astype(np.uint32))
        seq[at] = code[k]
        stay = np.ones(len(seq), bool)
        stay[at + 1] = False
        if bar == least:
            open_ = np.zeros(len(seq), bool)
            open_[met] = True  # chosen, whether replaced or not
            open_[at[at > 0] - 1] = True
            places = np.flatnonzero(open_[stay])
            places = places[: np.searchsorted(places, int(stay.sum()) - 1)]
        seq = seq[stay]
        n_codes += int(used.sum())
    rules = np.concatenate(rules) if rules else np.empty((0, 2), np.uint32)
    return Grammar(base.astype(np.uint32), rules, _lengths(len(base), rules), seq)


def _lengths(n_base: int, rules: np.ndarray) -> np.ndarray:
    """Expansion length of every code."""
    n = np.ones(n_base + len(rules), np.int64)
    done = n_base
    while done < len(n):  # a stretch of rules that refer to finished codes only
        deep = np.flatnonzero(rules[done - n_base :].max(axis=1) >= done)
        end = done + (int(deep[0]) if len(deep) else len(n) - done)
        part = rules[done - n_base : end - n_base]
        n[done:end] = n[part[:, 0]] + n[part[:, 1]]
        done = end
    return n


def expand(g: Grammar, codes: np.ndarray | None = None) -> np.ndarray:
    """The ids of some codes (default: all). Every code's expansion is laid out once, then copied by offset."""
    seq = g.seq if codes is None else codes
    if not len(seq):
        return np.empty(0, np.uint32)
    flat, starts = _layout(g)
    n = g.lengths[seq]
    total = int(n.sum())
    t = np.int32 if max(total, len(flat)) < 1 << 31 else np.int64  # half the memory to move
    n = n.astype(t)
    ends = np.cumsum(n, dtype=t)
    at = np.repeat(starts.astype(t)[seq] - (ends - n), n)
    at += np.arange(total, dtype=t)
    return flat[at]


def _layout(g: Grammar) -> tuple[np.ndarray, np.ndarray]:
    """Expansions of all codes end to end, and where each starts."""
    seq, nb = np.arange(len(g.lengths), dtype=np.uint32), len(g.base)
    while (deep := seq >= nb).any():
        at = np.cumsum(deep) + np.arange(len(seq))
        out = np.empty(len(seq) + int(deep.sum()), np.uint32)
        pair = g.rules[seq[deep] - nb]
        out[at[~deep]] = seq[~deep]
        out[at[deep] - 1] = pair[:, 0]
        out[at[deep]] = pair[:, 1]
        seq = out
    return g.base[seq], np.cumsum(g.lengths) - g.lengths


def slice_of(g: Grammar, start: int, stop: int) -> np.ndarray:
    """Ids start..stop-1: only the codes that cover them are expanded, found by their expansion lengths."""
    ends = np.cumsum(g.lengths[g.seq])
    i, j = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop, "left") + 1
    before = int(ends[i - 1]) if i else 0
    return expand(g, g.seq[i:j])[start - before : stop - before]


def dump(g: Grammar, doc_ids: np.ndarray, doc_null: np.ndarray, doc_tokens: np.ndarray) -> bytes:
    """One block of the file format.

    Magic, then five counts (documents, tokens, base codes, rules, codes in the sequence; unsigned 32-bit; tokens 64)
    and the arrays: document ids (int64), null flags (1 byte), tokens per document, base ids, rules, expansion lengths
    of the rules and the sequence (all unsigned 32-bit). Little-endian throughout.
    """
    head = MAGIC + struct.pack("<IQIII", len(doc_ids), int(doc_tokens.sum()), len(g.base), len(g.rules), len(g.seq))
    parts = (doc_ids.astype("<i8"), doc_null.astype("u1"), *(x.astype("<u4") for x in (doc_tokens, g.base, g.rules.ravel(), g.lengths[len(g.base) :], g.seq)))
    return head + b"".join(p.tobytes() for p in parts)


def load(data: bytes) -> tuple[Grammar, np.ndarray, np.ndarray, np.ndarray]:
    """A block -> grammar, document ids, null flags, tokens per document."""
    if data[:4] != MAGIC:
        raise ValueError("not a block of this format")
    docs, _, nb, nr, ns = struct.unpack_from("<IQIII", data, 4)
    at, out = 4 + struct.calcsize("<IQIII"), []
    for n, kind in ((docs, "<i8"), (docs, "u1"), (docs, "<u4"), (nb, "<u4"), (2 * nr, "<u4"), (nr, "<u4"), (ns, "<u4")):
        out.append(np.frombuffer(data, kind, n, at))
        at += out[-1].nbytes
    ids, null, tokens, base, rules, lengths, seq = out
    return Grammar(base, rules.reshape(-1, 2), np.r_[np.ones(nb, np.int64), lengths], seq), ids, null, tokens
