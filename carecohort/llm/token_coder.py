"""Context-mixing range coder for token ids, run over many blocks in lockstep.

Every block is coded on its own, so blocks of a batch advance together: step ``t``
codes token ``t`` of all of them with a few array operations.

Model of one block (integers only, so any machine decodes the same):

* order 2 and order 1 each predict one id, the one that last followed the context, with
  a confidence: how often in a row it did, up to 3.  The two confidences and whether both
  predict the same id choose one of 32 cells; a cell mixes the predictions by shares of
  256, which the block's head holds.
* order 0 holds frequencies of 4,096 of the block's ids, from its head, and codes whatever
  the predictions miss.  At least one share of a cell is left to it.

The encoder knows the whole block, so it finds contexts by sorting and counts shares and
frequencies first; the decoder only keeps what last followed each context.

One coding step of a range coder per token, in 24-bit words; carries are settled at the end.

Block layout (little-endian): ``CMR2``, token count, alphabet size, bytes of the packed
head, number of code words, the head (zlib: gaps of the sorted ids, frequencies less one,
shares of order 2 and of order 1), the code words, 3 bytes each, crc32 of all before.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
LANES = 2048
_CONTEXTS = 4096
_CELLS = 32
_SHARES = 256
_UNIT = 4096  # frequencies of a block, and what a share is divided into
_BITS = 20  # of _SHARES * _UNIT
_WORD, _WORD_MASK, _LEAST = 24, (1 << 24) - 1, 1 << 28
_HEAD = struct.Struct("<4sIIII")


def _active(lengths: np.ndarray):
    """How many lanes (longest first) still have a token at each step."""
    steps = int(lengths.max(initial=0))
    return len(lengths) - np.searchsorted(np.sort(lengths), np.arange(steps), side="right")


def _predictions(contexts: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Per token, what last followed its context, from 1, over two bits of confidence (0: nothing yet)."""
    keys = np.sort(contexts << 12 | np.arange(len(contexts), dtype=np.int32))
    order, context = (keys & BLOCK - 1).astype(np.intp), keys >> 12
    follows = following.take(order)
    again = context[1:] == context[:-1]
    hit = np.zeros(len(order) + 1, np.uint8)  # of the token before, then of each
    np.logical_and(again, follows[1:] == follows[:-1], out=hit[2:].view(bool))
    seen = follows[:-1] << 2
    seen += (hit[1:-1] & hit[:-2]) + hit[1:-1] + np.uint8(1)
    seen *= again
    out = np.zeros(len(order), np.uint16)
    out[order[1:]] = seen
    return out


def _intervals(x: np.ndarray, size: int):
    """Start and width of each token's interval, and what the head says of them."""
    x1, at = x + np.uint16(1), x.astype(np.intp)
    last, before = np.zeros(len(x), np.int32), np.zeros(len(x), np.int32)
    last[1:] = x[:-1]
    before[2:] = x[:-2]
    s1 = _predictions(last, x1)
    s2 = _predictions((before * 40503 + last) & (_CONTEXTS - 1), x1)
    cell = (s2 & 3) << 2
    cell |= s1 & 3
    cell += ((s1 ^ s2) < 4) * np.uint16(16)
    hit2 = x1 == s2 >> 2
    hit1 = (x1 == s1 >> 2) & ~hit2
    cell += hit1 * np.uint16(_CELLS)
    cell += hit2 * np.uint16(2 * _CELLS)
    cell = cell.astype(np.intp)
    n0, n1, n2 = np.bincount(cell, minlength=3 * _CELLS).reshape(3, _CELLS)
    n = np.maximum(n0 + n1 + n2, 1)
    f2 = np.minimum(np.maximum(n2 * _SHARES // n, n2 > 0), _SHARES - 2)
    f1 = np.minimum(np.maximum(n1 * _SHARES // n, n1 > 0), _SHARES - 1 - f2)
    counts = np.bincount(at[cell < _CELLS], minlength=size)
    often = 1 + counts * (_UNIT - size) // max(int(counts.sum()), 1)
    often[np.argmax(counts)] += _UNIT - often.sum()
    rest, none = _SHARES - f2 - f1, np.zeros(_CELLS, np.int64)
    shares = np.concatenate([rest, none, none]).astype(np.int32).take(cell)
    begin = (np.cumsum(often) - often).astype(np.int32).take(at)
    begin *= shares
    begin += np.concatenate([(f2 + f1) * _UNIT, f2 * _UNIT, none]).astype(np.int32).take(cell)
    shares *= often.astype(np.int32).take(at)
    shares += np.concatenate([none, f1 * _UNIT, f2 * _UNIT]).astype(np.int32).take(cell)
    return begin, shares, (often - 1).astype("<u2").tobytes() + f2.astype("u1").tobytes() + f1.astype("u1").tobytes()


def _packed(head: bytes) -> bytes:
    coder = zlib.compressobj(1, zlib.DEFLATED, 12, 6, zlib.Z_HUFFMAN_ONLY)
    return coder.compress(head) + coder.flush()


def encode_blocks(blocks: list[np.ndarray]) -> list[bytes]:
    """Encode blocks of at most ``BLOCK`` ids (below 2**32) each; empty blocks are allowed."""
    if not blocks:
        return []
    order = sorted(range(len(blocks)), key=lambda i: -len(blocks[i]))
    lengths = np.array([len(blocks[i]) for i in order])
    if lengths[0] > BLOCK:
        raise ValueError(f"a block holds {BLOCK} ids at most")
    active = _active(lengths)
    lanes = len(blocks)
    begins = np.zeros((lanes, max(len(active), 1)), np.int32)
    widths = np.zeros((lanes, max(len(active), 1)), np.int32)
    heads = []
    for lane, i in enumerate(order):
        ids, rank = _ranked(np.asarray(blocks[i], np.int64))
        gaps, model = ids.astype("<u4"), b""
        gaps[1:] -= gaps[:-1].copy()
        if len(rank):
            begins[lane, : len(rank)], widths[lane, : len(rank)], model = _intervals(rank, len(ids))
        heads.append((len(ids), _packed(gaps.tobytes() + model)))
    begins, widths = np.ascontiguousarray(begins.T), np.ascontiguousarray(widths.T)
    out = np.zeros(lanes * (len(active) + 2), np.int64)  # a word's number, then its lane; word 0 stays free
    place = np.arange(lanes) + lanes
    low, span = np.zeros(lanes, np.int64), np.full(lanes, 1 << 2 * _WORD, np.int64)
    for t, n in enumerate(active):
        r = span[:n] >> _BITS
        low[:n] += r * begins[t, :n]
        r *= widths[t, :n]
        short = np.flatnonzero(r < _LEAST)
        span[:n] = r
        if len(short):
            spot, bottom = place[short], low[short]
            out[spot] = bottom >> _WORD
            place[short] = spot + lanes
            low[short] = (bottom & _WORD_MASK) << _WORD
            span[short] <<= _WORD
    out[place] = (low + _WORD_MASK) >> _WORD  # what follows may be read as zeros
    used = place // lanes + 1
    out = out.reshape(-1, lanes)[: int(used.max())]
    while (carry := out >> _WORD).any():
        out &= _WORD_MASK
        out[:-1] += carry[1:]
    code = np.ascontiguousarray(out.T.astype("<u4")).view("u1").reshape(lanes, -1, 4)[:, :, :3]
    done: list[bytes] = [b""] * lanes
    for lane, i in enumerate(order):
        words = code[lane, 1 : used[lane]].tobytes()
        size, packed = heads[lane]
        body = _HEAD.pack(b"CMR2", lengths[lane], size, len(packed), len(words) // 3) + packed + words
        done[i] = body + struct.pack("<I", zlib.crc32(body))
    return done


def _ranked(ids: np.ndarray):
    if len(ids) and (top := int(ids.max())) < 1 << 17:
        there = np.zeros(top + 1, bool)
        there[ids] = True
        found = np.flatnonzero(there)
        table = np.empty(len(there), np.uint16)
        table[found] = np.arange(len(found))
        return found, table.take(ids)
    found, rank = np.unique(ids, return_inverse=True)
    return found, rank.astype(np.uint16)


def _parsed(i: int, payload: bytes):
    """Token count, ids, frequencies, shares of order 2 and 1, code words."""
    if len(payload) < _HEAD.size + 4 or zlib.crc32(payload[:-4]) != struct.unpack("<I", payload[-4:])[0]:
        raise ValueError(f"block {i} of the batch fails its checksum")
    magic, count, size, packed, words = _HEAD.unpack_from(payload)
    if magic != b"CMR2":
        raise ValueError(f"block {i} of the batch has an unknown format")
    head = zlib.decompress(payload[_HEAD.size : _HEAD.size + packed])
    alphabet = np.cumsum(np.frombuffer(head, "<u4", size).astype(np.int64))
    if not count:
        return 0, alphabet, np.full(1, _UNIT), np.zeros(_CELLS, np.int64), np.zeros(_CELLS, np.int64), np.zeros(0, "<u4")
    often = np.frombuffer(head, "<u2", size, 4 * size).astype(np.int64) + 1
    shares = np.frombuffer(head, "u1", 2 * _CELLS, 6 * size).astype(np.int64)
    code = np.zeros((words, 4), "u1")
    code[:, :3] = np.frombuffer(payload, "u1", 3 * words, _HEAD.size + packed).reshape(-1, 3)
    return count, alphabet, often, shares[:_CELLS], shares[_CELLS:], code.view("<u4").ravel()


def decode_blocks(payloads: list[bytes]) -> list[np.ndarray]:
    """Decode blocks written by :func:`encode_blocks`; a damaged block raises ``ValueError``."""
    if not payloads:
        return []
    parsed = [_parsed(i, p) for i, p in enumerate(payloads)]
    order = sorted(range(len(parsed)), key=lambda i: -parsed[i][0])
    lengths = np.array([parsed[i][0] for i in order])
    active = _active(lengths)
    lanes, lane = len(parsed), np.arange(len(parsed))
    width = max(len(p[1]) for p in parsed) + 1
    code = np.zeros((max(len(p[5]) for p in parsed) + 3, lanes), np.uint32)
    # at a frequency's number its id's, from 0; where ids' frequencies start
    found, starts = np.zeros((lanes, _UNIT), np.uint16), np.zeros((lanes, width + 1), np.uint16)
    share2, shares = np.zeros((lanes, _CELLS), np.int64), np.zeros((lanes, _CELLS), np.int64)
    for k, i in enumerate(order):
        _, _, often, f2, f1, words = parsed[i]
        code[: len(words), k] = words
        found[k] = np.repeat(np.arange(len(often), dtype=np.uint16), often)
        np.cumsum(often, out=starts[k, 1 : len(often) + 1], dtype=np.uint16)
        share2[k], shares[k] = f2 * _UNIT, f2 + f1
    value = code[0].astype(np.int64) << _WORD | code[1]
    code, found, starts, share2, shares = (a.ravel() for a in (code, found, starts, share2, shares))
    after1, after2 = np.zeros(lanes * width, np.uint16), np.zeros(lanes * _CONTEXTS, np.uint16)
    base1, base2, base_f, base_s, base_c = lane * width, lane * _CONTEXTS, lane * _UNIT, lane * (width + 1), lane * _CELLS
    inverse = np.ones(_SHARES + 1, np.int64)  # exact for what is divided, below 2**20
    inverse[1:] = -(-(1 << 32) // np.arange(1, _SHARES + 1))
    place = lane + 2 * lanes
    span = np.full(lanes, 1 << 2 * _WORD, np.int64)
    ranks = np.zeros((max(len(active), 1), lanes), np.uint16)
    last, before = np.zeros(lanes, np.int64), np.zeros(lanes, np.int64)
    for t, n in enumerate(active):
        if n < len(last):
            last, before, value, span = last[:n], before[:n], value[:n], span[:n]
        at1 = base1[:n] + last
        at2 = before * 40503
        at2 += last
        at2 &= _CONTEXTS - 1
        at2 += base2[:n]
        s1, s2 = after1.take(at1), after2.take(at2)
        cell = s2 & 3
        cell <<= 2
        cell |= s1 & 3
        cell += ((s1 ^ s2) < 4) * np.uint16(16)
        cell = cell + base_c[:n]
        known = shares.take(cell)
        rest = _SHARES - known
        known *= _UNIT
        r = span >> _BITS
        v = (value / r).astype(np.int64)  # both below 2**53, so doubles give it exactly
        u = v - known
        slot = np.maximum(u, 0)
        slot *= inverse.take(rest)
        slot >>= 32
        slot += base_f[:n]
        x = found.take(slot)
        at = x + base_s[:n]
        first = starts.take(at)
        at += 1
        size = (starts.take(at) - first) * rest
        first = first * rest
        first += known
        guessed = np.flatnonzero(u < 0)
        if len(guessed):
            f2 = share2.take(cell.take(guessed))
            by2 = v.take(guessed) < f2
            x[guessed] = (np.where(by2, s2.take(guessed), s1.take(guessed)) >> 2) - 1
            size[guessed] = np.where(by2, f2, known.take(guessed) - f2)
            first[guessed] = np.where(by2, 0, f2)
        first *= r
        value -= first
        span = r
        span *= size
        short = np.flatnonzero(span < _LEAST)
        if len(short):
            spot = place.take(short)
            value[short] = value.take(short) << _WORD | code.take(spot)
            place[short] = spot + lanes
            span[short] <<= _WORD
        ranks[t, :n] = x
        entry = x + 1
        entry <<= 2
        d1, d2 = s1 ^ entry, s2 ^ entry
        entry |= 1
        after1[at1] = np.where(d1 < 4, s1 + (d1 < 3), entry)
        after2[at2] = np.where(d2 < 4, s2 + (d2 < 3), entry)
        before, last = last, x.astype(np.int64)
    done: list[np.ndarray] = [np.zeros(0, np.int64)] * lanes
    ranks = np.ascontiguousarray(ranks.T)
    for k, i in enumerate(order):
        if lengths[k]:
            done[i] = parsed[i][1][ranks[k, : lengths[k]]]
    return done
