"""Word and shingle hashes of texts in numpy, for tasks that read Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = np.uint64(0x9E3779B97F4A7C15)
#: bytes hashed at once: the temporaries of a worker are some sixteen times as large
CHUNK = 1 << 16
#: bytes of text that a task works on at once, unless one text is longer
BATCH = 2 << 20


def _table(seed: int, n: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64(seed)).integers(1, 1 << 63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


_BYTE = _table(11, 256)
with np.errstate(over="ignore"):
    _POWER = np.cumprod(np.full(CHUNK, _ODD, dtype=np.uint64))
    _INVERSE = np.cumprod(np.full(CHUNK, np.uint64(pow(int(_ODD), -1, 1 << 64)), dtype=np.uint64))


def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values."""
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return h ^ (h >> np.uint64(33))


def _words_of(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and hashes of the words in at most CHUNK bytes."""
    space = _SPACE[buf]
    edge = np.diff(np.concatenate(([True], space, [True])).view(np.int8))
    starts, ends = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    if not len(starts):
        return starts, np.zeros(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        value = np.where(space, np.uint64(0), _BYTE[buf] * _POWER[: len(buf)])
        h = np.add.reduceat(value, starts) * _INVERSE[starts]
        return starts, mix(h + (ends - starts).astype(np.uint64) * _ODD)


def _long_word(buf: np.ndarray, at: int) -> tuple[int, np.uint64]:
    """End and hash of the word that begins at a place, read in parts: the same hash as that of a short word's rule."""
    total, shift, to = np.uint64(0), np.uint64(1), at
    with np.errstate(over="ignore"):
        while to < len(buf):
            part = buf[to : to + CHUNK]
            space = _SPACE[part]
            n = int(space.argmax()) if space.any() else len(part)
            total += (_BYTE[part[:n]] * _POWER[:n]).sum(dtype=np.uint64) * shift
            shift *= _POWER[n - 1] if n else np.uint64(1)
            to += n
            if n < len(part):
                break
        return to, mix(np.array([total * _INVERSE[0] + np.uint64(to - at) * _ODD]))[0]


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Byte offsets and 64-bit hashes of the words of a byte string (words: runs without ASCII white space).

    Equal words have equal hashes, however long they are and wherever they stand.
    """
    buf = np.frombuffer(data, dtype=np.uint8)
    if len(buf) <= CHUNK:
        return _words_of(buf)
    at, out = 0, []
    while at < len(buf):
        to = min(at + CHUNK, len(buf))
        if to < len(buf) and not _SPACE[buf[to]]:  # cut after the last space
            spaces = np.flatnonzero(_SPACE[buf[at:to]])
            if not len(spaces):
                end, h = _long_word(buf, at)
                out.append((np.array([at]), np.array([h])))
                at = end
                continue
            to = at + int(spaces[-1]) + 1
        starts, h = _words_of(buf[at:to])
        out.append((starts + at, h))
        at = to
    return np.concatenate([s for s, _ in out]), np.concatenate([h for _, h in out])


def batches(texts: Sequence[str | None], size: int = BATCH) -> Iterator[tuple[int, list[bytes]]]:
    """Texts as lower-cased bytes (A-Z only), in lists of about ``size`` bytes, with the place of the first."""
    first, part, n = 0, [], 0
    for i, text in enumerate(texts):
        data = (text or "").encode("utf-8", "surrogatepass").lower()
        if part and n + len(data) > size:
            yield first, part
            first, part, n = i, [], 0
        part.append(data)
        n += len(data) + 1
    if part:
        yield first, part


def shingle_sets(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of the word windows of each text, sorted inside a text, and the bounds (len(texts) + 1) of each.

    A text with fewer words has its whole sequence as one window; one without words has none.
    """
    joined = b"\n".join(texts)
    lengths = np.fromiter((len(t) + 1 for t in texts), dtype=np.int64, count=len(texts))
    begin = np.concatenate(([0], np.cumsum(lengths)))[:-1]
    at, h = word_hashes(joined)
    first = np.searchsorted(at, begin)  # first word of each text
    count = np.diff(np.append(first, len(at)))
    with np.errstate(over="ignore"):
        shingle = np.zeros(max(len(h) - words + 1, 0), dtype=np.uint64)
        for k in range(words):
            shingle = mix(shingle + h[k : len(h) - words + 1 + k] * _BYTE[k + 1] + np.uint64(k)) if len(shingle) else shingle
        owner = np.repeat(np.arange(len(texts)), count)
        inside = np.arange(len(owner)) - first[owner] + words <= count[owner] if len(owner) else np.zeros(0, dtype=bool)
        keep = inside[: len(shingle)]
        owners, values = owner[: len(shingle)][keep], shingle[keep]
        short = np.flatnonzero((count > 0) & (count < words))
        if len(short):
            whole = []
            for i in short:
                v = np.zeros(1, dtype=np.uint64)
                for k in range(count[i]):
                    v = mix(v + h[first[i] + k : first[i] + k + 1] * _BYTE[k + 1] + np.uint64(k))
                whole.append(mix(v + np.uint64(count[i]) * _ODD)[0])
            owners, values = np.concatenate((owners, short)), np.concatenate((values, np.array(whole, dtype=np.uint64)))
    order = np.lexsort((values, owners))
    owners, values = owners[order], values[order]
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = (values[1:] != values[:-1]) | (owners[1:] != owners[:-1])
    owners, values = owners[fresh], values[fresh]
    return values, np.searchsorted(owners, np.arange(len(texts) + 1))
