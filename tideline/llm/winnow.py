"""Windows of many sequences at once, cut into runs that share their smallest k-gram (winnowing). Numpy only; used inside tasks.

Every window of ``width`` symbols is assigned to the first of its k-grams with the smallest hash. Neighbouring windows with the same k-gram form a
run, whose content is the symbols that they cover. What a window's anchor is follows from the window alone. So equal windows have equal anchors, and
if two runs have equal content, all their windows are equal.
"""
import numpy as np

_ODD = 0x9E3779B97F4A7C15
_BYTE_BASE, _GRAM_BASE = 0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F
#: Bits of a sort key that hold a place; the rest holds the top of the hash. Equal tops go to the first place, which again the window alone decides.
_PLACE = np.uint64(32)

_powers = {}


def _power_table(base, n):
    """``base`` to the powers 0..n modulo 2**64, and of its inverse."""
    have = _powers.get(base)
    if have is None or len(have[0]) <= n:
        size = max(1 << 16, 1 << (n + 1).bit_length())
        inverse = pow(base, -1, 1 << 64)
        out = []
        for number in (base, inverse):
            table = np.full(size, number, np.uint64)
            table[0] = 1
            out.append(np.multiply.accumulate(table))
        have = _powers[base] = tuple(out)
    return have


def _mix(x):
    """Bijective scrambling of 64-bit values."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def span_hashes(values, starts, stops, base=_BYTE_BASE):
    """64-bit hashes of ``values[start:stop]``, from prefix sums of a polynomial modulo 2**64."""
    up, down = _power_table(base, len(values))
    sums = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values * up[:len(values)], out=sums[1:])
    return _mix((sums[stops] - sums[starts]) * down[starts] + (stops - starts).astype(np.uint64) * np.uint64(_ODD))


def _lowest(x, width):
    """Minimum of every ``width`` neighbours, by doubling."""
    done = 1
    while done < width:
        step = min(done, width - done)
        x = np.minimum(x[:-step], x[step:])
        done += step
    return x


def runs(values, bounds, width, k):
    """Runs of the sequences ``values[bounds[i]:bounds[i + 1]]`` (uint64): arrays ``sequence, first, last, anchor``.

    ``first`` and ``last`` are the first and the last window start of a run as places in ``values``; ``anchor`` is the hash of its k-gram.
    Sequences shorter than ``width`` have none.
    """
    n = len(values)
    if n < width:
        empty = np.zeros(0, np.int64)
        return empty, empty, empty, np.zeros(0, np.uint64)
    places = np.arange(n - k + 1)
    grams = span_hashes(values, places, places + k, _GRAM_BASE)
    keys = ((grams >> _PLACE) << _PLACE) | places.astype(np.uint64)
    least = _lowest(keys, width - k + 1) & np.uint64((1 << 32) - 1)
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))
    inside = owner[:n - width + 1] == owner[width - 1:]
    new = inside.copy()
    new[1:] &= ~inside[:-1] | (least[1:] != least[:-1]) | (owner[1:n - width + 1] != owner[:n - width])
    first = np.flatnonzero(new)
    stop = inside.copy()
    stop[:-1] &= ~inside[1:] | new[1:]
    last = np.flatnonzero(stop)
    return owner[first], first, last, grams[least[first].astype(np.int64)]


def chunks(lengths, limit=1 << 20):
    """Neighbouring items in groups of at most ``limit`` symbols; a longer item is a group of its own."""
    start, total = 0, 0
    for i, length in enumerate(lengths):
        if total and total + length > limit:
            yield start, i
            start, total = i, 0
        total += length
    if start < len(lengths):
        yield start, len(lengths)
