"""Exact substring duplicates by suffix arrays that are built by induced sorting.

Strings of `width` bytes that also start earlier in the corpus are found in four steps:

1. Every such string holds an anchor, the least hash among its K-byte grams.  Neighbouring
   strings with the same anchor form a run; equal strings have equal anchors.
2. Runs are dealt by anchor and sorted.  Of runs with equal content only the earliest goes on
   (the others are repeats as a whole, those of one slice of text before they are dealt); an
   anchor with a single run that can't repeat in itself is dropped.  So a group of copies
   counts once, whatever its size.
3. The runs that are left are gathered in shards by anchor; those of a hot anchor are cut anew
   by a second kind of anchor.  For each shard a suffix array is built by induced sorting, and
   the permuted common prefixes tell which of its strings are equal.
4. The repeated strings of a document become removed spans, joined to its text by its key.

Documents are ordered by id; null ids come before usual ones, in the order of a hash of their
texts (see common.keyed).  Rows with the same id and the same text are one document given twice
and get the same result; strings that start at the same place of the same id are never
"earlier" than each other.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, partitions, slices, slide, staged, table, utf8

WIDTH = 100
#: Bytes of a gram; every string of `width` bytes has width - GRAM + 1 of them.
GRAM = 16
#: Most strings in a run; longer runs are cut, which loses nothing.
RUN = 512
#: Bytes of runs in a shard.  An anchor isn't split between shards; one with over HOT bytes of
#: different runs has them cut anew by a second anchor (see _anew).
SHARD, HOT = 1 << 20, 1 << 19
#: Input bytes for each partition of the steps by anchor.
PARTITION = 24 << 20

_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
#: Multipliers of the grams' hash: of the anchors, and of the second anchors.
FIRST, SECOND = (_A, _B), (np.uint64(0xD1B54A32D192ED03), np.uint64(0x94D049BB133111EB))


# ---- induced sorting --------------------------------------------------------------------


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the one after it; the last one counts as smaller."""
    n = len(s)
    step = np.sign(s[1:].astype(np.int64) - s[:-1])
    at = np.where(step != 0, np.arange(n - 1), n)  # an equal pair takes the type to its right
    nearest = np.minimum.accumulate(at[::-1])[::-1]
    return np.append(np.append(step, 1)[np.minimum(nearest, n - 1)] > 0, True)


def _induce(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The order of all suffixes, induced from `lms`, the leftmost-smaller ones in order.

    Buckets of first symbols are walked upwards for the larger suffixes and downwards for the
    smaller ones.  A bucket is taken in waves: all that stands in it puts its predecessors
    into their buckets at once, and those that fall into the same bucket are the next wave.
    """
    n = len(s)
    sa = np.full(n, -1, np.int64)
    count = np.bincount(s, minlength=k)
    end = np.cumsum(count)
    start = end - count
    head = start.copy()
    first = s[lms]
    at = np.searchsorted(first, np.arange(k + 1))  # lms is ordered, so its first symbols are

    def put(pre: np.ndarray, place: np.ndarray, sign: int) -> None:
        c = s[pre]
        by = np.argsort(c, kind="stable")
        c = c[by]
        new = np.bincount(c, minlength=k)
        rank = np.arange(len(c)) - np.repeat(np.cumsum(new) - new, new)
        sa[place[c] + rank if sign > 0 else place[c] - 1 - rank] = pre[by]
        place += sign * new

    used = np.nonzero(count)[0]
    for c in used:
        done = start[c]
        while done < head[c]:
            wave = sa[done : head[c]]
            done = head[c]
            pre = wave[wave > 0] - 1
            pre = pre[~small[pre]]
            if len(pre):
                put(pre, head, 1)
        wave = lms[at[c] : at[c + 1]]
        pre = wave[wave > 0] - 1
        if len(pre):
            put(pre, head, 1)
    tail = end.copy()
    sa[0] = n - 1  # the closing symbol is alone in the least bucket
    tail[0] = 0
    for c in used[::-1]:
        done = end[c]
        while done > tail[c]:
            wave = sa[tail[c] : done][::-1]
            done = tail[c]
            pre = wave[wave > 0] - 1
            pre = pre[small[pre]]
            if len(pre):
                put(pre, tail, -1)
        wave = sa[start[c] : head[c]][::-1]
        pre = wave[wave > 0] - 1
        pre = pre[small[pre]]
        if len(pre):
            put(pre, tail, -1)
    return sa


#: Suffixes in a bucket, on the average, from which buckets go in waves of arrays.
WAVES = 64


def _walk(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """The same order as _induce() gives, suffix by suffix, for strings of many symbols, whose
    buckets are short: a list is walked while the predecessors are put further on in it."""
    n = len(s)
    count = np.bincount(s, minlength=k)
    ends = np.cumsum(count)
    # the symbol before each suffix if that one is to be put, else -1; n stands for an empty place
    before = np.concatenate([[-1], s[:-1], [-1]])
    larger, smaller = (np.where(np.concatenate([[False], kind[:-1], [False]]), before, -1).tolist() for kind in (~small, small))
    sa, tail = [n] * n, ends.tolist()
    for i, c in zip(lms[::-1].tolist(), s[lms[::-1]].tolist()):
        tail[c] = t = tail[c] - 1
        sa[t] = i
    head = (ends - count).tolist()
    for i in sa:
        c = larger[i]
        if c >= 0:
            h = head[c]
            sa[h] = i - 1
            head[c] = h + 1
    tail = ends.tolist()
    for i in reversed(sa):
        c = smaller[i]
        if c >= 0:
            tail[c] = t = tail[c] - 1
            sa[t] = i - 1
    return np.array(sa, np.int64)


def _named(s: np.ndarray, small: np.ndarray, lms: np.ndarray, k: int) -> np.ndarray:
    """A number for each leftmost-smaller substring (from one to the next, both ends included) that
    rises with their order by symbols, at one symbol the larger suffix first; equal ones share it.

    As many symbols as fit a word are compared at a time, and only among substrings that are
    equal so far and go on.
    """
    m, n = len(lms), len(s)
    size = np.append(np.diff(lms) + 1, 1)
    bits = int(2 * k + 1).bit_length()
    per = 63 // bits
    key = np.append(s.astype(np.int64) * 2 + small + 1, 0)
    by, lead = np.arange(m), np.zeros(m, np.int64)  # the order so far, and where each group of equal ones begins
    live, t = np.arange(m), 0  # places in the order that may yet be parted
    while len(live):
        rows = by[live]
        word = np.zeros(len(rows), np.int64)
        for i in range(per):
            word = word << bits | np.where(t + i < size[rows], key[np.minimum(lms[rows] + t + i, n)], 0)
        order = np.lexsort((word, lead[live])) if t else np.argsort(word, kind="stable")
        by[live], word, old = rows[order], word[order], lead[live]
        new = np.append(True, (word[1:] != word[:-1]) | (old[1:] != old[:-1]))
        lead[live] = live[np.maximum.accumulate(np.where(new, np.arange(len(live)), 0))]
        t += per
        alone = new & np.append(new[1:], True)
        live = live[~alone & (size[by[live]] > t)]
    name = np.empty(m, np.int64)
    name[by] = np.cumsum(np.append(False, lead[1:] != lead[:-1]))
    return name


def suffix_array(s: np.ndarray, k: int) -> np.ndarray:
    """The suffix array of s: symbols below k, the last one 0 and nowhere else."""
    n = len(s)
    if n == 1:
        return np.zeros(1, np.int64)
    small = _types(s)
    lms = np.nonzero(np.append(False, small[1:] & ~small[:-1]))[0]
    name = _named(s, small, lms, k)
    names = int(name.max()) + 1
    # the order of the leftmost-smaller suffixes is that of the string of their names
    order = np.argsort(name) if names == len(lms) else suffix_array(name, names)
    return (_induce if n >= WAVES * k else _walk)(s, small, lms[order], k)


def permuted_prefixes(data: np.ndarray, left: np.ndarray, sa: np.ndarray) -> np.ndarray:
    """For each position the length shared with the suffix before it in order.

    `left` has the bytes to the end of each position's own string, which no match passes.
    Only where the symbols before the two suffixes differ is the length compared, eight bytes
    at a time; everywhere else it is one less than at the position before.
    """
    n = len(data)
    before = np.full(n, -1, np.int64)
    before[sa[1:]] = sa[:-1]
    pos = np.arange(n)
    ok = (before > 0) & (pos > 0)
    reducible = np.zeros(n, bool)
    i = np.nonzero(ok)[0]
    reducible[i] = (data[i - 1] == data[before[i] - 1]) & (left[i - 1] > left[i]) & (left[before[i] - 1] > left[before[i]])
    buf = np.concatenate([data, np.zeros(16, np.uint8)])
    words = np.ndarray((n + 8,), "<u8", buf, strides=(1,))
    out = np.zeros(n, np.int64)
    i = np.nonzero(~reducible & (before >= 0))[0]
    j = before[i]
    most = np.minimum(left[i], left[j])
    live = np.nonzero(most > 0)[0]
    size = np.zeros(len(i), np.int64)
    while len(live):
        x = words[i[live] + size[live]] ^ words[j[live] + size[live]]
        size[live] += np.where(x == 0, 8, np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) >> 3)
        live = live[(x == 0) & (size[live] < most[live])]
    out[i] = np.minimum(size, most)
    head = np.maximum.accumulate(np.where(reducible, 0, pos))
    return np.where(reducible, np.maximum(out[head] - (pos - head), 0), out)


def repeats(data: np.ndarray, sizes: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(position, class) of each string of `width` bytes in a shard that occurs at least twice.

    The shard is the runs in `data` with the given sizes one after another; a closing symbol
    after each run keeps strings from crossing.
    """
    ends = np.cumsum(sizes)
    run = np.repeat(np.arange(len(sizes)), sizes)
    n = len(data)
    at = np.arange(n) + run  # its place once a closing symbol stands after each run
    s = np.ones(n + len(sizes) + 1, np.int64)
    s[at] = data.astype(np.int64) + 2
    s[-1] = 0
    flat = np.zeros(len(s), np.uint8)
    flat[at] = data
    left = np.zeros(len(s), np.int64)
    left[at] = ends[run] - np.arange(n)
    sa = suffix_array(s, 258)
    share = permuted_prefixes(flat, left, sa)[sa] >= width
    group = np.cumsum(~share)
    member = share | np.append(share[1:], False)
    place = np.full(len(s), -1, np.int64)
    place[at] = np.arange(n)
    return place[sa[member]], group[member]


# ---- anchors ----------------------------------------------------------------------------


def anchor_runs(data: np.ndarray, offsets: np.ndarray, width: int = WIDTH, odd: tuple[np.uint64, np.uint64] = FIRST) -> tuple[np.ndarray, ...]:
    """The runs of all texts in a slice: (text, start, bytes, anchor, content hash, may repeat in itself)."""
    n, w = len(data), width - GRAM + 1
    none = tuple(np.zeros(0, t) for t in (np.int64, np.int64, np.int64, np.uint64, np.uint64, bool))
    if n < width:
        return none
    buf = np.concatenate([data, np.zeros(8, np.uint8)])
    words = np.ndarray((n + 1,), "<u8", buf, strides=(1,))
    mix = words[: n - GRAM + 1] * odd[0] ^ (words[8 : n - GRAM + 9] * odd[1])
    mix ^= mix >> np.uint64(32)
    mix *= odd[1]
    mix ^= mix >> np.uint64(29)
    least = slide(mix, w, np.minimum)  # of the string that starts here
    sizes = np.diff(offsets)
    live = np.nonzero(sizes >= width)[0]
    mark = np.zeros(n - width + 2, np.int8)
    np.add.at(mark, offsets[live], 1)
    np.add.at(mark, offsets[live + 1] - width + 1, -1)
    valid = np.cumsum(mark[:-1]) > 0
    edge = np.append(True, least[1:] != least[:-1])
    edge[offsets[live]] = True  # a run never crosses texts
    edge[1:] |= valid[1:] & ~valid[:-1]
    edge &= valid
    start = np.nonzero(edge)[0]
    stop = np.nonzero(valid & np.append(~valid[1:] | edge[1:], True))[0] + 1
    long = np.nonzero(stop - start > RUN)[0]
    if len(long):
        more = np.concatenate([np.arange(start[i] + RUN, stop[i], RUN) for i in long])
        start = np.sort(np.concatenate([start, more]))
        stop = np.sort(np.concatenate([stop, more]))
    text = np.searchsorted(offsets, start, "right") - 1
    anchor = least[start]
    # anchors that stand twice within reach of one run may repeat inside it
    most = slide(np.concatenate([np.zeros(w - 1, np.uint64), np.where(valid, least, 0).astype(np.uint64), np.zeros(w - 1, np.uint64)]), w, np.maximum)
    hit = np.nonzero(mix == most[: len(mix)])[0]
    twice = (mix[hit[1:]] == mix[hit[:-1]]) & (np.diff(hit) <= w)
    own = np.isin(anchor, mix[hit[1:][twice]]) if twice.any() else np.zeros(len(start), bool)
    # content hash: polynomial over 64 bits by prefix sums of a second mix of each byte's word
    z = words[:n] * _B
    z ^= z >> np.uint64(31)
    z *= _A
    z ^= z >> np.uint64(33)
    size = stop - start + width - 1
    return text, start - offsets[text], size, anchor, _content(z, start, size, np.uint64(0xD6E8FEB86659FD93)), own


def _content(z: np.ndarray, start: np.ndarray, size: np.ndarray, odd: np.uint64) -> np.ndarray:
    """A 64-bit hash of data[start : start + size] that depends on all its bytes and their order."""
    out = np.zeros(len(start), np.uint64)
    live, t = np.arange(len(start)), 0
    while len(live):
        step = np.minimum(size[live] - t, 8)
        full = step == 8
        at = start[live] + np.where(full, t, size[live] - 8)  # the last word overlaps
        out[live] = (out[live] ^ z[at]) * odd
        out[live] ^= out[live] >> np.uint64(32)
        t += 8
        live = live[size[live] > t]
    return out ^ size.astype(np.uint64)


# ---- the Spark plan ---------------------------------------------------------------------

RUN_COLUMNS = "m long, h long, doc long, th long, at long, own boolean, copy boolean"
_START = 20  # bits of a packed span that hold its size


def _runs(docs: DataFrame, width: int) -> DataFrame:
    """The runs of all texts; `copy` marks those that an equal run of their slice precedes, which
    are dealt by document, not by anchor."""

    def run(parts):
        for b in parts:
            at, data = utf8(b.column(2))
            doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
            for i, j in slices(at):
                text, start, size, anchor, content, own = anchor_runs(data[at[i] : at[j]], at[i : j + 1] - at[i], width)
                if not len(text):
                    continue
                text = text + i
                by = np.lexsort((th[text], start, doc[text], size, content, anchor))
                text, start, size, anchor, content, own = (c[by] for c in (text, start, size, anchor, content, own))
                same = np.append(False, (anchor[1:] == anchor[:-1]) & (content[1:] == content[:-1]) & (size[1:] == size[:-1]))
                first = np.maximum.accumulate(np.where(same, 0, np.arange(len(same))))
                d, t = doc[text], th[text]
                copy = same & ((d != d[first]) | (start != start[first]))  # else it isn't later
                m = np.where(copy, d * 31 + t, anchor.view(np.int64))
                yield pa.RecordBatch.from_arrays([pa.array(m), pa.array(content.view(np.int64)), pa.array(d), pa.array(t), pa.array(start << _START | size), pa.array(own), pa.array(copy)], ["m", "h", "doc", "th", "at", "own", "copy"])

    return docs.mapInArrow(run, RUN_COLUMNS)


def _first_of_each(parts):
    """Of the runs of whole anchors, sorted: (m, doc, th, at), m null for a run that repeats an
    earlier one, else a run that may share strings with other runs of its anchor or with itself.

    Between batches at most three runs of the last anchor are held: its first one, which waits
    until another one or a repeat in itself is known, the first with the last content, and the
    last one.
    """
    held, sent, live_before = None, np.zeros(0, bool), False
    for b in parts:
        cols = [b.column(c).to_numpy(zero_copy_only=False) for c in ("m", "h", "doc", "th", "at", "own")]
        local = b.column("copy").to_numpy(zero_copy_only=False)
        far = [c[local] for c in cols]
        cols = [c[~local] for c in cols]
        if held is not None:
            cols = [np.concatenate([x, c]) for x, c in zip(held, cols)]
        done = np.append(sent, np.zeros(len(cols[0]) - len(sent), bool))
        m, h, doc, th, at, own = cols
        if len(m):
            size, start, rows = at & ((1 << _START) - 1), at >> _START, np.arange(len(m))
            same = np.append(False, (m[1:] == m[:-1]) & (h[1:] == h[:-1]) & (size[1:] == size[:-1]))
            first = np.maximum.accumulate(np.where(same, 0, rows))
            level = same & (doc == doc[first]) & (start == start[first])
            copy = same & ~level
            kept = ~copy & ~(level & (th == np.append(0, th[:-1])))  # else the same document given twice
            nth = np.cumsum(np.append(0, m[1:] != m[:-1]))
            lively = (np.bincount(nth, kept) > 1) | (np.bincount(nth, own) > 0)
            lively[0] |= live_before
            out = (copy | (kept & lively[nth])) & ~done
            tail = np.unique([rows[(nth == nth[-1]) & kept][0], first[-1], rows[-1]])
            held, live_before = [c[tail] for c in cols], bool(lively[-1])
            sent = ~kept[tail] | live_before
        else:
            out = copy = np.zeros(0, bool)
        got = [np.concatenate([f, c[out]]) for f, c in zip(far, cols)]
        gone = np.append(np.ones(len(far[0]), bool), copy[out])
        yield pa.RecordBatch.from_arrays([pa.array(got[0], mask=gone), *(pa.array(c) for c in got[2:5])], ["m", "doc", "th", "at"])


def _cut(parts):
    """(m, doc, th, start, run) of a document's runs, cut from its text."""
    for b in parts:
        text_at, data = utf8(b.column(2))
        doc, th = b.column(0).to_numpy(), b.column(1).to_numpy()
        ms, ats = b.column(3), b.column(4)
        per = ms.value_lengths().to_numpy()
        row = np.repeat(np.arange(b.num_rows), per)
        m, at = ms.flatten().to_numpy(), ats.flatten().to_numpy()
        start, size = at >> _START, at & ((1 << _START) - 1)
        begin = text_at[row] + start
        for i in range(0, len(m), 20_000):
            j = min(i + 20_000, len(m))
            runs = [data[a : a + k].tobytes() for a, k in zip(begin[i:j], size[i:j])]
            yield pa.RecordBatch.from_arrays([pa.array(m[i:j]), pa.array(doc[row[i:j]]), pa.array(th[row[i:j]]), pa.array(start[i:j]), pa.array(runs, pa.binary())], ["m", "doc", "th", "start", "run"])


def _later(place: np.ndarray, group: np.ndarray, doc: np.ndarray, start: np.ndarray) -> np.ndarray:
    """The places of strings that an equal string precedes, by (document, start)."""
    by = np.lexsort((start, doc, group))
    place, group, doc, start = place[by], group[by], doc[by], start[by]
    first = np.maximum.accumulate(np.where(np.append(True, group[1:] != group[:-1]), np.arange(len(group)), 0))
    return place[(doc != doc[first]) | (start != start[first])]


def _anew(width: int):
    """Runs (m, doc, th, start, run) of hot anchors, cut anew by a second anchor: what all of them
    share doesn't place them any more, what stands beside it does."""

    def run(parts):
        for b in parts:
            at, data = utf8(b.column(4))
            doc, th, start = (b.column(i).to_numpy() for i in (1, 2, 3))
            for i, j in slices(at):
                part = data[at[i] : at[j]]
                base = at[i : j + 1] - at[i]
                row, off, size, anchor, _, _ = anchor_runs(part, base, width, SECOND)
                begin, row = base[row] + off, row + i
                cut = [part[a : a + k].tobytes() for a, k in zip(begin, size)]
                yield pa.RecordBatch.from_arrays([pa.array(anchor.view(np.int64)), pa.array(doc[row]), pa.array(th[row]), pa.array(start[row] + off), pa.array(cut, pa.binary())], ["m", "doc", "th", "start", "run"])

    return run


def _unequal(parts):
    """Batches of runs, sorted by anchor and bytes, without those that equal an earlier run byte
    for byte; with each the spans of those."""
    prior = None  # the last run's anchor and bytes, and the place of the first that equals it
    for b in parts:
        if not b.num_rows:
            continue
        m, run = b.column(0).to_numpy(), b.column(4)
        doc, th, start = (b.column(i).to_numpy() for i in (1, 2, 3))
        same = np.append(False, (m[1:] == m[:-1]) & pc.equal(run.slice(1), run.slice(0, len(run) - 1)).to_numpy(zero_copy_only=False))
        same[0] = prior is not None and prior[0] == m[0] and prior[1] == run[0].as_py()
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(m))))
        d, s = doc[first], start[first]
        if same[0]:
            lead = np.cumprod(same).astype(bool)
            d, s = np.where(lead, prior[2], d), np.where(lead, prior[3], s)
        copy = same & ((doc != d) | (start != s))
        prior = (m[-1], run[-1].as_py(), d[-1], s[-1])
        size = np.diff(utf8(run)[0])[copy]
        spans = [pa.array(doc[copy]), pa.array(th[copy]), pa.array(start[copy] << _START | size)]
        yield b.filter(pa.array(~copy)), pa.RecordBatch.from_arrays(spans, ["doc", "th", "at"])


def _shard_spans(width: int):
    """Spans (doc, th, at) of the strings that are repeats, from runs sorted by anchor."""

    def shard(rows: list[pa.RecordBatch]):
        held = pa.Table.from_batches(rows).combine_chunks()
        at, data = utf8(held["run"])
        sizes = np.diff(at)
        doc, th, start = (held[c].to_numpy() for c in ("doc", "th", "start"))
        place, group = repeats(data, sizes, width)
        run = np.searchsorted(at, place, "right") - 1
        place = np.sort(_later(place, group, doc[run], start[run] + place - at[run]))
        if not len(place):
            return None
        run = np.searchsorted(at, place, "right") - 1
        edge = np.append(True, (np.diff(place) != 1) | (np.diff(run) != 0))
        a, z = place[edge], place[np.append(edge[1:], True)]
        r = run[edge]
        return pa.RecordBatch.from_arrays([pa.array(doc[r]), pa.array(th[r]), pa.array((start[r] + a - at[r]) << _START | (z - a + width))], ["doc", "th", "at"])

    def run(parts):
        held, size = [], 0
        for b, again in _unequal(parts):
            if again.num_rows:
                yield again
            if not b.num_rows:
                continue
            anchors = b.column(0).to_numpy()
            step = np.append(0, np.nonzero(np.diff(anchors))[0] + 1)
            weight = utf8(b.column(4))[0]
            # cut where an anchor ends and the shard is full; the anchor at the end may go on
            low = 0
            for a in step:
                a = int(a)
                new_anchor = a > 0 or not held or held[-1].column(0)[-1].as_py() != anchors[0]
                if new_anchor and size + weight[a] - weight[low] >= SHARD:
                    if a > low:
                        held.append(b.slice(low, a - low))
                    if (out := shard(held)) is not None:
                        yield out
                    held, size, low = [], 0, a
            held.append(b.slice(low))
            size += int(weight[-1] - weight[low])
        if held and (out := shard(held)) is not None:
            yield out

    return run


def _kept(parts):
    """n_bytes, n_removed, n_spans and the digest of what is left, of each document row."""
    for b in parts:
        at, data = utf8(b.column(1))
        raw, spans = memoryview(data), b.column(2).to_pylist()
        rows = []
        for i in range(b.num_rows):
            text = raw[at[i] : at[i + 1]]
            digest, removed, n, done = hashlib.sha256(), 0, 0, 0
            begin = end = -1
            for p in [*sorted(spans[i] or ()), None]:
                a = len(text) + 1 if p is None else p >> _START
                if a > end:  # touching spans are one
                    if end >= 0:
                        digest.update(text[done:begin])
                        removed, n, done = removed + end - begin, n + 1, end
                    begin = a
                if p is not None:
                    end = max(end, a + (p & ((1 << _START) - 1)))
            digest.update(text[done:])
            rows.append((len(text), removed, n, digest.hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        cols = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)] if rows else [pa.array([], k) for k in kinds]
        yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeated_spans(docs: DataFrame, width: int = WIDTH) -> tuple[DataFrame, DataFrame]:
    """(texts, spans): texts (doc, th, doc_id, text) dealt by document, and the spans (doc, th,
    at) that later copies cover, at = start << 20 | size in bytes, overlapping ones included."""
    spark = docs.sparkSession
    texts = keyed(docs)
    size = texts.agg(F.sum(F.octet_length("text").cast("long"))).first()[0] or 0
    n = max(partitions(spark), size // PARTITION + 1)
    size_of = F.col("at").bitwiseAND((1 << _START) - 1)
    runs = _runs(texts.select("doc", "th", "text"), width).repartition(n, "m").sortWithinPartitions("m", "h", size_of, "doc", "at", "th")
    dealt = staged(runs.mapInArrow(_first_of_each, "m long, doc long, th long, at long"), "first-runs")
    far = dealt.where("m IS NULL").select("doc", "th", "at")
    live = dealt.where("m IS NOT NULL")
    hot = staged(live.groupBy("m").agg(F.sum(size_of).alias("b")).where(F.col("b") > HOT).select("m"), "hot-anchors")
    spread = texts.repartition(n, "doc", "th")
    columns = "m long, doc long, th long, start long, run binary"

    def cut(runs: DataFrame) -> DataFrame:
        wanted = runs.groupBy("doc", "th").agg(F.collect_list("m").alias("ms"), F.collect_list("at").alias("ats"))
        return spread.join(wanted, ["doc", "th"]).select("doc", "th", "text", "ms", "ats").mapInArrow(_cut, columns)

    cold = cut(live.join(hot, "m", "left_anti"))
    again = cut(live.join(hot, "m", "left_semi")).mapInArrow(_anew(width), columns)
    sharded = cold.unionAll(again).repartition(n, "m").sortWithinPartitions("m", "run", "doc", "start")
    return spread, far.unionAll(sharded.mapInArrow(_shard_spans(width), "doc long, th long, at long"))


def remove_repeats(docs: DataFrame, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) for each document row."""
    texts, spans = repeated_spans(docs, width)
    by_doc = spans.groupBy("doc", "th").agg(F.collect_list("at").alias("spans"))
    joined = texts.join(by_doc, ["doc", "th"], "left").select("doc_id", "text", "spans")
    return joined.mapInArrow(_kept, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def op3_suffix_dedup(spark, sf_dir: str) -> DataFrame:
    """The bytes that repeat earlier ones, of each row of documents.  A null text is an empty one,
    without strings, as is any text under WIDTH bytes; null ids stay null and come first;
    repeated rows are one document; texts of any length are read whole; ties and equal places
    are as told above; no documents give no rows."""
    return remove_repeats(table(spark, sf_dir, "documents"))
