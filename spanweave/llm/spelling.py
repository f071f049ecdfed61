"""Spelling variants: words of the corpus grouped by a trie self-join at distance one.

The vocabulary is range-partitioned in code-point order, so that every task holds one stretch of
the sorted words, which is a prefix-partitioned part of the trie.  A task walks its part level by
level and carries the active pairs of nodes: pairs that one replaced letter or one inserted
letter has led to.  Such a pair has spent its distance, so only equal letters lead it further
down; where both nodes end words, a pair is emitted.

Words of different stretches differ for the first time at a node above both, and every such node
is a prefix of a stretch's first or last word.  A word sends its open nodes, those it shares with
the ends of its own stretch, as (depth, prefix, rest) with and without the next letter spent;
equality of these three joins the pairs that no stretch sees.  A word has as many open nodes as
letters in common with an end of its stretch, mostly one or two.
"""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, table

#: Code points and occurrences that a word has at least.
LETTERS, TIMES = 5, 3
#: Words in a stretch of the sorted vocabulary, about.
STRETCH = 20_000
#: One run in so many, by its checksum, is written without one of its letters.
ONE_IN = 97
#: From this depth on, the rests of at most so many pairs of words below two nodes are compared at once.
DEEP, FEW = 48, 64

#: Distinct words that a task counts before it passes them on.
HELD = 200_000

#: By Latin-1 byte: letters A-Z lowered, letters as they are, all else a blank.
_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))


def _counted(letters: int, one_in: int):
    def words_of(mark: str, text: str, counts: Counter) -> None:
        # what isn't in Latin-1 isn't a letter here, so it may become any other sign
        runs = Counter([w for w in text.encode("latin-1", "replace").translate(_LETTERS).split() if len(w) >= letters])
        begun = zlib.crc32(mark.encode())
        for run, n in runs.items():
            h = zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), begun)
            if h % one_in:
                counts[run] += n
            elif len(run) > letters:
                p = h % len(run)
                counts[run[:p] + run[p + 1 :]] += n

    def run(parts):
        counts: Counter = Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["word", "n"])
        for b in parts:
            for mark, text in zip(b.column(0).to_pylist(), b.column(1)):
                words_of(mark, text.as_py(), counts)
                if len(counts) > HELD:
                    yield out()
                    counts.clear()
        if counts:
            yield out()

    return run


def vocabulary(docs: DataFrame, letters: int = LETTERS, times: int = TIMES, one_in: int = ONE_IN) -> DataFrame:
    """(word, n): maximal runs of letters in whole texts, A-Z lowered, with their occurrences.

    A run whose crc32 after its document's id and a colon is divisible by `one_in` loses one code
    point.  A null id is written as nothing, a null text has no runs, repeated rows count each.
    """
    mark = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"))
    counts = docs.select(mark.alias("mark"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counted(letters, one_in), "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= times)


# ---- the trie of one stretch ------------------------------------------------------------


def _common(codes: np.ndarray, off: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Letters that each word shares with the word before it; 0 for the first."""
    n, out = len(size), np.zeros(len(size), np.int64)
    todo = np.arange(1, n)
    shorter = np.minimum(size[1:], size[:-1]) if n else size
    d = 0
    while len(todo):
        todo = todo[shorter[todo - 1] > d]
        todo = todo[codes[off[todo] + d] == codes[off[todo - 1] + d]]
        d += 1
        out[todo] = d
    return out


class _Level:
    """The nodes of one depth: each is the run of sorted words that begin with it."""

    def __init__(self, d: int, codes, off, size, lcp, above: _Level | None):
        alive = np.flatnonzero(size >= d)
        self.start = alive[(lcp[alive] < d) | (alive == 0)] if d else np.zeros(min(1, len(size)), np.int64)
        self.ends = size[self.start] == d
        stop = np.append(self.start[1:], len(size))
        self.words = np.searchsorted(alive, stop) - np.searchsorted(alive, self.start)
        self.alive = alive
        if above is not None:
            letter = codes[off[self.start] + d - 1].astype(np.int64)
            up = np.searchsorted(above.start, self.start, "right") - 1
            self.letter, self.key = letter, (up << 21) | letter
            self.up = up
            above.first = np.searchsorted(up, np.arange(len(above.start)))
            above.children = np.bincount(up, minlength=len(above.start))


def _spread(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place in the row) for `counts` places in each row."""
    row = np.repeat(np.arange(len(counts)), counts)
    return row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def _down(u, v, over_u: _Level, under_u: _Level, under_v: _Level, barred=None):
    """Children of the pairs (u, v) along equal letters; `barred` letters lead nowhere."""
    if not len(u):
        return u, v
    row, i = _spread(over_u.children[u])
    child = over_u.first[u][row] + i
    key = (v[row] << 21) | under_u.letter[child]
    at = np.searchsorted(under_v.key, key)
    ok = at < len(under_v.key)
    ok[ok] = under_v.key[at[ok]] == key[ok]
    if barred is not None:
        ok &= under_u.letter[child] != barred[row]
    return child[ok], at[ok]


def near_pairs(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Places of the pairs of sorted, distinct words that one inserted, deleted or replaced code
    point parts, each pair once."""
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    off = np.cumsum(size) - size
    lcp = _common(codes, off, size)
    forks = np.unique(lcp[1:])
    out: list[tuple[np.ndarray, np.ndarray]] = []
    none = np.zeros(0, np.int64)
    empty = (none, none)

    def emit(u, v, lu, lv):
        both = lu.ends[u] & lv.ends[v]
        out.append((lu.start[u[both]], lv.start[v[both]]))

    def settled(u, v, lu, lv, du, dv):
        """Compare the rests of pairs of small nodes word by word; the other pairs are returned."""
        small = lu.words[u] * lv.words[v] <= FEW
        for x, y in zip(u[small].tolist(), v[small].tolist()):
            below = lambda level, k: level.alive[(i := np.searchsorted(level.alive, level.start[k])) : i + level.words[k]].tolist()
            for a in below(lu, x):
                for b in below(lv, y):
                    if not (size[a] == du and size[b] == dv) and size[a] - du == size[b] - dv and np.array_equal(codes[off[a] + du : off[a] + size[a]], codes[off[b] + dv : off[b] + size[b]]):
                        out.append((np.array([a]), np.array([b])))
        return u[~small], v[~small]

    swapped, longer = empty, empty  # active pairs at this depth: both at d; at d + 1 and d
    d = -1
    levels: dict[int, _Level] = {}

    def level(k):
        if k not in levels:
            levels[k] = _Level(k, codes, off, size, lcp, levels.get(k - 1) if k - 1 in levels else (level(k - 1) if k > d and k > 0 else None))
        return levels[k]

    while len(words):
        idle = not len(swapped[0]) and not len(longer[0])
        after = forks[np.searchsorted(forks, d + 1) :]
        if idle and not len(after):
            break
        d = int(after[0]) if idle else d + 1
        levels = {k: x for k, x in levels.items() if k >= d}
        here, one, two = level(d), level(d + 1), level(d + 2)
        if d >= DEEP:
            swapped = settled(*swapped, here, here, d, d)
            longer = settled(*longer, one, here, d + 1, d)
        # active pairs go on along equal letters
        next_swapped, next_longer = _down(*swapped, here, one, one), _down(*longer, one, two, one)
        # new ones: two children of a node, and a child beside the node itself
        row, i = _spread(here.children)
        a = here.first[row] + i
        pair, j = _spread(here.children[row] - 1 - i)
        u, v = a[pair], a[pair] + 1 + j
        emit(u, v, one, one)
        next_swapped = (np.concatenate([next_swapped[0], u]), np.concatenate([next_swapped[1], v]))
        emit(a, row, one, here)
        u, v = _down(a, row, one, two, one, barred=one.letter[a])
        next_longer = (np.concatenate([next_longer[0], u]), np.concatenate([next_longer[1], v]))
        old = len(next_swapped[0]) - len(pair)
        emit(next_swapped[0][:old], next_swapped[1][:old], one, one)
        emit(*next_longer, two, one)
        swapped, longer = next_swapped, next_longer
    if not out:
        return none, none
    return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])


def open_nodes(words: list[str]) -> list[tuple[int, int, int, int, int, bool]]:
    """(place, depth, prefix, rest, letter, spent) for the nodes that a word of a stretch shares
    with its first or its last word; prefix and rest are 64-bit hashes, letter is -1 at the end."""
    if not words:
        return []
    size = np.array([len(w) for w in words], np.int64)
    codes = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
    lcp = _common(codes, np.cumsum(size) - size, size)
    low = np.minimum.accumulate(np.concatenate([size[:1], lcp[1:]]))
    high = np.minimum.accumulate(np.concatenate([lcp[1:], size[-1:]])[::-1])[::-1]
    rows = []
    for place, (w, c) in enumerate(zip(words, np.maximum(low, high).tolist())):
        n = len(w)
        before, after = xxhash.xxh64(), xxhash.xxh64(w[c + 1 :][::-1].encode("utf-32-le"))
        rests = [after.intdigest()]  # of the letters from c + 1, c, ..., 0
        for x in w[c::-1] if c < n else w[::-1]:
            after.update(x.encode("utf-32-le"))
            rests.append(after.intdigest())
        if c == n:
            rests.insert(0, None)
        for i in range(c + 1):
            x = before.intdigest()
            letter = ord(w[i]) if i < n else -1
            rows.append((place, i, x, rests[c + 1 - i], letter, False))
            if i < n:
                rows.append((place, i, x, rests[c - i], letter, True))
                before.update(w[i].encode("utf-32-le"))
    return rows


_SCHEMA = "kind int, id long, n long, word string, other long, other_n long, depth int, prefix long, rest long, letter int, spent boolean"


def _stretch(parts):
    """Words with their numbers (kind 0), near pairs (1) and open nodes (2) of one stretch."""
    held = [b for b in parts if b.num_rows]
    if not held:
        return
    t = pa.Table.from_batches(held)
    words, n = t.column(0).to_pylist(), t.column(1).to_numpy()
    first = TaskContext.get().partitionId() << 33
    ids = first + np.arange(len(words))
    schema = pa.schema([("kind", pa.int32()), ("id", pa.int64()), ("n", pa.int64()), ("word", pa.string()), ("other", pa.int64()), ("other_n", pa.int64()), ("depth", pa.int32()), ("prefix", pa.int64()), ("rest", pa.int64()), ("letter", pa.int32()), ("spent", pa.bool_())])

    def batch(kind, size, **cols):
        full = [pa.array(np.full(size, kind, np.int32))] + [pa.array(cols[f.name], f.type) if f.name in cols else pa.nulls(size, f.type) for f in list(schema)[1:]]
        return pa.RecordBatch.from_arrays(full, schema=schema)

    yield batch(0, len(words), id=ids, n=n, word=words)
    a, b = near_pairs(words)
    yield batch(1, len(a), id=ids[a], n=n[a], other=ids[b], other_n=n[b])
    rows = open_nodes(words)
    if rows:
        place, depth, prefix, rest, letter, spent = (np.array(c, k) for c, k in zip(zip(*rows), (np.int64, np.int32, np.uint64, np.uint64, np.int32, bool)))
        for s in range(0, len(rows), 50_000):
            z = slice(s, s + 50_000)
            yield batch(2, len(place[z]), id=ids[place[z]], n=n[place[z]], depth=depth[z], prefix=prefix[z].view(np.int64), rest=rest[z].view(np.int64), letter=letter[z], spent=spent[z])


def variants(words: DataFrame, stretch: int = STRETCH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of distinct words (word, n).

    form is the near word of largest n, the first in code-point order of equal ones, if that n
    is at least twice the word's; root follows forms to the last, the word itself if it has none.
    A form has twice the word's n, so chains are at most 63 long.  No words give no rows.
    """
    words = staged(words.select("word", "n"), "vocabulary")
    parts = max(1, -(-words.count() // stretch))
    sorted_words = words.repartitionByRange(parts, "word").sortWithinPartitions("word")
    made = staged(sorted_words.mapInArrow(_stretch, _SCHEMA), "trie")
    named = made.where("kind = 0").select("id", "word", "n")
    inside = made.where("kind = 1").select("id", "n", "other", "other_n")
    nodes = made.where("kind = 2").select("id", "n", "depth", "prefix", "rest", "letter", "spent")
    right = nodes.select("depth", "prefix", "rest", *[F.col(c).alias(f"r_{c}") for c in ("id", "n", "letter", "spent")])
    across = nodes.where("spent").join(right, ["depth", "prefix", "rest"]).where("letter <> r_letter AND shiftright(id, 33) <> shiftright(r_id, 33)")
    one_way = across.select("id", "n", F.col("r_id").alias("other"), F.col("r_n").alias("other_n"), "r_spent")
    back = lambda df: df.select(F.col("other").alias("id"), F.col("other_n").alias("n"), F.col("id").alias("other"), F.col("n").alias("other_n"))
    # two spent nodes meet in both orders, a spent and an unspent one only once
    links = F.explode(F.when(F.col("r_spent"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))).alias("turned")
    crossed = one_way.select("*", links)
    swap = lambda a, b: F.when(F.col("turned"), F.col(b)).otherwise(F.col(a)).alias(a)
    crossed = crossed.select(swap("id", "other"), swap("n", "other_n"), F.when(F.col("turned"), F.col("id")).otherwise(F.col("other")).alias("other"), F.when(F.col("turned"), F.col("n")).otherwise(F.col("other_n")).alias("other_n"))
    edges = inside.unionAll(back(inside)).unionAll(crossed)
    best = edges.groupBy("id").agg(F.count("*").alias("n_near"), F.max(F.struct("other_n", (-F.col("other")).alias("minus"))).alias("best"))
    held = named.join(best, "id", "left").withColumn("up", F.when(F.col("best.other_n") >= 2 * F.col("n"), -F.col("best.minus")))
    held = staged(held.select("id", "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), "up", F.when(F.col("up").isNotNull(), F.col("best.other_n")).alias("form_n")), "forms")
    chain = held.where("up IS NOT NULL").select("id", "up")
    while True:
        chain = staged(chain.join(chain.select(F.col("id").alias("up"), F.col("up").alias("further")), "up", "left").select("id", F.coalesce("further", "up").alias("up"), "further"), "roots")
        if not chain.where("further IS NOT NULL").limit(1).count():
            break
        chain = chain.select("id", "up")
    text = lambda id_col, word_col: named.select(F.col("id").alias(id_col), F.col("word").alias(word_col))
    out = held.join(text("up", "form"), "up", "left").join(chain.select("id", F.col("up").alias("top")), "id", "left").join(text("top", "root"), "top", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def op11_spelling_variants(spark, sf_dir: str) -> DataFrame:
    """The words of all documents with their usual spelling; rules as in vocabulary() and
    variants(): null texts have no words, null ids count as empty ones, repeated rows count each,
    very long runs are words like others, ties go to the first word, an empty table gives no rows."""
    return variants(vocabulary(table(spark, sf_dir, "documents")))
