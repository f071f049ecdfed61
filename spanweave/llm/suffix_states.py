"""Language-model scoring with a probabilistic suffix tree over words.

States are contexts of up to two words; a text begins in the context of an end.  A context
is kept, however rare, if the training text gains by it over its suffix (each occurrence left
out of the counts that judge it); the next-word distribution of a kept context is smoothed by its
suffix's with as much weight as it has followers, and that of the root by one for each word.  A
word is scored in the state of the longest kept suffix of what stands before it.

The tree grows with the corpus, so it is neither collected nor broadcast.  Documents are written
once as slices: rows with a dictionary of word hashes and the text as places in it.  A slice asks
for totals of what occurs in it (words, pairs, triples, followers, gains): it sends sorted keys
and its own sums, dealt by key to buckets; a bucket adds them up over all slices and answers with
the totals in the order of the keys, without the keys.  Slices and answers are tables bucketed by
the slice's number, so a slice meets its answers without a shuffle; questions and answers are
shuffled once, and each key once for a slice however common it is.
"""

from __future__ import annotations

import re
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import shared_folder
from .common import id_array, ids, table

#: Words of the longest contexts; the share of all training tokens that a context has at least (none)
#: and its least number, which leaves none out either: what occurs once gains nothing, as each
#: occurrence is left out; log likelihood (nats) of the training text that it must gain over its suffix.
DEPTH, SHARE, LEAST, GAIN = 2, 0.0, 2, 8.0
#: Tokens in a slice, about, and bytes of a text that are cut into tokens at a time.
SLICE, CHUNK = 400_000, 4 << 20
#: Slices for each bucket of keys, beyond 64 buckets: the keys of so many fit a task with room to spare.
PER_BUCKET = 8

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
_SPACE = re.compile(rb"[\x20\x09-\x0D]")
#: The token after the last word; no word is empty.
_END = b""

_SLICES = "slice long, hashes binary, ids binary, doc binary, uid binary, size binary, skip binary, held binary"
_ASKED = "slice long, bucket long, keys binary, sums binary"
_ANSWERS = "slice long, bucket long, totals binary, occurring long, total double"


def _chunks(b: bytes, limit: int):
    """Parts of a text that end at white space, so that no word is cut."""
    at = 0
    while len(b) - at > limit:
        m = _SPACE.search(b, at + limit)
        if m is None:
            break
        yield b[at : m.end()]
        at = m.end()
    yield b[at:] if at else b


def _sliced(limit: int, chunk: int):
    """Documents (doc_id, text, held) to slices.  A text longer than a chunk is cut into pieces,
    which repeat the last words of the piece before."""

    def run(parts):
        begun, made = TaskContext.get().partitionId() << 24, 0
        places: defaultdict = defaultdict()
        places.default_factory = places.__len__
        text: list[np.ndarray] = []
        rows: list[tuple] = []
        total = 0

        def flush():
            nonlocal made, total
            hashes = np.fromiter((xxhash.xxh64_intdigest(w) for w in places), np.uint64, len(places))
            cols = [np.array(c, k).tobytes() for c, k in zip(zip(*rows), (np.int64, np.int64, np.int64, np.int64, bool))]
            row = [begun + made, hashes.tobytes(), np.concatenate(text).astype(np.uint32).tobytes(), *cols]
            made, total = made + 1, 0
            places.clear()
            text.clear()
            rows.clear()
            kinds = [pa.int64()] + [pa.binary()] * 7
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(row, kinds)], ["slice", "hashes", "ids", "doc", "uid", "size", "skip", "held"])

        n_docs = 0
        for b in parts:
            for d, t, held in zip(ids(b.column(0)).tolist(), b.column(1), b.column(2).to_pylist()):
                uid, n_docs = (begun << 16) + n_docs, n_docs + 1
                before = [_END]
                pieces = list(_chunks(t.as_py().encode().translate(_LOWER), chunk))
                for k, piece in enumerate(pieces):
                    words = piece.split()
                    if k == len(pieces) - 1:
                        words.append(_END)
                    both = before + words
                    text.append(np.fromiter(map(places.__getitem__, both), np.int64, len(both)))
                    rows.append((d, uid, len(both), len(before), held))
                    total += len(both)
                    before = both[-DEPTH:]
                    if total >= limit:
                        yield flush()
        if rows:
            yield flush()

    return run


def _planes(v: np.ndarray) -> bytes:
    """Numbers with all their first bytes first, so that the shuffle's compression finds the zeros."""
    return v.view(np.uint8).reshape(len(v), v.itemsize).T.tobytes()


def _numbers(b, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(b, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _packed(keys: np.ndarray) -> bytes:
    """Sorted keys as steps from one to the next."""
    return _planes(np.diff(keys, prepend=np.uint64(0)))


def _mix(a: np.ndarray, b: np.ndarray | np.uint64) -> np.ndarray:
    """A 64-bit hash of two hashes in order."""
    with np.errstate(over="ignore"):
        x = (a ^ (a >> np.uint64(32))) * np.uint64(0x9E3779B97F4A7C15) + b
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _distinct(keys: np.ndarray, merged: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """np.unique with the inverse, in less time.

    Plain numbers sort several times faster than their places, so the places stand in the low bits
    of the keys; keys that this puts out of order, which agree in all high bits, and keys that
    consist of sorted runs (`merged`) are sorted by place.
    """
    if not len(keys):
        return keys, np.zeros(0, np.int64)
    order = None
    if not merged:
        low = np.uint64((1 << (len(keys) - 1).bit_length()) - 1)
        order = (np.sort((keys & ~low) | np.arange(len(keys), dtype=np.uint64)) & low).astype(np.int64)
        u = keys[order]
    if merged or (u[1:] < u[:-1]).any():
        order = np.argsort(keys, kind="stable")
        u = keys[order]
    new = np.append(True, u[1:] != u[:-1])
    back = np.empty(len(keys), np.int64)
    back[order] = np.cumsum(new) - 1
    return u[new], back


def before(v: np.ndarray) -> np.ndarray:
    """The value of the position before; of the first, its own."""
    return np.concatenate([v[:1], v[:-1]])


class _Slice:
    """A slice and what it knows after the answers so far."""

    def __init__(self, row: dict, answers: dict[int, np.ndarray], n: int, v: int, least: float):
        get = lambda c, k: np.frombuffer(row[c], k)
        self.hashes, text = get("hashes", np.uint64), get("ids", np.uint32).astype(np.int64)
        self.doc, self.uid, self.size, self.skip, self.held = get("doc", np.int64), get("uid", np.int64), get("size", np.int64), get("skip", np.int64), get("held", bool)
        self.answers, self.n, self.v, self.least = answers, n, v, least
        first = np.cumsum(self.size) - self.size
        self.piece = np.repeat(np.arange(len(self.size)), self.size)
        place = np.arange(len(text)) - first[self.piece]
        # positions after the first of a piece; those among its first `skip` are scored elsewhere
        at = np.flatnonzero(place > 0)
        self.piece = self.piece[at]
        self.scored = place[at] >= self.skip[self.piece]
        self.train = self.scored & ~self.held[self.piece]
        self.word, self.before, self.deep = text[at], text[at - 1], place[at] >= 2

    def _asked(self, keys: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        u, back = _distinct(keys)
        return u, np.bincount(back, sums, len(u)), back

    def words(self):
        order = np.argsort(self.hashes)
        return self.hashes[order], np.bincount(self.word[self.train], minlength=len(self.hashes)).astype(float)[order]

    def know_words(self):
        self.count = np.zeros(len(self.hashes))
        self.count[np.argsort(self.hashes)] = self.answers[0]
        self.c0 = self.count[self.word]
        self.c1 = self.count[self.before]
        self.e1 = self.c1 >= self.least
        self.key1 = _mix(self.hashes[self.before], self.hashes[self.word])
        self.pairs = self._asked(self.key1[self.e1], self.train[self.e1])

    def know_pairs(self):
        self.know_words()
        self.n1 = np.zeros(len(self.word))
        self.n1[self.e1] = self.answers[1][self.pairs[2]]
        self.c2 = np.where(self.deep, before(self.n1), 0)
        self.e2 = self.c2 >= self.least
        self.triples = self._asked(_mix(before(self.key1)[self.e2], self.hashes[self.word[self.e2]]), self.train[self.e2])

    def know_triples(self):
        self.know_pairs()
        self.n2 = np.zeros(len(self.word))
        self.n2[self.e2] = self.answers[2][self.triples[2]]
        # contexts are words of the dictionary, and pairs that the slice has asked for
        at = np.zeros(len(self.word), np.int64)
        at[self.e1] = self.pairs[2]
        self.over1, self.over2 = self.before[self.e1], before(at)[self.e2]
        self.one = np.flatnonzero(np.bincount(self.over1, minlength=len(self.hashes)))
        self.two = np.flatnonzero(np.bincount(self.over2, minlength=len(self.pairs[0])))
        keys = np.concatenate([_mix(self.hashes[self.one], np.uint64(1)), _mix(self.pairs[0][self.two], np.uint64(2))])
        self.order = np.argsort(keys)
        self.contexts = keys[self.order]

    def _of_contexts(self, one: np.ndarray, two: np.ndarray):
        sums = np.concatenate([np.bincount(self.over1, one[self.e1], len(self.hashes))[self.one], np.bincount(self.over2, two[self.e2], len(self.pairs[0]))[self.two]])
        return self.contexts, sums[self.order]

    def followers(self):
        """Each follower of a context counts one over all its occurrences."""
        self.know_triples()
        share = lambda n: np.where(self.train, 1 / np.maximum(n, 1), 0)
        return self._of_contexts(share(self.n1), share(self.n2))

    def _answer(self, k: int) -> tuple[np.ndarray, np.ndarray]:
        got = np.empty(len(self.order))
        got[self.order] = self.answers[k]
        of_one, of_two = np.zeros(len(self.hashes)), np.zeros(len(self.pairs[0]))
        of_one[self.one], of_two[self.two] = got[: len(self.one)], got[len(self.one) :]
        one, two = np.zeros(len(self.word)), np.zeros(len(self.word))
        one[self.e1], two[self.e2] = of_one[self.over1], of_two[self.over2]
        return one, two

    def _chain(self, out: float):
        """Probabilities by root, one and two words; `out` occurrences of each word left out."""
        f1, f2 = self._answer(3)
        p0 = (np.maximum(self.c0 - out, 0) + 1) / (self.n + self.v + 1)
        p1 = self._smooth(self.n1, self.c1, f1, p0, self.e1, out)
        return p0, p1, self._smooth(self.n2, self.c2, f2, p1, self.e2, out)

    @staticmethod
    def _smooth(n, c, f, below, where, out):
        f = np.where(n == out, np.maximum(f - 1, 1), f) if out else f
        return np.where(where, (np.maximum(n - out, 0) + f * below) / np.where(where, c - out + f, 1), below)

    def gains(self):
        self.know_triples()
        p0, p1, p2 = self._chain(1.0)
        with np.errstate(divide="ignore"):
            return self._of_contexts(np.where(self.train, np.log(p1 / p0), 0), np.where(self.train, np.log(p2 / p1), 0))

    def scores(self):
        """For each piece: tokens, known ones, base and model log10 probability."""
        self.know_triples()
        p0, p1, p2 = self._chain(0.0)
        g1, g2 = self._answer(4)
        kept2 = self.e2 & (g2 > 0)
        kept1 = self.e1 & ((g1 > 0) | kept2)  # a kept context keeps its suffix
        p = np.where(kept2, p2, np.where(kept1, p1, p0))
        add = lambda v: np.bincount(self.piece[self.scored], v[self.scored], len(self.size))
        return add(np.ones(len(p))), add(self.c0 > 0), add(np.log10(p0)), add(np.log10(p))


#: What slices ask for, in order; each needs the answers before it.
_ROUNDS = ("words", "pairs", "triples", "followers", "gains")


def _ask(s: _Slice, k: int):
    if k == 1:
        s.know_words()
        return s.pairs[:2]
    if k == 2:
        s.know_pairs()
        return s.triples[:2]
    return (s.words, None, None, s.followers, s.gains)[k]()


_BINARY = {"hashes", "ids", "doc", "uid", "size", "skip", "held"}
#: Answers are whole numbers; to gains only whether they are enough.
_REPLY = (np.int64, np.int64, np.int64, np.int64, np.uint8)


def _rows(b: pa.RecordBatch):
    """The slices of a batch with their answers by round; nothing asked, nothing answered."""
    for i in range(b.num_rows):
        row = {n: b.column(c)[i].as_buffer() if n in _BINARY else b.column(c)[i].as_py() for c, n in enumerate(b.schema.names)}
        answers = {}
        for k in range(len(_ROUNDS)):
            got = sorted(row.pop(f"got{k}", None) or (), key=lambda a: a["bucket"])
            answers[k] = np.concatenate([np.zeros(0, _REPLY[k]), *(_numbers(a["totals"], _REPLY[k]) for a in got)])
        yield row, answers


def _questions(k: int, bits: int, *model):
    def run(parts):
        for b in parts:
            for row, answers in _rows(b):
                keys, sums = _ask(_Slice(row, answers, *model), k)
                bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
                cuts = [0, *(np.flatnonzero(bucket[1:] != bucket[:-1]) + 1).tolist(), len(keys)] if len(keys) else []
                many = len(cuts) - 1
                if many > 0:
                    sums = sums if k > 2 else sums.astype(np.uint32)
                    cols = [[row["slice"]] * many, bucket[cuts[:-1]], [_packed(keys[a:z]) for a, z in zip(cuts, cuts[1:])], [_planes(sums[a:z]) for a, z in zip(cuts, cuts[1:])]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.binary(), pa.binary()))], ["slice", "bucket", "keys", "sums"])

    return run


def _totals(k: int, gain: float):
    """Totals of a bucket's keys over all slices, for each slice in the order of its keys; and in a
    row of a negative slice how many keys occur in training, and how often."""

    def run(t: pa.Table) -> pa.Table:
        keys = [np.cumsum(_numbers(x.as_buffer(), np.uint64)) for x in t.column("keys")]
        sums = [_numbers(x.as_buffer(), np.uint32 if k <= 2 else np.float64) for x in t.column("sums")]
        u, back = _distinct(np.concatenate(keys), merged=True)
        total = np.bincount(back, np.concatenate(sums), len(u))
        out, cuts = (total >= gain if k == 4 else np.rint(total)).astype(_REPLY[k])[back], np.cumsum([0, *map(len, keys)])
        answers = [_planes(out[a:z]) for a, z in zip(cuts, cuts[1:])]
        none = [None] * len(answers)
        bucket = t.column("bucket")[0].as_py()
        cols = [*t.column("slice").to_pylist(), -1 - bucket], [bucket] * (len(answers) + 1), [*answers, None], [*none, int((total > 0).sum())], [*none, float(total.sum())]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.float64())
        return pa.table([pa.array(c, k) for c, k in zip(cols, kinds)], names=["slice", "bucket", "totals", "occurring", "total"])

    return run


def _final(*model):
    def run(parts):
        for b in parts:
            for row, answers in _rows(b):
                s = _Slice(row, answers, *model)
                n_tokens, n_known, base, score = s.scores()
                cols = [pa.array(s.uid), id_array(s.doc), pa.array(s.held), pa.array(n_tokens.astype(np.int64)), pa.array(n_known.astype(np.int64)), pa.array(base), pa.array(score)]
                yield pa.RecordBatch.from_arrays(cols, ["uid", "doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    return run


def scored(docs: DataFrame, held_out, share: float = SHARE, least: int = LEAST, gain: float = GAIN, slice_tokens: int = SLICE, chunk: int = CHUNK) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) for each document.

    `held_out` is a column of docs: the rows that the model doesn't learn from; a null is false.
    Null texts are empty ones and have the end as their one token; null ids stay null; repeated
    rows count and are scored each; an empty table gives no rows.
    """
    spark = docs.sparkSession
    rows = docs.withColumn("__held", F.coalesce(held_out, F.lit(False)))
    rows = rows.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), F.col("__held").alias("held"))
    size = rows.agg(F.sum(F.octet_length("text") + 8)).first()[0] or 0
    n_slices = 1 + size // (6 * slice_tokens)
    bits = max(6, int(n_slices // PER_BUCKET).bit_length())
    files = int(min(n_slices, 4096))
    mark = uuid.uuid4().hex

    def bucketed(df: DataFrame, what: str) -> DataFrame:
        name = f"spanweave_{what}_{mark}"
        df.write.bucketBy(files, "slice").option("path", f"{shared_folder(spark)}/{name}").option("compression", "zstd").saveAsTable(name)
        return spark.table(name)

    known = bucketed(rows.mapInArrow(_sliced(slice_tokens, chunk), _SLICES), "slices")
    n = v = 0
    for k, what in enumerate(_ROUNDS):
        asked = known.mapInArrow(_questions(k, bits, n, v, least), _ASKED)
        reply = asked.groupBy("bucket").applyInArrow(_totals(k, gain), _ANSWERS).repartition(files, "slice")
        together = F.collect_list(F.when(F.col("totals").isNotNull(), F.struct("bucket", "totals"))).alias(f"got{k}")
        answers = bucketed(reply.groupBy("slice").agg(together, F.sum("occurring").alias("occurring"), F.sum("total").alias("total")), what)
        if k == 0:
            v, n = (int(x or 0) for x in answers.agg(F.sum("occurring"), F.sum("total")).first())
            least = max(least, share * n)
        known = known.join(answers.select("slice", f"got{k}").hint("shuffle_hash"), "slice", "left")  # both by bucket
    pieces = known.mapInArrow(_final(n, v, least), "uid long, doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    whole = pieces.groupBy("uid").agg(F.first("doc_id").alias("doc_id"), F.first("held_out").alias("held_out"), *[F.sum(c).alias(c) for c in ("n_tokens", "n_known", "base_score", "score")])
    return whole.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), "base_score", "score")


def op13_suffix_tree_scores(spark, sf_dir: str) -> DataFrame:
    """Every document's log10 probability; documents whose id's crc32 modulo 7 is 2 are held out,
    others learnt from (a null id too); rules as in scored()."""
    docs = table(spark, sf_dir, "documents")
    return scored(docs, F.crc32(F.col("doc_id").cast("long").cast("string").cast("binary")) % 7 == 2)
