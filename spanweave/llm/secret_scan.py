"""Secret scan: regular expressions propose findings, a random forest removes false ones.

The forest sees a finding's length, its character transitions, how much of it dictionary
words cover, whether it stands in a path, and its neighbouring words.  It is trained from
labelled findings: rows of (before, candidate, after, label).  `labelled_findings` makes a
bounded seeded set by rule for use where nobody has labelled any.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import id_text, small_batches, table
from .trees import forest, vote

TREES, DEPTH, SEED = 40, 8, 20
#: Labelled findings that the seeded set holds; also the most that `train` takes.
FINDINGS = 6000
#: Characters on either side that count as a finding's neighbourhood.
AROUND = 60

# No pattern caps a finding: each runs to the end of its token (or END line).  Possessive
# quantifiers keep that linear.
_ASSIGNED = r"(?i:\b(?:[a-z0-9_]*(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|auth|credential)s?))[\"']?\s{0,3}[:=]\s{0,3}[\"']?(?!-----BEGIN )([^\s\"'<>,;]{6,}+)"
_SHAPES = r"\b(AKIA[0-9A-Z]{16,}+|gh[pousr]_[A-Za-z0-9]{36,}+|xox[abprs]-[A-Za-z0-9-]{10,}+|sk-[A-Za-z0-9_-]{20,}+|AIza[0-9A-Za-z_-]{35,}+|eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{5,}+|[A-Za-z]++://[^\s:/@]++:[^\s:/@]{3,}+@[^\s/]++)"
_BLOB = r"(?<![A-Za-z0-9+/_=-])((?=[A-Za-z+/_=-]*+[0-9])[A-Za-z0-9+/_-]{20,}+={0,2})(?![A-Za-z0-9+/_=-])"
# Any body up to an END line; where that was cut off, what can stand in a key.
_BEGIN, _END = "-----BEGIN [A-Z ]*PRIVATE KEY-----", "-----END [A-Z ]*PRIVATE KEY-----"
_PEM = rf"({_BEGIN}(?:(?:[^-]|-(?!----(?:BEGIN|END) ))*+{_END}|(?:(?<=\n)(?:Proc-Type|DEK-Info|Version|Comment):[^\n]*+|\\+[nrt]|[A-Za-z0-9+/=\s])*+))"
PATTERN = re.compile("|".join((_ASSIGNED, _SHAPES, _BLOB, _PEM)))
KINDS = ("assigned", "shaped", "blob", "pem")
#: A text without any of these can't hold a finding; a cheap first look.
_HINT = re.compile(r"[0-9]|[:=]|-----BEGIN")

#: Words that placeholders and ordinary identifiers are made of.
WORDS = (
    "access account admin api app auth branch build cache change client code commit config connection content data database default "
    "demo deploy dev digest document dummy email endpoint example fake file fixture foo function hash header host http id image index "
    "insert internal invalid item key language library license local login main manager master message method model module mock name network "
    "null object option order output package page param pass password path placeholder port private process product project public query "
    "read release request resource response result root sample schema secret server service session setting sha size source static "
    "status string super system table template test text the time token type undefined update upload url user username value version view web with your"
).split()
#: Neighbours that speak for a secret, and against one.
FOR = frozenset("token secret password passwd pwd key apikey api_key auth credential credentials bearer login private access".split())
AGAINST = frozenset("sha sha1 sha256 md5 commit checksum digest hash uuid guid revision example sample placeholder fixture mock dummy test template id version etag".split())

FEATURES = (
    "length", "digits", "capitals", "lower", "signs", "kinds_changed", "entropy", "vowel_steps", "longest_run", "covered", "hex_only",
    "slashes", "in_path", "test_path", "for_near", "against_near", "assigned", "shaped", "repeated", "uuid",
)
_WORD = re.compile("|".join(sorted((w for w in WORDS if len(w) > 2), key=len, reverse=True)), re.I)
_UUID = re.compile(r"[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}")
_NEAR = re.compile(r"[A-Za-z_][A-Za-z0-9_]*")
_HEX = re.compile("[0-9a-fA-F]+")


def features(before: str, found: str, after: str, kind: str) -> list[float]:
    """The statistics of one finding; all defined for any strings, empty ones too."""
    n = max(1, len(found))
    classes = [0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3 for c in found]
    changed = sum(a != b for a, b in zip(classes, classes[1:]))
    counts = np.bincount(classes, minlength=4) if classes else np.zeros(4)
    often = Counter(found).values()
    share = [c / n for c in often]
    vowels = [c in "aeiouAEIOU" for c, k in zip(found, classes) if k in (1, 2)]
    run = best = 0
    for c, k in zip(found, classes):
        run = run + 1 if k in (1, 2) else 0
        best = max(best, run)
    left = [w.lower() for w in _NEAR.findall(before)[-4:]]
    right = [w.lower() for w in _NEAR.findall(after)[:2]]
    parts = {p for w in (*left, *right) for p in (w, *w.split("_"))}
    stretch = re.search(r"\S*$", before)[0] + found + re.match(r"\S*", after)[0]
    return [
        float(len(found)), counts[0] / n, counts[1] / n, counts[2] / n, counts[3] / n, changed / n,
        -sum(p * math.log2(p) for p in share), sum(a != b for a, b in zip(vowels, vowels[1:])) / max(1, len(vowels)), best / n,
        sum(len(w) for w in _WORD.findall(found)) / n, float(bool(_HEX.fullmatch(found))),
        found.count("/") / n, float("/" in stretch.replace("//", "", 1) and kind != "shaped"), float(bool(re.search(r"(?i)test|example|fixture|mock|sample|docs?/", stretch))),
        float(len(parts & FOR)), float(len(parts & AGAINST)), float(kind == "assigned"), float(kind in ("shaped", "pem")),
        max(often, default=0) / n, float(bool(_UUID.fullmatch(found))),
    ]


def findings(text: str | None) -> list[tuple[int, int, str, str, str, str]]:
    """(start, stop, kind, before, candidate, after) of each candidate, left to right."""
    if not text or not _HINT.search(text):
        return []
    out = []
    for m in PATTERN.finditer(text):
        i = m.lastindex
        a, z = m.span(i)
        out.append((a, z, KINDS[i - 1], text[max(0, a - AROUND) : a], m[i], text[z : z + AROUND]))
    return out


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, str, str, str, int]]:
    """(before, candidate, after, kind, label) made by rule: half secrets, half false positives."""
    r = random.Random(seed)
    pick = lambda chars, k: "".join(r.choices(chars, k=k))
    hexes, base64 = "0123456789abcdef", string.ascii_letters + string.digits + "+/"
    syllables = "the er on an re he in ed nd ha at en es or ti hi ou it is st ar ion ble ment eau lich keit ung sch que ción ado".split()
    prose = lambda k: " ".join("".join(r.choices(syllables, k=r.randint(1, 4))) for _ in range(k))
    keys = ["token", "secret", "password", "api_key", "access_key", "auth_token", "client_secret"]
    quote = lambda x: r.choice(['{}', '"{}"', "'{}'"]).format(x)

    def secret():
        value = r.choice([lambda: pick(hexes, r.choice([32, 40, 64])), lambda: pick(base64, r.randint(20, 64)), lambda: pick(string.ascii_letters + string.digits + "!#%*", r.randint(10, 24))])()
        how = r.random()
        if how < 0.6:
            q = r.choice(['"', "'", ""])
            return f"{prose(3)} {r.choice(keys)}{r.choice([' = ', '=', ': '])}{q}", value, f"{q} {prose(2)}", "assigned"
        if how < 0.8:
            return f"{prose(3)} ", r.choice(["AKIA" + pick(string.ascii_uppercase + string.digits, 16), "ghp_" + pick(string.ascii_letters + string.digits, 36), "sk-" + pick(string.ascii_letters + string.digits, 40)]), f" {prose(2)}", "shaped"
        return f"{prose(2)} {r.choice(keys)} ", pick(base64[:-2], r.randint(28, 60)), f" {prose(2)}", "blob"

    def false():
        how = r.randrange(7)
        if how == 0:
            return f"{prose(2)} {r.choice(['commit', 'sha256', 'md5', 'checksum', 'revision'])} ", pick(hexes, r.choice([32, 40, 64])), f" {prose(2)}", "blob"
        if how == 1:
            u = pick(hexes, 32)
            return f"{prose(2)} {r.choice(['id', 'uuid', 'request'])} ", f"{u[:8]}-{u[8:12]}-{u[12:16]}-{u[16:20]}-{u[20:]}", f" {prose(1)}", "blob"
        if how == 2:
            w = r.choice(["changeme", "your_token_here", "password123", "example_key_value", "xxxxxxxxxxxxxxxx", "placeholder_secret", "test-token-0000", "${API_TOKEN}", "process.env.SECRET", "config.get_password()", "none_null_default", "getenv(AUTH_TOKEN)"])
            return f"{prose(2)} {r.choice(keys)} = ", w, f" {prose(2)}", "assigned"
        if how == 3:
            return f"{prose(1)} /usr/lib/{r.choice(WORDS)}/", "/".join(r.choices(WORDS, k=4)) + f"/v{r.randint(1, 99)}", f".py {prose(2)}", "blob"
        if how == 4:
            return f"{prose(3)} ", "".join(r.choices(syllables, k=r.randint(8, 14))) + str(r.randint(0, 9)), f" {prose(2)}", "blob"
        if how == 5:
            return f"{prose(2)} {r.choice(['token', 'auth', 'secret', 'password'])}: ", "".join(r.choices(syllables, k=r.randint(2, 7))) + r.choice(["", ".", ")"]), f" {prose(2)}", "assigned"
        return f"{prose(2)} ", pick("0123456789", r.randint(20, 30)), f" {prose(2)}", "blob"

    return [(*secret(), 1) if i % 2 == 0 else (*false(), 0) for i in range(n)]


def train(rows: list[tuple[str, str, str, str, int]], trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> list:
    """A forest from labelled findings (before, candidate, after, kind, label); at most FINDINGS of them."""
    rows = rows[:FINDINGS]
    x = np.array([features(b, c, a, k) for b, c, a, k, _ in rows])
    return forest(x, np.array([r[-1] for r in rows]), trees, depth, seed)


SCHEMA = "doc_id long, start int, stop int, kind string, score double, is_secret int, finding_sha256 string"


def _judged(model: list, texts: list[str | None]) -> list[list[tuple[int, int, str, float, str]]]:
    found = [findings(t) for t in texts]
    flat = [f for fs in found for f in fs]
    p = vote(model, np.array([features(b, c, a, k) for _, _, k, b, c, a in flat])) if flat else []
    score = iter(zip(flat, p))
    return [[(f[0], f[1], f[2], float(s), f[4]) for f, s in (next(score) for _ in fs)] for fs in found]


def scan(docs: DataFrame, model: list | None = None) -> DataFrame:
    """Each candidate finding with its score: doc_id, start, stop (characters), kind, score,
    is_secret (score of at least 0.5) and the SHA-256 of the finding, never the finding itself.

    Documents without candidates have no rows; null and empty texts have none.
    """
    model = train(labelled_findings()) if model is None else model

    def run(parts):
        for b in parts:
            rows = [
                (d, a, z, k, s, int(s >= 0.5), hashlib.sha256(c.encode()).hexdigest())
                for d, hits in zip(b.column(0).to_pylist(), _judged(model, b.column(1).to_pylist()))
                for a, z, k, s, c in hits
            ]
            if rows:
                kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.int32(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], [x.split()[0] for x in SCHEMA.split(", ")])

    return id_text(docs).mapInArrow(run, SCHEMA)


MASK = "[SECRET]"


def masked(docs: DataFrame, model: list | None = None) -> DataFrame:
    """The documents with each secret in `text` replaced by MASK; all rows and columns stay,
    n_chars (where there is such a column) follows the new text, null texts stay null."""
    model = train(labelled_findings()) if model is None else model

    def hide(texts):
        import pandas as pd

        out = []
        for t, hits in zip(texts, _judged(model, [None if t is None or t != t else t for t in texts])):
            for a, z, _, s, _ in reversed(hits):
                if s >= 0.5:
                    t = t[:a] + MASK + t[z:]
            out.append(t)
        return pd.Series(out, dtype=object)

    hidden = F.pandas_udf(hide, "string")
    out = docs.withColumn("text", hidden("text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return out


def op5_secret_forest(spark, sf_dir: str) -> DataFrame:
    """Each candidate finding of each row of documents; rules as in scan(): texts without one, null
    and empty ones have no rows, null ids stay null, repeated rows count each, candidates don't
    overlap and run to the end of their token in texts of any length."""
    return scan(table(spark, sf_dir, "documents"))


def stage(spark, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: secrets in the texts are masked; no document goes.  Null texts stay null,
    repeated rows and missing ids don't matter, an empty table stays empty."""
    small_batches(spark)
    return masked(docs)
