"""Secret scans: candidate strings, and a random forest that removes false findings.

Candidates are whole runs of [A-Za-z0-9+/=_.-], 16 long or more, or 8 or more behind `=` or
`:`; runs of plain lower-case words are none. A
forest of TREES trees, grown here in numpy, scores each one on its length, the surprise of
its character transitions under the corpus' language, the part of it that dictionary words cover, signs
of a path or an address, and the words before it. It is trained from labelled findings:
by default those of `labelled_findings`, made from published key formats and from the
usual false positives (digests, identifiers, file names, versions, addresses); a table of
(before, candidate, after, secret) replaces them.

The transition model and the dictionary are fitted on the words of those findings'
contexts and of all documents, each row counted. Tasks count words and transitions of
their rows first (words are emitted whenever HELD distinct ones are held), so the shuffle
sees partial counts. The transition table is 28 by 28; the dictionary has the words that
occur twice at least and make up SHARE of all words, 1 / SHARE of them at most. Every
text is scanned whole.

Null and empty texts have no candidates; a run is one candidate however long; repeated rows are scanned one by one; other columns are ignored.
"""

from __future__ import annotations

import base64
import math
import random
import re
from collections import Counter
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, saved, table

TREES, DEPTH, LEAF = 40, 8, 4
SHARE, HELD = 5e-7, 1 << 18
CUT = 0.5
_CHARS = r"[A-Za-z0-9+/=_.\-]"
#: A whole run, however long; a shorter one only as an assigned value (group 1).
CANDIDATE = re.compile(rf"{_CHARS}{{16,}}|[=:]\s{{0,3}}[\"']?({_CHARS}{{8,15}})(?!{_CHARS})")
#: What no key looks like: lower-case words, joined or not.
_WORDS = re.compile(r"[+/=_.\-]*+(?:[A-Za-z]?[a-z]++[+/=_.\-]*+)++|[+/=_.\-]++")
_CUES = ("token", "secret", "password", "passwd", "pwd", "key", "apikey", "auth", "credential", "bearer", "private")
_PLAIN = ("commit", "sha", "sha256", "md5", "digest", "checksum", "id", "uuid", "version", "file", "path", "url", "etag", "revision")
FEATURES = ("length", "surprise", "entropy", "digits", "upper", "classes", "coverage", "slashes", "dots", "dashes", "extension", "hex", "cue", "plain", "assigned", "quoted")


def labelled_findings(n: int = 4000, seed: int = 5) -> list[tuple[str, str, str, int]]:
    """(before, candidate, after, secret) of made-up findings, half of them secrets."""
    rnd = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda chars, k: "".join(rnd.choice(chars) for _ in range(k))
    hexa = lambda k: pick("0123456789abcdef", k)
    word = lambda: "".join(rnd.choice(["the", "ing", "er", "tion", "con", "ment", "re", "data", "file", "user", "page", "index", "main"]) for _ in range(rnd.randint(1, 3)))
    keys = [lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), lambda: "ghp_" + pick(alnum, 36), lambda: hexa(rnd.choice([32, 40, 48, 64])), lambda: pick(alnum, rnd.randint(20, 48)), lambda: base64.b64encode(rnd.randbytes(rnd.randint(18, 48))).decode(), lambda: "sk_live_" + pick(alnum, 24), lambda: "xoxb-" + pick("0123456789", 11) + "-" + pick(alnum, 24), lambda: "AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ", 16), lambda: pick(alnum, rnd.randint(9, 15))]
    plain = [lambda: hexa(rnd.choice([32, 40, 64])), lambda: f"{hexa(8)}-{hexa(4)}-{hexa(4)}-{hexa(4)}-{hexa(12)}", lambda: "/".join(word() for _ in range(rnd.randint(3, 5))) + f"/{word()}{rnd.randint(1, 99)}.html", lambda: f"{word()}-{word()}-{rnd.randint(1, 9)}.{rnd.randint(0, 99)}.{rnd.randint(0, 9)}.tar.gz", lambda: "www." + word() + word() + f"{rnd.randint(1, 99)}.example.com", lambda: word() + "_" + word() + "_" + word() + str(rnd.randint(1, 2024)), lambda: f"2024-{rnd.randint(10, 12)}-{rnd.randint(10, 28)}T{rnd.randint(10, 23)}", lambda: word() + "." + str(rnd.randint(10, 99)) + "." + word() + word(), lambda: pick("0123456789", 16) + "e" + pick("0123456789", 3), lambda: pick("0123456789", rnd.randint(8, 20)), lambda: "".join(word().upper() + "_" for _ in range(3)) + "NAME", lambda: word() + str(rnd.randint(1, 2024)), lambda: word() + ":" + str(rnd.randint(1000, 9999)), lambda: f"{rnd.randint(1, 9)}.{rnd.randint(0, 99)}.{rnd.randint(0, 99)}-{word()}"]
    out = []
    while len(out) < n:
        if len(out) % 2:
            before = rnd.choice([f"{rnd.choice(_CUES)} = \"", f"{rnd.choice(_CUES)}: ", f"{word()}_{rnd.choice(_CUES)}='", f"{rnd.choice(_CUES).upper()}=", f"set the {rnd.choice(_CUES)} to "])
            cand, label = rnd.choice(keys)(), 1
        else:
            before = rnd.choice([f"{rnd.choice(_PLAIN)} ", f"{rnd.choice(_PLAIN)}: ", f"{rnd.choice(_PLAIN)} = \"", f"{word()} ", f"in {word()} ", "see http://", "the "])
            cand, label = rnd.choice(plain)(), 0
        if len(cand) >= 8 and not _WORDS.fullmatch(cand):
            out.append((before, cand, rnd.choice(["\"", " ", "\n", "'"]), label))
    return out


def tally(texts: Iterable[str]) -> Counter:
    """How often each word occurs."""
    words: Counter = Counter()
    for t in texts:
        if len(t) > 1 << 20:  # without a list of all words
            words.update(m[0] for m in re.finditer(r"[a-z]{2,20}", t.lower()))
        else:
            words.update(re.findall(r"[a-z]{2,20}", t.lower()))
    return words


def transitions(words: Counter) -> np.ndarray:
    """How often a character follows another in words; 0 stands for their ends."""
    counts = np.zeros((28, 28), np.int64)
    for w, n in words.items():
        x = [0, *(ord(c) - 96 for c in w), 0]
        for a, b in zip(x, x[1:]):
            counts[a, b] += n
    return counts


class Language:
    """Character transitions and frequent words of some texts, and of counts made before."""

    def __init__(self, texts: list[str], counts: np.ndarray | None = None, words: Counter | None = None):
        own = tally(texts)
        counts = 1 + transitions(own) + (0 if counts is None else counts)
        self.cost = -np.log2(counts / counts.sum(1, keepdims=True))
        words = own if words is None else words + own
        least = frequent(int(counts[0].sum()) - counts.shape[1])
        self.words = {w for w, n in words.items() if n >= least and len(w) > 2}

    def surprise(self, s: str) -> float:
        x = [(ord(c) - 96) if "a" <= c <= "z" else 27 if c.isdigit() else 0 for c in s.lower()]
        return float(np.mean(self.cost[x[:-1], x[1:]]))

    def coverage(self, s: str) -> float:
        s, covered, i = s.lower(), 0, 0
        while i < len(s):
            k = next((k for k in range(min(12, len(s) - i), 2, -1) if s[i : i + k] in self.words), 0)
            covered += k
            i += k or 1
        return covered / len(s)


def features(before: str, cand: str, after: str, language: Language) -> list[float]:
    n = len(cand)
    shares = np.array(list(Counter(cand).values())) / n
    near = re.findall(r"[a-z0-9]+", before.lower().replace("_", " "))[-3:]
    digits, upper, lower = (sum(f(c) for c in cand) for f in (str.isdigit, str.isupper, str.islower))
    return [
        math.log2(n), language.surprise(cand), float(-(shares * np.log2(shares)).sum()), digits / n, upper / n, (digits > 0) + (upper > 0) + (lower > 0), language.coverage(cand),
        cand.count("/") / n, cand.count("."), cand.count("-") + cand.count("_"), float(bool(re.search(r"\.[a-z]{2,4}$", cand))), float(bool(re.fullmatch(r"[0-9a-f-]+|[0-9A-F-]+", cand))),
        float(any(c in w for w in near for c in _CUES)), float(any(w in _PLAIN for w in near)), float(bool(re.search(r"[=:]\s*[\"']?$", before))), float(before[-1:] in "\"'" and after[:1] in "\"'" and bool(before)),
    ]


class Forest:
    """Classification trees on bootstrap samples, each split on the best of some features."""

    def __init__(self, x: np.ndarray, y: np.ndarray, seed: int = 3):
        rng = np.random.default_rng(seed)
        self.trees = [self._grow(x, y, np.sort(rng.integers(0, len(y), len(y))), rng) for _ in range(TREES)]

    def _grow(self, x: np.ndarray, y: np.ndarray, rows: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, ...]:
        nodes: list[list[float]] = []

        def add(rows: np.ndarray, depth: int) -> int:
            at = len(nodes)
            share = float(y[rows].mean())
            nodes.append([-1, 0.0, 0, 0, share])
            if depth == DEPTH or len(rows) < 2 * LEAF or share in (0.0, 1.0):
                return at
            best = (1e9, -1, 0.0)
            for f in rng.choice(x.shape[1], int(math.ceil(math.sqrt(x.shape[1]))), replace=False):
                order = np.argsort(x[rows, f], kind="stable")
                v, t = x[rows[order], f], np.cumsum(y[rows[order]])
                k = np.arange(1, len(rows))
                ok = (v[1:] > v[:-1]) & (k >= LEAF) & (len(rows) - k >= LEAF)
                if not ok.any():
                    continue
                p, q = t[:-1] / k, (t[-1] - t[:-1]) / (len(rows) - k)
                gini = np.where(ok, k * p * (1 - p) + (len(rows) - k) * q * (1 - q), 1e9)
                i = int(gini.argmin())
                if gini[i] < best[0]:
                    best = (float(gini[i]), int(f), float((v[i] + v[i + 1]) / 2))
            if best[1] < 0:
                return at
            left = x[rows, best[1]] <= best[2]
            nodes[at][:2] = best[1], best[2]
            nodes[at][2] = add(rows[left], depth + 1)
            nodes[at][3] = add(rows[~left], depth + 1)
            return at

        add(rows, 0)
        table_ = np.array(nodes)
        return table_[:, 0].astype(int), table_[:, 1], table_[:, 2].astype(int), table_[:, 3].astype(int), table_[:, 4]

    def score(self, x: np.ndarray) -> np.ndarray:
        total, rows = np.zeros(len(x)), np.arange(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), int)
            for _ in range(DEPTH):
                inner = feature[at] >= 0
                go = x[rows, np.maximum(feature[at], 0)] <= cut[at]
                at = np.where(inner, np.where(go, left[at], right[at]), at)
            total += share[at]
        return total / len(self.trees)


def scan(text: str, language: Language, forest: Forest) -> tuple[int, list[tuple[int, int, float]]]:
    """(candidates, (start, end, score) of those that are secrets) of a text, in code points."""
    found = [m.span(m.lastindex or 0) for m in CANDIDATE.finditer(text)]
    found = [(a, b) for a, b in found if not _WORDS.fullmatch(text, a, b)]
    if not found:
        return 0, []
    x = np.array([features(text[max(0, a - 60) : a], text[a:b], text[b : b + 2], language) for a, b in found])
    return len(found), [(a, b, float(s)) for (a, b), s in zip(found, forest.score(x), strict=True) if s >= CUT]


def word_counts(docs: DataFrame) -> DataFrame:
    """(a, b, word, n) over all texts: transitions a to b with a null word, and words of three letters or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, words = np.zeros((28, 28), np.int64), Counter()

        def emit() -> pa.RecordBatch:
            nonlocal counts
            counts = counts + transitions(words)
            kept = [(w, n) for w, n in words.items() if len(w) > 2]
            words.clear()
            none = pa.nulls(len(kept), pa.int32())
            return pa.RecordBatch.from_arrays([none, none, pa.array([w for w, _ in kept], pa.string()), pa.array([n for _, n in kept], pa.int64())], ["a", "b", "word", "n"])

        for batch in batches:
            for t in batch.column(0):
                words.update(tally([t.as_py() or ""]))
                if len(words) >= HELD:
                    yield emit()
        yield emit()
        a, b = np.nonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int32()), pa.array(b, pa.int32()), pa.nulls(len(a), pa.string()), pa.array(counts[a, b], pa.int64())], ["a", "b", "word", "n"])

    return arrow_map(docs.select("text"), run, "a int, b int, word string, n long").groupBy("a", "b", "word").agg(F.sum("n").alias("n"))


def frequent(total: int) -> int:
    """The occurrences that a word of the dictionary needs, of total words."""
    return max(2, math.ceil(SHARE * total))


def corpus_language(docs: DataFrame, contexts: list[str]) -> Language:
    found = saved(word_counts(docs), "words")
    counts = np.zeros((28, 28), np.int64)
    for r in found.where("word is null").collect():
        counts[r.a, r.b] = r.n
    own = tally(contexts)
    least = frequent(int(counts[0].sum()) + sum(own.values()))
    near = found.where(F.col("word").isNotNull() & ((F.col("n") >= least) | F.col("word").isin(list(own))))
    return Language(contexts, counts, Counter({r.word: r.n for r in near.select("word", "n").collect()}))


def fit(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None) -> tuple[Language, Forest]:
    findings = findings or labelled_findings()
    language = corpus_language(docs, [b + " " + a for b, _, a, _ in findings])
    x = np.array([features(b, c, a, language) for b, c, a, _ in findings])
    return language, Forest(x, np.array([f[3] for f in findings], float))


def find_secrets(docs: DataFrame, findings: list[tuple[str, str, str, int]] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_candidates, n_secrets, spans) for each row; spans are start:end:score, comma-joined."""
    docs = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, findings))  # at most 1 / SHARE words and TREES trees

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        language, forest = model.value
        for batch in batches:
            got = [scan(t or "", language, forest) for t in batch.column(1).to_pylist()]
            spans = [",".join(f"{a}:{b}:{s:.3f}" for a, b, s in x) for _, x in got]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in got], pa.int64()), pa.array([len(x) for _, x in got], pa.int64()), pa.array(spans, pa.string())], ["doc_id", "n_candidates", "n_secrets", "spans"])

    return arrow_map(docs, run, "doc_id long, n_candidates long, n_secrets long, spans string")


def op9_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_secrets(table(spark, sf_dir, "documents"))
