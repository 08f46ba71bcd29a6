"""Secret scan with a random forest against false positives (operator 7).

Candidates are token-like runs (of twelve characters or more, with a digit, a
capital inside or a joining mark), values assigned to a credential word, tokens
with a well-known prefix, passwords inside urls and private key blocks.  Each is
described over its whole length by length, entropy, character transitions,
dictionary coverage, path marks and the neighbouring words on both sides, and
judged by a random forest trained on labelled findings.  Those judged secret are
replaced in the text by ``MARK``.

The dictionary holds the ``DICTIONARY`` most frequent words (of equal ones those
that sort first) of ``MIN_WORD`` to ``MAX_WORD`` letters of the scanned corpus,
counted over all rows; it only feeds one feature, and its size is a parameter of
the model.  There is no table of labelled findings, so they are generated from a
seed (``FINDINGS`` of them, a documented bound) with words of the dictionary:
credentials of common shapes in assignments on one side; digests, identifiers,
paths, numbers, placeholders and ordinary long words in their usual surroundings
on the other.

Defined cases: null text has no finding and stays null; empty text has none;
overlapping candidates are merged into the longest; repeated rows and null ids
each keep their row; other columns are ignored by ``scan`` and kept by
``redact``; an empty table gives an empty result.  A run of letters of one case
without a credential context is an ordinary word and no candidate.
"""

from __future__ import annotations

import functools
import math
import random
import re
import string
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import id_and_text, table

FINDINGS = 6000
TREES = 48
MAX_DEPTH = 9
SEED = 7
ACCEPT = 0.5
MARK = "[SECRET]"
AROUND = 48

DICTIONARY = 20_000
MIN_WORD, MAX_WORD = 4, 16
FLUSH = 200_000

# Words that name credentials, words beside harmless values, placeholders, common words, prefixes of tokens.
CREDENTIAL = "token secret password passwd pwd apikey api_key api-key access_key auth bearer credential credentials private_key client_secret passphrase signature key".split()
HARMLESS = "commit sha sha1 sha256 md5 checksum digest hash uuid guid revision version build ref etag id isbn doi order invoice tracking card phone".split()
PLACEHOLDER = "example sample dummy placeholder changeme your yourkey xxxx xxxxxxxx test todo redacted none null insert here".split()
COMMON = "about also been code config data default example file from have html http into json line list local more name page path some such than that their them then there they this time user value were which will with work".split()
PREFIXES = "AKIA ASIA ghp_ gho_ ghu_ ghs_ github_pat_ glpat- sk- sk_live_ pk_live_ rk_live_ xoxa- xoxb- xoxp- AIza ya29. npm_ pypi- hf_ dop_v1_ shpat_ SG. eyJ".split()

_RUN = re.compile(r"[A-Za-z0-9_+/=~.\-]{12,}")
_TOKENLIKE = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]|[A-Za-z][_+=~][A-Za-z]")
_ASSIGN = re.compile(r"(?i)(?:token|secret|passw(?:or)?d|pwd|passphrase|api[_-]?key|access[_-]?key|private[_-]?key|auth|bearer|credentials?)[\"']?(?:\s{0,3}[:=]\s{0,3}|(?<=bearer)\s{1,3})[\"']?([^\s\"']{6,})")
_URL_PASSWORD = re.compile(r"[A-Za-z][A-Za-z0-9+.\-]{1,20}://[^\s/:@\"']{1,64}:([^\s/@\"']{4,})@")
_PREFIXED = re.compile(r"(?<![A-Za-z0-9])(?:" + "|".join(map(re.escape, PREFIXES)) + r")[A-Za-z0-9_\-+/=.]{12,}")
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----.*?(?:-----END [A-Z ]{0,30}PRIVATE KEY-----|\Z)", re.S)
_WORD = re.compile(r"[a-z]{3,}")
_PLAIN = re.compile(r"[a-z]{%d,%d}" % (MIN_WORD, MAX_WORD))
_ASSIGNED = re.compile(r"[=:]\s{0,3}[\"']?$")
_CRED = re.compile(r"(?i)\b(?:" + "|".join(map(re.escape, CREDENTIAL)) + r")\b")
_SAFE = re.compile(r"(?i)\b(?:" + "|".join(HARMLESS) + r")\b")
_HOLD = re.compile(r"(?i)(?:" + "|".join(PLACEHOLDER) + r")")
_PATHLIKE = re.compile(r"^(?:\.{0,2}/|[A-Za-z]:|https?:)|/[\w.\-]+/|\.(?:py|js|html?|json|txt|md|csv|png|jpe?g|com|org|net)\b")
_UUID = re.compile(r"^[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$")
NAMES = (
    "length", "entropy", "transitions", "dictionary", "digits", "upper", "hex", "vowels", "path", "credential near", "credential before", "credential after", "assigned",
    "harmless near", "harmless before", "harmless after", "placeholder", "numeric", "uuid", "quoted", "prefix", "block", "url password", "marks",
)


def candidates(text: str) -> list[tuple[int, int]]:
    """Spans (code points) of merged candidates, in order."""
    spans = [m.span() for m in _PEM.finditer(text)] if "-----BEGIN" in text else []
    if "=" in text or ":" in text:
        spans += [m.span(1) for m in _ASSIGN.finditer(text)]
    elif "earer" in text or "EARER" in text:
        spans += [m.span(1) for m in _ASSIGN.finditer(text)]
    if "://" in text:
        spans += [m.span(1) for m in _URL_PASSWORD.finditer(text)]
    for m in _RUN.finditer(text):
        run = m[0]
        if _TOKENLIKE.search(run):
            core = run.strip("./=-_~+") if run[-1] in "./-_~+" else run
            if len(core) >= 12:
                at = m.start() + run.index(core)
                spans.append((at, at + len(core)))
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans, key=lambda s: (s[0], -s[1])):
        if out and a < out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_KIND = str.maketrans({chr(c): "a" if 97 <= c <= 122 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else "." for c in range(128)})


def _covered(low: str, known: frozenset[str]) -> int:
    """Letters of ``low`` inside words of the dictionary, longest first from the left."""
    total = 0
    for run in _WORD.findall(low):
        if run in known:
            total += len(run)
            continue
        at = 0
        while at + MIN_WORD <= len(run):
            for size in range(min(MAX_WORD, len(run) - at), MIN_WORD - 1, -1):
                if run[at : at + size] in known:
                    total += size
                    at += size
                    break
            else:
                at += 1
    return total


def features(value: str, before: str, after: str, known: frozenset[str]) -> list[float]:
    n = len(value)
    seen = Counter(value)
    counts = np.fromiter(seen.values(), float)
    entropy = float(-(counts / n * np.log2(counts / n)).sum())
    kinds = np.frombuffer(value.translate(_KIND).encode("utf-32-le", "surrogatepass"), np.uint32)
    low = value.lower()
    letters = sum(k for c, k in seen.items() if c.isascii() and c.isalpha())
    vowels = sum(seen.get(c, 0) for c in "aeiouAEIOU")
    last = before[-24:]
    return [
        math.log2(n),
        entropy,
        float((kinds[1:] != kinds[:-1]).sum()) / max(1, n - 1),
        _covered(low, known) / n,
        sum(k for c, k in seen.items() if c.isdigit()) / n,
        sum(k for c, k in seen.items() if c.isupper()) / n,
        float(all(c in "0123456789abcdefABCDEF" for c in seen)),
        vowels / max(1, letters),
        float(bool(_PATHLIKE.search(value)) or before.endswith("/")),
        float(bool(_CRED.search(last))),
        float(bool(_CRED.search(before))),
        float(bool(_CRED.search(after))),
        float(bool(_ASSIGNED.search(last))),
        float(bool(_SAFE.search(last))),
        float(bool(_SAFE.search(before))),
        float(bool(_SAFE.search(after))),
        float(bool(_HOLD.search(value)) or bool(_HOLD.search(before[-16:])) or max(seen.values()) > 0.6 * n),
        float(not letters),
        float(bool(_UUID.match(value))),
        float(before[-1:] in "\"'" and before != "" and after[:1] == before[-1:]),
        float(value.startswith(_STARTS)),
        float(value.startswith("-----BEGIN")),
        float(after[:1] == "@" and before[-1:] == ":"),
        sum(k for c, k in seen.items() if not c.isalnum()) / n,
    ]


_STARTS = tuple(PREFIXES)


def _describe(text: str, span: tuple[int, int], known: frozenset[str]) -> list[float]:
    a, b = span
    return features(text[a:b], text[max(0, a - AROUND) : a], text[b : b + AROUND], known)


def dictionary(docs: DataFrame, size: int = DICTIONARY) -> tuple[str, ...]:
    """The ``size`` most frequent words of plain letters over all texts, sorted.

    Words are counted in each task, in pieces of ``FLUSH`` distinct ones, then by word.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: Counter[str] = Counter()

        def partial() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(own), pa.string()), pa.array(list(own.values()), pa.int64())], ["word", "n"])

        for batch in batches:
            for text in batch.column("text").to_pylist():
                for at in range(0, len(text or ""), 1 << 20):
                    own.update(_PLAIN.findall(text[at : at + (1 << 20)].lower()))
                    if len(own) > FLUSH:
                        yield partial()
                        own.clear()
        if own:
            yield partial()

    words = id_and_text(docs).select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return tuple(sorted(r.word for r in words.orderBy(F.desc("n"), "word").limit(size).collect()))


#: Shapes of generated secrets and of harmless findings, by name.
SECRETS = ("hex", "base64", "prefixed", "alnum", "letters", "password", "passphrase", "jwt", "pem", "url", "bearer")
OTHERS = ("digest", "uuid", "path", "number", "placeholder", "slug", "address", "word", "date", "identifier", "public block")


class _Maker:
    """Findings (value, before, after) of the named shapes."""

    def __init__(self, rng: random.Random, words: tuple[str, ...]) -> None:
        self.rng, self.words = rng, words

    def pick(self, chars: str, k: int) -> str:
        return "".join(self.rng.choice(chars) for _ in range(k))

    def prose(self, k: int) -> str:
        return " ".join(self.rng.choice(self.words) for _ in range(k))

    def name(self) -> str:
        return self.rng.choice(["token", "secret", "password", "api_key", "apikey", "access_key", "client_secret", "auth", "private_key", "credential"])

    def assign(self) -> str:
        return self.rng.choice([" = ", "=", ": ", ":"])

    def secret(self, shape: str) -> tuple[str, str, str]:
        rng, pick = self.rng, self.pick
        hexes, alnum = "0123456789abcdef", string.ascii_letters + string.digits
        quote = rng.choice(['"', "'", ""])
        before, after = f"{self.prose(3)} {self.name()}{self.assign()}{quote}", (quote or " ") + " " + self.prose(2)
        if shape == "hex":
            value = pick(hexes, rng.choice([32, 40, 48, 64]))
        elif shape == "base64":
            value = pick(alnum + "+/", rng.randint(20, 88))
        elif shape == "prefixed":
            value = rng.choice(PREFIXES[:-1])
            value += pick(string.ascii_uppercase + string.digits, 16) if value in ("AKIA", "ASIA") else pick(rng.choice([alnum, string.ascii_letters, string.ascii_lowercase]), rng.randint(20, 44))
            if rng.random() < 0.5:
                before, after = self.prose(3) + " ", " " + self.prose(2)
        elif shape == "alnum":
            value = pick(alnum, rng.randint(16, 40))
        elif shape == "letters":
            value = pick(rng.choice([string.ascii_letters, string.ascii_lowercase]), rng.randint(16, 40))
        elif shape == "password":
            value = pick(alnum + "!@#$%^&*", rng.randint(8, 20))
        elif shape == "passphrase":
            value = rng.choice(["", "-", "_", "."]).join(rng.choice(self.words) for _ in range(rng.randint(4, 6)))
            before = f"{self.prose(3)} {rng.choice(['password', 'passphrase', 'passwd', 'pwd'])}{rng.choice([' = ', '='])}{quote}"
        elif shape == "jwt":
            value = "eyJ" + pick(alnum, 30) + "." + pick(alnum, 40) + "." + pick(alnum + "-_", 43)
            if rng.random() < 0.3:
                before, after = self.prose(3) + " ", " " + self.prose(2)
        elif shape == "pem":
            kind = rng.choice(["", "RSA ", "EC ", "OPENSSH "])
            value = f"-----BEGIN {kind}PRIVATE KEY-----\n" + "\n".join(pick(alnum + "+/", 64) for _ in range(rng.randint(3, 26))) + f"\n-----END {kind}PRIVATE KEY-----"
            before, after = self.prose(3) + "\n", "\n" + self.prose(2)
        elif shape == "url":
            value = pick(alnum + "!$%", rng.randint(8, 20))
            before, after = f"{self.prose(2)} {rng.choice(['mongodb', 'postgres', 'https', 'redis', 'amqp'])}://{rng.choice(self.words)}:", "@" + rng.choice(self.words) + ".com/" + self.prose(1)
        else:
            value = pick(rng.choice([alnum, string.ascii_letters, alnum + "-_."]), rng.randint(20, 60))
            before, after = self.prose(2) + rng.choice([" Authorization: Bearer ", " bearer ", " auth: Bearer "]), " " + self.prose(2)
        return value, before, after

    def other(self, shape: str) -> tuple[str, str, str]:
        rng, pick, prose = self.rng, self.pick, self.prose
        hexes = "0123456789abcdef"
        word = lambda: rng.choice(self.words)
        quote = rng.choice(['"', "'", ""])
        before, after = prose(4) + " ", (quote or " ") + prose(3)
        if shape == "digest":
            value = pick(hexes, rng.choice([12, 32, 40, 64]))
            before = f"{prose(2)} {rng.choice(['commit ', 'sha256:', 'md5 = ', 'checksum: ', 'digest ', 'etag: '])}{quote}"
            if rng.random() < 0.3:
                before, after = prose(3) + " ", f" {rng.choice(['commit', 'checksum', 'digest', 'sha1'])} {prose(2)}"
        elif shape == "uuid":
            value = "-".join(pick(hexes, k) for k in (8, 4, 4, 4, 12))
            before = prose(2) + rng.choice([" id: ", " uuid = ", " ", " request ", " token = "]) + quote
        elif shape == "path":
            value = rng.choice(["/", "./", "https://www.", ""]) + "/".join(word() + str(rng.randint(0, 99)) for _ in range(rng.randint(2, 4))) + rng.choice([".html", ".py", ".png", "", ".json"])
            before = prose(4) + rng.choice([" ", " path = ", " file: ", " https://www."]) + quote
        elif shape == "number":
            value = pick(string.digits, rng.choice([12, 13, 16, 16, 20]))
            before = prose(4) + " " + rng.choice(["", "", "card ", "phone ", "order "])
        elif shape == "placeholder":
            value = rng.choice(["your_api_key_1234", "xxxxxxxxxxxxxxxx1", "changeme12345678", "example-token-0001", "placeholder_9999", "<your-token-123>", "test_secret_value1", "insert_key_here", "***************"])
            before = f"{prose(2)} {self.name()}{self.assign()}{quote}"
        elif shape == "slug":
            value = rng.choice("-_").join(word() for _ in range(rng.randint(2, 4))) + rng.choice(["", str(rng.randint(1, 99))])
        elif shape == "address":
            value = ".".join(str(rng.randint(0, 255)) for _ in range(4)) if rng.random() < 0.5 else f"{word()}.{rng.randint(1, 99)}@{word()}{rng.randint(0, 9)}.{rng.choice(['com', 'net', 'example.com'])}"
            value = value.ljust(7, "0")
        elif shape == "word":
            value = word() + rng.choice(["", "", word()])
            before = f"{prose(2)} {self.name()}{rng.choice([': ', ':', ' = '])}{quote}"
        elif shape == "date":
            value = "20" + "-".join(f"{rng.randint(1, 28):02d}" for _ in range(3)) + "T" + ":".join(f"{rng.randint(0, 59):02d}" for _ in range(3))
            before = prose(3) + rng.choice([" ", " date: "])
        elif shape == "identifier":
            value = word() + "".join(w.capitalize() for w in prose(rng.randint(1, 3)).split()) + rng.choice(["", "()", "_" + word()])
            before = prose(3) + rng.choice([" ", " = ", ": "])
        else:
            value = "-----BEGIN CERTIFICATE-----" + pick(string.ascii_letters + string.digits, 64)
            value = value[27:] if rng.random() < 0.5 else "_".join([word().upper()] * 2) + pick(string.digits, 2)
            before = prose(3) + " sha256 digest " if len(value) == 64 else prose(4) + " "
        return value, before, after


def labelled_findings(n: int = FINDINGS, seed: int = SEED, words: tuple[str, ...] = tuple(COMMON), secrets: tuple[str, ...] = SECRETS, others: tuple[str, ...] = OTHERS) -> tuple[np.ndarray, np.ndarray]:
    """(features, label) of ``n`` generated findings, half of them secrets, of the named shapes in turn."""
    rng = random.Random(seed)
    words = words or tuple(COMMON)
    known, make = frozenset(words), _Maker(rng, words)
    x, y = [], []
    for i in range(n):
        k = i // 2
        value, before, after = make.secret(secrets[k % len(secrets)]) if i % 2 else make.other(others[k % len(others)])
        x.append(features(value, before[-AROUND:], after[:AROUND], known))
        y.append(i % 2)
    return np.array(x, np.float32), np.array(y, np.int64)


class Forest:
    """Random forest of Gini trees over a small feature matrix."""

    def __init__(self, x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = MAX_DEPTH, seed: int = SEED) -> None:
        rng = np.random.default_rng(seed)
        self.trees = []
        for _ in range(trees):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[list[float]] = []
            self._grow(x[rows], y[rows], depth, rng, nodes)
            self.trees.append(np.array(nodes))

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng: np.random.Generator, nodes: list) -> int:
        """Append the subtree; a node is [feature or -1, threshold, left, right, share]."""
        at = len(nodes)
        share = float(y.mean())
        nodes.append([-1, 0.0, 0, 0, share])
        if depth == 0 or share in (0.0, 1.0) or len(y) < 8:
            return at
        best = (share * (1 - share) * len(y) - 1e-9, -1, 0.0)
        for f in rng.choice(x.shape[1], max(2, round(math.sqrt(x.shape[1]))), replace=False):
            order = np.argsort(x[:, f], kind="stable")
            v, ones = x[order, f], np.cumsum(y[order])
            n = np.arange(1, len(v))
            cut = np.flatnonzero(v[1:] != v[:-1])
            if not len(cut):
                continue
            left, right = ones[cut], ones[-1] - ones[cut]
            nl, nr = n[cut], len(v) - n[cut]
            cost = left * (nl - left) / nl + right * (nr - right) / nr
            k = int(cost.argmin())
            if cost[k] < best[0]:
                best = (float(cost[k]), int(f), float((v[cut[k]] + v[cut[k] + 1]) / 2))
        if best[1] >= 0:
            go = x[:, best[1]] <= best[2]
            nodes[at][:2] = [best[1], best[2]]
            nodes[at][2] = self._grow(x[go], y[go], depth - 1, rng, nodes)
            nodes[at][3] = self._grow(x[~go], y[~go], depth - 1, rng, nodes)
        return at

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for tree in self.trees:
            at = np.zeros(len(x), int)
            while True:
                inner = tree[at, 0] >= 0
                if not inner.any():
                    break
                f = np.maximum(tree[at, 0], 0).astype(int)
                go = np.where(x[np.arange(len(x)), f] <= tree[at, 1], tree[at, 2], tree[at, 3]).astype(int)
                at = np.where(inner, go, at)
            total += tree[at, 4]
        return total / len(self.trees)


class Detector:
    """A forest with the dictionary its features look words up in."""

    def __init__(self, forest: Forest, words: tuple[str, ...]) -> None:
        self.forest, self.known = forest, frozenset(words)


@functools.lru_cache(maxsize=4)
def trained(words: tuple[str, ...] = tuple(COMMON), findings: int = FINDINGS, seed: int = SEED) -> Detector:
    words = words or tuple(COMMON)
    return Detector(Forest(*labelled_findings(findings, seed, words), seed=seed), words)


def find(texts: list[str | None], detector: Detector) -> list[list[tuple[int, int, float]]]:
    """(start, end, score) of the candidates of each text."""
    spans = [candidates(t) if t else [] for t in texts]
    rows = [_describe(t, s, detector.known) for t, own in zip(texts, spans) for s in own]
    scores = iter(detector.forest.score(np.array(rows, np.float32)).tolist() if rows else [])
    return [[(a, b, next(scores)) for a, b in own] for own in spans]


def masked(text: str | None, found: list[tuple[int, int, float]], accept: float = ACCEPT) -> str | None:
    if text is None:
        return None
    out, at = [], 0
    for a, b, score in found:
        if score >= accept:
            out += [text[at:a], MARK]
            at = b
    return "".join([*out, text[at:]])


FINDING = "array<struct<start:int,end:int,score:double>>"


def scan(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, findings, redacted): candidates with their scores, and the text without secrets."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(dictionary(docs)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("score", pa.float64())]))
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                texts = part.column("text").to_pylist()
                found = find(texts, shared.value)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([[{"start": a, "end": b, "score": s} for a, b, s in own] for own in found], kind), pa.array([masked(t, own, accept) for t, own in zip(texts, found)], pa.string())],
                    ["doc_id", "findings", "redacted"],
                )

    return id_and_text(docs).mapInArrow(run, f"doc_id long, findings {FINDING}, redacted string")


def redact(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """``docs`` with the secrets of its column text masked; all rows and columns stay."""
    shared = docs.sparkSession.sparkContext.broadcast(trained(dictionary(docs)))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(place).to_pylist()
            clean = [masked(t, own, accept) for t, own in zip(texts, find(texts, shared.value))]
            yield batch.set_column(place, "text", pa.array(clean, batch.schema.field(place).type))

    return docs.mapInArrow(run, T.StructType(docs.schema.fields))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).select(
        "doc_id",
        F.size("findings").cast("long").alias("n_candidates"),
        F.size(F.filter("findings", lambda x: x["score"] >= ACCEPT)).cast("long").alias("n_secrets"),
        F.sha2(F.coalesce("redacted", F.lit("")).cast("binary"), 256).alias("redacted_sha256"),
    )
