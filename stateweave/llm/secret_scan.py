"""Secret scans: candidates by pattern, false positives removed by a random forest.

Patterns find strings that could be credentials: key blocks, passwords in URLs, values assigned to telling names, known
prefixes, and long mixed strings.  A forest of decision trees, trained from labelled findings, decides which are real from the candidate's
length, its character transitions, how much of it a dictionary covers, whether it is a path, and the words next to it.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import discard, stored
from .texts import as_bytes, bound_batches, tidied

# Names that announce a credential, prefixes of known kinds, and names that announce something harmless.
TELLING = ["password", "passwd", "pwd", "secret", "token", "api_key", "apikey", "access_key", "private_key", "auth", "credential", "bearer"]
PREFIXES = ["AKIA", "ASIA", "ghp_", "gho_", "ghs_", "github_pat_", "xoxb-", "xoxp-", "sk_live_", "rk_live_", "AIza", "glpat-", "npm_", "eyJ"]
HARMLESS = ["sha1", "sha256", "md5", "checksum", "digest", "commit", "uuid", "guid", "hash", "revision", "example", "placeholder", "version", "doi", "isbn"]
#: Words that speak for a name or a phrase rather than a random string, whatever the corpus.
DICTIONARY = ["the", "and", "ing", "ion", "ent", "for", "tion", "with", "that", "this", "name", "user", "test", "example", "your", "here", "change", "value", "string", "token", "pass", "word", "key", "index", "path", "file", "image", "page", "http", "www", "com", "org", "html", "main", "data", "item", "list", "view", "date", "time"]
#: Commonest words of the corpus that join them.
CORPUS_WORDS = 20_000

#: A value assigned to a telling name (in quotes up to the closing one, else up to a blank, quote, comma, semicolon or
#: angle bracket), a known prefix with what follows, the password in a URL, a long string without blanks.
#: A candidate ends where its characters do, however long it is.
_NAMED = re.compile(
    rb"([?&]?)(?i:" + b"|".join(t.replace("_", "[_-]?").encode() for t in TELLING) + rb")[A-Za-z0-9_-]{0,12}[\"']?\s{0,3}(?:(?<=(?i:bearer))\s|:=|=>|[:=])\s{0,3}"
    rb"(?:\"([^\"\s]{8,})\"|'([^'\s]{8,})'|`([^`\s]{8,})`|[\"'`]?([^\s\"'`,;<>]{8,}))"
)
_KNOWN = re.compile(b"(?<![A-Za-z0-9])((?:" + b"|".join(re.escape(p.encode()) for p in PREFIXES) + rb")[A-Za-z0-9_+/=.-]{10,})")
_IN_URL = re.compile(rb"://[^\s/:@\"'<>]*:([^\s/@\"'<>]+)@")
_LONG = re.compile(rb"([A-Za-z0-9_+/=.-]{24,})")
_BLOCK = re.compile(rb"-----BEGIN [A-Z0-9 ]{1,40}-----")
_BODY = re.compile(rb"[A-Za-z0-9+/=\s:,.\\-]*")
_DIGIT, _LETTER = re.compile(rb"[0-9]"), re.compile(rb"[A-Za-z]")
#: Bytes of text on each side of a candidate that are looked at.
CONTEXT = 48
#: Placeholder for a removed secret.
MASK = b"[secret]"

FEATURES = ["length", "upper", "digits", "other", "case_turns", "digit_turns", "repeats", "entropy", "vowel_turns", "hex", "dictionary", "slashes", "dots", "is_path", "is_url", "telling", "harmless", "known", "quoted", "assigned", "in_url", "block", "private"]
_TELLING = re.compile("(?:" + "|".join(t.replace("_", "[_-]?") for t in TELLING) + r")[a-z_-]{0,12}\W{0,6}$")
_HARMLESS = re.compile("(?:" + "|".join(HARMLESS) + r")[a-z_-]{0,12}\W{0,6}$")


class Dictionary:
    """Words of at least three letters; ``covered`` says how many characters of a text they cover, from the left, longest first."""

    def __init__(self, words: list[str] = ()):
        self.words = {w for w in (*DICTIONARY, *words) if len(w) >= 3}
        self.longest = max(map(len, self.words))

    def covered(self, low: str) -> int:
        at = total = 0
        while at < len(low):
            n = next((n for n in range(min(self.longest, len(low) - at), 2, -1) if low[at : at + n] in self.words), 0)
            total += n
            at += n or 1
        return total


def corpus_words(docs: DataFrame, text_col: str = "text", most: int = CORPUS_WORDS) -> list[str]:
    """The ``most`` commonest runs of 4 to 20 letters a-z in all texts (counted over all documents, ties by the word).

    ``most`` is the size of the dictionary.  Counts are summed before shuffling; a histogram of them (some hundred rows)
    tells how common a word has to be, so that little more than the dictionary reaches the driver.
    """
    found = docs.select(F.explode(F.regexp_extract_all(F.lower(F.col(f"`{text_col}`").cast("string")), F.lit("(?<![a-z])[a-z]{4,20}(?![a-z])"), F.lit(0))).alias("word"))
    counts = stored(found.groupBy("word").count().withColumn("scale", F.floor(F.log2("count") * 16)))
    cut = have = 0
    for cut, n in sorted(counts.groupBy("scale").count().collect(), reverse=True):
        have += n
        if have >= most:
            break
    top = counts.where(F.col("scale") >= cut).orderBy(F.desc("count"), "word").limit(most)
    words = [r["word"] for r in top.collect()]
    discard(counts)
    return words


def features(value: str, before: str, after: str, dictionary: Dictionary) -> list[float]:
    """``FEATURES`` of a candidate and its surroundings."""
    block = value.startswith("-----BEGIN")
    private = block and "PRIVATE" in value[:60]
    n = len(value)
    kinds = "".join("d" if c.isdigit() else "u" if c.isupper() else "l" if c.islower() else "o" for c in value)
    turns = Counter(zip(kinds, kinds[1:], strict=False))
    counts = np.array([value.count(c) for c in set(value)], float) / n
    low = value.lower()
    vowel = bytes(c in "aeiou" for c in low if c.isalpha())
    near = before.lower()
    return [
        n, kinds.count("u") / n, kinds.count("d") / n, kinds.count("o") / n,
        (turns["u", "l"] + turns["l", "u"]) / n, sum(k for (a, b), k in turns.items() if "d" in (a, b) and a != b) / n,
        sum(a == b for a, b in zip(value, value[1:], strict=False)) / n, float(-(counts * np.log2(counts)).sum()),
        sum(a != b for a, b in zip(vowel, vowel[1:], strict=False)) / max(1, len(vowel)), float(all(c in string.hexdigits for c in value)),
        dictionary.covered(low) / n, value.count("/") / n, value.count(".") / n,
        float(value.startswith(("/", "./")) or value.count("/") >= 3), float("://" in before[-8:] or "www." in low),
        float(bool(_TELLING.search(near))), float(bool(_HARMLESS.search(near))), float(value.startswith(tuple(PREFIXES))),
        float(before[-1:] in ("'", '"', "`")), float(bool(re.search(r"[:=]\s*['\"`]?$", before))),
        float(after[:1] == "@" and "://" in before), float(block), float(private),
    ]


@dataclass
class Forest:
    """Trees as arrays: feature (-1 at a leaf), threshold, children, share of real secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]
    dictionary: Dictionary

    def probability(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, threshold, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                inner = feature[at] >= 0
                if not inner.any():
                    break
                go_left = x[np.arange(len(x)), np.maximum(feature[at], 0)] <= threshold[at]
                at = np.where(inner, np.where(go_left, left[at], right[at]), at)
            total += share[at]
        return total / max(1, len(self.trees))


def _grow(x: np.ndarray, y: np.ndarray, rng: np.random.Generator, depth: int, least: int) -> tuple:
    nodes: list[list[float]] = []

    def split(rows: np.ndarray, left_depth: int) -> int:
        me = len(nodes)
        nodes.append([-1, 0.0, -1, -1, float(y[rows].mean())])
        if left_depth == 0 or len(rows) < 2 * least or y[rows].min() == y[rows].max():
            return me
        best = (1e-12, -1, 0.0)
        n, ones = len(rows), y[rows].sum()
        for f in rng.choice(x.shape[1], max(1, int(np.sqrt(x.shape[1]))), replace=False).tolist():
            order = rows[np.argsort(x[rows, f], kind="stable")]
            v, k = x[order, f], np.arange(1, n)
            left = np.cumsum(y[order])[:-1]
            gini = n - ones**2 / n - (n - ones) ** 2 / n - (k - left**2 / k - (k - left) ** 2 / k) - ((n - k) - (ones - left) ** 2 / (n - k) - (n - k - ones + left) ** 2 / (n - k))
            gini[(v[1:] == v[:-1]) | (k < least) | (n - k < least)] = -1
            i = int(np.argmax(gini))
            if gini[i] > best[0]:
                best = (float(gini[i]), f, float(v[i]))
        if best[1] >= 0:
            go = x[rows, best[1]] <= best[2]
            nodes[me][:2] = best[1:]
            nodes[me][2] = split(rows[go], left_depth - 1)
            nodes[me][3] = split(rows[~go], left_depth - 1)
        return me

    split(rng.integers(0, len(y), len(y)), depth)
    f, t, a, b, s = zip(*nodes, strict=True)
    return np.array(f, np.int64), np.array(t), np.array(a, np.int64), np.array(b, np.int64), np.array(s)


def train_forest(findings: list[tuple[str, str, str, bool]], trees: int = 40, depth: int = 10, least: int = 3, seed: int = 5, words: list[str] = ()) -> Forest:
    """A forest from labelled findings (candidate, text before, text after, whether it is a secret) and dictionary words."""
    dictionary = Dictionary(words)
    x = np.array([features(v, b, a, dictionary) for v, b, a, _ in findings], float)
    y = np.array([float(label) for *_, label in findings])
    rng = np.random.default_rng(seed)
    return Forest([_grow(x, y, rng, depth, least) for _ in range(trees)], dictionary)


def corpus_forest(docs: DataFrame, text_col: str = "text") -> Forest:
    """A forest trained on the made-up findings, with the words of the corpus (one pass over the texts)."""
    words = corpus_words(docs, text_col)
    return train_forest(labelled_findings(words=words), words=words)


def labelled_findings(n: int = 3000, seed: int = 7, words: list[str] = ()) -> list[tuple[str, str, str, bool]]:
    """Made-up labelled findings (the same for the same ``words``): random credentials and what is mistaken for them.

    ``n`` bounds the training set.  Names, paths and phrases among them are made of ``words`` too.
    """
    vocabulary = [*DICTIONARY, *[w for w in words if len(w) <= 12][:2000]]
    rng = np.random.default_rng(seed)
    pick = lambda seq: seq[int(rng.integers(len(seq)))]
    draw = lambda letters, k: "".join(letters[i] for i in rng.integers(0, len(letters), k))
    hexa, b62, b64 = "0123456789abcdef", string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/"
    syllable = lambda: draw("bcdfghklmnprstvw", 1) + draw("aeiou", 1) + draw("lmnrst", int(rng.integers(0, 2)))
    word = lambda: pick(vocabulary) if rng.random() < 0.5 else "".join(syllable() for _ in range(int(rng.integers(1, 4))))
    around = lambda: " ".join(word() for _ in range(5)) + " "
    out = []
    for i in range(n):
        tie, quote = pick([" = ", "=", ": ", ":", " := "]), pick(['"', "'", "", ""])
        if i % 2:
            name = pick(TELLING)
            value, named = pick([
                lambda: (draw(hexa, pick([18, 24, 32, 40, 64])), True), lambda: (draw(b62, int(rng.integers(12, 48))), True), lambda: (draw(b64, int(rng.integers(20, 64))), True),
                lambda: (draw(b62 + "_-", int(rng.integers(10, 24))), True), lambda: (pick(PREFIXES) + draw(b62, int(rng.integers(16, 40))), rng.random() < 0.5),
                lambda: (draw(b62 + "!@#%^&*-_", int(rng.integers(8, 20))) + draw("0123456789", 1) + pick(["", "!", "#"]), True),
                lambda: (word().capitalize() + draw("0123456789", int(rng.integers(2, 5))) + pick("!@#$%&*") + word() + draw(b62, int(rng.integers(0, 4))), True),
                lambda: ("eyJ" + ".".join(draw(b62 + "_-", int(rng.integers(20, 400))) for _ in range(3)), rng.random() < 0.5),
                lambda: (draw(b62 + "!#%^*-_", int(rng.integers(6, 24))) + draw("0123456789", 1), None),
                lambda: ("-----BEGIN " + pick(["", "RSA ", "EC ", "OPENSSH ", "ENCRYPTED "]) + "PRIVATE KEY-----\n" + "\n".join(draw(b64, 64) for _ in range(int(rng.integers(2, 24)))) + "\n", False),
            ])()
            before = around() + (name + tie + quote if named else pick(["postgres", "https", "redis"]) + "://" + word() + ":" if named is None else pick(["", "uses ", "key "]))
            if named is None:
                quote = "@" + word()
        else:
            value, before = pick([
                lambda: (pick(["your", "my", "the", "some"]) + pick(["_", "-"]) + word() + "_" + word() + pick(["", "_here"]), pick(TELLING) + tie + quote),
                lambda: (pick("x*0a-.") * int(rng.integers(8, 40)), pick(TELLING) + tie + quote),
                lambda: ("/".join(word() for _ in range(int(rng.integers(4, 9)))) + str(int(rng.integers(10))), pick(["", "path=", "file: ", "/"])),
                lambda: ("_".join(word() for _ in range(int(rng.integers(5, 9)))) + str(int(rng.integers(100))), pick(["", "name=", "id: "])),
                lambda: (draw(hexa, pick([32, 40, 64])), pick(HARMLESS) + tie + quote),
                lambda: (f"{draw(hexa, 8)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 4)}-{draw(hexa, 12)}", pick(HARMLESS + ["id", "ref"]) + tie + quote),
                lambda: ("www." + word() + word() + ".com/" + "/".join(word() for _ in range(4)) + "1", "http://"),
                lambda: (word().capitalize() + "".join(word().capitalize() for _ in range(int(rng.integers(4, 8)))) + str(int(rng.integers(10))), pick(["", "class ", "token: "])),
                lambda: ("".join(syllable() for _ in range(int(rng.integers(8, 14)))) + pick(["", "1", ".2"]), pick(["", "the ", "token "])),
                lambda: (pick([word, lambda: word() + word(), lambda: word() + pick("-_.") + word()])(), pick(TELLING) + pick(["", "or", "s", "_name", "_type", "_url"]) + tie + quote),
                lambda: (pick(["${", "{{", "$", "%"]) + word().upper() + "_" + word().upper() + pick(["}", "}}", "", "%"]), pick(TELLING) + tie + quote),
                lambda: (pick(["os.environ", "config", "self", "settings", "process.env"]) + pick([".", "["]) + word() + "_" + word() + pick(["", "()", "]"]), pick(TELLING) + tie),
                lambda: (pick(["password", "pass", "secret", "yourpassword", "xxxx", "****", "example"]), pick(["postgres", "https"]) + "://user:"),
                lambda: ("-----BEGIN " + pick(["CERTIFICATE", "PUBLIC KEY", "PGP SIGNATURE", "CERTIFICATE REQUEST"]) + "-----\n" + "\n".join(draw(b64, 64) for _ in range(int(rng.integers(2, 24)))) + "\n", ""),
                lambda: (draw(hexa, pick([32, 40, 64])), pick(HARMLESS + ["HEAD is now at ", "in commit ", "revision ", "sha256-"])),
            ])()
            if before.endswith("://user:"):
                quote = "@" + word()
            before = around() + before
        out.append((value, before[-CONTEXT:], (quote + " " + around())[:CONTEXT], bool(i % 2)))
    return out


def blocks(text: bytes) -> list[tuple[int, int]]:
    """Armoured blocks (keys, certificates): up to their end line, or as far as their characters go."""
    out, at, ends = [], 0, True
    while m := _BLOCK.search(text, at):
        close = text.find(b"-----END ", m.end()) if ends else -1
        ends = close >= 0
        body = _BODY.match(text, m.end()).end()
        end = text.find(b"-----", close + 9) if 0 <= close <= body + 9 else -1
        at = end + 5 if end >= 0 else max(body, m.end())
        out.append((m.start(), at))
    return out


def candidates(text: bytes) -> list[tuple[int, int]]:
    """Where candidates stand in a text (bytes), in order.

    Blocks come first, then passwords in URLs, known prefixes and values of telling names, then what is left of long
    strings; of overlapping ones of a kind the earlier, or the longest that starts there.
    """
    kinds = [blocks(text) if b"-----BEGIN " in text else [], [m.span(1) for m in _IN_URL.finditer(text)] if b"://" in text else []]
    named = []
    for m in _NAMED.finditer(text) if b"=" in text or b":" in text or b"earer" in text else ():
        a, b = m.span(next(i for i in range(2, 6) if m[i]))
        if m[5]:  # not in quotes: a query string goes on at &, a sentence may end here
            b = a + len((m[5].split(b"&")[0] if m[1] else m[5]).rstrip(b".)]}"))
        if b - a >= 8:
            named.append((a, b))
    kinds += [named + [m.span(1) for m in _KNOWN.finditer(text)]]
    long = [m.span(1) for m in _LONG.finditer(text) if _DIGIT.search(m[1]) and _LETTER.search(m[1])]
    taken: list[tuple[int, int]] = []
    for found in kinds:
        fresh: list[tuple[int, int]] = []
        for a, b in sorted(found, key=lambda x: (x[0], -x[1])):
            if (not fresh or a >= fresh[-1][1]) and not _overlaps(taken, a, b):
                fresh.append((a, b))
        taken = sorted(taken + fresh)
    rest = []
    for a, b in long:
        for x, y in [*taken[_first_after(taken, a) :], (len(text) + 1, 0)]:
            if x >= b:
                x = b
            if x - a >= 24 and _DIGIT.search(text, a, x) and _LETTER.search(text, a, x):
                rest.append((a, x))
            if x >= b:
                break
            a = max(a, y)
    return sorted(taken + rest)


def _first_after(spans: list[tuple[int, int]], at: int) -> int:
    """Index of the first of some ordered, disjoint spans that ends after ``at``."""
    return bisect_right(spans, at, key=lambda s: s[1])


def _overlaps(spans: list[tuple[int, int]], a: int, b: int) -> bool:
    i = _first_after(spans, a)
    return i < len(spans) and spans[i][0] < b


def scan_text(text: bytes, forest: Forest, threshold: float = 0.5) -> tuple[int, list[tuple[int, int, float]]]:
    """Number of candidates; begin, end and probability of those taken for secrets."""
    spans = candidates(text)
    if not spans:
        return 0, []
    say = lambda b: b.decode("utf-8", "replace")
    x = np.array([features(say(text[a:b]), say(text[max(0, a - CONTEXT) : a]), say(text[b : b + CONTEXT]), forest.dictionary) for a, b in spans])
    p = forest.probability(x)
    return len(spans), [(a, b, float(q)) for (a, b), q in zip(spans, p, strict=True) if q >= threshold]


def mask_text(text: bytes, found: list[tuple[int, int, float]]) -> bytes:
    """The text with a placeholder for each secret."""
    out, at = [], 0
    for a, b, _ in found:
        out += [text[at:a], MASK]
        at = b
    return b"".join([*out, text[at:]])


def scan_secrets(docs: DataFrame, forest: Forest, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """Secrets in every whole text: a row for each row, no shuffle; the trained forest (of fixed size) goes to workers.

    Returns ``id_col``, ``n_candidates``, ``n_secrets``, ``max_probability`` (null without secrets), ``findings``
    (array of begin, end in bytes, probability) and ``masked`` (the text with placeholders; null for a null text).

    A null or empty text has no candidates.  Repeated rows are scanned each; a null id stays null; other columns are
    ignored; an empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    id_type = docs.schema[id_col].dataType.simpleString()
    kind = pa.list_(pa.struct([("begin", pa.int64()), ("end", pa.int64()), ("probability", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            rows = [scan_text(t, forest, threshold) for t in texts]
            there = batch.column(1).is_valid().to_pylist()
            yield pa.RecordBatch.from_arrays([
                batch.column(0), pa.array([n for n, _ in rows], pa.int64()), pa.array([len(f) for _, f in rows], pa.int64()), pa.array([max((p for *_, p in f), default=None) for _, f in rows], pa.float64()),
                pa.array([[{"begin": a, "end": b, "probability": p} for a, b, p in f] for _, f in rows], kind),
                pa.array([mask_text(t, f).decode("utf-8", "replace") if ok else None for t, (_, f), ok in zip(texts, rows, there, strict=True)], pa.string()),
            ], names=[id_col, "n_candidates", "n_secrets", "max_probability", "findings", "masked"])

    schema = f"`{id_col}` {id_type}, n_candidates bigint, n_secrets bigint, max_probability double, findings array<struct<begin:bigint,end:bigint,probability:double>>, masked string"
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string").alias("text")).mapInArrow(tidied(run), schema)


def mask_documents(docs: DataFrame, forest: Forest, text_col: str = "text", threshold: float = 0.5) -> DataFrame:
    """``docs`` with a placeholder for each secret in their texts; all rows and columns stay (null texts too)."""
    bound_batches(docs.sparkSession)
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            masked = [None if t is None else mask_text(t, scan_text(t, forest, threshold)[1]) for t in batch.column(at).cast(pa.binary()).to_pylist()]
            columns = list(batch.columns)
            columns[at] = pa.array(masked, pa.binary()).cast(batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return docs.mapInArrow(tidied(run), docs.schema)
