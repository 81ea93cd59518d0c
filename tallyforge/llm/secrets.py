"""Secret scans: patterns, and guess costs of values in a credential context.

A value that follows a credential word is cut at minimum cost into words,
dates, repeats, keyboard walks and brute-force spans; where even the cheapest
cut takes many guesses, the value is a secret. Every such value is priced,
whether a pattern has found it or not.
"""

from __future__ import annotations

import functools
import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import table

KINDS = ("assign", "access", "hex", "guess")
SPANS = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType()), T.StructField("log10_guesses", T.DoubleType())]))

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")  # a run is matched whole, so shorter ones are just those that fail
_CONTEXT = re.compile(r"""(?:pass(?:word|wd|code|phrase)?|pwd|passwort|secret|token|api[_-]?key|auth[_-]?key|credentials?|login|private[_-]?key|access[_-]?key)["']?[\x20\t]*(?::|=>?|\bis\b)[\x20\t]*["']?([^\s"'<>|,;]+)""", re.I | re.A)
_ASSIGN_HINTS = ("password", "passwd", "secret", "token", "apikey", "api_key")
_CONTEXT_HINTS = ("pass", "pwd", "secret", "token", "api", "auth", "credential", "login", "private", "access")

#: Guesses (log10) from which on a value counts as a secret.
THRESHOLD = 9.0
#: The commonest passwords first: a word costs its place.
COMMON = """password 123456 12345678 qwerty abc123 letmein monkey dragon iloveyou admin welcome login master
sunshine princess football shadow superman michael changeme secret passw0rd test guest default root user hello
freedom whatever trustno1 baseball batman access starwars example sample dummy placeholder your_password yourpassword
token apikey none null true false todo redacted hidden""".split()
#: Frequent words, which follow these where no other list is given.
FREQUENT = """the and you that for with this have from not are was but all can one there out what about when your which
will would could time people them other than then now look only come its over think also back after use two how our work
first well way even new want because any these give day most name key code data file server service system house water
world life home love summer winter spring autumn red green blue black white little big good happy money family friend
city country school night morning music game star sun moon king queen dog cat horse tiger lion apple orange coffee
correct battery staple number test account office company email phone""".split()
#: Words of a dictionary that is learnt from documents: at most so many, each in so many of them and such a share of them at least.
WORDS, SEEN, SHARE = 20_000, 3, 1e-4
#: What a run of letters in one case costs that is plausible as a word but in no list: one of 100,000, or of two such when longer.
WORD_COST, WORD_LETTERS = 5.0, 14
#: What a letter costs after another (a row for each of a-z), in steps of -0.3 of the log10 of its share: counted
#: over the distinct words of Python's docstrings. A word costs at most so much a pair in the mean: of its own words
#: of 8 letters 3 % cost more, and of random ones 2 % don't.
_PAIRS = """95459759597353959342677869 37573989369278469446389958 39583994494489299573599979 47751779289587489547588979 48435568799553857234967589
49773389299588399465499959 48892954399564479347489997 29982899399667399574699979 55455559998452369543959796 38882888885888368888188868 47961869398494669737585989
38752799399399379855579939 25982899398758439857599979 49433639496786489932669979 76448669796542549355455899 39872896499398349354589969 99979999999796999669099999
38552769397656379544678959 59592794397677559832488969 39682794299679469445597959 44564669599443649333999999 29991999399978599899999999 29873993399594399357997799
48373696399779729672989768 67564879399544429533975966 39991999399957599976999977""".split()
_PAIR_STEP, PAIR_COST = 0.3, 1.35
_LEET = str.maketrans("@4301!5$7", "aaeoiisst")
_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
_KEY = {c: (r, i) for r, row in enumerate(_ROWS) for i, c in enumerate(row)}
_YEAR = re.compile(r"(?=((?:19|20)[0-9]{2}))")
_YEAR_FIRST = re.compile(r"[0-9]{4}([-/._]?)(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12][0-9]|3[01])")
_YEAR_LAST = re.compile(r"(?:0?[1-9]|[12][0-9]|3[01])([-/._]?)(?:0?[1-9]|1[0-2])\1[0-9]{4}")
_DATE_COST, _YEAR_COST = math.log10(365 * 120), math.log10(120)
#: The longest walk over the keyboard or the alphabet that is one segment, and the longest letters that may be plausible.
WALK, LONG = 26, 1000
_LOG = [0.0, *(math.log10(i) for i in range(1, 1 << 10))]
#: Letters in one case, or behind one capital, where U stands for a capital and l for another letter.
_LETTERS = re.compile("U+(?!l)|U?l+")
#: The price of each further segment: where to cut is itself a guess.
CUT_COST = math.log10(2)


@functools.lru_cache(1 << 16)
def _char_cost(c: str) -> float:
    return math.log10(10 if c.isdigit() else 26 if c.isalpha() and c.isascii() else 33 if c.isascii() else 100)


@functools.lru_cache(1 << 16)
def plausible(letters: str) -> bool:
    """Whether the pairs of letters are those of a word; accents don't count, and other scripts than Latin have no pairs."""
    low = "".join(c for c in unicodedata.normalize("NFKD", letters.casefold()) if not unicodedata.combining(c))
    costs = [int(_PAIRS[ord(a) - 97][ord(b) - 97]) if "a" <= a <= "z" and "a" <= b <= "z" else 9 for a, b in zip(low, low[1:], strict=False)]
    return bool(costs) and _PAIR_STEP * sum(costs) <= PAIR_COST * len(costs) + 1e-9


class Dictionary:
    """Ranked words, the commonest first; shorter ones than 3 letters and those of one repeated character count for nothing."""

    def __init__(self, words: list[str] = FREQUENT):
        ranked = dict.fromkeys(w.lower() for w in (*COMMON, *words) if len(w) > 2 and len(set(w.lower())) > 1)
        self.cost = {w: math.log10(i + 2) for i, w in enumerate(ranked)}
        sizes: dict[str, set[int]] = {}
        for w in self.cost:
            sizes.setdefault(w[:3], set()).add(len(w))
        self.sizes = {k: sorted(v) for k, v in sizes.items()}
        self.longest = max(map(len, self.cost))

    def segments(self, value: str) -> Iterator[tuple[int, int, float]]:
        """All runs of ``value`` that are words, also in capitals or with digits for letters."""
        low = value.lower()
        for text in {low, low.translate(_LEET)} if len(low) == len(value) else {value}:
            for i in range(len(text) - 2):
                for n in self.sizes.get(text[i : i + 3], ()):
                    if (cost := self.cost.get(text[i : i + n])) is not None and i + n <= len(text):
                        yield i, i + n, cost + (value[i : i + n] != text[i : i + n]) * math.log10(4)


def _dates(value: str) -> Iterator[tuple[int, int, float]]:
    """All years, and all runs that are a date with one."""
    for m in _YEAR.finditer(value):
        y, n = m.start(), len(value)
        yield y, y + 4, _YEAR_COST
        for j in range(y + 6, min(n, y + 10) + 1):
            if _YEAR_FIRST.fullmatch(value, y, j):
                yield y, j, _DATE_COST
        for i in range(max(0, y - 6), y - 1):
            if _YEAR_LAST.fullmatch(value, i, y + 4):
                yield i, y + 4, _DATE_COST


_DEFAULT = Dictionary()


def guess_cost(value: str, dictionary: Dictionary = _DEFAULT) -> float:
    """log10 of the guesses that the cheapest segmentation of ``value`` takes; 0 for an empty one.

    Segments: words of the dictionary, whole runs of up to LONG letters that are
    plausible as a word, years and dates, three or more times one character, walks of 3 to
    WALK characters, and brute force; any part of the value that is one counts.
    Each segment but the first costs CUT_COST more.

    Time is linear in the length: all segments but repeats are bounded. A
    repeat need only begin where its run does, or where a segment ends that
    began before the run: any other beginning can be moved to the left, which
    costs less than the segments in between.
    """
    n = len(value)
    low = value.lower() if len(value.lower()) == n else value
    ends: dict[int, list[tuple[int, float]]] = {}
    for i, j, cost in (*dictionary.segments(value), *_dates(value)):
        ends.setdefault(j, []).append((i, cost))
    for m in _LETTERS.finditer("".join("U" if c.isupper() else "l" if c.isalpha() else "." for c in value)):
        i, j = m.span()
        if 3 <= j - i <= LONG and plausible(value[i:j]):
            ends.setdefault(j, []).append((i, WORD_COST * math.ceil((j - i) / WORD_LETTERS)))
    within = max(dictionary.longest, 10, WALK)
    starts, walk = [0], 0  # of repeats in the present run, and of the present walk
    best = [0.0] * (n + 1)
    brute = [0.0] * (n + 1)  # the cheapest way that ends in a brute-force span
    for j in range(1, n + 1):
        c = _char_cost(value[j - 1])
        least = min(brute[j - 1], best[j - 1] + CUT_COST) + c if j > 1 else c
        brute[j] = least
        if j in ends:
            for i, cost in ends[j]:
                least = min(least, best[i] + cost + (CUT_COST if i else 0.0))
        if j > 1:
            if not _near(low[j - 2], low[j - 1]):
                walk = j - 1
            for i in range(max(walk, j - WALK), j - 2):
                least = min(least, best[i] + _char_cost(low[i]) + _LOG[j - i] + 1 + (CUT_COST if i else 0.0))
            if value[j - 2] != value[j - 1]:
                starts = [j - 1]
            else:
                if j - 1 - starts[0] <= within and (j - 1 in ends or j - 1 - starts[0] == 1):
                    starts.append(j - 1)
                for i in starts:
                    if j - i >= 3:
                        least = min(least, best[i] + c + math.log10(j - i) + (CUT_COST if i else 0.0))
        best[j] = least
    return best[n]


@functools.lru_cache(1 << 16)
def _near(a: str, b: str) -> bool:
    p, q = _KEY.get(a), _KEY.get(b)
    if p and q and a != b and abs(p[0] - q[0]) <= 1 and abs(p[1] - q[1]) <= 1:
        return True
    return abs(ord(a) - ord(b)) == 1 and a.isalnum() and b.isalnum()


def find_secrets(text: str, threshold: float = THRESHOLD, dictionary: Dictionary = _DEFAULT) -> list[tuple[str, int, int, float | None]]:
    """(kind, start, end, log10 guesses) of all secrets, by start and then kind; code points, end exclusive.

    Every value in a credential context is priced: it is a guess span from the
    threshold on, also where a pattern's span holds it; the price of an assign
    span is that of its value.
    """
    low = text.lower()
    found: list[tuple[str, int, int, float | None]] = []
    price = functools.cache(lambda value: guess_cost(value, dictionary))
    if any(h in low for h in _ASSIGN_HINTS):
        found += [("assign", m.start(), m.end(), price(m[2])) for m in _ASSIGN.finditer(text) if len(m[2]) >= 8]
    if "AKIA" in text:
        found += [("access", m.start(), m.end(), None) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    found += [("hex", m.start(), m.end(), None) for m in _HEX.finditer(text)]
    if any(h in low for h in _CONTEXT_HINTS):
        for m in _CONTEXT.finditer(text):
            value = m[1].rstrip(".:!?)]}")
            if (cost := price(value)) >= threshold:
                found.append(("guess", m.start(1), m.start(1) + len(value), cost))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


_LONE = re.compile(r"(?<!\w)[^\W\d_]{3,24}(?!\w)")


def vocabulary_words(path: str, *, least: int = 4) -> list[str]:
    """The whole words of a tokenizer's vocabulary (.json with word ends), those of the earliest merges first.

    A dictionary that is the same for every table: merges are learnt by
    frequency, so ids rank the words. Only words of ``least`` and more letters
    a-z count, since short ones are mostly endings; FREQUENT comes first. The
    file bounds the list.
    """
    with open(path, encoding="utf-8") as f:
        ids = json.load(f)["model"]["vocab"]
    end = "</w>"
    words = sorted((i, w.removesuffix(end)) for w, i in ids.items() if w.endswith(end))
    return list(dict.fromkeys([*FREQUENT, *(w for _, w in words if len(w) >= least and w.isascii() and w.isalpha())]))


def ranked_words(docs: DataFrame, *, text: str = "text", most: int = WORDS, least: int = SEEN, share: float = SHARE) -> list[str]:
    """The words that most documents hold, commonest first: a dictionary for guess costs of a corpus in other words.

    It depends on the table, so learn it once and pass the same list from then on.

    Words are lone runs of 3 to 24 letters, in lower case; values in a
    credential context teach nothing. All documents are counted, each once a
    word. Ties are by name. Null texts have no words, and an empty table gives
    no list. ``share`` bounds what is sent to the driver, however many tasks
    send: no more words can be in such a share of the documents than the mean
    document has distinct words over ``share``; ``most`` bounds the list.
    """
    least = max(least, math.ceil(share * docs.count()))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def flush():
            out = pa.RecordBatch.from_pydict({"word": list(found), "n": pa.array(found.values(), pa.int64())})
            found.clear()
            return out

        for batch in batches:
            for t in batch.column(0).to_pylist():
                low = (t or "").lower()
                if any(h in low for h in _CONTEXT_HINTS):
                    low = _CONTEXT.sub(" ", low)
                found.update(set(_LONE.findall(low)))
                if len(found) > 200_000:
                    yield flush()
        yield flush()

    counted = docs.select(text).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    return [r.word for r in counted.orderBy(F.desc("n"), "word").limit(most).collect()]


def scan_secrets(docs: DataFrame, *, text: str = "text", into: str = "secrets", threshold: float = THRESHOLD, words: list[str] | None = None) -> DataFrame:
    """``docs`` with an array ``into`` of structs (kind, start, end, log10_guesses); a column that is called so is replaced.

    Kinds: assign, access and hex by pattern, leftmost and non-overlapping per
    kind; guess for values in a credential context that take at least
    10 ** ``threshold`` guesses, inside another span or not. ``words`` is a
    dictionary, commonest first: a given one (``vocabulary_words``), or one
    that ``ranked_words`` has learnt from a corpus once and that is then kept;
    FREQUENT by default. Spans are in code points, by start and then
    kind. A null or empty text has none. Rows are judged each for itself.
    """
    held = docs.sparkSession.sparkContext.broadcast(FREQUENT if words is None else words)

    @F.arrow_udf(SPANS)
    def scan(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        dictionary = Dictionary(held.value)
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("log10_guesses", pa.float64())]))
        names = ("kind", "start", "end", "log10_guesses")
        for texts in batches:
            yield pa.array([[dict(zip(names, x, strict=True)) for x in find_secrets(t.as_py() or "", threshold, dictionary)] for t in texts], kind)

    return docs.withColumn(into, scan.asNondeterministic()(F.col(text)))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s.kind, s.start.cast("string"), s.end.cast("string"))), ",")


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per document with the secrets of its whole text; the dictionary is a public vocabulary, so no row's verdict depends on others."""
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = scan_secrets(docs, words=vocabulary_words(public_tokenizers.path("word_bpe_49k.json")))
    count = lambda kind: F.size(F.filter("secrets", lambda s: s.kind == kind)).cast("long").alias(f"n_{kind}")
    return docs.select(
        "doc_id",
        *map(count, KINDS),
        F.sha2(_listed(F.filter("secrets", lambda s: s.kind != "guess")), 256).alias("base_sha256"),
        _listed(F.col("secrets")).alias("spans"),
    )
