"""Toxicity scores: a learned lexicon matched through Levenshtein automata, judged in its context.

From half of a bounded sample of labelled rows a lexicon is learned: words, and stems that begin words, that stand
in many more toxic documents than others. It becomes a trie. Every different word of the corpus is turned into a
Levenshtein automaton and run against the trie, so misspelled terms are found too. Each match is looked at in a
window of words: inside quotation marks or right after a reporting word it is a quotation, which counts apart from
abuse, and near a word of address it counts as such. From the other half of the sample a logistic regression learns how much matches, misspellings and
contexts weigh, in number and in density. Every document is scored over its whole text in one scan without shuffles.

Words are runs of letters, marks and digits of any script, lower-cased; all other characters part them. In scripts
that are written without spaces a word begins at each character and is ``UNSPACED`` characters long at most.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import held, prepare, spill, table
from ._words import NORMAL

#: Labelled rows that the classifier is fitted on at most; the first by a hash of their id.
LABELLED = 16_000

# Parameters of the model, the same at every size of the corpus.
#: Characters of a stem, and documents of the sample that a term must stand in.
STEM, SUPPORT = (3, 9), 6
#: Occurrences of a term in one document that count when terms are chosen.
BURST = 8
#: How much more frequent among their words a term must be in toxic documents, and how surely (natural units of likelihood).
RATIO, SURE = 6.0, 8.0
#: Terms that explain a toxic document: others in it don't count as its own (copies of one text share all their words).
EXPLAINED = 3
#: Words on each side of a match that are its context, and words before it where a reporting word makes it reported speech.
CONTEXT, REPORTED = 8, 4
#: Characters of a word of a script without spaces.
UNSPACED = 8
#: Different words that a worker remembers; when there are more it starts anew.
REMEMBERED = 200_000

# Words of address and words that report speech, in the languages of the corpus.
ADDRESS = frozenset("you your youre u ur du dich dir dein deine ihr euch tu te toi ton ta tes vous votre tú ti tus usted ustedes vos".split())
REPORT = frozenset("said says wrote writes called quote quoted quotes reported sagte sagt schrieb nannte zitat zitiert dit disait écrit écrivit appelé cite citation dijo dice escribió llamó cita citado".split())
#: The signs that end a quotation, by the one that begins it; within a family one quotation is open at a time.
MARKS = ({'"': '"'}, {"“": "”", "„": "“”"}, {"«": "»", "»": "«"}, {"‹": "›", "›": "‹"})

_ADDRESS, _REPORT = (frozenset(w.encode() for w in words) for words in (ADDRESS, REPORT))
_FAMILY = {mark: k for k, family in enumerate(MARKS) for pair in family.items() for mark in "".join(pair)}
_MARK = re.compile("|".join(map(re.escape, _FAMILY)))
#: What marks and line feeds are in a list of words: control characters, which no word holds.
_SIGN = {mark: chr(1 + k) for k, mark in enumerate(_FAMILY)}
_MEANT = {sign.encode(): mark for mark, sign in _SIGN.items()}
_BREAK = b"\x1f"
_PLAIN = NORMAL.tobytes()
_table = NORMAL.copy()
_table[[ord(sign) for sign in _SIGN.values()]] = [ord(sign) for sign in _SIGN.values()]
_table[10] = _BREAK[0]
_MARKED = _table.tobytes()
#: Thai, Lao, Burmese and Khmer, kana, and the ideographs.
_NO_SPACES = re.compile("[\u0e00-\u0eff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\U00020000-\U0003ffff]+")


@lru_cache(maxsize=1 << 16)
def _in_word(char: str) -> bool:
    return char.isalnum() or unicodedata.category(char)[0] == "M"


def words_of(text: str, marked: bool = False) -> list[bytes]:
    """The words of a lower-cased text; with the signs of quotation marks and line feeds among them if ``marked``."""
    if not text.isascii():
        for char in set(text):
            if char > "\x7f" and not _in_word(char) and not (marked and char in _FAMILY):
                text = text.replace(char, " ")
    if marked:
        text = re.sub("[\x01-\x1f]", lambda m: "\n" if m[0] == "\n" else " ", text).replace("\n", " \n ")
        text = _MARK.sub(lambda m: f" {_SIGN[m[0]]} ", text)
    out = text.encode().translate(_MARKED if marked else _PLAIN).split(b" ")
    out = [w for w in out if w]
    if not text.isascii() and _NO_SPACES.search(text):
        out = [part for w in out for part in _unspaced(w)]
    return out


def _unspaced(word: bytes) -> list[bytes]:
    """A word, or where it holds a run of a script without spaces, the words that begin at each of its characters."""
    text = word.decode()
    out, at = [], 0
    for run in _NO_SPACES.finditer(text):
        out += [text[at : run.start()], *(run[0][k : k + UNSPACED] for k in range(len(run[0])))]
        at = run.end()
    return [w.encode() for w in [*out, text[at:]] if w]


def quoted_words(tokens: list[bytes]) -> tuple[list[bytes], list[bool]]:
    """The words of a marked list, and whether each one stands between two marks that belong together.

    A quotation ends within its line; a mark that isn't answered there quotes nothing. Marks of one family don't
    care for those of another, so quotations of either kind may lie in one another.
    """
    words: list[bytes] = []
    edge = Counter()
    begun: list[tuple[str, int] | None] = [None] * len(MARKS)
    for token in tokens:
        mark = _MEANT.get(token)
        if mark is not None:
            family = _FAMILY[mark]
            was = begun[family]
            if was and mark in MARKS[family][was[0]]:
                edge[was[1]] += 1
                edge[len(words)] -= 1
                begun[family] = None
            elif mark in MARKS[family]:
                begun[family] = mark, len(words)
        elif token == _BREAK:
            begun = [None] * len(MARKS)
        else:
            words.append(token)
    depth, inside = 0, []
    for k in range(len(words)):
        depth += edge.get(k, 0)
        inside.append(depth > 0)
    return words, inside


class Shapes:
    """The states of all Levenshtein automata of ``k`` edits, whatever the word, and their transitions.

    A state of a word's automaton is an offset and a shape: the positions (characters of the word used since the
    offset, edits made) that no other one covers. Where a character leads depends only on the shape and on which of
    the next characters of the word it equals, so transitions are worked out once and looked up from then on.
    """

    def __init__(self, k: int) -> None:
        self.k, self.reach = k, 3 * k + 2
        self.shapes: list[tuple[tuple[int, int], ...]] = []
        self.number: dict[tuple[tuple[int, int], ...], int] = {}
        self.known: dict[tuple[int, int, int], tuple[int, int]] = {}

    def _of(self, positions: set[tuple[int, int]], rest: int) -> tuple[int, int]:
        """The offset and the number of the shape of these positions, none of which lies behind the word; -1 if there is none."""
        least: dict[int, int] = {}
        for i, e in positions:
            if i <= rest:
                least[i] = min(least.get(i, self.k), e)
        kept = sorted((i, e) for i, e in least.items() if not any(f < e and f + abs(i - j) <= e for j, f in least.items()))
        if not kept:
            return 0, -1
        offset = kept[0][0]
        shape = tuple((i - offset, e) for i, e in kept)
        if shape not in self.number:
            self.number[shape] = len(self.shapes)
            self.shapes.append(shape)
        return offset, self.number[shape]

    def start(self, rest: int) -> int:
        return self._of({(0, 0)}, min(rest, self.reach))[1]

    def step(self, shape: int, equal: int, rest: int) -> tuple[int, int]:
        """By how much the offset moves and the next shape: for the bits of the next characters that are equal, and
        the characters that the word has left (from ``reach`` on they are enough)."""
        key = shape, equal, rest
        known = self.known.get(key)
        if known is None:
            out = set()
            for i, e in self.shapes[shape]:
                for more in range(self.k - e + 1):  # characters that the string lacks before the equal one
                    if equal >> (i + more) & 1:
                        out.add((i + more + 1, e + more))
                if e < self.k:
                    out.add((i, e + 1))  # the string has a character more
                    if i < rest:
                        out.add((i + 1, e + 1))  # or another one
            known = self.known[key] = self._of(out, rest)
        return known


class Levenshtein:
    """The automaton of all strings within some edits of a word; a state is an offset and the number of a shape."""

    def __init__(self, word: str, shapes: Shapes) -> None:
        self.length, self.shapes = len(word), shapes
        self.where: dict[str, int] = {}  # bits of the places of each character
        for i, char in enumerate(word):
            self.where[char] = self.where.get(char, 0) | 1 << i
        self.mask = (1 << shapes.reach) - 1

    def start(self) -> tuple[int, int]:
        return 0, self.shapes.start(self.length)

    def step(self, state: tuple[int, int], char: str) -> tuple[int, int] | None:
        """The state after a character; None if no string goes on from here."""
        offset, shape = state
        rest = self.length - offset
        moved, shape = self.shapes.step(shape, self.where.get(char, 0) >> offset & self.mask, rest if rest < self.shapes.reach else self.shapes.reach)
        return (offset + moved, shape) if shape >= 0 else None

    def distance(self, state: tuple[int, int]) -> int | None:
        """The edits from the word to the string read so far, None if too many."""
        rest = self.length - state[0]
        return min((e + rest - i for i, e in self.shapes.shapes[state[1]] if e + rest - i <= self.shapes.k), default=None)

    def prefix_distance(self, state: tuple[int, int]) -> int:
        """The edits from the nearest beginning of the word to the string read so far."""
        return min(e for _, e in self.shapes.shapes[state[1]])


class Lexicon:
    """A trie of terms; a term that ends in ``*`` is a stem, which only has to begin a word."""

    def __init__(self, terms: dict[str, float]) -> None:
        self.weight = terms
        self.root: dict = {}
        self.exact: dict[str, str] = {}
        self.stems: dict[str, str] = {}
        self.shapes = Shapes(1)
        halves: dict[tuple[int, int], set[str]] = {}
        for term in terms:
            node, stem, body = self.root, term.endswith("*"), term.rstrip("*")
            (self.stems if stem else self.exact)[body] = term
            if len(body) >= (6 if stem else 5):  # shorter ones are too near to other words
                for c in body:
                    node = node.setdefault(c, {})
                node["*" if stem else ""] = term
                m = len(body) // 2
                halves.setdefault((0, m), set()).add(body[:m])
                for shift in (-1, 0, 1):
                    halves.setdefault((m + shift, len(body) - m), set()).add(body[m:])
        self.halved = [(at, at + n, found) for (at, n), found in halves.items()]
        self.shortest = 4  # a term of five characters less one
        self.longest = max(map(len, terms), default=0) + 2  # what follows decides nothing: a whole term would be two edits away
        self.sizes = sorted({len(s) for s in self.stems}, reverse=True)
        self.known: dict[bytes, tuple[str, int] | None] = {}

    def lookup(self, word: str) -> tuple[str, int] | None:
        """The best term of a word with its distance, 0 or 1."""
        if word in self.exact:
            return self.exact[word], 0
        for n in self.sizes:
            if word[:n] in self.stems:
                return self.stems[word[:n]], 0
        word = word[: self.longest]
        if len(word) >= self.shortest:
            for at, end, halves in self.halved:  # one edit leaves one half of the term as it is, moved by one character at most
                if word[at:end] in halves:
                    return self.near(word)
        return None

    def near(self, word: str) -> tuple[str, int] | None:
        """Walk the trie and the word's automaton together; the nearest term, then the longest."""
        automaton, best = Levenshtein(word, self.shapes), None
        stack = [(self.root, automaton.start())]
        while stack:
            node, state = stack.pop()
            for char, child in node.items():
                if char == "":
                    d = automaton.distance(state)
                elif char == "*":
                    d = automaton.prefix_distance(state)
                else:
                    after = automaton.step(state, char)
                    if after:
                        stack.append((child, after))
                    continue
                if d is not None and (best is None or (d, -len(child), child) < (best[1], -len(best[0]), best[0])):
                    best = child, d
        return best

    def matches(self, words: list[bytes]) -> list[tuple[int, str, int]]:
        """(position, term, distance) of the words that match."""
        known, most = self.known, 4 * self.longest
        if len(known) > REMEMBERED:
            known.clear()
        if max(map(len, words), default=0) > most:
            words = [w[:most] for w in words]  # bytes of more characters than decide
        for w in set(words).difference(known):
            known[w] = self.lookup(w.decode(errors="ignore"))
        return [(i, *m) for i, m in enumerate(map(known.__getitem__, words)) if m]


FEATURES = ("exact", "exact density", "weight", "weight density", "misspelled", "misspelled density", "quoted density", "address density", "terms", "long")


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    """The numbers that a document is judged by; all 0 for a text without a match, but for its length."""
    lowered = (text or "").lower()
    words = words_of(lowered)
    found = lexicon.matches(words)
    n = len(words)
    quoted = address = 0
    abuse = []
    if found:
        inside = quoted_words(words_of(lowered, True))[1] if _MARK.search(lowered) else None
        for i, t, d in found:
            if (inside is not None and inside[i]) or not _REPORT.isdisjoint(words[max(0, i - REPORTED) : i]):
                quoted += 1
                continue
            abuse.append((t, d))
            if not _ADDRESS.isdisjoint(words[max(0, i - CONTEXT) : i + CONTEXT + 1]):
                address += 1
    exact = [t for t, d in abuse if d == 0]
    near = len(abuse) - len(exact)
    weight = sum(lexicon.weight[t] for t in exact)
    per = 100.0 / (n + 20)
    return [math.log1p(len(exact)), len(exact) * per, math.log1p(weight), weight * per, math.log1p(near), near * per, quoted * per, address * per, math.log1p(len(set(exact))), math.log1p(n)]


class Model(NamedTuple):
    terms: dict[str, float]
    mean: np.ndarray
    scale: np.ndarray
    factor: np.ndarray  # of the features and 1

    def score(self, rows: np.ndarray) -> np.ndarray:
        x = np.column_stack([(rows - self.mean) / self.scale, np.ones(len(rows))]) @ self.factor
        return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def held_out(column: str) -> Column:
    """Whether the remainder of the crc32 of the id's text by 5 is 0: labels of these rows are never used."""
    return F.coalesce(F.crc32(F.col(column).cast("string").cast("binary")) % 5 == 0, F.lit(False))


def _stems(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(term, occurrences in toxic documents, in others, toxic documents) of all words and stems, summed by batch.

    A document's occurrences of a term count up to ``BURST``; all its words together stand under the empty term.
    """
    low, high = STEM
    for batch in batches:
        counts, docs = (Counter(), Counter()), Counter()
        for text, toxic in zip(batch.column("text").to_pylist(), batch.column("toxic").to_pylist(), strict=True):
            side = 0 if toxic else 1
            own: Counter = Counter()
            for word, n in Counter(words_of((text or "").lower())).items():
                counts[side][""] += n
                w = word.decode()
                if _NO_SPACES.match(w):
                    for k in range(2, len(w) + 1):
                        own[w[:k] + "*"] += n
                elif len(word) >= 3:
                    own[w] += n
                    for k in range(low, min(high, len(w)) + 1):
                        own[w[:k] + "*"] += n
            for term, n in own.items():
                counts[side][term] += min(n, BURST)
            if toxic:
                docs.update(own.keys())
        names = list(set(counts[0]) | set(counts[1]))
        yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(pa.array([c[t] for t in names], pa.int64()) for c in (*counts, docs))], names=["term", "yes", "no", "docs"])


def _likelihood(got, of, share):
    """The terms of a log-likelihood ratio of one side: ``got`` of ``of`` words where ``share`` of all are expected; of columns or numbers."""
    return [(got, of * share), (of - got, of * (1 - share))]


def surprise(yes: int, no: int, n_yes: int, n_no: int) -> float:
    """How surely a term's share differs between n_yes and n_no words, as the log of a likelihood ratio."""
    share = (yes + no) / (n_yes + n_no)
    return sum(x * math.log(x / want) for got, of in ((yes, n_yes), (no, n_no)) for x, want in _likelihood(got, of, share) if x and want)


def _surprise_column(n_yes: int, n_no: int) -> Column:
    share = (F.col("yes") + F.col("no")) / F.lit(n_yes + n_no)
    parts = [_likelihood(F.col("yes"), F.lit(float(n_yes)), share), _likelihood(F.col("no"), F.lit(float(n_no)), share)]
    return sum((F.when((x > 0) & (want > 0), x * F.log(x / want)).otherwise(0.0) for side in parts for x, want in side), F.lit(0.0))


def choose_terms(rows: list[tuple[str, int, int]], n_yes: int, n_no: int, documents: list[list[str]] | None = None) -> dict[str, float]:
    """Terms by how surely they tell toxic words apart, none of which begins another; the log of how much more frequent each is.

    rows: (term, occurrences in toxic documents, in others); n_yes and n_no are all words of both. Of terms that are
    equally sure, words come before stems, then longer terms, then the alphabet decides. ``documents`` are the terms
    in each toxic document: a term must stand in ``SUPPORT`` of them that hold fewer than ``EXPLAINED`` terms chosen before.
    """
    where: dict[str, list[int]] = {}
    for k, terms in enumerate(documents or ()):
        for t in terms:
            where.setdefault(t, []).append(k)
    held_by = [0] * len(documents or ())
    chosen: dict[str, float] = {}
    bodies: set[str] = set()
    begun: set[str] = set()  # all that the chosen ones begin with
    for term, yes, no in sorted(rows, key=lambda r: (-round(surprise(r[1], r[2], n_yes, n_no), 6), r[0].endswith("*"), -len(r[0]), r[0])):
        body = term.rstrip("*")
        starts = {body[:k] for k in range(1, len(body) + 1)}
        if body in begun or not bodies.isdisjoint(starts):
            continue
        own = where.get(term, [])
        if documents is not None and sum(held_by[k] < EXPLAINED for k in own) < SUPPORT:
            continue
        chosen[term] = math.log((yes + 0.5) / (n_yes + 1) * (n_no + 1) / (no + 0.5))
        bodies.add(body)
        begun |= starts
        for k in own:
            held_by[k] += 1
    return chosen


def _holding(terms: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """The terms that stand in each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, high = terms.value, max(map(len, terms.value), default=0)
        for batch in batches:
            found = []
            for text in batch.column("text").to_pylist():
                words = {w.decode() for w in set(words_of((text or "").lower()))}
                found.append(sorted(known.intersection({*words, *(w[:k] + "*" for w in words for k in range(1, min(len(w), high) + 1))})))
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string()))], names=["terms"])

    return run


def fit_logistic(rows: np.ndarray, label: np.ndarray, ridge: float = 1.0) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, and the factors of a ridge logistic regression by Newton's method."""
    mean, scale = rows.mean(0), rows.std(0)
    scale = np.where(scale > 1e-9, scale, 1.0)
    x = np.column_stack([(rows - mean) / scale, np.ones(len(rows))])
    penalty = np.full(x.shape[1], ridge)
    penalty[-1] = 1e-6
    factor = np.zeros(x.shape[1])

    def cost(f: np.ndarray) -> float:
        z = x @ f
        return float(np.logaddexp(0, z).sum() - label @ z + 0.5 * penalty @ (f * f))

    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ factor, -30, 30)))
        slope = x.T @ (p - label) + penalty * factor
        bend = (x * (p * (1 - p) + 1e-9)[:, None]).T @ x + np.diag(penalty)
        step, size = np.linalg.solve(bend, slope), 1.0
        while size > 1e-4 and cost(factor - size * step) > cost(factor):
            size /= 2
        factor = factor - size * step
        if np.abs(size * step).max() < 1e-6:
            break
    return mean, scale, factor


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", labelled: int = LABELLED) -> Model:
    """Learn lexicon and factors from at most ``labelled`` rows of ``labels`` that aren't held out.

    Labels that are null, or whose id is, are not used; of several labels of an id the largest counts. Without
    toxic or other labels the lexicon is empty and every score is the share of toxic rows (0 without any label). Of an
    id that names several texts each one is learned from. Nulls and empty texts are texts of no words; texts and words
    may be of any length.
    """
    spark = docs.sparkSession
    prepare(spark)
    known = labels.select(F.col(id_col).cast("long").alias("__id"), F.col(label_col).cast("int").alias("toxic")).where("toxic is not null and __id is not null").where(~held_out("__id"))
    known = known.groupBy("__id").agg(F.max("toxic").alias("toxic"))
    sample = spark.createDataFrame(known.orderBy(F.xxhash64("__id"), "__id").limit(labelled).collect(), "__id long, toxic int")  # bounded by the parameter
    texts = docs.select(F.col(id_col).cast("long").alias("__id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(sample), "__id")
    first = F.pmod(F.xxhash64(F.lit("half"), "__id"), F.lit(2)) == 0
    counted = texts.where(first).select("text", "toxic").mapInArrow(_stems, "term string, yes long, no long, docs long")
    totals = sample.groupBy(first.alias("first"), "toxic").agg(F.count("*").alias("n")).collect()  # at most 4 rows
    terms: dict[str, float] = {}
    if {bool(r["toxic"]) for r in totals if r["first"]} == {True, False}:
        sums = spill(counted.groupBy("term").agg(F.sum("yes").alias("yes"), F.sum("no").alias("no"), F.sum("docs").alias("docs")).where(f"docs >= {SUPPORT} or term = ''"), "terms")
        n_yes, n_no = sums.where("term = ''").select("yes", "no").first() or (0, 0)
        often = sums.where("term <> ''").where((F.col("yes") + 0.5) * (n_no + 1) >= RATIO * (F.col("no") + 0.5) * (n_yes + 1))
        sure = often.where(_surprise_column(n_yes, n_no) >= SURE)  # of the bounded sample
        rows = [(r["term"], r["yes"], r["no"]) for r in sure.collect()]
        candidates = spark.sparkContext.broadcast(frozenset(r[0] for r in rows))
        toxic = [r["terms"] for r in texts.where(first & (F.col("toxic") != 0)).select("text").mapInArrow(_holding(candidates), "terms array<string>").collect()]  # bounded by the sample
        terms = choose_terms(rows, n_yes, n_no, sorted(toxic))
    shared = spark.sparkContext.broadcast(terms)
    rows = texts.where(~first).mapInArrow(_train_rows(shared), "features array<double>, toxic int").collect()  # bounded by the sample
    x = np.array([r["features"] for r in rows], np.float64).reshape(-1, len(FEATURES))
    y = np.array([r["toxic"] != 0 for r in rows], np.float64)
    if not len(y) or y.min() == y.max():
        share = float(y.mean()) if len(y) else 0.0
        factor = np.zeros(len(FEATURES) + 1)
        factor[-1] = math.log(max(share, 1e-9) / max(1 - share, 1e-9))
        return Model(terms, np.zeros(len(FEATURES)), np.ones(len(FEATURES)), factor)
    order = np.lexsort(np.column_stack([x, y]).T)  # rows come in any order; the sums must not
    return Model(terms, *fit_logistic(x[order], y[order]))


def _lexicon(terms: dict[str, float]) -> Lexicon:
    return held(("lexicon", tuple(terms.items())), lambda: Lexicon(terms))


def _train_rows(terms: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lexicon = _lexicon(terms.value)
        for batch in batches:
            rows = [features(t, lexicon) for t in batch.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.list_(pa.float64())), batch.column("toxic")], names=["features", "toxic"])

    return run


def _score(model: Broadcast, texts: pa.Array) -> np.ndarray:
    lexicon = _lexicon(model.value.terms)
    rows = np.array([features(t, lexicon) for t in texts.to_pylist()], np.float64).reshape(-1, len(FEATURES))
    return model.value.score(rows)


def toxicity(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row; null and empty texts are scored as texts of no words. Ids may be null or repeat."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(_score(shared, batch.column("text")))], names=["id", "score"])

    prepare(docs.sparkSession)
    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, score double")


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", limit: float = 0.5) -> DataFrame:
    """The rows whose score is below the limit, with all columns as they are; nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(_score(shared, batch.column(at)) < limit))

    prepare(docs.sparkSession)
    return docs.mapInArrow(run, docs.schema)


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``documents``."""
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = toxicity(docs, model)
    return out.select(F.col("id").alias("doc_id"), held_out("id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
