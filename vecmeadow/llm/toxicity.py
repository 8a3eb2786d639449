"""Toxicity by a subsequence string kernel and a support vector machine over Nyström landmarks.

Two strings are alike by the subsequences of three characters that they share,
weighted by how far each is spread: a gap or an inserted character weakens a
match and does not end it. The kernel is normalised, the ends of a string count as
characters, and runs of single letters ("a b c d") are read as one word too.

The machine reads the windows of a sentence: each word, and each run of 2 to ``WINDOW``
neighbouring words, in which white space is a character like any other. A sentence
is as toxic as its worst window and a document as its worst sentence.

Training takes labelled sentences. A sentence of a toxic document is labelled
toxic when it holds a witness: a word that toxic documents have and clean ones
do not, by smoothed odds, or, in toxic documents without such a word, a run of words. Witnesses are the
words that are in a fair share of the toxic documents, and then, one by one, the one that is in most documents not yet
explained; near copies of a training document are left out first, since all their
words would look like witnesses. All sentences of clean documents are clean. The machine (squared hinge
loss, on the kernel's Nyström features) starts from witnesses, variants of them with characters or blanks put in, and clean words.
Then it is trained on the sentences, each by its worst window so far, a few times over. Landmarks
are the witnesses that cover most toxic documents and the clean windows most like them.
The kernel is an inner product of subsequence weights, so the sum over landmarks
becomes one weight per subsequence, and scoring needs no landmark.

The score is a logistic curve that
passes through ``threshold`` where training documents are told apart best.

At most ``sample`` labelled documents of each class are used, the first by a hash
of their ids, less those of more than ``longest`` bytes, so that what the driver gets is bounded. Without both classes every score is 0. A null or empty text has no
words and the lowest score. Null and repeated ids are scored like any others.
"""

from __future__ import annotations

import re
import uuid
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vecmeadow.llm import worker
from vecmeadow.llm.quality import labelled_sample

SAMPLE = 2500
LONGEST_TRAINED = 32 * 1024  # bytes of a document that trains
THRESHOLD = 0.7
SLOPE = 6.0
DECAY = 0.6
SPAN = 6
FEATURE_BITS = 20
SPREAD_BITS = 2  # hold SPAN - 2 spreads
LANDMARKS = 256
NEGATIVES = 8000
COST = 50.0
LOWEST = -2.0
BIAS = -1.0  # a word like no landmark is clean
SHARE = 0.015
SENTENCE_TURNS = 3
WINDOW = 4
MEMO_WORDS = 300_000
MEMO_BYTES = 32 * 1024 * 1024
BLOCK_BYTES = 1 << 20
CLASSES = 64  # of characters in the cube; the last is for all others
MOST_CODE = 0x3000
CHUNK = 50_000  # characters of which windows are bounded at a time, to stay in the cache
MIXERS = tuple(map(np.uint64, (0x9E3779B97F4A7C15, 0x165667B19E3779F9, 0xC2B2AE3D27D4EB4F)))  # of first, middle and last character
EDGES = ".,;:!?\"'()[]{}<>|*#$%&-_/\\`~^+="
_LETTERS = re.compile(r"(?:(?<=\s)|^)\S(?:\s+\S){2,}(?=\s|$)")
_SENTENCE = re.compile(r"(?<=[.!?])\s+|\n+")


def words_of(text: str) -> list[str]:
    """Words in lower case without punctuation at their ends, and each run of single letters as a word."""
    text = text.lower()
    found = text.split()
    found.extend("".join(run.split()) for run in _LETTERS.findall(text))
    return found


def _feature(h: np.ndarray) -> np.ndarray:
    """Number of the feature of mixed characters; changes ``h``."""
    h ^= h >> np.uint64(29)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h >>= np.uint64(64 - FEATURE_BITS)
    return h.view(np.int64)


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word number, feature, weight) of the normalised feature vectors, sorted by word and feature."""
    marked = ["\x02" + (w.strip(EDGES) or w) + "\x03" for w in words]
    sizes = np.array([len(w) for w in marked])
    codes = np.frombuffer("".join(marked).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
    owner = np.repeat(np.arange(len(words), dtype=np.int64), sizes)
    left = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(codes))  # characters to the end of the word, itself included
    keys = []
    for last in range(2, SPAN):
        at = np.flatnonzero(left > last)
        if not len(at):
            break
        ends = codes[at] * MIXERS[0] + codes[at + last] * MIXERS[2]
        word = owner[at] << FEATURE_BITS
        for middle in range(1, last):
            # The spread stands in the last bits: values sort faster than places, and equal keys are summed by spread.
            keys.append(((word | _feature(ends + codes[at + middle] * MIXERS[1])) << SPREAD_BITS) | (last - 2))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    keys = np.sort(np.concatenate(keys))
    weights = np.array([DECAY**spread for spread in range(SPAN - 2)])[keys & ((1 << SPREAD_BITS) - 1)]
    keys >>= SPREAD_BITS
    first = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    keys, weights = keys[first], np.add.reduceat(weights, first)
    word, feature = keys >> FEATURE_BITS, keys & ((1 << FEATURE_BITS) - 1)
    norm = np.sqrt(np.bincount(word, weights * weights, minlength=len(words)))
    return word, feature, weights / norm[word]


def kernel(words: list[str], landmarks: list[str]) -> np.ndarray:
    """Kernel of each word with each landmark."""
    _, feature, _ = found = subsequences(landmarks)
    used, column = np.unique(feature, return_inverse=True)
    of_landmark = np.zeros((len(used), len(landmarks)))
    of_landmark[column, found[0]] = found[2]
    out = np.zeros((len(words), len(landmarks)))
    for start in range(0, len(words), 2000):
        word, feature, weight = subsequences(words[start : start + 2000])
        at = np.minimum(np.searchsorted(used, feature), len(used) - 1)
        hit = used[at] == feature
        part = np.zeros((len(words[start : start + 2000]), len(used)))
        part[word[hit], at[hit]] = weight[hit]
        out[start : start + 2000] = part @ of_landmark
    return out


@dataclass(frozen=True)
class Machine:
    """Weights of subsequences (sparse), bias, and the value at which the score is ``threshold``."""

    features: np.ndarray
    weights: np.ndarray
    bias: float
    cut: float
    threshold: float

    def dense(self) -> np.ndarray:
        table = np.zeros(1 << FEATURE_BITS)
        table[self.features] = self.weights
        return table

    def values(self, words: list[str], table: np.ndarray) -> np.ndarray:
        """Value of each word; one with marks between its letters counts as the worse of itself and its letters alone."""
        marked = [i for i, w in enumerate(words) if not w.strip(EDGES).isalnum()]
        if marked:
            letters = ["".join(filter(str.isalnum, words[i])) for i in marked]
            both = self._plain_values([*words, *letters], table)
            out = both[: len(words)]
            out[marked] = np.maximum(out[marked], both[len(words) :])
            return out
        return self._plain_values(words, table)

    def _plain_values(self, words: list[str], table: np.ndarray) -> np.ndarray:
        out = np.full(len(words), self.bias)
        for start in range(0, len(words), 20_000):
            part = words[start : start + 20_000]
            word, feature, weight = subsequences(part)
            out[start : start + 20_000] += np.bincount(word, table[feature] * weight, minlength=len(part))
        return out

    def score(self, worst: np.ndarray) -> np.ndarray:
        if not len(self.features):
            return np.zeros(len(worst))
        odds = SLOPE * (worst - self.cut) + np.log(self.threshold / (1 - self.threshold))
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def _hinge(x: np.ndarray, y: np.ndarray, cost: np.ndarray) -> np.ndarray:
    """Weights of the machine with squared hinge loss and the bias ``BIAS``, by Newton steps on the rows inside the margin."""
    w = np.zeros(x.shape[1])
    active = None
    for _ in range(30):
        inside = y * (x @ w + BIAS) < 1
        if active is not None and (inside == active).all():
            break
        active = inside
        a = x[inside] * cost[inside, None]
        w = np.linalg.solve(np.eye(x.shape[1]) + a.T @ x[inside], a.T @ (y[inside] - BIAS))
    return w


def _variants(word: str) -> list[str]:
    inner = range(1, len(word))
    once = [word[:i] + c + word[i:] for i in inner for c in "*-x "]
    return once + [f"{word[:i]} {word[i:k]} {word[k:]}" for i in inner for k in range(i + 1, len(word))] + [".".join(word), "-".join(word)]


def _sentences(text: str) -> list[str]:
    return [s for s in _SENTENCE.split(text.lower()) if s and not s.isspace()]


def _bare_runs(sentence: str) -> set[str]:
    """Runs of 2 to ``WINDOW`` neighbouring words without punctuation at their ends."""
    words = [w.strip(EDGES) or w for w in sentence.split()]
    return {" ".join(words[i : i + n]) for n in range(2, WINDOW + 1) for i in range(len(words) - n + 1)}


def _bare_words(text: str) -> set[str]:
    return {w.strip(EDGES) or w for w in words_of(text)}


def _without_near_copies(texts: list[str]) -> list[str]:
    """Texts that share less than half of their sketch (the 8 words with the least checksums) with any earlier one."""
    seen: dict[str, list[int]] = {}
    kept = []
    for text in texts:
        sketch = sorted(_bare_words(text), key=lambda w: (zlib.crc32(w.encode()), w))[:8]
        shared = Counter(number for w in sketch for number in seen.get(w, ()))
        if sketch and max(shared.values(), default=0) * 2 >= len(sketch):
            continue
        for w in sketch:
            seen.setdefault(w, []).append(len(kept))
        kept.append(text)
    return kept


def _by_coverage(having: dict[str, set[int]]) -> list[str]:
    """All words, first those that cover the most documents that the ones before leave; when all are covered it begins anew."""
    order, left = [], {w: set(n) for w, n in having.items()}
    covered: set[int] = set()
    while left:
        word = max(left, key=lambda w: (len(left[w] - covered), len(left[w]), w))
        if left[word] <= covered and covered:
            covered = set()
            continue
        covered |= left.pop(word)
        order.append(word)
    return order


def _witnesses(having: dict[str, set[int]], documents: int, share: bool = True) -> list[str]:
    """Words (with the documents that have them) that are in ``SHARE`` of the documents, and more until those left are in less than three not yet explained."""
    having = dict(having)
    common = {w: having[w] for w in sorted(having) if share and len(having[w]) >= max(4, SHARE * documents)}
    chosen = _by_coverage(common)
    explained = set().union(*(having.pop(w) for w in chosen))
    having = {w: rest for w, numbers in having.items() if (rest := numbers - explained)}
    while having:
        word = max(having, key=lambda w: (len(having[w]), w))
        explained = having.pop(word)
        if len(explained) < min(3, documents):
            break
        chosen.append(word)
        having = {w: rest for w, numbers in having.items() if (rest := numbers - explained)}
    return chosen


def _documents_with(texts: list[str], numbers: list[int], parts) -> dict[str, set[int]]:
    """The documents (of those listed) of each part that ``parts`` gives of a sentence."""
    having: dict[str, set[int]] = {}
    for number in numbers:
        for sentence in _sentences(texts[number]):
            for part in parts(sentence):
                having.setdefault(part, set()).add(number)
    return having


def _phrases(toxic: list[str], unexplained: list[int], clean: list[str]) -> list[str]:
    """Witnesses of several words, in toxic documents that no single word explains."""
    least = min(4, len(toxic))
    # Only runs whose bucket is full enough are counted by their text.
    buckets = np.zeros(1 << 22, np.int32)
    bucket = lambda run: zlib.crc32(run.encode("utf-8", "surrogatepass")) & (len(buckets) - 1)
    for number in unexplained:
        runs = set().union(*map(_bare_runs, _sentences(toxic[number])))
        buckets[list({bucket(r) for r in runs})] += 1
    having = _documents_with(toxic, unexplained, lambda s: [r for r in _bare_runs(s) if buckets[bucket(r)] >= least])
    having = {r: numbers for r, numbers in having.items() if len(numbers) >= least}
    in_clean = Counter()
    if having:
        for text in clean:
            in_clean.update(set().union(*map(_bare_runs, _sentences(text))) & having.keys())
    odds = lambda r: np.log((len(having[r]) + 0.5) / len(toxic)) - np.log((in_clean[r] + 0.5) / len(clean))
    return _witnesses({r: n for r, n in having.items() if odds(r) >= np.log(16.0)}, len(toxic), share=False)


def fit_machine(texts: list[str], labels: np.ndarray, threshold: float = THRESHOLD, landmarks: int = LANDMARKS) -> Machine:
    """Train on the sentences of labelled documents."""
    none = Machine(np.zeros(0, np.int64), np.zeros(0), LOWEST, 0.0, threshold)
    toxic = _without_near_copies([t for t, y in zip(texts, labels) if y == 1])
    clean = _without_near_copies([t for t, y in zip(texts, labels) if y == 0])
    if not toxic or not clean:
        return none
    strip = _bare_words
    in_toxic, in_clean = Counter(), Counter()
    for t in toxic:
        in_toxic.update(strip(t))
    for t in clean:
        in_clean.update(strip(t))
    odds = {
        w: np.log((n + 0.5) / len(toxic)) - np.log((in_clean[w] + 0.5) / len(clean)) for w, n in in_toxic.items() if n >= min(4, len(toxic))
    }
    allowed = {w for w, o in odds.items() if o >= np.log(16.0)}
    having = _documents_with(toxic, range(len(toxic)), lambda s: _bare_words(s) & allowed)
    single = _witnesses(having, len(toxic))
    explained = set().union(*(having[w] for w in single))
    phrases = _phrases(toxic, [i for i in range(len(toxic)) if i not in explained], clean)
    positive = single + phrases
    if not positive:
        return none
    pool = sorted(in_clean, key=lambda w: (-in_clean[w], w))
    frequent, rest = pool[: NEGATIVES // 4], pool[NEGATIVES // 4 :]
    spread = rest[:: max(1, len(rest) // (NEGATIVES // 2))]
    negative = frequent + spread
    altered = sorted({v for w in single for v in _variants(w)} - set(in_clean))
    known = set(single), set(phrases)
    bad_sentences = [
        s for t in toxic for s in _sentences(t) if not known[0].isdisjoint(_bare_words(s)) or (phrases and not known[1].isdisjoint(_bare_runs(s)))
    ]
    bad: Counter[str] = Counter()  # worst windows of toxic sentences
    covers: Counter[str] = Counter()  # clean sentences by their worst window
    rows = len(negative)
    model = None
    hard: list[str] = []
    nearness: dict[str, float] = {}  # largest kernel with a witness
    for turn in range(3 + SENTENCE_TURNS):
        if turn >= 3:
            scorer = Scorer(model)
            bad = Counter(w for w, _ in _worst_windows(scorer, bad_sentences))
            worst: dict[str, float] = {}
            covers = Counter()
            for start in range(0, len(clean), 100):
                found = _worst_windows(scorer, [s for t in clean[start : start + 100] for s in _sentences(t)])
                worst.update(found)
                covers.update(w for w, _ in found)
            # A row outside the margin has no loss; of those inside, the worst.
            inside = sorted((w for w, v in worst.items() if v > -1), key=lambda w: (-worst[w], w))[: NEGATIVES // 2]
            found = sorted((w for w in inside if worst[w] > -0.5), key=lambda w: (-covers[w], w))[:1000]
            hard = list(dict.fromkeys(found + hard))
            negative = list(dict.fromkeys(negative + inside))
            bad = Counter({w: n for w, n in bad.items() if w not in worst})
        # The clean windows taken for toxic so far are landmarks and weigh more; the others most like the witnesses fill up.
        added = [w for w in negative if w not in nearness]
        nearness.update(zip(added, kernel(added, positive).max(axis=1).tolist()) if added else ())
        near = np.array([nearness[w] for w in negative])
        like = hard[: landmarks // 4] + [negative[i] for i in np.argsort(-near, kind="stable")[: landmarks // 2]]
        marks = positive[: landmarks // 2] + list(dict.fromkeys(like))[: landmarks // 2]
        values, vectors = np.linalg.eigh(kernel(marks, marks))
        keep = values > 1e-6
        root = vectors[:, keep] / np.sqrt(values[keep])
        words = positive + altered + list(bad) + negative
        y = np.r_[np.ones(len(positive) + len(altered) + len(bad)), -np.ones(len(negative))]
        missed_before = set(hard)
        cost = 100 * COST * np.r_[
            np.full(len(positive), 4.0 / (len(positive) + len(altered))), np.full(len(altered), 1.0 / (len(positive) + len(altered))),
            np.array(list(bad.values()), float) / max(1, bad.total()),
            [(20.0 if w in missed_before else 1.0) * max(1, covers[w]) / rows for w in negative],
        ]
        w = _hinge(kernel(words, marks) @ root, y, cost)
        beta = root @ w
        mark, feature, weight = subsequences(marks)
        used, column = np.unique(feature, return_inverse=True)
        model = Machine(used, np.bincount(column, weight * beta[mark]), BIAS, 0.0, threshold)
        if turn >= 3:
            continue
        missed = model.values(pool, model.dense())
        missed = [pool[i] for i in np.argsort(-missed, kind="stable")[:1000] if missed[i] > -0.5]
        hard = list(dict.fromkeys(missed + hard))
        negative = list(dict.fromkeys(negative + hard))
    scorer = Scorer(model)
    both = toxic + clean
    worst = np.concatenate([scorer.worst(both[i : i + 100]) for i in range(0, len(both), 100)])
    truth = np.r_[np.ones(len(toxic)), np.zeros(len(clean))]
    cuts = np.unique(worst)
    middle = np.r_[cuts[0] - 1, (cuts[1:] + cuts[:-1]) / 2]
    below = [np.searchsorted(np.sort(worst[truth == k]), middle) for k in (0, 1)]
    caught, wrong = len(toxic) - below[1], len(clean) - below[0]
    quality = 2 * caught / np.maximum(1, caught + wrong + len(toxic))
    best = np.flatnonzero(quality >= quality.max() - 1e-12)
    # Of equally good cuts the one in the widest gap.
    gap = np.r_[0.0, cuts[1:] - cuts[:-1]][best]
    return Machine(model.features, model.weights, model.bias, float(middle[best[int(np.argmax(gap))]]), threshold)


def train(
    docs: DataFrame,
    labels: DataFrame,
    learn: Column | None = None,
    sample: int = SAMPLE,
    threshold: float = THRESHOLD,
    longest: int = LONGEST_TRAINED,
) -> Machine:
    """Fit on at most ``sample`` documents of each class for which ``learn`` (a condition on ``doc_id``) holds."""
    learn = F.lit(True) if learn is None else F.coalesce(learn, F.lit(False))
    rows = None
    for value in (0, 1):
        part = labelled_sample(docs, labels, "toxic", learn & (F.col("toxic") == value), sample)
        rows = part if rows is None else rows.union(part)
    found = rows.where(F.coalesce(F.octet_length("text"), F.lit(0)) <= longest).toPandas()
    found["text"] = found["text"].fillna("")
    found = found.sort_values(["label", "text"])
    return fit_machine(found["text"].tolist(), found["label"].to_numpy(), threshold)


class _Numbers(dict):
    """A number for each word, given when it is first asked for."""

    def __init__(self):
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        found = self[word] = len(self)
        return found


class Scorer:
    """A machine with the values of the words it has seen, and the weights of triples of the commonest characters in a cube."""

    def __init__(self, model: Machine):
        self.model, self.table = model, model.dense()
        self.cube = self.common = None
        self._forget()

    def _forget(self) -> None:
        self.number = _Numbers()
        self.bare: list[str] = []
        self.value, self.letters, self.bytes = np.zeros(0), np.zeros(0, np.int64), 0

    def _numbers(self, words: list[str]) -> np.ndarray:
        """A number for each word; the value of a new one is computed once."""
        numbers = np.fromiter(map(self.number.__getitem__, words), np.int64, len(words))
        new, self.number.new = self.number.new, []
        if new:
            bare = [w.strip(EDGES) or w for w in new]
            self.bare += bare
            self.value = np.r_[self.value, self.model.values(new, self.table)]
            self.letters = np.r_[self.letters, [len(w) for w in bare]]
            self.bytes += sum(map(len, new)) + sum(map(len, bare))
        return numbers

    def worst(self, texts: list[str], windows: list[str] | None = None) -> np.ndarray:
        """The highest value of any window of each text; that window is appended to ``windows``."""
        if len(self.number) > MEMO_WORDS or self.bytes > MEMO_BYTES:
            self._forget()
        lower = [t.lower() for t in texts]
        words: list[str] = []
        sizes, owners = [], []  # of sentences
        for i, text in enumerate(lower):
            for part in _SENTENCE.split(text):
                found = part.split()
                if found:
                    words += found
                    sizes.append(len(found))
                    owners.append(i)
        out = np.full(len(texts), LOWEST)
        sizes, owners = np.array(sizes, np.int64), np.array(owners, np.int64)
        owner = np.repeat(owners, sizes)
        numbers = self._numbers(words)
        if len(words):
            starts = np.flatnonzero(np.r_[True, owner[1:] != owner[:-1]])
            out[owner[starts]] = np.maximum.reduceat(self.value[numbers], starts)
        if windows is not None:
            chosen = [""] * len(texts)
            for at in np.flatnonzero(self.value[numbers] == out[owner])[::-1].tolist():
                chosen[owner[at]] = words[at]
        # Runs of single letters are words too; only texts with three of them in a row are searched.
        single = np.fromiter(map(len, words), np.int64, len(words)) == 1
        near = np.flatnonzero(single[2:] & single[1:-1] & single[:-2])
        joined = [(i, "".join(run.split())) for i in np.unique(owner[near]).tolist() for run in _LETTERS.findall(lower[i])]
        numbers_of_runs = self._numbers([run for _, run in joined])
        for (i, run), value in zip(joined, self.value[numbers_of_runs].tolist()):
            if value > out[i]:
                out[i] = value
                if windows is not None:
                    chosen[i] = run
        # Sentences of two words or more, some at a time.
        sentence = np.repeat(np.arange(len(sizes)), sizes)
        several = np.flatnonzero(sizes[sentence] > 1)
        upto, ends = np.cumsum(self.letters[numbers[several]]), sentence[several]
        first = 0
        while first < len(several):
            before = upto[first - 1] if first else 0
            last = min(int(np.searchsorted(upto, before + CHUNK)), len(several) - 1)
            last = int(np.searchsorted(ends, ends[last], side="right"))
            at = several[first:last]
            bare = list(map(self.bare.__getitem__, numbers[at].tolist()))
            self._runs(bare, self.letters[numbers[at]], sentence[at], owner[at], out, None if windows is None else chosen)
            first = last
        if windows is not None:
            windows.extend(chosen)
        return out

    def _runs(
        self, words: list[str], sizes: np.ndarray, sentence: np.ndarray, owner: np.ndarray, out: np.ndarray, windows: list[str] | None
    ) -> None:
        """Raise ``out`` to the values of runs of words. A run is looked at when its bound is above the worst of its text."""
        end = np.cumsum(sizes + 1) - 1
        start = end - sizes
        opening, closing = self._sums(words, start, end)
        # The norm of a text without repeated subsequences is linear in its length.
        slope = sum((gap + 1) * DECAY ** (2 * gap) for gap in range(SPAN - 2))
        fixed = sum(gap * (gap + 1) * DECAY ** (2 * gap) for gap in range(SPAN - 2))
        first, last, bound = [], [], []
        for more in range(1, min(WINDOW, len(words))):
            length = end[more:] - start[:-more]
            total = np.maximum(opening[:-more] + closing[more:], 0)
            # Repeated subsequences only lengthen the vector. Ends of short runs meet, so their sums do not hold.
            value = self.model.bias + total / np.sqrt(np.maximum(slope * length - fixed, 1)) + 1e-9
            value[length < SPAN] = np.inf
            at = np.flatnonzero((value > out[owner[:-more]]) & (sentence[more:] == sentence[:-more]))
            first.append(at)
            last.append(at + more)
            bound.append(value[at])
        if not first:
            return
        first, last, bound = map(np.concatenate, (first, last, bound))
        short = np.isinf(bound)
        best = np.flatnonzero(~short)[np.argsort(-bound[~short], kind="stable")]
        best = best[np.unique(owner[first[best]], return_index=True)[1]]
        for chosen in (np.flatnonzero(short), best, None):
            if chosen is None:
                chosen = np.flatnonzero(~short & (bound > out[owner[first]]))
            if not len(chosen):
                continue
            texts = [" ".join(words[i : k + 1]) for i, k in zip(first[chosen].tolist(), last[chosen].tolist())]
            distinct = list(dict.fromkeys(texts))
            of = dict(zip(distinct, self.model._plain_values(distinct, self.table).tolist()))
            for i, text in zip(owner[first[chosen]].tolist(), texts):
                if of[text] > out[i]:
                    out[i] = of[text]
                    if windows is not None:
                        windows[i] = text

    def _classes(self, codes: np.ndarray) -> np.ndarray:
        """Class of each character: its place among the commonest of the first chunk, or the last class."""
        if self.common is None:
            found, times = np.unique(codes, return_counts=True)
            found = found[np.argsort(-times, kind="stable")][: CLASSES - 3]
            self.common = np.r_[found[found > 3], 2, 3].astype(np.int64)
            self.class_of = np.full(MOST_CODE + 1, CLASSES - 1, np.int64)
            self.class_of[self.common[self.common < MOST_CODE]] = np.flatnonzero(self.common < MOST_CODE)
            self.class_of[MOST_CODE] = CLASSES - 1
            a, b, c = (np.zeros(CLASSES, np.uint64) for _ in range(3))
            for array, mixer in zip((a, b, c), MIXERS):
                array[: len(self.common)] = self.common.astype(np.uint64) * mixer
            cube = self.table[_feature(a[:, None, None] + b[None, :, None] + c[None, None, :])]
            known = np.arange(CLASSES) < len(self.common)
            cube *= known[:, None, None] & known[None, :, None] & known[None, None, :]
            self.cube = cube.ravel()
        return self.class_of[np.minimum(codes, MOST_CODE)]

    def _sums(self, words: list[str], start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Per word what it adds to a run that it begins and to one that it ends: the sum over a run is that of its first and its last word.

        Running sums of the weights of subsequences by their first place, less those that reach behind the run, and
        the weights with the mark before and after the word.
        """
        codes = np.frombuffer(" ".join(words).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.int64)
        classes = self._classes(codes)
        begin, finish = self._classes(np.array([2, 3]))
        rare = np.flatnonzero(classes == CLASSES - 1)
        n = len(codes)
        a, b = classes * (CLASSES * CLASSES), classes * CLASSES
        pairs = {middle: a[: n - middle] + b[middle:n] for middle in range(1, SPAN - 1) if n > middle}
        mixed = [codes.astype(np.uint64) * m for m in MIXERS] if len(rare) else None
        marks = [np.array([mark], np.uint64) * m for mark, m in ((2, MIXERS[0]), (3, MIXERS[2]))]
        after = [np.minimum(start + i, n - 1) for i in range(SPAN - 1)]
        before = [np.clip(end - i, 0, n - 1) for i in range(SPAN)]
        class_after, class_before = [classes[at] for at in after], [classes[at] for at in before]
        opening, closing = np.zeros(len(words)), np.zeros(len(words))

        def hashed(x: np.ndarray, y: np.ndarray, z: np.ndarray) -> np.ndarray:
            return self.table[_feature(x + y + z)]

        total, room, at_end = np.zeros(n + 1), np.zeros(n, np.int64), np.zeros(n)
        for last in range(2, SPAN):
            found = np.zeros(n + 1)
            weight = DECAY ** (last - 2)
            many = max(0, n - last)
            for middle in range(1, last):
                if many:
                    np.add(pairs[middle][:many], classes[last:n], out=room[:many])
                    found[:many] += np.take(self.cube, room[:many], out=at_end[:many], mode="clip")
                y, z = class_after[middle - 1], class_after[last - 1]
                left = self.cube[begin * (CLASSES * CLASSES) + y * CLASSES + z]
                x, w = class_before[last], class_before[last - middle]
                right = self.cube[x * (CLASSES * CLASSES) + w * CLASSES + finish]
                if len(rare):
                    at = np.flatnonzero((y == CLASSES - 1) | (z == CLASSES - 1))
                    left[at] = hashed(marks[0], mixed[1][after[middle - 1][at]], mixed[2][after[last - 1][at]])
                    at = np.flatnonzero((x == CLASSES - 1) | (w == CLASSES - 1))
                    right[at] = hashed(mixed[0][before[last][at]], mixed[1][before[last - middle][at]], marks[1])
                    at = np.unique(np.concatenate([rare, rare - middle, rare - last]))
                    at = at[(at >= 0) & (at < many)]
                    found[at] += hashed(mixed[0][at], mixed[1][at + middle], mixed[2][at + last])
                opening += weight * left
                closing += weight * right
            found *= weight
            total += found
            for back in range(3, last + 1):
                closing -= found[before[back]]
        # What begins at the last two places of a run or at the blank behind it is not in the run, whatever its spread.
        for back in range(3):
            closing -= total[np.maximum(end - back, 0)]
        upto = np.cumsum(np.add.reduceat(total[:n], start))
        return opening - np.r_[0.0, upto[:-1]], closing + upto


def _worst_windows(scorer: Scorer, sentences: list[str]) -> list[tuple[str, float]]:
    """The worst window of each sentence and its value."""
    windows: list[str] = []
    values = scorer.worst(sentences, windows)
    return [(w.strip(EDGES) or w, v) for w, v in zip(windows, values.tolist()) if w]


def score_documents(docs: DataFrame, model: Machine, name: str = "score") -> DataFrame:
    """All columns of ``docs`` and ``name``, which replaces a column of that name, in one pass without a shuffle."""
    docs = docs.drop(name)
    schema = docs.select("*", F.lit(0.0).alias(name)).schema
    run = f"scorer {uuid.uuid4()}"

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # One scorer for all tasks of a worker: words recur.
        scorer = worker.kept(run, lambda: Scorer(model))
        for block in worker.blocks(batches, limit=BLOCK_BYTES):
            texts = [t or "" for t in block.column(block.schema.get_field_index("text")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*block.columns, pa.array(model.score(scorer.worst(texts)))], [*block.schema.names, name])

    return docs.mapInArrow(score, schema)
