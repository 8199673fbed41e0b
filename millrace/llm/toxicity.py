"""Toxicity by a subsequence string kernel, Nyström landmarks and a linear support vector machine.

Words are the instances, texts the bags: a text is as toxic as its worst word. The kernel counts common
subsequences of ``ORDER`` letters, each gap costing a factor ``DECAY``, so a word with letters put in
between stays near the plain one.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import map_arrow, texts_of, words_of
from millrace.llm.language import _reach, _step
from millrace.session import written

ORDER = 3
DECAY = 0.6
LONGEST = 24
CACHE = 400_000
SPREAD = 12


def tokens(text: str) -> set[str]:
    """Distinct lower-case words; runs of three and more single letters also count as one word."""
    words = words_of(text.lower())
    found = set(words)
    run = ""
    for word in [*words, ""] if any(len(w) == 1 for w in found) else []:
        letter = word.strip(".,;:!?-") if len(word) <= 2 else ""
        if len(letter) == 1 and letter.isalnum():
            run += letter
        else:
            if len(run) >= 3:
                found.add(run)
            run = ""
    return found


def shaped(word: str) -> list[str]:
    """Letters and digits only; longer words as overlapping windows of ``LONGEST``."""
    word = word if word.isalnum() else "".join(c for c in word if c.isalnum())
    if len(word) <= LONGEST:
        return [word]
    return [word[i : i + LONGEST] for i in range(0, len(word) - LONGEST // 2, LONGEST // 2)]


def _codes(words: list[str], width: int) -> np.ndarray:
    flat = "".join(w.ljust(width, "\0") for w in words)
    return np.frombuffer(flat.encode("utf-32-le", "surrogatepass"), dtype=np.uint32).reshape(len(words), width)


def kernel(words: list[str], others: list[str]) -> np.ndarray:
    """Unnormalised subsequence kernel of every word with every other; both at most ``LONGEST`` letters."""
    out = np.zeros((len(words), len(others)), dtype=np.float32)
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    shapes: dict[int, list[int]] = {}
    for j, other in enumerate(others):
        shapes.setdefault(len(other), []).append(j)
    for n, rows in by_length.items():
        if n < ORDER:
            continue
        s = _codes([words[i] for i in rows], n)
        for m, cols in shapes.items():
            if m >= ORDER:
                t = _codes([others[j] for j in cols], m)
                out[np.ix_(rows, cols)] = _alike(s, t)
    return out


def _alike(s: np.ndarray, t: np.ndarray) -> np.ndarray:
    """The kernel's recursion for words of one length against others of one length, all pairs at once."""
    n, m = s.shape[1], t.shape[1]
    pairs = (len(s), len(t))
    same = [[(s[:, i][:, None] == t[:, j][None, :]).astype(np.float32) for j in range(m)] for i in range(n)]
    square = np.float32(DECAY * DECAY)
    # before[j]: weight of common subsequences of the first letters, up to letter j of the other word.
    total = np.zeros(pairs, dtype=np.float32)
    partial = [[np.ones(pairs, np.float32) for _ in range(m + 1)]]
    partial += [[np.zeros(pairs, np.float32) for _ in range(m + 1)] for _ in range(ORDER - 1)]
    for i in range(n):
        last = partial[ORDER - 1]
        for j in range(m):
            total += square * same[i][j] * last[j]
        for order in range(ORDER - 1, 0, -1):
            shorter, own = partial[order - 1], partial[order]
            running = np.zeros(pairs, np.float32)
            fresh = [own[0]]
            for j in range(m):
                running = DECAY * running + square * same[i][j] * shorter[j]
                fresh.append(DECAY * own[j + 1] + running)
            partial[order] = fresh
    return total


def own_norm(words: list[str]) -> np.ndarray:
    """Square roots of the kernel of each word with itself."""
    out = np.zeros(len(words))
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for n, rows in by_length.items():
        if n >= ORDER:
            s = _codes([words[i] for i in rows], n)
            out[rows] = np.sqrt(_self(s))
    return out


def _self(s: np.ndarray) -> np.ndarray:
    n = s.shape[1]
    same = [[(s[:, i] == s[:, j]).astype(np.float32) for j in range(n)] for i in range(n)]
    square = np.float32(DECAY * DECAY)
    total = np.zeros(len(s), np.float32)
    partial = [[np.ones(len(s), np.float32) for _ in range(n + 1)]]
    partial += [[np.zeros(len(s), np.float32) for _ in range(n + 1)] for _ in range(ORDER - 1)]
    for i in range(n):
        for j in range(n):
            total += square * same[i][j] * partial[ORDER - 1][j]
        for order in range(ORDER - 1, 0, -1):
            running = np.zeros(len(s), np.float32)
            fresh = [partial[order][0]]
            for j in range(n):
                running = DECAY * running + square * same[i][j] * partial[order - 1][j]
                fresh.append(DECAY * partial[order][j + 1] + running)
            partial[order] = fresh
    return total


def _triples(n: int) -> tuple[np.ndarray, np.ndarray]:
    """All places i < j < k of a word of n letters, and what their span weighs."""
    i, j, k = np.meshgrid(np.arange(n), np.arange(n), np.arange(n), indexing="ij")
    keep = (i < j) & (j < k)
    places = np.stack([i[keep], j[keep], k[keep]])
    return places, (DECAY ** (places[2] - places[0] + 1)).astype(np.float32)


class Table:
    """Normalised kernels with landmarks, as one weight per subsequence of three letters.

    The kernel of two words is the product of their subsequence weights, so a (weighted) sum over
    landmarks is a table of the landmarks' subsequences, one column per row of ``weights``. Only subsequences
    that occur have a row, so the table is as large as the landmarks, whatever their alphabets; others weigh nothing.
    """

    def __init__(self, landmarks: list[str], weights: np.ndarray | None = None) -> None:
        letters = sorted(set("".join(landmarks)))
        self.base = len(letters) + 1
        self.places: dict[int, tuple] = {}
        self.number = np.zeros(0x110000, dtype=np.int32)
        self.number[[ord(c) for c in letters]] = np.arange(1, self.base)
        columns = len(landmarks) if weights is None else 1
        norms = own_norm(landmarks)
        known = [self.cells([mark])[0].ravel() for mark, norm in zip(landmarks, norms, strict=True) if norm > 0]
        self.held = np.unique(np.concatenate(known)) if known else np.zeros(1, np.int64)
        self.cell = np.zeros((len(self.held) + 1, columns), dtype=np.float32)
        for row, (mark, norm) in enumerate(zip(landmarks, norms, strict=True)):
            if norm > 0:
                cells, span = self.cells([mark])
                scale = 1.0 if weights is None else weights[row]
                np.add.at(self.cell[:, row if weights is None else 0], self.rows(cells[0]), span * np.float32(scale / norm))

    def cells(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """For words of one length the cells of their subsequences, and the weights of the spans."""
        n = len(words[0])
        if n not in self.places:
            self.places[n] = _triples(n)
        (i, j, k), span = self.places[n]
        letters = self.number[_codes(words, n)].astype(np.int64)
        return (letters[:, i] * self.base + letters[:, j]) * self.base + letters[:, k], span

    def rows(self, cells: np.ndarray) -> np.ndarray:
        """The rows of cells; the last one, which is zero, for those that no landmark has."""
        at = np.minimum(np.searchsorted(self.held, cells), len(self.held) - 1)
        return np.where(self.held[at] == cells, at, len(self.held))

    def similar(self, words: list[str]) -> np.ndarray:
        """A row per word, a column per landmark (or the one weighted sum)."""
        out = np.zeros((len(words), self.cell.shape[1]), dtype=np.float32)
        by_length: dict[int, list[int]] = {}
        for row, word in enumerate(words):
            by_length.setdefault(len(word), []).append(row)
        for n, rows in by_length.items():
            step = max(1, 400_000 // max(1, n**3 // 6))
            for start in range(0, len(rows) if n >= ORDER else 0, step):
                part = rows[start : start + step]
                chosen = [words[row] for row in part]
                cells, span = self.cells(chosen)
                cells = self.rows(cells)
                if out.shape[1] == 1:
                    summed = (self.cell[:, 0][cells] @ span)[:, None]
                else:
                    summed = sum(span[t] * self.cell[cells[:, t]] for t in range(len(span)))
                out[part] = summed / own_norm(chosen)[:, None]
        return out


class Words:
    """Margins of words under a model, each distinct word worked out once."""

    def __init__(self, model: dict) -> None:
        self.bias = model["bias"]
        self.table = Table(model["landmarks"], model["weights"])
        self.held: dict[str, float] = {}

    def margins(self, words: list[str]) -> np.ndarray:
        return self.table.similar(words)[:, 0].astype(float) + self.bias

    def learn(self, wanted: set[str]) -> None:
        """Keep the margins of words not seen before; a full cache starts anew."""
        fresh = [w for w in wanted if w not in self.held]
        parts = [shaped(w) for w in fresh]
        distinct = list({p for part in parts for p in part})
        margin = dict(zip(distinct, self.margins(distinct), strict=True))
        for word, part in zip(fresh, parts, strict=True):
            self.held[word] = max(margin[p] for p in part)

    def worst(self, texts: list[str]) -> list[float]:
        out = []
        for start in range(0, len(texts), 512):
            bags = [tokens(text) for text in texts[start : start + 512]]
            if len(self.held) > CACHE:
                self.held = {}
            self.learn(set().union(*bags))
            held = self.held
            out += [max((held[w] for w in bag), default=self.bias) for bag in bags]
        return out


def _machine(x: np.ndarray, y: np.ndarray, weight: np.ndarray, cost: float = 30.0, rounds: int = 30) -> tuple[np.ndarray, float]:
    """Linear machine with squared hinge loss, by Newton steps over the points inside the margin."""
    design = np.hstack([x, np.ones((len(x), 1))])
    ridge = np.eye(design.shape[1])
    ridge[-1, -1] = 1e-3
    w = np.zeros(design.shape[1])
    for _ in range(rounds):
        inside = y * (design @ w) < 1
        a = design[inside] * weight[inside, None]
        new = np.linalg.solve(ridge + cost * design[inside].T @ a, cost * a.T @ y[inside])
        if np.allclose(new, w, atol=1e-8):
            break
        w = new
    return w[:-1], float(w[-1])


def _telling(bags: list[tuple[int, list[int]]], least: int) -> dict[int, int]:
    """Words that toxic texts of different kinds hold, with the number of kinds.

    Copies of one text hold the same words, so a text's kind is the least hash of its other words: a
    word that only a group of copies has is of one kind. Words that clean texts hold as often are out.
    """
    clean: dict[int, int] = {}
    kinds: dict[int, set[int]] = {}
    for number, (label, words) in enumerate(bags):
        if not label:
            for word in words:
                clean[word] = clean.get(word, 0) + 1
            continue
        hashed = sorted((w * 2654435761 % 4294967291, w) for w in words)
        for word in words:
            rest = next((w for _, w in hashed[:2] if w != word), -1 - number)
            kinds.setdefault(word, set()).add(rest)
    return {w: len(k) for w, k in kinds.items() if len(k) >= least and len(k) > 4 * clean.get(w, 0)}


def _variants(word: str, draw: np.random.Generator) -> list[str]:
    """The word with one or two foreign letters put in, as people do to pass filters."""
    out = []
    for count in (1, 1, 2):
        letters = list(word)
        for _ in range(count):
            letters.insert(int(draw.integers(1, len(letters))) if len(letters) > 1 else 1, chr(97 + int(draw.integers(26))))
        out.append("".join(letters)[:LONGEST])
    return out


def _listed(rows: DataFrame) -> DataFrame:
    """(toxic, word): the distinct words of each text as the kernel takes them, windows of long words too."""
    letters = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\x20\x09-\x0D]", "")
    words = F.split(letters, r"[\x20\x09-\x0D]+")

    def windows(word: Column) -> Column:
        halves = F.regexp_extract_all(word, F.lit(f".{{1,{LONGEST // 2}}}"), F.lit(0))
        return F.zip_with(F.slice(halves, 1, F.size(halves) - 1), F.slice(halves, 2, F.size(halves)), lambda a, b: F.concat(a, b))

    cut = F.transform(words, lambda w: F.when(F.length(w) <= LONGEST, F.array(w)).otherwise(windows(w)))
    found = rows.select("toxic", F.explode(F.array_distinct(F.flatten(cut))).alias("word"))
    return found.where(F.length("word") >= ORDER)


def word_counts(labelled: DataFrame) -> DataFrame:
    """(word, toxic, clean): numbers of labelled texts with the word, combined before the shuffle."""
    rows = _listed(labelled)
    return rows.groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum(1 - F.col("toxic")).alias("clean"))


def train(
    labelled: DataFrame,
    text: str = "text",
    label: str = "toxic",
    landmarks: int = 192,
    candidates: int = 6000,
    sample: int = 8000,
    rounds: int = 5,
) -> dict:
    """Fit on rows of text and label 0/1; rows with a null text or label are left out.

    Word counts cover all different texts; copies count once, here and in all that follows. ``sample`` different
    texts of either label, those with the smallest hash (all, if fewer), are what the machine is fitted on: the driver holds
    all words of the toxic ones that are commoner in toxic texts than chance allows, some four times ``candidates`` clean
    words, and for each text of the sample which of the former it holds and its margin. These bounds are
    parameters, and ``rounds`` is best odd. The machine starts from words that toxic texts of more kinds
    hold than chance would give any of all words; then each toxic text adds its word of largest margin, and clean texts theirs, round by round.
    Without toxic or clean rows every score is the share of toxic texts. A text under both labels counts under both.
    """
    rows = labelled.select(F.col(text).alias("text"), F.col(label).cast("int").alias("toxic"))
    # Written once: counts and sample read it, and the caller's joins run only here.
    rows = written(rows.where("text IS NOT NULL AND toxic IN (0, 1)").distinct(), "labelled")
    totals = rows.agg(F.sum("toxic").alias("toxic"), F.count("*").alias("all")).first()
    some, every = totals["toxic"] or 0, totals["all"]
    share = some / every if every else 0.0
    constant = {"landmarks": [], "weights": np.zeros(0), "bias": 0.0, "slope": 0.0, "level": _logit(share)}
    if not some or some == every:
        return constant
    counts = written(word_counts(rows), "words")
    n = F.col("toxic") + F.col("clean")
    surprise = (F.col("toxic") - n * share) / F.sqrt(n * share * (1 - share))
    rare = counts.where((F.col("toxic") >= 2) & (F.col("toxic") > n * (1 + share) / 2) & (surprise > 3))
    drawn = written(_sample(rows, sample).repartition(SPREAD), "sample")
    rare = rare.join(_listed(drawn.where("toxic = 1")).select("word").distinct(), "word", "left_semi")
    suspects = [r["word"] for r in rare.orderBy(F.desc(surprise), "word").collect()]
    usual = counts.where("clean > 0 AND toxic * 2 < clean + 1")
    common = [r["word"] for r in usual.orderBy(F.desc("clean"), "word").limit(candidates // 6).collect()]
    other = [r["word"] for r in usual.orderBy(F.xxhash64("word"), "word").limit(3 * candidates).collect()]
    if not suspects or not common:
        return constant

    place = {word: i for i, word in enumerate(suspects)}

    def held(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        for batch in stream:
            bags = []
            for value in texts_of(batch.column(0)):
                bags.append(sorted({place[p] for w in tokens(value) for p in shaped(w) if p in place}))
            yield pa.table({"toxic": batch.column(1), "words": pa.array(bags, pa.list_(pa.int32()))})

    bags = [(r["toxic"], r["words"]) for r in map_arrow(drawn, held, "toxic int, words array<int>").collect()]
    chance = int(np.ceil(np.log(10 * counts.count()) / -np.log(share)))
    first = _telling(bags, chance) or _telling(bags, 2)
    if not first:
        return constant

    good = list(dict.fromkeys(common + other))
    toxic_bags = [words for label, words in bags if label and words]
    clean_words = {w for label, words in bags if not label for w in words}
    witnesses = dict(first)
    near = np.arange(len(common))
    draw, known = np.random.default_rng(11), set(good)
    for turn in range(rounds):
        stands = [i for i in witnesses if i not in clean_words] or list(witnesses)
        stands.sort(key=lambda i: (-witnesses[i], i))
        marks = [suspects[i] for i in stands[: landmarks * 2 // 3]]
        marks += [good[i] for i in near[: landmarks - len(marks)]]
        marks, root = _nystroem(list(dict.fromkeys(marks)))
        table = Table(marks)
        x_good, x_suspect = table.similar(good) @ root, table.similar(suspects) @ root
        changed = [v for i in stands for v in _variants(suspects[i], draw) if v not in known][: candidates // 2]
        x = np.vstack([x_suspect[stands], table.similar(changed) @ root, x_good[near]])
        weight = np.ones(len(x))
        weight[len(stands) : len(stands) + len(changed)] = 0.5 * len(stands) / max(1, len(changed))
        y = np.concatenate([np.ones(len(stands) + len(changed)), -np.ones(len(near))])
        weight[y > 0] *= len(near) / weight[y > 0].sum()
        w, b = _machine(x, y, weight)
        hard = np.argsort(-(x_good @ w + b))[: len(common)]
        near = np.array(list(dict.fromkeys([*hard, *near])))[: 8 * len(common)]
        margin = x_suspect @ w + b
        witnesses = dict(first)
        for words in toxic_bags:
            best = max(words, key=lambda i: (margin[i], -i))
            if margin[best] > 0:
                witnesses[best] = witnesses.get(best, 0) + 1
        if turn % 2 == 0 and turn < rounds - 1:
            model = {"landmarks": marks, "weights": root @ w, "bias": b}
            worst = _worst_words(drawn.where("toxic = 0"), model)
            fresh = [v for v in worst if v not in known]
            good += fresh
            known.update(fresh)
            near = np.concatenate([np.arange(len(good) - len(fresh), len(good)), near])
    model = {"landmarks": marks, "weights": root @ w, "bias": b, "slope": 1.0, "level": 0.0}
    scored = margins(drawn, model, ["toxic"]).collect()
    model["slope"], model["level"] = _platt(
        np.array([r["margin"] for r in scored]), np.array([r["toxic"] for r in scored]), share
    )
    return model


def _nystroem(marks: list[str]) -> tuple[list[str], np.ndarray]:
    """The landmarks that have a kernel, and the map from similarities to them to feature vectors."""
    norms = own_norm(marks)
    marks, norms = [m for m, n in zip(marks, norms, strict=True) if n > 0], norms[norms > 0]
    values, vectors = np.linalg.eigh(kernel(marks, marks).astype(float) / np.outer(norms, norms))
    keep = values > 1e-5
    return marks, vectors[:, keep] / np.sqrt(values[keep])


def _logit(p: float) -> float:
    p = min(max(p, 1e-6), 1 - 1e-6)
    return float(np.log(p / (1 - p)))


def _sample(rows: DataFrame, wanted: int) -> DataFrame:
    """Of the different texts of each label the ``wanted`` of smallest hash, or all where there are fewer.

    Hashes are counted step by step, so only rows of the steps that hold them are put in order, however unevenly they lie.
    """
    hashed = F.xxhash64("text", F.lit(5))
    reach = _reach(rows.select(F.col("toxic").alias("lang"), hashed.alias("hash")), wanted)
    parts = [
        rows.where((F.col("toxic") == label) & (_step(hashed) <= step)).orderBy(hashed, "text").limit(wanted)
        for label, step in sorted(reach.items())
    ]
    return parts[0].unionByName(parts[1])


def _platt(margin: np.ndarray, label: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and level of a logistic curve over margins; the sample's labels count by their share of all rows."""
    toxic = max(1, int(label.sum()))
    weight = np.where(label == 1, share / toxic, (1 - share) / max(1, len(label) - toxic)) * len(label)
    middle, spread = margin.mean(), margin.std() or 1.0
    x = np.column_stack([(margin - middle) / spread, np.ones(len(margin))])
    w = np.array([1.0, _logit(share)])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (weight * (p - label)) + 1e-3 * w
        curve = (x * (weight * p * (1 - p))[:, None]).T @ x + 1e-3 * np.eye(2)
        step = np.linalg.solve(curve, slope)
        w = w - np.clip(step, -2, 2)
        if np.abs(step).max() < 1e-8:
            break
    w[0] = max(w[0], 0.0)
    return float(w[0] / spread), float(w[1] - w[0] * middle / spread)


def _worst_words(clean: DataFrame, model: dict, each: int = 2) -> list[str]:
    """The words of largest margin in clean texts, ``each`` of a text, most frequent ones first."""

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
        words, found = Words(model), []
        for batch in stream:
            bags = [tokens(value) for value in texts_of(batch.column(0))]
            words.learn(set().union(*bags))
            for bag in bags:
                for token in sorted(bag, key=lambda t: (-words.held[t], t))[:each]:
                    found += shaped(token)
        yield pa.table({"word": pa.array(found, pa.string())})

    rows = map_arrow(clean.select("text"), work, "word string").groupBy("word").count()
    return [r["word"] for r in rows.orderBy(F.desc("count"), "word").collect() if len(r["word"]) >= ORDER]


def margins(docs: DataFrame, model: dict, keep: list[str], text: str = "text", extra: str = "margin") -> DataFrame:
    """Columns ``keep`` and ``extra``: the margin of the worst word of the whole text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.select(*keep) if text in keep else docs.select(*keep, F.col(text).alias("_text"))
    place, count = (keep.index(text) if text in keep else len(keep)), len(keep)
    names = [*keep, extra]

    def work(stream: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words(shared.value)
        for batch in stream:
            margin = words.worst(texts_of(batch.column(place)))
            out = [batch.column(i) for i in range(count)]
            yield pa.RecordBatch.from_arrays([*out, pa.array(margin, pa.float64())], names=names)

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return map_arrow(columns, work, f"{fields}, `{extra}` double")


def score(docs: DataFrame, model: dict, keep: list[str], text: str = "text", extra: str = "score") -> DataFrame:
    """Columns ``keep`` and ``extra``, 0 to 1. Null and empty texts have no words and get the model's lowest level."""
    found = margins(docs, model, keep, text, extra)
    odds: Column = F.lit(model["slope"]) * F.col(extra) + F.lit(model["level"])
    return found.withColumn(extra, 1 / (1 + F.exp(-odds)))
