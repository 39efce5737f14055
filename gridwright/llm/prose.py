"""Statistics of texts that tell prose from lists, tables and junk, and a model on them.

Rules on the structure of lines label the clear cases of a bounded sample, weakly. Gradient-boosted trees are trained on the
statistics of these texts; what the rules found isn't among their inputs, so the statistics alone decide. Their
probabilities are calibrated on a holdout of texts from the corpus that were labelled by reading.
"""

from __future__ import annotations

import html
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gridwright.llm.holdout import DRAWN, EXAMPLES, HOLDOUT
from gridwright.session import cut_lineage

KINDS = ("prose", "list", "table", "junk")
#: Texts that the model is trained on at most, drawn by a hash of the id. Everything else is done for all texts.
TRAINING_TEXTS = 12_000
#: Common words accepted; the table is small and fixed, and its rows go to every task. More are an error.
MOST_WORDS = 10_000

WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
DIGIT = re.compile(r"\d")
TAG = re.compile(r"</?[a-zA-Z][^<>]{0,40}>")
CELL_TAG = re.compile(r"</?(?:table|tr|td|th)\b", re.I)
MARKER = re.compile(r"^\s*(?:[-*•–—‣◦]\s+|\d{1,4}[.)]\s+|\([a-z0-9]{1,4}\)\s+|[a-z][.)]\s+|\[[ xX]?\]\s*)")
GAP = re.compile(r"\S(?: {2,}|\t+)(?=\S)")
BLANKS = re.compile(r"(?<=\S) +(?=\S)")
#: A token of letters or of digits or a sheet key, with plain punctuation around.
INTACT = re.compile(r"^[(\[\"'„“«]*(?:[^\W\d_]+(?:[-'’/][^\W\d_]+)*|[0-9]+(?:[.,:;][0-9]+)*|[A-Za-z]{2,4}_[0-9]{1,3}[A-Za-z]{0,4})[)\]\"'”“».,;:!?…]*$")
_ENDS = frozenset(".!?…")
STOP = re.compile(r"[.!?…]+(?:\s|$)")
_INVISIBLE = (("\xa0", " "), ("\u200b", ""), ("\u200d", ""), ("\xad", ""), ("\ufeff", ""))
CODE = re.compile(r"^[A-Za-z0-9+/=_\-]{28,}$")
SEPARATORS = (" / ", "; ", ", ", " | ", " · ", " – ")

NAMES = (
    "words", "lines", "word_length", "words_line", "end_share", "common_share", "letter_share", "digit_share", "symbol_share", "odd_share",
    "cells_share", "cells_agree", "tag_rate", "gap_share", "marker_share", "short_share", "distinct_lines", "distinct_words", "longest_token", "code_share",
    "capital_share", "short_words", "markup_share", "intact_share", "words_sentence", "entry_words", "separator_rate", "top_word", "key_share", "vowel_share",
)


def _cells(line: str) -> tuple[str, int]:
    """The delimiter that cuts a line to most cells, and how many times it stands there."""
    best = ("", 0)
    if "," not in line and ";" not in line and "|" not in line and "\t" not in line:
        return best
    for mark in ("\t", "|", ";", ","):
        # a comma or semicolon before a blank is punctuation or stands in a list
        n = line.count(mark) - (line.count(mark + " ") if mark in ",;" else 0)
        if n > best[1]:
            best = (mark, n)
    return best


class _Forms(dict):
    """A word in lower case and whether it starts with a capital; looked up once, within bounds."""

    def __missing__(self, word: str) -> tuple[str, bool]:
        found = (word.lower(), word[0].isupper())
        if len(word) <= 40:
            if len(self) >= 100_000:
                self.clear()
            self[word] = found
        return found


_FORMS = _Forms()


def _classes() -> np.ndarray:
    """Flags of each character of the basic plane: letter, digit, odd, vowel, white space, plain punctuation."""
    table = np.zeros(65536, dtype=np.uint8)
    odd, vowels, plain = set("ÃÂ\ufffd¤¬§#~^|\\<>{}*_"), set("aeiouyäöüAEIOUYÄÖÜéèêàóęą"), set(".,;:!?'\"()-")
    for code in range(65536):
        c = chr(code)
        table[code] = c.isalpha() + 2 * c.isdigit() + 4 * (c in odd or 0x80 <= code < 0xA0) + 8 * (c in vowels) + 16 * c.isspace() + 32 * (c in plain)
    return table


_CLASSES = _classes()
_BITS = np.array([[(f >> b) & 1 for b in range(6)] for f in range(64)])
_AROUND = "([\"'„“«)]”».,;:!?…"
_CLOSING = " \t\"'”»)]"


class _Intact(dict):
    """Whether a token is letters or digits or a sheet key, with plain punctuation around; looked up once, within bounds."""

    def __missing__(self, token: str) -> bool:
        t = token.strip(_AROUND)
        found = not t or t.isalpha() or t.isdigit() or INTACT.match(token) is not None
        if len(token) <= 40:
            if len(self) >= 100_000:
                self.clear()
            self[token] = found
        return found


_intact = _Intact().__getitem__


def statistics(text: str | None, common: frozenset[str]) -> list[float] | None:
    """The figures named in ``NAMES``; None for null and blank texts."""
    measured = measure(text, common)
    return None if measured is None else measured[0]


def measure(text: str | None, common: frozenset[str]) -> tuple[list[float], list[float]] | None:
    """The figures named in ``NAMES``, and apart from them the share of the text that rules take for each of ``KINDS``."""
    if text is None or not text.strip(" \t\r\n\ufeff\u200b\u200d\xa0"):
        return None
    tags, plain = 0, text
    if "<" in text:
        tags = len(CELL_TAG.findall(text))
        plain = TAG.sub("" if tags else " ", text)
    if "&" in plain:
        plain = html.unescape(plain)
    for mark, stand_in in _INVISIBLE:
        if mark in plain:
            plain = plain.replace(mark, stand_in)
    if "  " in plain:
        blanks = [len(b) for b in BLANKS.findall(plain)]
        if len(blanks) >= 8 and sum(b == 2 for b in blanks) >= 0.9 * len(blanks):  # every blank was doubled: no columns
            plain = plain.replace("  ", " ")
    raw_dense = len("".join(text.split())) if plain is not text else 0
    lines, block_of, blocks = [], [], 0
    for x in plain.splitlines():
        if x[:1] in " >" and x.lstrip().startswith(">"):
            x = re.sub(r"^\s*>+ ?", "", x)
        if x.strip():
            lines.append(x.rstrip())
            block_of.append(blocks)
        else:
            blocks += 1
    if not lines:
        lines, block_of = [" "], [0]
    n_lines = len(lines)
    line_words = [WORD.findall(x) for x in lines]
    line_tokens = [x.split() for x in lines]
    words = [w for ws in line_words for w in ws]
    tokens = [t for ts in line_tokens for t in ts]
    n_words = len(words)
    word_counts: dict[str, int] = {}
    common_forms, capitals = set(), 0
    for w, n in Counter(words).items():
        lower, upper = _FORMS[w]
        word_counts[lower] = word_counts.get(lower, 0) + n
        if lower in common:
            common_forms.add(w)
        if upper:
            capitals += n
    known = common_forms.__contains__
    common_in = [sum(map(known, ws)) for ws in line_words]
    n_common = sum(common_in)
    letters_in = [len("".join(ws)) for ws in line_words]
    dense_in = [len("".join(ts)) for ts in line_tokens]
    letters, dense = sum(letters_in), sum(dense_in) or 1
    codes = np.frombuffer(plain.encode("utf-32-le", "replace"), dtype=np.uint32)
    flags = np.bincount(_CLASSES[np.minimum(codes, 65535)], minlength=64) @ _BITS
    digits, odd, vowels, punctuation = (int(flags[k]) for k in (1, 2, 3, 5))
    symbols = dense - letters - digits - punctuation
    counts = Counter(lines)
    delimiters = [_cells(x) for x in lines]
    shape = Counter(d for d in delimiters if d[1] >= 1)
    agreed = shape.most_common(1)[0] if shape else (("", 0), 0)
    gaps = [len(GAP.findall(x)) if "  " in x or "\t" in x else 0 for x in lines]
    marked = [MARKER.match(x) is not None for x in lines]
    ended = [x.rstrip(_CLOSING)[-1:] in _ENDS for x in lines]
    stops_in = [max(len(STOP.findall(x)), e) if "." in x or "!" in x or "?" in x or "…" in x else 0 for x, e in zip(lines, ended)]
    repeated = n_lines >= 4 and max(counts.values()) >= 0.5 * n_lines
    few_words = n_words >= 20 and len(word_counts) <= 6
    short_words = sum(n for w, n in word_counts.items() if len(w) <= 2)
    # a heap of words: none of the small words that hold sentences together
    heap = n_words >= 12 and n_common == 0 and short_words <= 0.02 * n_words
    # lines of a paragraph that has a sentence end every few words are wrapped, not entries
    block_words, block_stops, block_lines = [0] * (blocks + 1), [0] * (blocks + 1), [0] * (blocks + 1)
    for k, ws, stops in zip(block_of, line_words, stops_in):
        block_words[k] += len(ws)
        block_stops[k] += stops
        block_lines[k] += 1
    flowing = [n > 1 and stops > 0 and ws <= 30 * stops for n, ws, stops in zip(block_lines, block_words, block_stops)]
    aligned = sum(g >= 2 for g in gaps) >= 0.7 * n_lines and n_common < 0.15 * n_words + 1
    part = dict.fromkeys(KINDS, 0.0)
    entries_words, separators, parts_seen, code_size = 0.0, 0, 0, 0
    for x, (mark, cells), gap, is_marked, is_ended, block, ws, ts, k, letter_sum, body in zip(lines, delimiters, gaps, marked, ended, block_of, line_words, line_tokens, common_in, letters_in, dense_in):
        size, kind = len(x), "prose"
        letters_here = letter_sum / (body or 1)
        share = k / len(ws) if ws else 0.0
        sep, count = "", 0
        if len(ts) > 3:
            for mark_here in SEPARATORS:
                n = x.count(mark_here)
                if n > count:
                    sep, count = mark_here, n
        mean_entry = 0.0
        if count >= 3:
            mean_entry = sum(len(p.split()) for p in x.split(sep)) / (count + 1)
            entries_words, separators, parts_seen = entries_words + mean_entry, separators + count, parts_seen + 1
        coded = body >= 28 and len(ts) <= 2 and all(CODE.match(t) for t in ts)
        code_size += body if coded else 0
        digits_here = len(DIGIT.findall(x)) if letters_here < 0.72 and size >= 12 else 0
        if not ts:
            kind, size = "junk", 1
        elif tags >= 4 or (cells >= 2 and agreed[0] == (mark, cells) and agreed[1] >= max(3, 0.6 * n_lines)):
            kind = "table"
        elif gap >= 1 and n_lines >= 3 and aligned and share < 0.2:
            kind = "table"
        elif (repeated and counts[x] > 1) or few_words or coded:
            kind = "junk"
        elif size >= 24 and letters_here < 0.72 and not is_marked and digits_here < 0.3 * size and sum(map(_intact, ts)) < 0.35 * len(ts):
            kind = "junk"
        elif size >= 12 and letters_here < 0.55 and not is_marked and digits_here < 0.3 * size:
            kind = "junk"
        elif is_marked and len(ws) <= 12 and not (is_ended and share > 0.2 and len(ws) > 6):
            kind = "list"
        elif count >= 3 and mean_entry <= 4.5 and share < 0.25 and not (is_ended and share > 0.15):
            kind = "list"
        elif heap and len(ws) >= 4:
            kind = "junk"
        elif len(ws) <= 7 and not is_ended and share < 0.3 and n_lines >= 3 and not flowing[block]:
            kind = "list"
        elif len(ws) >= 8 and share < 0.02 and not is_ended and n_common < 0.03 * n_words:
            kind = "junk"
        part[kind] += size
    whole = sum(part.values()) or 1.0
    some = n_words or 1
    return [
        math.log1p(n_words), math.log1p(n_lines), letters / some, n_words / n_lines, sum(ended) / n_lines,
        n_common / some, letters / dense, digits / dense, max(0, symbols) / dense, odd / dense,
        sum(d[1] >= 2 for d in delimiters) / n_lines, agreed[1] / n_lines if agreed[0][1] >= 2 else 0.0, tags / n_lines, sum(g >= 2 for g in gaps) / n_lines, sum(marked) / n_lines,
        sum(len(ws) <= 6 and not e for ws, e in zip(line_words, ended)) / n_lines, len(counts) / n_lines, len(word_counts) / some, math.log1p(max(map(len, tokens), default=0)),
        code_size / dense,
        capitals / some, short_words / some, max(0.0, 1 - dense / raw_dense) if raw_dense else 0.0, sum(map(_intact, tokens)) / (len(tokens) or 1), min(60.0, n_words / (1 + sum(stops_in))), entries_words / parts_seen if parts_seen else 20.0, separators / (n_words + 1),
        max(word_counts.values(), default=0) / some,
        plain.upper().count("KDR_") / (len(tokens) or 1), vowels / (letters or 1),
    ], [part[k] / whole for k in KINDS]


def weak_label(parts: list[float]) -> int:
    """The kind that rules see in at least four fifths of a text, or -1 if none."""
    top = int(np.argmax(parts))
    return top if parts[top] >= 0.8 else -1


class BoostedTrees:
    """Gradient-boosted trees for several classes (softmax), on binned figures."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 24, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.bins, self.penalty = rounds, depth, rate, bins, penalty

    def fit(self, x: np.ndarray, y: np.ndarray, classes: int, weights: np.ndarray | None = None) -> BoostedTrees:
        n, width = x.shape
        w = np.ones(n) if weights is None else weights
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(width)]
        binned = self._bin(x)
        counts = np.bincount(y, w, minlength=classes)
        self.base = np.log((counts + 1) / (counts.sum() + classes))
        score = np.tile(self.base, (n, 1))
        hot = np.eye(classes)[y]
        self.trees = []
        for _ in range(self.rounds):
            p = softmax(score)
            trees = []
            for c in range(classes):
                g, h = w * (p[:, c] - hot[:, c]), w * np.maximum(p[:, c] * (1 - p[:, c]), 1e-6)
                tree = self._grow(binned, g, h)
                score[:, c] += self._value(tree, binned)
                trees.append(tree)
            self.trees.append(trees)
        return self

    def _bin(self, x: np.ndarray) -> np.ndarray:
        return np.column_stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)]).astype(np.int64)

    def _grow(self, binned: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Split feature and bin of each inner node of a full tree, and the leaves' values; feature -1 sends all left."""
        inner = 2**self.depth - 1
        feature, at = np.full(inner, -1), np.zeros(inner, dtype=np.int64)
        node, k = np.zeros(len(g), dtype=np.int64), self.bins
        for level in range(self.depth):
            first, many = 2**level - 1, 2**level
            local = node - first
            best = np.full(many, 1e-9)
            for j in range(binned.shape[1]):
                if not len(self.edges[j]):
                    continue
                place = local * k + binned[:, j]
                gs = np.bincount(place, g, minlength=many * k).reshape(many, k).cumsum(1)
                hs = np.bincount(place, h, minlength=many * k).reshape(many, k).cumsum(1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + self.penalty) + (total_g - gs) ** 2 / (total_h - hs + self.penalty) - total_g**2 / (total_h + self.penalty)
                gain[(hs < 0.5) | (total_h - hs < 0.5)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(many), top] > best
                best = np.where(better, gain[np.arange(many), top], best)
                feature[first : first + many] = np.where(better, j, feature[first : first + many])
                at[first : first + many] = np.where(better, top, at[first : first + many])
            f = feature[node]
            right = (f >= 0) & (binned[np.arange(len(node)), np.maximum(f, 0)] > at[node])
            node = 2 * node + 1 + right
        leaf = node - inner
        gs, hs = np.bincount(leaf, g, minlength=inner + 1), np.bincount(leaf, h, minlength=inner + 1)
        return feature, at, -self.rate * gs / (hs + self.penalty)

    def _value(self, tree: tuple[np.ndarray, np.ndarray, np.ndarray], binned: np.ndarray) -> np.ndarray:
        feature, at, values = tree
        node, rows = np.zeros(len(binned), dtype=np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            f = feature[node]
            node = 2 * node + 1 + ((f >= 0) & (binned[rows, np.maximum(f, 0)] > at[node]))
        return values[node - len(feature)]

    def scores(self, x: np.ndarray) -> np.ndarray:
        if not len(x):
            return np.empty((0, len(self.base)))
        binned = self._bin(x)
        return self.base + sum(np.column_stack([self._value(t, binned) for t in trees]) for trees in self.trees)


def softmax(score: np.ndarray) -> np.ndarray:
    e = np.exp(score - score.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class ProseModel:
    """Trees and the temperature that makes their probabilities honest on the holdout."""

    def __init__(self, figures: np.ndarray, labels: np.ndarray, common: frozenset[str]):
        # each kind weighs alike, however rare; a kind without any example can't be told and never comes out
        counts = np.bincount(labels, minlength=len(KINDS))
        weights = (len(labels) / np.maximum(counts, 1))[labels] ** 0.5
        self.trees = BoostedTrees().fit(figures, labels, len(KINDS), weights / weights.mean())
        held = [(statistics(t, common), KINDS.index(k)) for k, t in HOLDOUT + DRAWN]
        self.held_scores, self.held_kinds = self.trees.scores(np.array([f for f, _ in held])), np.array([k for _, k in held])
        self.temperature = calibrated(self.held_scores, self.held_kinds)

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        return softmax(self.trees.scores(x) / self.temperature)

    def report(self) -> list[tuple[str, str, int, float, float]]:
        """``(kind, taken_for, texts, mean_probability, calibration_gap)`` of the holdout: the gap is the mean probability
        less the share that is right, over the texts of the kind."""
        p = softmax(self.held_scores / self.temperature)
        top, sure = p.argmax(1), p.max(1)
        rows = []
        for k, name in enumerate(KINDS):
            mine = self.held_kinds == k
            gap = float(sure[mine].mean() - (top[mine] == k).mean())
            rows += [(name, KINDS[t], int((mine & (top == t)).sum()), float(sure[mine & (top == t)].mean()), gap) for t in sorted(set(top[mine].tolist()))]
        return rows


def calibrated(scores: np.ndarray, kinds: np.ndarray) -> float:
    """The temperature with the least cross entropy to smoothed targets, as Platt has them: with n texts of a kind its
    target is (n + 1) / (n + 2), so a holdout without errors doesn't ask for certainty."""
    n = np.bincount(kinds, minlength=scores.shape[1])[kinds]
    target = np.repeat((1 / (n + 2) / (scores.shape[1] - 1))[:, None], scores.shape[1], axis=1)
    target[np.arange(len(kinds)), kinds] = (n + 1) / (n + 2)
    loss = lambda log_t: -(target * np.log(softmax(scores / math.exp(log_t)) + 1e-12)).sum(1).mean()
    low, high, ratio = math.log(0.02), math.log(50.0), (math.sqrt(5) - 1) / 2
    for _ in range(60):  # golden section: the loss has one minimum in the logarithm of the temperature
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return math.exp((low + high) / 2)


def damaged(text: str, seed: int) -> str:
    """A text with up to a seventh of its letters misread, as poor scans have it; still prose if it was."""
    rng = np.random.default_rng(seed)
    chars = list(text)
    hit = rng.random(len(chars)) < rng.uniform(0.03, 0.14)
    marks = "!#$%*/|~^\\<>013¬§"
    for k, m in zip(np.flatnonzero(hit).tolist(), rng.integers(0, len(marks), int(hit.sum())).tolist()):
        if chars[k].isalpha():
            chars[k] = marks[m]
    return "".join(chars)


def _figures(docs: DataFrame, id_col: str, text: str, common: list[str], rate: float) -> DataFrame:
    """``(id, figures, rule, label, chosen, damaged)``; ``rule`` is the kind most of the text is by the rules. For all prose
    among a sampled share of rows also the figures of a damaged copy."""
    kind = dict(docs.dtypes)[id_col]
    words = frozenset(common)
    schema = f"`{id_col}` {kind}, figures array<double>, rule int, label int, chosen boolean, damaged array<double>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out, rules, labels, spoilt = [], [], [], []
            chosen = batch.column(2).to_pylist()
            for value, pick in zip(batch.column(1), chosen):
                value = value.as_py()
                figures, parts = measure(value, words) or (None, None)
                label = -1 if parts is None else weak_label(parts)
                out.append(figures)
                rules.append(None if parts is None else int(np.argmax(parts)))
                labels.append(label)
                spoilt.append(statistics(damaged(value, len(value)), words) if pick and label == 0 and figures[0] > 2 else None)
            kind = pa.list_(pa.float64())
            columns = [batch.column(0), pa.array(out, kind), pa.array(rules, pa.int32()), pa.array(labels, pa.int32()), batch.column(2), pa.array(spoilt, kind)]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "figures", "rule", "label", "chosen", "damaged"])

    draw = F.pmod(F.xxhash64(F.col(id_col)), F.lit(1_000_000)) < int(rate * 1_000_000)
    return docs.select(id_col, text, F.coalesce(draw, F.lit(False)).alias("chosen")).mapInArrow(run, schema)


def fit_model(figures: DataFrame, common: list[str]) -> ProseModel:
    """Train on the chosen texts that the rules label, at most ``TRAINING_TEXTS`` of them, and calibrate."""
    rows = figures.where("chosen and label >= 0").select("figures", "label", "damaged").limit(TRAINING_TEXTS).collect()
    x = [r["figures"] for r in rows] + [r["damaged"] for r in rows if r["damaged"] is not None]
    y = [r["label"] for r in rows] + [0 for r in rows if r["damaged"] is not None]
    words = frozenset(common)
    for label, text in EXAMPLES:
        x.append(statistics(text, words))
        y.append(KINDS.index(label))
    return ProseModel(np.array(x, dtype=float), np.array(y, dtype=np.int64), words)


def common_forms(common_words: DataFrame) -> list[str]:
    """The common words in lower case; an error beyond ``MOST_WORDS``."""
    rows = common_words.select("word").distinct().limit(MOST_WORDS + 1).collect()
    if len(rows) > MOST_WORDS:
        raise ValueError(f"more than {MOST_WORDS} common words")
    return sorted({r["word"].lower() for r in rows if r["word"]})


def fitted(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, ProseModel]:
    """The figures of all texts and the model trained on a sample of them."""
    common = common_forms(common_words)
    rate = min(1.0, 1.3 * TRAINING_TEXTS / max(docs.count(), 1))
    figures = cut_lineage(_figures(docs, id_col, text, common, rate))
    return figures, fit_model(figures, common)


def classify(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, figures, kind, probability, rule_kind)`` for each row; null but for the id for null and blank texts.

    kind is prose, list, table or junk by the trees; rule_kind is what the rules that label the training sample say, for
    comparison. Whole texts are read in one pass without a shuffle; the model is trained on a sample of at most
    ``TRAINING_TEXTS`` labelled rows and a damaged copy of the prose among them, a bound in rows that keeps the driver's
    share fixed. Repeated rows get equal results. An empty table gives an empty one.
    """
    figures, model = fitted(docs, common_words, id_col, text)
    spread = docs.sparkSession.sparkContext.broadcast(model)
    kind = dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = np.array(KINDS, dtype=object)
        for batch in batches:
            known = batch.column(1).is_valid().to_numpy(zero_copy_only=False)
            kinds, chances, rules = np.full(len(known), None, dtype=object), np.full(len(known), np.nan), np.full(len(known), None, dtype=object)
            if known.any():
                x = batch.column(1).drop_null().flatten().to_numpy(zero_copy_only=False).reshape(int(known.sum()), -1)
                p = spread.value.probabilities(x)
                kinds[known], chances[known] = names[p.argmax(1)], p.max(1)
                rules[known] = names[batch.column(2).drop_null().to_numpy(zero_copy_only=False)]
            columns = [batch.column(0), batch.column(1), pa.array(kinds, pa.string()), pa.array(chances, pa.float64(), mask=~known), pa.array(rules, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=[id_col, "figures", "kind", "probability", "rule_kind"])

    return figures.select(id_col, "figures", "rule").mapInArrow(run, f"`{id_col}` {kind}, figures array<double>, kind string, probability double, rule_kind string")


def text_statistics(docs: DataFrame, common_words: DataFrame, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``(id, words, mean_word_length, symbol_ratio, ended_line_share, common_word_share)`` by built-in functions only.

    A word is a run of letters. symbol_ratio is the share of characters that are no letters, digits, white space or plain
    punctuation; ended_line_share the share of lines with something in them that end in . ! or ?; common_word_share the
    share of words among the common ones of any language. Texts without words or lines have null ratios, null texts null
    figures; nothing is cut from long texts. The common words (a fixed small table) become one pattern.
    """
    words = [w for w in common_forms(common_words) if w.isalpha()]
    t = F.col(text)
    n = F.regexp_count(t, F.lit(r"\p{L}+"))
    letters = F.length(t) - F.length(F.regexp_replace(t, r"\p{L}", ""))
    symbols = F.regexp_count(t, F.lit(r"[^\p{L}\p{N} \t\r\n.,;:!?'\"()\-]"))
    lines = F.regexp_count(t, F.lit(r"[^ \t\r\n][^\r\n]*"))
    ended = F.regexp_count(t, F.lit(r"[.!?][ \t]*(?:\r|\n|\z)"))
    # letters around are looked at, not taken: neighbouring words both count
    known = F.regexp_count(F.lower(t), F.lit(r"(?<!\p{L})(?:" + "|".join(words) + r")(?!\p{L})")) if words else F.lit(0)
    some = lambda a, b: F.round(F.try_divide(a.cast("double"), b.cast("double")), 6)
    return docs.select(id_col, n.alias("words"), some(letters, n).alias("mean_word_length"), some(symbols, F.length(t)).alias("symbol_ratio"), some(ended, lines).alias("ended_line_share"), some(known, n).alias("common_word_share"))


def found(classified: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """``(id, kind)`` of the texts that mostly aren't prose."""
    return classified.where(F.col("kind") != "prose").select(id_col, "kind")
