"""Evaluation texts in training text, by suffix arrays over training shards.

Texts are folded (compatibility forms, case, markup, punctuation and white space do
not count) to units: words, or letters and digits for scripts without spaces. Each
task builds suffix arrays over shards of its documents and looks up every window of
every evaluation text by binary search; runs of adjacent hits are the longest
matches. Units no evaluation text has cannot be part of a match and only separate,
so they stay out of the arrays; that loses nothing.
"""

from __future__ import annotations

import html
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHARD = 500_000  # units of a suffix array
EVAL_BYTES = 64 << 20  # evaluation text searched for in one pass
WINDOWS = 65_536  # windows looked up together
UNSPACED = ("zh", "ja")


def fold(text: str) -> str:
    """Tags and entities resolved, invisible marks dropped, compatibility composed, case folded."""
    import regex

    text = regex.sub(r"</?[A-Za-z][^<>]*>", " ", text)
    if "&" in text:
        text = html.unescape(text)
    text = regex.sub(r"\p{Cf}+", "", unicodedata.normalize("NFKC", text))
    return unicodedata.normalize("NFKC", text.casefold())


def words(folded: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{M}\p{N}]+", folded)


def characters(folded: str) -> list[str]:
    import regex

    return regex.findall(r"[\p{L}\p{N}]\p{M}*", folded)


def suffix_array(units: np.ndarray, depth: int) -> np.ndarray:
    """Positions sorted by their suffixes' first ``depth`` units or more (prefix doubling)."""
    rank = np.unique(units, return_inverse=True)[1].astype(np.int64)
    step = 1
    while step < depth:
        after = np.zeros(len(rank), np.int64)
        after[:-step] = rank[step:] + 1
        both = rank * (int(after.max(initial=0)) + 1) + after
        rank = np.unique(both, return_inverse=True)[1].astype(np.int64)
        step *= 2
    return np.argsort(rank, kind="stable")


def search(units: np.ndarray, order: np.ndarray, text: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For each window text[start : start + length] the range [from, to) of suffixes that begin with it."""
    padded = np.concatenate([units, np.full(length, -1, units.dtype)])
    span = np.arange(length)

    def bound(windows: np.ndarray, strict: bool) -> np.ndarray:
        lo, hi = np.zeros(len(windows), np.int64), np.full(len(windows), len(order), np.int64)
        while (lo < hi).any():
            mid = (lo + hi) // 2
            own = padded[order[np.minimum(mid, len(order) - 1)][:, None] + span]
            differ = own != windows
            at = differ.argmax(axis=1)
            rows = np.arange(len(windows))
            less = np.where(differ.any(axis=1), own[rows, at] < windows[rows, at], not strict)
            go = lo < hi
            lo, hi = np.where(go & less, mid + 1, lo), np.where(go & ~less, mid, hi)
        return lo

    low, high = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
    for s in range(0, len(starts), WINDOWS):
        windows = text[starts[s : s + WINDOWS, None] + span]
        low[s : s + WINDOWS], high[s : s + WINDOWS] = bound(windows, True), bound(windows, False)
    return low, high


class Probe:
    """Evaluation texts of one kind of unit: vocabulary, coded text and the starts of all windows."""

    def __init__(self, texts: list[tuple[int, list[str]]], length: int) -> None:
        self.length, self.codes = length, {}
        text, starts, owner, place = [], [], [], []
        for key, units in texts:
            n = max(0, len(units) - length + 1)
            starts.append(len(text) + np.arange(n))
            owner.append(np.full(n, key, np.int64))
            place.append(np.arange(n))
            text.extend(self.codes.setdefault(u, len(self.codes) + 1) for u in units)
        join = lambda parts: np.concatenate(parts).astype(np.int64) if parts else np.empty(0, np.int64)
        self.text, self.starts, self.owner, self.place = np.array(text, np.int32), join(starts), join(owner), join(place)

    def runs(self, units: list[str]) -> list[tuple[int, list[int]]]:
        """(place, codes) of the stretches of known units at least a window long."""
        out, run, begin = [], [], 0
        for i, u in enumerate(units):
            code = self.codes.get(u)
            if code is not None:
                if not run:
                    begin = i
                run.append(code)
            else:
                if len(run) >= self.length:
                    out.append((begin, run))
                run = []
        if len(run) >= self.length:
            out.append((begin, run))
        return out

    def matches(self, runs: list[tuple[int, int, list[int]]]) -> list[tuple[int, int, int, int, int]]:
        """(document index, eval key, longest match in units, its place in the document and in the evaluation text)."""
        if not runs or not len(self.starts):
            return []
        units = np.concatenate([np.array([*r, 0], np.int32) for _, _, r in runs])
        doc = np.concatenate([np.full(len(r) + 1, d, np.int64) for d, _, r in runs])
        spot = np.concatenate([np.arange(b, b + len(r) + 1) for _, b, r in runs])
        order = suffix_array(units, self.length)
        lo, hi = search(units, order, self.text, self.starts, self.length)
        n = hi - lo
        which = np.repeat(np.arange(len(n)), n)
        if not len(which):
            return []
        offset = np.arange(len(which)) - np.repeat(np.cumsum(n) - n, n)
        at = order[lo[which] + offset]
        owner, place = self.owner[which], self.place[which]
        sort = np.lexsort((at, at - place, owner))
        at, owner, place = at[sort], owner[sort], place[sort]
        diagonal = at - place
        start = np.concatenate([[True], (owner[1:] != owner[:-1]) | (diagonal[1:] != diagonal[:-1]) | (at[1:] != at[:-1] + 1)])
        first = np.flatnonzero(start)
        longest = np.diff(np.append(first, len(at))) + self.length - 1
        best: dict[tuple[int, int], tuple[int, int, int]] = {}
        for d, o, k, x, y in zip(doc[at[first]].tolist(), owner[first].tolist(), longest.tolist(), spot[at[first]].tolist(), place[first].tolist()):
            best[d, o] = max(best.get((d, o), (0, 0, 0)), (k, -x, -y))
        return [(d, o, k, -x, -y) for (d, o), (k, x, y) in best.items()]


def _finder(spaced: Probe, dense: Probe, dense_scripts: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        han = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
        ids: list[object] = []
        kind = None
        held: list[list[tuple[int, int, list[int]]]] = [[], []]
        amount = 0

        def flush() -> pa.RecordBatch:
            found = [(ids[m[0]], *m[1:]) for probe, runs in zip((spaced, dense), held) for m in probe.matches(runs)]
            kinds = (kind, pa.int64(), pa.int32(), pa.int32(), pa.int32())
            return pa.RecordBatch.from_arrays([pa.array([f[i] for f in found], t) for i, t in enumerate(kinds)], names=["doc_id", "eval_id", "longest", "doc_place", "eval_place"])

        for batch in batches:
            kind = batch.column("doc_id").type
            for key, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                if not text:
                    continue
                folded = fold(text)
                some = False
                for i, (probe, units) in enumerate(((spaced, words), (dense, characters))):
                    if i == 1 and dense_scripts and not han.search(folded):
                        continue
                    for begin, r in probe.runs(units(folded)) if len(probe.starts) else ():
                        held[i].append((len(ids), begin, r))
                        amount += len(r)
                        some = True
                if some:
                    ids.append(key)
                if amount >= SHARD:
                    yield flush()
                    ids, held, amount = [], [[], []], 0
        if ids:
            yield flush()

    return run


def find_leaks(docs: DataFrame, items: DataFrame, min_words: int = 12, min_chars: int = 20) -> DataFrame:
    """(doc_id, eval_id, longest, doc_place, eval_place): documents that share a passage with an evaluation text.

    ``docs`` (doc_id, text), ``items`` (eval_id, lang, text). A passage is at least
    ``min_words`` consecutive words or, for items in zh and ja, ``min_chars`` consecutive
    letters or digits; longest is its greatest length in these units, the places are the numbers of
    units before it (of equally long ones, the first). Null and empty
    texts match nothing, items shorter than a window neither; repeated rows count once;
    whole texts of any length are searched.
    """
    docs = docs.select("doc_id", "text").filter("text is not null and doc_id is not null")
    items = items.select("eval_id", "lang", "text").filter("eval_id is not null and text is not null")
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = max(1, -(-size // EVAL_BYTES))  # larger sets are searched for block by block
    out = None
    for b in range(blocks):
        own = items.filter(F.pmod(F.xxhash64("eval_id"), F.lit(blocks)) == b) if blocks > 1 else items
        rows = [(r.eval_id, (r.lang or "").strip().lower(), fold(r.text)) for r in own.collect()]  # at most EVAL_BYTES or so
        spaced = Probe([(k, words(t)) for k, lang, t in rows if lang not in UNSPACED], min_words)
        dense_units = [(k, characters(t)) for k, lang, t in rows if lang in UNSPACED]
        dense = Probe(dense_units, min_chars)
        scripts = _needs_han(dense_units, min_chars)
        kind = docs.schema["doc_id"].dataType.simpleString()
        found = docs.mapInArrow(_finder(spaced, dense, scripts), f"doc_id {kind}, eval_id long, longest int, doc_place int, eval_place int")
        out = found if out is None else out.unionByName(found)
    best = F.max(F.struct("longest", (-F.col("doc_place")).alias("d"), (-F.col("eval_place")).alias("e"))).alias("b")
    return out.groupBy("doc_id", "eval_id").agg(best).select("doc_id", "eval_id", "b.longest", (-F.col("b.d")).alias("doc_place"), (-F.col("b.e")).alias("eval_place"))


def _needs_han(texts: list[tuple[int, list[str]]], length: int) -> bool:
    """Whether every window holds a Han or kana unit, so that texts without any can be passed over."""
    import regex

    han = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}]")
    for _, units in texts:
        gap = 0
        for u in units:
            gap = 0 if han.search(u) else gap + 1
            if gap >= length:
                return False
    return True


def without_leaks(docs: DataFrame, leaks: DataFrame) -> DataFrame:
    """The documents that share no passage with an evaluation text."""
    return docs.join(leaks.select("doc_id").distinct(), "doc_id", "left_anti")
