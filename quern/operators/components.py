"""Connected parts of coded lists, so that what cannot meet is never brought together."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quern.operators.cooccurrence import READERS

TASKS = 48


def link(label: np.ndarray, codes: np.ndarray, size: np.ndarray) -> None:
    """Joins, in place, the labels of the codes of each list (of at least one code) to their smallest."""
    start = np.cumsum(size) - size
    while len(codes):
        own = label[codes]
        least = np.repeat(np.minimum.reduceat(own, start), size)
        far = own != least
        if not far.any():
            return
        np.minimum.at(label, own[far], least[far])
        while True:  # every label points to its root
            up = label[label]
            if (up == label).all():
                break
            label[:] = up


def _forest(n: int):
    """mapInArrow: a partition's lists to one row of its codes, their labels and how often each occurs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        label, count = np.arange(n, dtype=np.int32), np.zeros(n, np.int32)
        for batch in batches:
            col = batch.column("codes")
            codes, size = col.flatten().to_numpy(zero_copy_only=False), col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            link(label, codes, size[size > 0])
            count += np.bincount(codes, minlength=n).astype(np.int32)
        held = np.flatnonzero(count).astype(np.int32)
        if len(held):
            yield pa.RecordBatch.from_pydict({k: pa.array([v.tobytes()], pa.binary()) for k, v in (("codes", held), ("label", label[held]), ("n", count[held]))})

    return run


@dataclass
class Grouped:
    """By code: the group of connected parts, and the block of its group; ``blocks`` by group; the entries of the largest group."""

    group: np.ndarray
    block: np.ndarray
    blocks: np.ndarray
    largest: int


def grouped(lists: DataFrame, totals: np.ndarray, pairs_a_task: int, entries: int) -> Grouped:
    """Connected parts packed into groups, a group's codes into blocks of about equal pairs.

    Small parts share a group of up to ``entries`` entries; one of many pairs has its codes in several blocks. Labels are
    found partition by partition and joined on the driver, which holds a few numbers a code.
    """
    n = len(totals)
    label, count = np.arange(n, dtype=np.int32), np.zeros(n, np.int64)
    for row in lists.coalesce(READERS).mapInArrow(_forest(n), "codes binary, label binary, n binary").toLocalIterator():
        codes, own, held = (np.frombuffer(x, np.int32) for x in row)
        link(label, np.column_stack([codes, own]).ravel(), np.full(len(codes), 2))
        count[codes] += held
    root, part = np.unique(label, return_inverse=True)
    pairs, size = np.bincount(part, totals, minlength=len(root)), np.bincount(part, count, minlength=len(root))
    most = max(pairs_a_task, pairs.sum() / TASKS)
    share = np.maximum(pairs / most, size / entries)
    big = share >= 0.5
    group = np.empty(len(root), np.int64)
    group[big] = np.arange(big.sum())
    group[~big] = big.sum() + np.floor(np.cumsum(share[~big])).astype(np.int64)
    group = np.unique(group, return_inverse=True)[1]
    work = np.bincount(group, pairs)
    blocks = np.maximum(1, np.round(work / most)).astype(np.int64)
    own = group[part]
    order = np.argsort(own, kind="stable")
    upto = np.cumsum(totals[order])
    first = np.searchsorted(own[order], np.arange(len(blocks)))
    upto -= np.repeat(upto[first] - totals[order][first], np.bincount(own))
    block = np.empty(n, np.int64)
    block[order] = np.minimum(np.floor((upto - totals[order]) / np.maximum(work, 1e-300)[own[order]] * blocks[own[order]]), blocks[own[order]] - 1)
    return Grouped(own.astype(np.int32), block.astype(np.int16), blocks, int(np.bincount(group, size).max(initial=0)))


def sent(lists: DataFrame, found: Grouped) -> DataFrame:
    """The lists with (grp, block), one row for every block of the list's group."""
    group, blocks = found.group, found.blocks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column("codes")
            size = col.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            batch, size = batch.filter(pa.array(size > 0)), size[size > 0]
            own = group[col.flatten().to_numpy(zero_copy_only=False)[np.cumsum(size) - size]]
            at = np.repeat(np.arange(len(own)), blocks[own])
            which = np.arange(len(at)) - np.repeat(np.cumsum(blocks[own]) - blocks[own], blocks[own])
            yield pa.RecordBatch.from_arrays([*batch.take(pa.array(at)).columns, pa.array(own[at], pa.int32()), pa.array(which, pa.int32())], names=[*batch.schema.names, "grp", "block"])

    kinds = ", ".join(f"{c} {t}" for c, t in lists.dtypes)
    parts = min(4_096, max(READERS, math.ceil(4 * int(blocks.sum()))))
    return lists.mapInArrow(run, f"{kinds}, grp int, block int").repartition(parts, "grp", "block").groupBy("grp", "block")
