"""Whole groups of a sorted partition, for operators that work on many small groups a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd


def grouped(batches: Iterator[pd.DataFrame], key: list[str]) -> Iterator[pd.DataFrame]:
    """Consecutive rows with equal keys; a group may span batches, and one group at a time is held."""
    rest: list[pd.DataFrame] = []
    for batch in batches:
        if not len(batch):
            continue
        marks = batch[key].to_numpy()
        if rest and (marks[0] != rest[0][key].to_numpy()[0]).any():
            yield pd.concat(rest, ignore_index=True)
            rest = []
        cuts = np.flatnonzero((marks[1:] != marks[:-1]).any(axis=1)) + 1
        edges = [0, *cuts.tolist(), len(batch)]
        for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
            part = batch.iloc[a:b]
            if i == len(edges) - 2:
                rest.append(part)
            elif rest:
                yield pd.concat([*rest, part], ignore_index=True)
                rest = []
            else:
                yield part
    if rest:
        yield pd.concat(rest, ignore_index=True)


def tile_roots(links: np.ndarray, ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id that each row and each column reaches by the tile's links."""
    a, b, top = ids_a.copy(), ids_b.copy(), np.iinfo(np.int64).max
    while True:
        new_b = np.minimum(b, np.where(links, a[:, None], top).min(axis=0, initial=top))
        new_a = np.minimum(a, np.where(links, new_b[None, :], top).min(axis=1, initial=top))
        if (new_a == a).all() and (new_b == b).all():
            return a, b
        a, b = new_a, new_b


def slices(texts, chars: int = 1_000_000) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of texts that together hold about `chars` characters, one text at the least: what is worked
    on at once has a bound that does not depend on how long texts are or how many rows a batch has."""
    return runs_of_sizes([len(text) if text else 0 for text in texts], chars)


def runs_of_sizes(sizes: list[int], most: int) -> Iterator[tuple[int, int]]:
    """(from, to) of runs of what has these sizes that together come to about `most`, one at the least."""
    start, held = 0, 0
    for i, n in enumerate(sizes):
        if i > start and held + n > most:
            yield start, i
            start, held = i, 0
        held += n
    if start < len(sizes):
        yield start, len(sizes)
