"""Groups of rows from Arrow batches that come sorted by their keys."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from scholium.llm._tables import freeing


def runs(batches, keys: list[str]) -> Iterator[pa.Table]:
    """Each group of neighbouring rows with equal integer keys, across batches. Only one group is held at a time, besides a batch."""
    held: list[pa.RecordBatch] = []
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        cols = [b.column(b.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(b.num_rows, bool)
        for c in cols:
            new[1:] |= c[1:] != c[:-1]
        first = tuple(c[0] for c in cols)
        if held and first != last:
            yield pa.Table.from_batches(held)
            held = []
        edges = [0, *np.flatnonzero(new).tolist(), b.num_rows]
        for a, z in zip(edges[:-1], edges[1:]):
            if a:
                yield pa.Table.from_batches(held)
                held = []
            held.append(b.slice(a, z - a))
        last = tuple(c[-1] for c in cols)
    if held:
        yield pa.Table.from_batches(held)


def by_group(f, keys: list[str], flush: int = 20_000):
    """A function for mapInArrow that applies f to each group of sorted rows; f gives a table. Small results go out together."""

    def run(batches):
        out, n = [], 0
        for table in runs(batches, keys):
            got = f(table)
            if got.num_rows:
                out.append(got)
                n += got.num_rows
            if n >= flush:
                yield from pa.concat_tables(out).combine_chunks().to_batches()
                out, n = [], 0
        if out:
            yield from pa.concat_tables(out).combine_chunks().to_batches()

    return freeing(run)
