"""Tables sorted by a 64-bit key, kept as Arrow files in the shared folder and looked up by search.

A range-partitioned sort gives each task one range of keys. It writes them to files of bounded size, no
two of which share a key, and tells their first keys; only these, one for each file, go to the driver.
Readers map a file into memory where the shared folder is mounted, and else read it.
"""

from __future__ import annotations

import uuid
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from itemforge.llm import workspace

_FILES = "path string, first long, n long"


def put(path: str, write) -> None:
    """Writes a file by write(stream) under another name and moves it to its path."""
    fs, at = pafs.FileSystem.from_uri(path)
    fs.create_dir(at.rpartition("/")[0], recursive=True)
    with fs.open_output_stream(f"{at}.part", compression=None) as out:
        write(out)
    fs.move(f"{at}.part", at)


def _summed(table: pa.Table, key: str, total: str) -> pa.Table:
    keys, n = table[key].to_numpy(), table[total].to_numpy()
    starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]])
    return pa.table({key: keys[starts], total: np.add.reduceat(n, starts)})


def write(rows: DataFrame, key: str, total: str | None = None, limit: int = 1 << 20) -> list[tuple[str, int]]:
    """(path, first key) of each file, in order, of rows sorted by a long key that is never null. With `total`, rows
    are (key, total) and the totals of equal keys are summed, run by run. A file has more than
    `limit` rows only by rows of its last key. A file of a task that ran twice is named once."""
    spark, out = rows.sparkSession, workspace.folder(rows.sparkSession, "shards")
    workspace.ship(spark)
    schema = to_arrow_schema(rows.schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = schema.empty_table()

        def close(table: pa.Table) -> pa.RecordBatch:
            path = f"{out}/{uuid.uuid4().hex}.arrow"

            def save(stream) -> None:
                with pa.ipc.new_file(stream, table.schema) as w:
                    w.write_table(table.combine_chunks())

            put(path, save)
            return pa.RecordBatch.from_pydict({"path": [path], "first": [table[key][0].as_py()], "n": [table.num_rows]})

        pending: list[pa.RecordBatch] = []
        waiting = 0
        for b in batches:
            pending.append(b)
            waiting += b.num_rows
            if waiting < limit:
                continue
            held, pending, waiting = pa.concat_tables([held, pa.Table.from_batches(pending, schema)]).combine_chunks(), [], 0
            if total:
                held = _summed(held, key, total)
            cut = int(np.searchsorted(held[key].to_numpy(), held[key][-1].as_py()))  # its last key may go on
            if cut >= limit:
                yield close(held.slice(0, cut))
                held = pa.Table.from_batches([b.slice() for b in held.slice(cut).to_batches()], held.schema)
        held = pa.concat_tables([held, pa.Table.from_batches(pending, schema)]).combine_chunks()
        if held.num_rows:
            yield close(_summed(held, key, total) if total else held)

    dealt = rows.repartitionByRange(workspace.partitions(spark), key).sortWithinPartitions(key)
    files = workspace.saved(dealt.mapInArrow(run, _FILES), "shards-list")
    return sorted(((r.path, r.first) for r in files.collect()), key=lambda f: f[1])


class Lookup:
    """Finds keys in files that write() made."""

    def __init__(self, files: list[tuple[str, int]], key: str, opened: int = 64):
        self.paths, self.firsts = [p for p, _ in files], np.array([f for _, f in files], dtype="<i8")
        self.key, self.opened = key, opened
        self.open: OrderedDict[int, pa.Table] = OrderedDict()

    def _table(self, k: int) -> pa.Table:
        if k not in self.open:
            fs, at = pafs.FileSystem.from_uri(self.paths[k])
            source = pa.memory_map(at) if isinstance(fs, pafs.LocalFileSystem) else fs.open_input_file(at)
            self.open[k] = pa.ipc.open_file(source).read_all()
            if len(self.open) > self.opened:
                self.open.popitem(last=False)
        self.open.move_to_end(k)
        return self.open[k]

    def find(self, keys: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, pa.Table]]:
        """(which, at, table) for each file that has some of the keys: the places of these in `keys`, and
        the first row of each in the table."""
        if not len(self.firsts) or not len(keys):
            return
        shard = np.searchsorted(self.firsts, keys, "right") - 1
        order = np.argsort(shard, kind="stable")
        edges = np.flatnonzero(np.r_[True, np.diff(shard[order]) != 0, True])
        for a, b in zip(edges, edges[1:], strict=False):
            which = order[a:b]
            if shard[which[0]] < 0:
                continue
            table = self._table(int(shard[which[0]]))
            there = table[self.key].chunk(0).to_numpy()
            at = np.searchsorted(there, keys[which])
            hit = there[np.minimum(at, len(there) - 1)] == keys[which]
            yield which[hit], at[hit], table
