"""Lines of a JSON object that is read in blocks, in Arrow batches: what each line opens and closes, and the texts of the entries.

A task gets the lines of a block in order, so depths and entries are counted as they pass and nothing is shuffled for it. A batch is
looked at in steps of a megabyte: quotes, backslashes and brackets are found in its bytes at once, and only lines whose quotes do not pair up
as they should are searched by the pattern.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ..functions import fixed

#: `fixed.JSON_STRING` on the bytes of a text, where the dot leaves out what it leaves out in Java: the ends of lines.
JSON_STRING = re.compile(fixed.JSON_STRING.replace(".", r"(?!\xc2\x85|\xe2\x80[\xa8\xa9])[^\r\n]").encode())
#: Bytes of text that one numpy step looks at; a longer single line is searched by the pattern.
CHUNK_BYTES = 1 << 20
#: Blanks and commas before a line's first sign that are passed for all lines at once; a longer indent is passed alone.
INDENT = 64

QUOTE, ESCAPE, OPEN, CLOSE = 1, 2, 3, 4
_KIND = np.zeros(256, np.uint8)
for _signs, _kind in ((b'"', QUOTE), (b"\\", ESCAPE), (b"{[", OPEN), (b"}]", CLOSE)):
    _KIND[list(_signs)] = _kind

#: A block: two hashes of its file's path (the path itself, with every line, would be most of what a task is sent) and where it begins.
BLOCK = ["file", "check", "block"]
TOTALS = "file long, check long, block long, total long, named map<long,long>"
PIECES = "file long, check long, entry long, block long, at long, value string"


def _bytes_of(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts and where each text begins and the last one ends."""
    _, places, data = values.buffers()
    width = np.int64 if pa.types.is_large_string(values.type) else np.int32
    ends = np.frombuffer(places, width)[values.offset:values.offset + len(values) + 1].astype(np.int64)
    return (np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)), ends


def _first_signs(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Where each line begins after blanks, tabs and commas; its end if nothing else is there."""
    at, end = ends[:-1].copy(), ends[1:]
    open_ = np.flatnonzero(at < end)
    for _ in range(INDENT):
        sign = data[at[open_]]
        open_ = open_[(sign == 32) | (sign == 9) | (sign == 44)]
        at[open_] += 1
        open_ = open_[at[open_] < end[open_]]
        if not len(open_):
            return at
    for line in open_:
        text = data[at[line]:end[line]].tobytes()
        at[line] += len(text) - len(text.lstrip(b" \t,"))
    return at


def _one(text: bytes) -> tuple[int, bool]:
    bare = JSON_STRING.sub(b"s", text)
    step = sum(bare.count(sign) for sign in (b"{", b"[")) - sum(bare.count(sign) for sign in (b"}", b"]"))
    return step, bare.lstrip(b" \t,").startswith(b"s")


def _judged_chunk(data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    lines = len(ends) - 1
    low = ends[0]
    seen = _KIND[data[low:ends[-1]]]
    at = np.flatnonzero(seen)
    kind = seen[at]
    at = at + low
    firsts = np.searchsorted(at, ends)
    line = np.repeat(np.arange(lines), np.diff(firsts))
    number = np.arange(len(at))
    back = kind == ESCAPE
    after = np.zeros(len(at), bool)  # right behind a backslash of its line
    after[1:] = back[:-1] & (at[1:] == at[:-1] + 1) & (line[1:] == line[:-1])
    runs = np.maximum.accumulate(np.where(back & ~after, number, 0)) if len(at) else number
    escapes = back & ((number - runs) % 2 == 0)
    escaped = np.zeros(len(at), bool)
    escaped[1:] = after[1:] & escapes[:-1]
    quote = (kind == QUOTE) & ~escaped
    earlier = np.concatenate([[0], np.cumsum(quote)])
    inside = ((earlier[:-1] - earlier[firsts[:-1]][line]) & 1).astype(bool)
    counted = (kind >= OPEN) & ~inside
    steps = np.bincount(line[counted], np.where(kind[counted] == OPEN, 1, -1), minlength=lines).astype(np.int64)
    start = _first_signs(data, ends)
    head = np.where(start < ends[1:], data[np.minimum(start, len(data) - 1)], 0) if len(data) else np.zeros(lines, np.uint8)
    named = (head == ord('"')) | (head == ord("s"))
    # a quote without its end, a backslash outside of strings, and one before a sign that may be a line's end
    odd = np.bincount(line[quote], minlength=lines) % 2 == 1
    odd[line[back & ~inside]] = True
    maybe = at[escapes & inside] + 1
    odd[line[escapes & inside][np.isin(data[np.minimum(maybe, len(data) - 1)], (0xC2, 0xE2))] if len(maybe) else []] = True
    for i in np.flatnonzero(odd):
        steps[i], named[i] = _one(data[ends[i]:ends[i + 1]].tobytes())
    return steps, named


def judged(values: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Per line: brackets that it opens less those that it closes outside of strings, and whether it begins with a string."""
    data, ends = _bytes_of(values)
    steps, named = np.zeros(len(values), np.int64), np.zeros(len(values), bool)
    done = 0
    while done < len(values):
        upto = max(done + 1, int(np.searchsorted(ends, ends[done] + CHUNK_BYTES, "right")) - 1)
        if ends[upto] - ends[done] > CHUNK_BYTES:
            steps[done], named[done] = _one(data[ends[done]:ends[upto]].tobytes())
        else:
            steps[done:upto], named[done:upto] = _judged_chunk(data, ends[done:upto + 1])
        done = upto
    return steps, named


def _runs(batch: pa.RecordBatch) -> list[tuple[tuple[int, ...], int, int]]:
    """The parts of a batch that are of one block, each with its block."""
    columns = [batch.column(name).to_numpy() for name in BLOCK]
    other = np.any([column[1:] != column[:-1] for column in columns], axis=0)
    cuts = [0, *(np.flatnonzero(other) + 1).tolist(), batch.num_rows]
    return [(tuple(int(column[a]) for column in columns), a, b) for a, b in zip(cuts[:-1], cuts[1:])]


def block_totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per block (`TOTALS`): what its lines open less what they close, and how many lines begin with a string at each depth, counted from the block's begin."""
    rows: list[tuple[tuple[int, ...], int, list[tuple[int, int]]]] = []
    now, depth, found = None, 0, Counter()
    for batch in batches:
        if not batch.num_rows:
            continue
        steps, named = judged(batch.column("value"))
        for key, a, b in _runs(batch):
            if key != now:
                if now is not None:
                    rows.append((now, depth, sorted(found.items())))
                now, depth, found = key, 0, Counter()
            after = depth + np.cumsum(steps[a:b])
            values, counts = np.unique((after - steps[a:b])[named[a:b]], return_counts=True)
            found.update(dict(zip(values.tolist(), counts.tolist())))
            depth = int(after[-1])
    if now is not None:
        rows.append((now, depth, sorted(found.items())))
        keys, total, depths = zip(*rows)
        yield pa.RecordBatch.from_arrays(
            [*[pa.array(column, pa.int64()) for column in zip(*keys)], pa.array(total, pa.int64()), pa.array(depths, pa.map_(pa.int64(), pa.int64()))], [*BLOCK, "total", "named"])


def entry_pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The lines of each entry that lie in one batch of a block, as one text (`PIECES`); an object on a single line has a negative number of its own as entry.

    Lines come with the depth and the entries before their block, `base` and `first`.
    """
    now, depth, begun, last = None, 0, 0, -1
    for batch in batches:
        if not batch.num_rows:
            continue
        values = batch.column("value")
        steps, named = judged(values)
        data, ends = _bytes_of(values)
        at = batch.column("at").to_numpy()
        entry, kept, fresh = np.zeros(len(steps), np.int64), np.zeros(len(steps), bool), np.zeros(len(steps), bool)
        for key, a, b in _runs(batch):
            if key != now:
                now, depth, begun, last = key, batch.column("base")[a].as_py(), batch.column("first")[a].as_py(), -1
            if at[a] <= last or (np.diff(at[a:b]) <= 0).any():
                raise ValueError("the lines of a block did not come in order")
            after = depth + np.cumsum(steps[a:b])
            before = after - steps[a:b]
            number = begun + np.cumsum((before == 1) & named[a:b])
            own = (before >= 1) & (number > 0)
            for i in np.flatnonzero(own & (before == 1) & ~named[a:b]):  # the end of the whole object belongs to no entry
                own[i] = not data[ends[a + i]:ends[a + i + 1]].tobytes().lstrip(b" ").startswith(b"}")
            for i in np.flatnonzero(before == 0):
                if len(data[ends[a + i]:ends[a + i + 1]].tobytes().strip(b" ")) > 1:
                    own[i], number[i] = True, -1 - at[a + i]
            entry[a:b], kept[a:b], fresh[a] = np.where(own, number, entry[a:b]), own, True
            depth, begun, last = int(after[-1]), begun + int(((before == 1) & named[a:b]).sum()), int(at[b - 1])
        rows = np.flatnonzero(kept)
        if len(rows):
            run = np.cumsum(fresh)[rows]
            cuts = np.flatnonzero(np.concatenate([[True], (entry[rows][1:] != entry[rows][:-1]) | (run[1:] != run[:-1])]))
            texts = pa.ListArray.from_arrays(pa.array([*cuts.tolist(), len(rows)], pa.int32()), values.take(pa.array(rows)).cast(pa.string()))
            starts = rows[cuts]
            file, check, block = (batch.column(name).take(pa.array(starts)) for name in BLOCK)
            yield pa.RecordBatch.from_arrays(
                [file, check, pa.array(entry[starts]), block, pa.array(at[starts]), pc.binary_join(texts, "\n")], ["file", "check", "entry", "block", "at", "value"])
