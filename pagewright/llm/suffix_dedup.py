"""Removal of long repeated byte strings over a whole corpus, by suffix arrays.

A byte goes if a string of LENGTH bytes that covers it also starts anywhere else, in the same document or another. Strings are
judged on the input and never cross documents.

1. Every LENGTH-byte window names one anchor in it: the KEY-byte string of least hash, leftmost among equals. Equal windows name
   equal anchors at the same place in them, so only windows whose anchors occur twice need a look. Windows of one anchor are neighbours;
   they and what they cover are a snippet. A snippet is known by its anchor's hash and 64 bits of a cryptographic digest (BLAKE2b) of its bytes.
2. Snippets of one anchor string are put one after another, and their suffix array (lyndon.py, the linear grouping construction) brings
   windows that start alike together; neighbours with LENGTH bytes in common that occur at least twice are repeats. Snippets that are all equal
   are one string, whose suffixes have nothing to be ordered among: their number decides.
3. An anchor string with more than MOST_SNIPPETS different snippets (a passage that very many documents share) isn't gathered in one task. Its
   snippets are split into classes of CLASS_WINDOWS neighbouring windows, by the bytes that those have in common; step 2 then holds for each class.
   A class that still has too many (where very many texts part from a passage) is split into its windows: these are classes of one string each, counted
   under 128 bits of the digest, with partial sums.
4. Repeats go back to the occurrences and to the documents, where bytes are cut.

Defined results: a null or empty text has no bytes, and its digest is that of no bytes. Texts under LENGTH bytes stay. All copies
of a repeated string go, the first included. Repeated rows repeat each other's strings. An empty table gives an empty
result. Extra columns are ignored by ``digests`` and kept by ``without_repeats``.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagewright.llm.common import give_back, hidden, let_workers_import, number_of, numbered, shuffle_partitions
from pagewright.llm.lyndon import suffix_arrays
from pagewright.llm.pieces import mixed, powers, prefix_hashes, range_hashes, slices, text_buffer
from pagewright.llm.tiles import groups_of

LENGTH = 200
KEY = 64
WINDOWS = LENGTH - KEY + 1
#: Different snippets of one anchor that one task orders at most.
MOST_SNIPPETS = 64
#: About the root of the windows of a usual snippet: with parts of this many windows, and single windows of the parts that stay
#: large, a hot anchor gives the fewest rows.
CLASS_WINDOWS = 8
#: Bytes of snippets whose suffix arrays are made side by side, and of texts whose anchors are: a byte takes about 100 in a worker.
_SIDE_BY_SIDE = 1_200_000
_TEXTS_AT_A_TIME = 1 << 19
_CLASS, _CHECK, _TEXT, _MARKS, _REP = (hidden(x) for x in ("class", "check", "text", "marks", "rep"))
#: A document's check bits, an offset and a number of windows in one long: 23, 32 and 8 bits.
_CHECK_BITS = (1 << 23) - 1


def digests_of(whole: bytes, start: np.ndarray, end: np.ndarray, size: int = 8) -> np.ndarray:
    """Digests of the bytes from start to end, as rows of longs."""
    made = b"".join(hashlib.blake2b(whole[a:b], digest_size=size).digest() for a, b in zip(start.tolist(), end.tolist(), strict=True))
    return np.frombuffer(made, "<i8").reshape(-1, size // 8)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, ...]:
    """(hash of the anchor, first byte, number of windows, its text's number) of all snippets."""
    n = int(offsets[-1])
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none.astype(np.uint64), none, none, none
    prefix, (_, down) = prefix_hashes(data[:n]), powers(n + 1)
    keys = mixed((prefix[KEY:] - prefix[:-KEY]) * down[: n - KEY + 1])
    # a hash with its place below: the least is the leftmost of equal hashes
    placed = (keys & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(keys), dtype=np.uint64)
    blocks = -(-len(placed) // WINDOWS)
    padded = np.full(blocks * WINDOWS, np.uint64(2**64 - 1))
    padded[: len(placed)] = placed
    padded = padded.reshape(blocks, WINDOWS)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    back = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    windows = n - LENGTH + 1
    least = np.minimum(back[:windows], ahead[WINDOWS - 1 : WINDOWS - 1 + windows])
    sizes = np.diff(offsets)
    text = np.repeat(np.arange(len(sizes)), sizes)[:windows]
    starts = np.flatnonzero(np.arange(windows) + LENGTH <= offsets[1:][text])
    if not len(starts):
        return none.astype(np.uint64), none, none, none
    at = (least[starts] & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
    count = np.diff(np.append(first, len(at)))
    begin = starts[first]
    return keys[at[first]], begin, count, text[begin]


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text -> key, n: how many snippets of a part of the texts have an anchor."""
    for batch in batches:
        for part in slices(batch.column(0), _TEXTS_AT_A_TIME):
            key, n = np.unique(anchors(*text_buffer(part))[0].view(np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(n)], names=["key", "n"])
    give_back()


def _anchor_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """text, class, check -> key, snip, class, at, more.

    A snippet that a text repeats (a line or word over and over) is one row: where it stands first, and where else."""
    for batch in batches:
        done = 0
        for part in slices(batch.column(0), _TEXTS_AT_A_TIME):
            data, offsets = text_buffer(part)
            key, begin, count, text = anchors(data, offsets)
            snippet = digests_of(data.tobytes(), begin, begin + count - 1 + LENGTH)[:, 0].view(np.uint64)
            own, check = (batch.column(i).slice(done, len(part)).to_numpy()[text] for i in (1, 2))
            done += len(part)
            at = check << 40 | (begin - offsets[:-1][text]) << 8 | count
            order = np.argsort(mixed(key + snippet * np.uint64(3) + text.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)), kind="stable")
            key, snippet, text, own, at = (x[order] for x in (key, snippet, text, own, at))
            first = np.flatnonzero(np.append(True, (key[1:] != key[:-1]) | (snippet[1:] != snippet[:-1]) | (text[1:] != text[:-1]))[: len(key)])
            ends = np.append(first[1:], len(key))
            back = np.argsort(order[first])  # in the texts' order, which a shuffle's compression likes
            first, ends = first[back], ends[back]
            more: list[np.ndarray | None] = [None] * len(first)
            for i in np.flatnonzero(ends - first > 1).tolist():
                more[i] = at[first[i] + 1 : ends[i]]
            yield pa.RecordBatch.from_arrays([*(pa.array(x[first]) for x in (key.view(np.int64), snippet.view(np.int64), own, at)), pa.array(more, pa.list_(pa.int64()))], names=["key", "snip", _CLASS, "at", "more"])
    give_back()


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and values of a list array; nulls are empty lists."""
    return column.offsets.to_numpy() - column.offsets[0].as_py() if len(column) else np.zeros(1, np.int64), column.flatten()


def _wanted(batch: pa.RecordBatch):
    """For each row that stands for its class: its bytes and the snippets to take from it. Columns: doc_id, text, check, rep, wanted."""
    same = [a == b for a, b in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True)]
    checks = batch.column(2).to_pylist()
    for row in np.flatnonzero(same).tolist():
        text = batch.column(1)[row].as_py().encode()
        items = batch.column(4)[row].values
        key, snip, at, copies = (items.field(i).to_numpy() for i in range(4))
        mine = at >> 40 == checks[row]
        yield text, key[mine], snip[mine], (at[mine] >> 8) & 0xFFFFFFFF, at[mine] & 255, copies[mine]


def _snippet_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows: list[tuple] = []
        for text, *columns in _wanted(batch):
            rows += [(k, s, c, text[b : b + n - 1 + LENGTH]) for k, s, b, n, c in zip(*(x.tolist() for x in columns), strict=True)]
        columns = [*zip(*rows, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["key", "snip", "copies", "bytes"])


def _part_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The parts of the wanted snippets: windows whose distances to the anchor fall into one class, under a key of the class and the bytes common to it.

    Columns: key2, snip2, copies, bytes, then the snippet (key, snip) that it is from, its first window there and its number of windows."""
    for batch in batches:
        rows: list[tuple] = []
        for text, key, snip, begin, count, copies in _wanted(batch):
            data = np.frombuffer(text, np.uint8)
            prefix, (_, down) = prefix_hashes(data), powers(len(data) + 1)
            hashes = mixed((prefix[KEY:] - prefix[:-KEY]) * down[: len(data) - KEY + 1]).view(np.int64)
            for k, s, b, n, c in zip(*(x.tolist() for x in (key, snip, begin, count, copies)), strict=True):
                anchor = b + int((hashes[b : b + WINDOWS] == k).argmax())
                for kind in range((anchor - b - n + 1) // CLASS_WINDOWS, (anchor - b) // CLASS_WINDOWS + 1):
                    last = anchor - kind * CLASS_WINDOWS  # the last window that the class can have
                    low, high = max(b, last - CLASS_WINDOWS + 1), min(b + n - 1, last)
                    rows.append((k, kind, last, low, high, s, c, b))
            if not rows:
                continue
            k, kind, last, low, high, s, c, b = (np.array(x, np.int64) for x in zip(*rows, strict=True))
            common = range_hashes(prefix, last, last - CLASS_WINDOWS + 1 + LENGTH)
            key2 = mixed(common ^ (k.view(np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ (kind.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            snip2 = digests_of(text, low, high + LENGTH)[:, 0]
            parts = [text[x:y] for x, y in zip(low.tolist(), (high + LENGTH).tolist(), strict=True)]
            rows = []
            yield pa.RecordBatch.from_arrays([pa.array(key2.view(np.int64)), pa.array(snip2), pa.array(c), pa.array(parts, pa.binary()), pa.array(k), pa.array(s), pa.array(low - b), pa.array(high - low + 1)], names=["key2", "snip2", "copies", "bytes", "key", "snip", "low", "n"])


def _window_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, snip, copies, bytes -> a row for each window: its digest, key, snip, offset, copies."""
    for batch in batches:
        whole = b"".join(batch.column(3).to_pylist())
        sizes = pc.binary_length(batch.column(3)).to_numpy()
        count = sizes - LENGTH + 1
        rows = np.repeat(np.arange(len(sizes)), count)
        offset = np.arange(len(rows)) - np.repeat(np.cumsum(count) - count, count)
        start = (np.cumsum(sizes) - sizes)[rows] + offset
        one, two = (np.ascontiguousarray(x) for x in digests_of(whole, start, start + LENGTH, 16).T)
        key, snip, copies = (batch.column(i).to_numpy()[rows] for i in range(3))
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in (one, two, key, snip, offset, copies)], names=["w1", "w2", "key", "snip", "off", "copies"])


def repeated_windows(groups: list[list[bytes]], copies: list[list[int]]) -> list[list[np.ndarray]]:
    """For each snippet of each group, which of its windows occur at least twice in the group, copies counted."""
    sizes = [len(s) for g in groups for s in g]
    last = np.cumsum([len(g) for g in groups]) - 1
    marks = np.full(len(sizes), 1, np.uint8)
    marks[last] = 0
    snippet_starts = np.cumsum(np.array(sizes) + 1) - sizes - 1
    data = np.frombuffer(b"\0".join(s for g in groups for s in g) + b"\0", np.uint8)
    symbols = data.astype(np.int64) + 2
    symbols[snippet_starts + sizes] = marks  # 1 between the snippets of a group, 0 behind the last
    group_starts = np.append(snippet_starts[np.append(0, last[:-1] + 1)], len(symbols))
    order = suffix_arrays(symbols, group_starts)
    owner = np.repeat(np.arange(len(sizes)), np.array(sizes) + 1)
    group = np.repeat(np.arange(len(groups)), [len(g) for g in groups])
    order = order[order + LENGTH <= (snippet_starts + sizes)[owner[order]]]
    whole = np.lib.stride_tricks.sliding_window_view(data, LENGTH)
    alike = np.zeros(len(order), bool)  # with the one before
    for at in range(1, len(order), 100_000):
        a, b = order[at - 1 : at + 99_999], order[at : at + 100_000]
        a = a[: len(b)]
        alike[at : at + len(b)] = (group[owner[a]] == group[owner[b]]) & (whole[a] == whole[b]).all(axis=1)
    repeated = np.zeros(len(symbols), bool)
    if len(order):
        weight = np.concatenate([np.asarray(c, np.int64) for c in copies])[owner[order]]
        runs = np.flatnonzero(~alike)
        total = np.add.reduceat(weight, runs)
        repeated[order] = np.repeat(total >= 2, np.diff(np.append(runs, len(order))))
    each = iter([repeated[a : a + max(0, n - LENGTH + 1)] for a, n in zip(snippet_starts.tolist(), sizes, strict=True)])
    return [[next(each) for _ in g] for g in groups]


def _order_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key, snip, copies, bytes, with the rows of a key together -> key, snip, run (first window * 256 + the one behind the last).

    Strings of about the same length are ordered side by side: the longest one decides how many steps that takes."""
    held: dict[int, list[tuple]] = {}
    sizes: dict[int, int] = {}

    def done(kind: int) -> pa.RecordBatch:
        groups = held.pop(kind)
        sizes.pop(kind)
        made = repeated_windows([g[2] for g in groups], [g[3] for g in groups])
        rows = []
        for (key, snips, _, _), found in zip(groups, made, strict=True):
            for snip, mask in zip(snips, found, strict=True):
                edge = np.flatnonzero(np.diff(np.concatenate([[0], mask, [0]])))
                rows += [(key, snip, a * 256 + b) for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True)]
        columns = [*zip(*rows, strict=True)] or [[]] * 3
        return pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in columns], names=["key", "snip", "run"])

    for table in groups_of(batches, 1):
        own = {s: (b, c) for s, c, b in zip(*(table.column(i).to_pylist() for i in (1, 2, 3)), strict=True)}  # a row whose id repeats gives a snippet again
        size = sum(len(b) for b, _ in own.values())
        kind = size.bit_length()
        held.setdefault(kind, []).append((table.column(0)[0].as_py(), [*own], [b for b, _ in own.values()], [c for _, c in own.values()]))
        sizes[kind] = sizes.get(kind, 0) + size
        if sum(sizes.values()) >= _SIDE_BY_SIDE:
            yield done(max(sizes, key=sizes.__getitem__))
    for kind in sorted(held):
        yield done(kind)
    give_back()


def _with_class(docs: DataFrame, text_col: str) -> DataFrame:
    text = docs.withColumn(_TEXT, F.coalesce(F.col(text_col), F.lit("")))
    return text.withColumns({_CLASS: F.xxhash64(_TEXT), _CHECK: F.xxhash64(F.lit("check"), F.col(_TEXT)).bitwiseAND(F.lit(_CHECK_BITS))})


def _marks(own: DataFrame, id_col: str) -> DataFrame:
    """class -> marks: the repeated stretches of its texts, each as check bits, first window and number of windows in one long."""
    spark = own.sparkSession
    base = own.select(F.col(id_col).alias("doc_id"), _TEXT, _CLASS, _CHECK)
    every = base.filter(F.octet_length(_TEXT) >= LENGTH).select(_TEXT, _CLASS, _CHECK).mapInArrow(_anchor_batches, f"key long, snip long, {_CLASS} long, at long, more array<long>")
    times = F.lit(1).cast("long") + F.coalesce(F.size("more"), F.lit(0))
    # no value is null; saying so here keeps joins from adding their own filters, which would make the exchanges differ
    every = every.filter(F.col("key").isNotNull() & F.col("snip").isNotNull() & F.col(_CLASS).isNotNull() & F.col("at").isNotNull())
    counted = base.filter(F.octet_length(_TEXT) >= LENGTH).select(_TEXT).mapInArrow(_count_batches, "key long, n long").filter("key IS NOT NULL")
    twice = counted.groupBy("key").agg(F.sum("n").alias("n")).filter("n > 1").select("key")
    seen = every.join(twice.hint("shuffle_hash"), "key")
    # The least occurrence stands for its snippet: the same one in every use, whatever is computed again. The filter keeps all rows: with it, every use of
    # the snippets reads all columns, so that Spark makes the anchors' exchange once and reuses it.
    # (Longs, and not a struct of them, so that a hash aggregate holds them.)
    snippets = seen.groupBy("key", "snip").agg(F.sum(times).alias("copies"), F.min(_CLASS).alias(_CLASS), F.min_by("at", _CLASS).alias("at"))
    snippets = snippets.filter(F.col(_CLASS).isNotNull() & F.col("at").isNotNull() & (F.col("copies") > 0))
    kinds = snippets.groupBy("key").agg(F.count("*").alias("kinds"))
    sorted_out = snippets.join(kinds.hint("shuffle_hash"), "key")
    all_equal = sorted_out.filter("kinds = 1").select("key", "snip", F.lit(WINDOWS).cast("long").alias("run"))

    reps = base.groupBy(_CLASS).agg(F.min("doc_id").alias(_REP))

    def from_texts(which: Column, make, schema: str) -> DataFrame:
        wanted = sorted_out.filter(which).groupBy(_CLASS).agg(F.collect_list(F.struct("key", "snip", "at", "copies")).alias("wanted"))
        # of copies of a text, the representative's row alone leaves the join; put so that it is no key, and the texts' exchange is the one that the result reads, too
        stands = F.coalesce(F.col("doc_id") == F.col(_REP), F.col("doc_id").isNull() & F.col(_REP).isNull())
        joined = base.join(wanted.join(reps, _CLASS).hint("shuffle_hash"), _CLASS).filter(stands)
        return joined.select("doc_id", _TEXT, _CHECK, _REP, "wanted").mapInArrow(make, schema)

    def ordered_runs(rows: DataFrame) -> DataFrame:
        return rows.repartition(shuffle_partitions(spark), "key").sortWithinPartitions("key").mapInArrow(_order_batches, "key long, snip long, run long")

    few = from_texts((F.col("kinds") > 1) & (F.col("kinds") <= MOST_SNIPPETS), _snippet_batches, "key long, snip long, copies long, bytes binary")
    ordered = ordered_runs(few)

    # The hot anchors' windows by parts. A row whose id repeats gives its parts again, but then their copies are two already.
    parts = from_texts(F.col("kinds") > MOST_SNIPPETS, _part_batches, "key2 long, snip2 long, copies long, bytes binary, key long, snip long, low long, n long")
    counted = parts.groupBy(F.col("key2").alias("key"), F.col("snip2").alias("snip")).agg(F.sum("copies").alias("copies"), F.first("bytes").alias("bytes"))
    part_kinds = counted.groupBy("key").agg(F.count("*").alias("kinds"), F.sum("copies").alias("n")).filter("n > 1").select("key", "kinds")
    known = counted.join(part_kinds.hint("shuffle_hash"), "key")
    equal_parts = known.filter("kinds = 1").select("key", "snip", F.lit(WINDOWS).cast("long").alias("run"))
    part_rows = known.filter((F.col("kinds") > 1) & (F.col("kinds") <= MOST_SNIPPETS)).select("key", "snip", "copies", "bytes")
    ordered_parts = ordered_runs(part_rows)
    many = known.filter(F.col("kinds") > MOST_SNIPPETS).select("key", "snip", "copies", "bytes").mapInArrow(_window_batches, "w1 long, w2 long, key long, snip long, off long, copies long")
    repeated = many.groupBy("w1", "w2").agg(F.sum("copies").alias("n")).filter("n > 1").select("w1", "w2")
    places = many.join(repeated.hint("shuffle_hash"), ["w1", "w2"]).groupBy("key", "snip").agg(F.array_sort(F.collect_set("off")).alias("offs"))
    stretch = places.select("key", "snip", F.posexplode("offs").alias("n", "off")).groupBy("key", "snip", (F.col("off") - F.col("n")).alias("island"))
    counted_parts = stretch.agg((F.min("off") * 256 + F.max("off") + 1).alias("run")).select("key", "snip", "run")
    part_runs = equal_parts.unionByName(ordered_parts).unionByName(counted_parts).select(F.col("key").alias("key2"), F.col("snip").alias("snip2"), "run")
    from_parts = parts.drop("bytes", "copies").join(part_runs.hint("shuffle_hash"), ["key2", "snip2"])
    first, behind = F.shiftright("run", 8), F.least(F.col("run").bitwiseAND(F.lit(255)), F.col("n"))
    split = from_parts.select("key", "snip", ((F.col("low") + first) * 256 + F.col("low") + behind).alias("run")).distinct()

    runs = all_equal.unionByName(ordered).unionByName(split)
    found = seen.join(runs.hint("shuffle_hash"), ["key", "snip"]).select(_CLASS, "run", F.explode(F.concat(F.array("at"), F.coalesce("more", F.array().cast("array<long>")))).alias("at"))
    windows = F.col("at").bitwiseAND(F.lit(255))
    low, high = F.shiftright("run", 8), F.least(F.col("run").bitwiseAND(F.lit(255)), windows)
    return found.groupBy(_CLASS).agg(F.collect_set(F.col("at") - windows + low * 256 + high - low).alias(_MARKS))


def removed_spans(marks: np.ndarray, check: int) -> np.ndarray:
    """Maximal removed runs, as rows of begin and end."""
    marks = np.sort(marks[marks >> 40 == check])
    begin = (marks >> 8) & 0xFFFFFFFF
    end = np.maximum.accumulate(begin + (marks & 255) - 1 + LENGTH) if len(marks) else begin
    new = np.flatnonzero(np.append(True, begin[1:] > end[:-1])) if len(marks) else np.zeros(0, np.int64)
    return np.column_stack([begin[new], end[np.append(new[1:] - 1, len(marks) - 1)] if len(marks) else new])


def _rest(text: bytes, spans: np.ndarray) -> bytes:
    edges = [0, *spans.ravel().tolist(), len(text)]
    return b"".join(text[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))


def _rows(batch: pa.RecordBatch):
    """The last three columns are text, check, marks."""
    offsets, values = _lists(batch.column(batch.num_columns - 1))
    values, checks = values.to_numpy(zero_copy_only=False), batch.column(batch.num_columns - 2).to_pylist()
    nulls = batch.column(batch.num_columns - 1).is_null().to_numpy(zero_copy_only=False)
    for row, text in enumerate(batch.column(batch.num_columns - 3)):
        marks = values[offsets[row] : offsets[row + 1]] if not nulls[row] else values[:0]
        yield text.as_py().encode(), removed_spans(marks.astype(np.int64), checks[row])


def _digest_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = [(len(text), int((spans[:, 1] - spans[:, 0]).sum()), len(spans), hashlib.sha256(_rest(text, spans)).hexdigest()) for text, spans in _rows(batch)]
        columns = [*zip(*rows, strict=True)] or [[]] * 4
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, t) for x, t in zip(columns, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _text_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        kept = [_rest(text, spans).decode("utf-8", "ignore") for text, spans in _rows(batch)]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-3], pa.array(kept, pa.string())], names=[*batch.schema.names[:-3], _TEXT])


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: n_bytes, n_removed, n_spans and the sha256 of what is left."""
    let_workers_import(docs.sparkSession)
    own = _with_class(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")), "text").select("doc_id", _TEXT, _CLASS, _CHECK)
    joined = own.join(_marks(own, "doc_id").hint("shuffle_hash"), _CLASS, "left")
    kind = own.schema["doc_id"].dataType.simpleString()
    return joined.select("doc_id", _TEXT, _CHECK, _MARKS).mapInArrow(_digest_batches, f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents with their columns, whatever their names, repeats cut from the text. Bytes of a character that a cut has split go too. A null text becomes empty."""
    let_workers_import(docs.sparkSession)
    rows, text = numbered(docs), number_of(docs, text_col)
    own = _with_class(rows, text)
    joined = own.join(_marks(own, number_of(docs, id_col)).hint("shuffle_hash"), _CLASS, "left")
    rest = [c for c in rows.columns if c != text]
    schema = ", ".join([*(f"{c} {rows.schema[c].dataType.simpleString()}" for c in rest), f"{_TEXT} string"])
    cut = joined.select(*rest, _TEXT, _CHECK, _MARKS).mapInArrow(_text_batches, schema)
    return cut.select(*(F.col(_TEXT if c == text else c) for c in rows.columns)).toDF(*docs.columns)
