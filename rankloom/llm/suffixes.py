"""Removal of repeated passages by names of anchored strings, in place of prefix doubling over all positions.

A byte goes if a string of ``threshold`` (100) bytes covers it that also starts earlier: in a smaller doc_id, or earlier
in the same document. Strings are judged on the input and may overlap; they never cross documents.

Prefix doubling sorts rank pairs of all positions at growing offsets: the name for 2 k bytes is made of the name for k bytes
at a place and at the place k further on, and places whose name is unique are dropped from the next round. Here names grow
in the tasks, and Spark sorts only anchors (see the README for why):

1. Within a task names grow from 1 to 64 bytes at every place; a name is a 64-bit mix of its pair. A string of 100 bytes
   contains 69 places of 32-byte names, and the least of these is its anchor. Equal strings have equal anchors, and
   neighbouring strings mostly share one, so that only one place in about 35 is sorted.
2. Spark sorts the anchors by (32-byte name, name of all bytes that strings of this anchor cover, place). Anchors with a
   unique 32-byte name are dropped. Where the longer name was met earlier, all strings of the anchor repeat: their bytes
   go. The first of each longer name goes on if the shorter one has several.
3. Spark sorts these again in runs of up to eight strings, which begin at fixed distances from the anchor, by the name of
   the 93 bytes that they share and that of all their bytes; what repeats goes, and a unique name of 93 bytes ends here.
4. Of the runs left, Spark sorts the strings one by one by their 100-byte name, the pair of the 64-byte names at a place
   and 36 further on. All but the first of each name repeat.
5. The places found are brought to their documents, and joined to spans there.

Copies met in one task are marked before the shuffle, so a passage that a third of all rows share sends one row per
task; the scan over sorted rows holds one batch. Names that decide have 128 bits, and are taken as the strings themselves.
A document is read in overlapping parts of about a quarter MB. Documents are shuffled once by doc_id and text, for 3. to 5.

A null text is empty. Rows without doc_id have no place in the order: they are returned whole and make no other string a
repeat; or, if ``nameless`` says so (the query and the pipeline do), they follow all ids by a hash of their text (but for
a table that has the largest long as an id). Rows that repeat a doc_id and its text are one document and answered each; other texts with the same doc_id are
documents of their own and follow each other by 128 bits of hashes, up to 2 ** 23 of them for one id (more are an error). An empty table gives no rows. Only doc_id and text are looked at, so other columns cannot clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankloom.functions.ranking import row_numbers
from rankloom.session import stable

THRESHOLD = 100
GRAM, LONG = 32, 64
PART = 1 << 18
HELD = 1 << 18  # anchors or strings held for marking copies before they are sent

# A place is packed in a long: 23 bits for the number of the text among those of its doc_id, a bit for anchors known to go
# on, 31 bits of the start (a text has at most 2 GB), 7 of the number of strings from there, which is not zero. The sign
# says that these strings are known to repeat.
_START, _VARIANT = 7, 40
_SEVERAL = np.int64(1 << 39)
_COVERED = np.int64(-1 << 63)
_VARIANTS = 1 << 23


def _start_of(place: np.ndarray) -> np.ndarray:
    return (place >> _START) & ((1 << 31) - 1)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9FB21C651E98DF25)
    return x ^ (x >> np.uint64(29))


def _pair(a: np.ndarray, b: np.ndarray, seed: int) -> np.ndarray:
    return _mix(a * np.uint64(0xD6E8FEB86659FD93 + 2 * seed) + b)


def _names(data: np.ndarray, seed: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """The names of the 32 and 64 bytes from each place where so many are left."""
    name, k, short = _mix(data.astype(np.uint64) + np.uint64(1 + 256 * seed)), 1, None
    while k < LONG:
        if k == GRAM:
            short = name
        name = _pair(name[:-k], name[k:], seed + k)
        k *= 2
    return short, name


def _anchors(data: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray, tuple[np.ndarray, np.ndarray]]:
    """For each place where a string of the threshold starts, its anchor; the names."""
    short, long = _names(data)
    bits = np.uint64(len(data).bit_length())
    least = ((short >> bits) << bits) | np.arange(len(short), dtype=np.uint64)
    width, k = threshold - GRAM + 1, 1
    while 2 * k <= width:
        least = np.minimum(least[:-k], least[k:])
        k *= 2
    if k < width:
        least = np.minimum(least[: len(least) - (width - k)], least[width - k :])
    return (least & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64), short, long


def _parts(text: bytes, threshold: int) -> Iterator[tuple[int, np.ndarray]]:
    """Overlapping parts in which each string of the threshold starts once; with where they start."""
    for at in range(0, len(text) - threshold + 1, PART):
        yield at, np.frombuffer(text, np.uint8, min(PART + threshold - 1, len(text) - at), at)


def _whole(long: np.ndarray, first: np.ndarray, count: np.ndarray, distance: np.ndarray, threshold: int) -> np.ndarray:
    """The name of all bytes of runs of strings, with where their anchor lies."""
    last = first + count - 1 + threshold - LONG  # where the last 64 bytes start
    name = _pair(long[first], long[np.minimum(first + LONG - 12, last)], 101)
    return _pair(_pair(name, long[last], 102), (count * 256 + distance).astype(np.uint64), 103)


def _runs(text: bytes, threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """By part: where it starts, and for each run of strings with one anchor the first string, how many there are, the
    name of the anchor and that of all their bytes."""
    for at, data in _parts(text, threshold):
        anchor, short, long = _anchors(data, threshold)
        first = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
        count = np.diff(np.append(first, len(anchor)))
        place = anchor[first]
        yield at, first, count, short[place], _whole(long, first, count, place - first, threshold)


class _Sender:
    """Collects rows (name, name, doc, place), marks copies within what it holds, and gives batches."""

    def __init__(self):
        self.rows: list[tuple[np.ndarray, ...]] = []
        self.held = 0

    def add(self, a: np.ndarray, b: np.ndarray, doc: int, place: np.ndarray) -> None:
        self.rows.append((a.view(np.int64), b.view(np.int64), np.full(len(a), doc, np.int64), place))
        self.held += len(a)

    def batch(self, anchors: bool) -> pa.RecordBatch:
        """Anchors whose a-name has several b-names here are known to go on. They are dealt out by both names, so that
        a very common a-name is spread over tasks, and one row with place 0 tells where the a-name itself goes; should
        an equal row get there from a task that did not know, both go on, and the next round finds them equal."""
        a, b, doc, place = (np.concatenate(x) for x in zip(*self.rows, strict=True))
        self.rows, self.held = [], 0
        order = np.lexsort((place, doc, b, a))
        a, b, doc, place = a[order], b[order], doc[order], place[order]
        same = np.concatenate([[False], (a[1:] == a[:-1]) & (b[1:] == b[:-1])])
        again = np.concatenate([[False], same[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1])])
        extra = np.zeros(0, np.int64)
        if anchors:
            group = np.cumsum(np.concatenate([[False], a[1:] != a[:-1]]))
            several = np.bincount(group, weights=~same)[group] > 1
            extra = np.unique(a[several])
            a = np.where(several, _pair(a.view(np.uint64), b.view(np.uint64), 106).view(np.int64), a)
            place = np.where(several, place | _SEVERAL, place)
        place = np.where(same, place | _COVERED, place)
        a = np.where(same, _mix(place.view(np.uint64)).view(np.int64), a)  # marked rows go anywhere
        b = np.where(same, 0, b)
        back = np.argsort(order)  # neighbours in a text stay neighbours, which packs better
        a, b, doc, place, again = a[back], b[back], doc[back], place[back], again[back]
        none = np.zeros_like(extra)
        columns = [pa.array(np.concatenate([x[~again], y])) for x, y in ((a, extra), (b, none), (doc, none), (place, none))]
        return pa.RecordBatch.from_arrays(columns, names=["a", "b", "doc", "place"])


def _send_anchors(threshold: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender()
        for batch in batches:
            for doc, text, variant in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), strict=True):
                text = text.as_py() or b""
                top = np.int64(variant) << _VARIANT
                for at, first, count, name, whole in _runs(text, threshold):
                    sender.add(name, whole, doc, top | ((at + first) << _START) | count)
                    if sender.held >= HELD:
                        yield sender.batch(True)
        if sender.held:
            yield sender.batch(True)

    return run


def _open_strings(text: bytes, places: np.ndarray, threshold: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """By part: where it starts, its bytes, and the starts in it of the strings at the places."""
    places = np.sort(places)
    start, count = _start_of(places), places & 127
    for at, data in _parts(text, threshold):
        here = slice(*np.searchsorted(start, [at, at + PART]))
        if here.start < here.stop:
            n = count[here]
            yield at, data, np.repeat(start[here] - at, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)


def _send_open(threshold: int, single: bool):
    """Documents with the places of their strings in question: runs of up to eight, or single ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _Sender()
        for batch in batches:
            columns = (batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()), batch.column(2).to_pylist(), batch.column(3))
            for doc, text, variant, places in zip(*columns, strict=True):
                text = text.as_py() or b""
                top = np.int64(variant) << _VARIANT
                for at, data, string in _open_strings(text, places.values.to_numpy(), threshold):
                    if single:
                        (_, one), (_, two) = _names(data, 0), _names(data, 1000)
                        further, count = string + threshold - LONG, np.ones(len(string), np.int64)
                        a, b = _pair(one[string], one[further], 104), _pair(two[string], two[further], 105)
                    else:
                        anchor, _, long = _anchors(data, threshold)
                        place = anchor[string]
                        step = (place - string) >> 3
                        first = np.flatnonzero(np.concatenate([[True], (place[1:] != place[:-1]) | (step[1:] != step[:-1]) | (np.diff(string) != 1)]))
                        count, string, place, step = np.diff(np.append(first, len(string))), string[first], place[first], step[first]
                        shared = place - 8 * step  # all strings of a step hold the bytes from here, seven fewer than their own
                        a = _pair(_pair(long[shared], long[shared + threshold - 7 - LONG], 107), step.astype(np.uint64), 108)
                        b = _whole(long, string, count, place - string, threshold)
                    sender.add(a, b, doc, top | ((at + string) << _START) | count)
                    if sender.held >= HELD:
                        yield sender.batch(not single)
        if sender.held:
            yield sender.batch(not single)

    return run


def _scan(keep_first: bool):
    """Rows sorted by names and place. Marked rows, and all but the first of each pair of names, are repeats; with
    ``keep_first`` the firsts of those a-names that have several b-names are given too."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last: tuple[int, ...] | None = None  # a, b, doc, place of the last unmarked row
        several, waiting = False, None  # of its a-name: whether it has several b-names, else its first row
        for batch in batches:
            a, b, doc, place = (batch.column(i).to_numpy() for i in range(4))
            marked = place < 0
            out = [(doc[marked], place[marked] ^ _COVERED, np.ones(int(marked.sum()), bool))]
            a, b, doc, place = (x[~marked] for x in (a, b, doc, place))
            if len(a):
                before = last or (~a[0], 0, 0, 0)
                prior = [np.concatenate([[np.int64(v)], x[:-1]]) for v, x in zip(before, (a, b, doc, place), strict=True)]
                same_a = a == prior[0]
                same = same_a & (b == prior[1])
                more = same & ((doc != prior[2]) | (place != prior[3])) & (place > 0)
                out.append((doc[more], place[more], np.ones(int(more.sum()), bool)))
                if keep_first:
                    first, group = ~same, np.cumsum(~same_a)  # group 0 is the last one of the batch before
                    kinds = np.bincount(group, weights=first * (1 + ((place == 0) | (place & _SEVERAL > 0))), minlength=group[-1] + 1)
                    kinds[0] += 1 + several if last else 0
                    give = first & (kinds[group] > 1) & (place > 0)
                    if waiting is not None and kinds[0] > 1:
                        out.append((np.array([waiting[0]]), np.array([waiting[1]]), np.zeros(1, bool)))
                        waiting = None
                    out.append((doc[give], place[give], np.zeros(int(give.sum()), bool)))
                    several = bool(kinds[-1] > 1)
                    if group[-1] > 0:
                        at = np.flatnonzero(first & (group == group[-1]))[0]
                        waiting = None if several else (doc[at], place[at])
                last = (a[-1], b[-1], doc[-1], place[-1])
            doc, place, repeats = (np.concatenate(x) for x in zip(*out, strict=True))
            yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(place & ~_SEVERAL), pa.array(repeats)], names=["doc", "place", "repeats"])

    return run


def spans(places: np.ndarray, threshold: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the maximal runs of bytes that the strings at the places cover."""
    start = _start_of(places)
    order = np.argsort(start, kind="stable")
    start, end = start[order], (start + (places & 127) - 1 + threshold)[order]
    if not len(start):
        return start, end
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    return start[new], np.append(reach[:-1][new[1:]], reach[-1])


def _cut(threshold: int, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for text, places in zip(batch.column(1).cast(pa.binary()), batch.column(batch.num_columns - 1), strict=True):
                text = text.as_py() or b""
                start, end = spans(places.values.to_numpy() if places.is_valid else np.zeros(0, np.int64), threshold)
                kept = b"".join(text[a:b] for a, b in zip([0, *end.tolist()], [*start.tolist(), len(text)], strict=True))
                rows.append((len(text), len(text) - len(kept), len(start), kept.decode(errors="ignore") if with_text else hashlib.sha256(kept).hexdigest()))
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
            columns = [pa.array(x, t) for x, t in zip(zip(*rows, strict=True) if rows else [()] * 4, kinds, strict=True)]
            rest = {"rest": batch.column(2)} if batch.num_columns > 3 else {}
            named = {"doc": batch.column(0)} | rest | dict(zip(("n_bytes", "n_removed", "n_spans", "kept"), columns, strict=True))
            yield pa.RecordBatch.from_arrays([*named.values()], names=[*named])

    return run


def last_id(docs: DataFrame) -> int | None:
    """The largest id, or zero, if rows without one can be placed after it."""
    r = docs.agg(F.max("doc_id").cast("long").alias("last"), F.count_if(F.col("doc_id").isNull()).alias("nameless")).first()
    top = max(0, r["last"] or 0)
    return top if r["nameless"] and top < (1 << 63) - 1 else None


def numbered_texts(texts: DataFrame) -> DataFrame:
    """``texts`` (doc, text, ...), with ``variant`` if some id has different texts: their number in the order of two hashes,
    128 bits together. Only ids and hashes are shuffled, and only ids with different texts are numbered."""
    names = [F.xxhash64("text").alias("h1"), F.xxhash64(F.lit("second"), "text").alias("h2")]
    hashed = texts.filter("doc IS NOT NULL").select("doc", *names)
    ends = hashed.groupBy("doc").agg(F.min(F.struct("h1", "h2")).alias("least"), F.max(F.struct("h1", "h2")).alias("most"))
    several = stable(ends.filter("least <> most").select("doc"))
    if several.isEmpty():
        return texts
    distinct = hashed.join(several, "doc", "left_semi").distinct()
    number = stable(row_numbers(distinct, ["doc"], ["h1", "h2"], "variant").withColumn("variant", (F.col("variant") - 1).cast("int")))
    if number.agg(F.max("variant")).first()[0] >= _VARIANTS:
        raise ValueError(f"an id has more than {_VARIANTS} different texts")
    found = texts.withColumns({"h1": names[0], "h2": names[1]}).join(number, ["doc", "h1", "h2"], "left")
    return found.select(*texts.columns, F.coalesce("variant", F.lit(0)).alias("variant"))


def remove_repeats(docs: DataFrame, threshold: int = THRESHOLD, with_text: bool = False, carry: list[str] | None = None, nameless: bool = False) -> DataFrame:
    """doc, n_bytes, n_removed, n_spans and kept: the SHA-256 of the bytes left, or with ``with_text`` the text left (of a
    character cut in two nothing is left). One row per document row. The columns named in ``carry`` come as a struct
    ``rest``."""
    if not LONG + 8 <= threshold <= 106:
        raise ValueError(f"the threshold must be from {LONG + 8} to 106 bytes")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rest = [F.struct(*carry).alias("rest")] if carry else []
    texts = docs.select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).alias("text"), *rest)
    top = last_id(docs) if nameless else None
    if top is not None:
        room = F.lit((1 << 63) - 1 - top)
        texts = texts.withColumn("doc", F.coalesce(F.col("doc").cast("long"), F.lit(top + 1) + F.pmod(F.xxhash64("text"), room)))

    texts = numbered_texts(texts)
    # without the column all texts are number 0, and the key of a document is its id
    own = ["doc", "variant"] if "variant" in texts.columns else ["doc"]
    number = F.col("variant") if len(own) > 1 else F.lit(0).alias("variant")

    def judged(sent: DataFrame, single: bool = False) -> DataFrame:
        """doc, variant, found (places that repeat), open (places that go on)."""
        rows = sent.repartition("a").sortWithinPartitions("a", "b", "doc", "place").mapInArrow(_scan(not single), "doc long, place long, repeats boolean")
        variant = F.shiftright("place", _VARIANT).cast("int").alias("variant")
        return rows.groupBy("doc", *[variant] * (len(own) - 1)).agg(F.collect_list(F.when(F.col("repeats"), F.col("place"))).alias("found"), F.collect_list(F.when(~F.col("repeats"), F.col("place"))).alias("open"))

    names = "a long, b long, doc long, place long"
    anchors = stable(judged(texts.select("doc", "text", number).filter("doc IS NOT NULL").mapInArrow(_send_anchors(threshold), names)))
    # all uses read the same columns, so that Spark shuffles the texts once
    placed = texts.repartition(parts, *own)

    def send_open(found: DataFrame, single: bool) -> DataFrame:
        going_on = placed.join(found.filter("size(open) > 0").select(*own, "open"), own).select(*placed.columns, "open")
        return judged(going_on.select("doc", "text", number, "open").mapInArrow(_send_open(threshold, single), names), single)

    runs = stable(send_open(anchors, False))
    strings = send_open(runs, True)
    none = F.expr("CAST(array() AS array<long>)")
    found = (
        anchors.select(*own, "found")
        .join(runs.select(*own, F.col("found").alias("more")), own, "left")
        .join(strings.select(*own, F.col("found").alias("most")), own, "left")
        .select(*own, F.concat("found", F.coalesce("more", none), F.coalesce("most", none)).alias("places"))
    )
    placed_columns = [c for c in placed.columns if c != "variant"]
    kind = "".join(f"{f.name} {f.dataType.simpleString()}, " for f in placed.schema if f.name not in ("text", "variant"))
    cut = (
        placed.join(found, own, "left")
        .select(*placed_columns, "places")
        .mapInArrow(_cut(threshold, with_text), f"{kind}n_bytes long, n_removed long, n_spans long, kept string")
    )
    return cut if top is None else cut.withColumn("doc", F.when(F.col("doc") <= top, F.col("doc")))


def without_repeats(docs: DataFrame, threshold: int = THRESHOLD) -> DataFrame:
    """The documents with all their columns, the text without its repeats. A null text stays null."""
    others = [c for c in docs.columns if c not in ("doc_id", "text")]
    had = F.col("text").isNull().alias("no_text")
    row = F.struct(*[F.col(f"`{c}`") for c in others] or [F.lit(1)]).alias("row")
    cut = remove_repeats(docs.select("doc_id", "text", had, row), threshold, True, ["no_text", "row"], nameless=True)
    text = F.when(~F.col("rest.no_text"), F.col("kept"))
    columns = {c: F.col(f"rest.row.`{c}`") for c in others} | {"doc_id": F.col("doc"), "text": text}
    return cut.select(*[columns[c].alias(c) for c in docs.columns])
