"""Long exact spans shared between records.

Method: hashing of units. Residues have no lines or paragraphs, so the unit is cut by content: among
the q-grams of a window of ``length`` letters the one with the smallest hash is its anchor, and a
unit is what consecutive windows with the same anchor cover. Equal texts are cut alike wherever they
stand. Digests of units are grouped over all records, the earliest record (smallest id) of each is
kept as its representative, and offsets are carried along.

Exactness: a unit that stands in two records makes all its windows shared. Where units with one
anchor differ (they begin or end at the edge of a shared stretch, or hold an edit), their windows are
compared one by one, each distinct unit once. So the result is that of comparing all windows, while
about one unit for every 30 letters is shuffled, and of most of these only the anchor: a window that stands in
two texts has the same anchor in both, so units of anchors of one text are done with. Digests have 128
bits and are made of code points, so every letter of Unicode counts as itself.

Copies: equal residues are first grouped by digest and only the earliest is cut into units; all
windows of a text that several records hold are shared without further work. Residues aren't shuffled for
that: a table of ids and digests is, and it is joined to the residues by broadcast where it is small.

Windows with ten or more n/N in a row don't count. Null, empty or short residues give no row. A
repeated row of one record_id is not another record. Memory: residues are cut in blocks of 2 million
letters, so that a chromosome needs little more than its own size; stretches are merged by a sort within
their record, in linear time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqloom.session import cut, spread

LENGTH, GRAM, GAP = 80, 24, 10
BLOCK = 2_000_000
_UNIT_SCHEMA = "text_id long, start long, n_windows long, anchor long, digest binary"
_WINDOW_SCHEMA = "text_id long, at long, asks boolean, window binary"
_SPAN_SCHEMA = "record_id long, span_start long, span_end long"


def _gram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram: polynomial by doubling, then mixed, so that no letter is favoured."""
    with np.errstate(over="ignore"):
        base = np.uint64(0x9E3779B97F4A7C15)
        piece, width = codes.astype(np.uint64) + np.uint64(1), 1
        out, done = None, 0
        power = base
        while q:
            if q & 1:
                if out is None:
                    out, done = piece, width
                else:
                    n = len(codes) - done - width + 1
                    out, done = out[:n] * power + piece[done : done + n], done + width
            q >>= 1
            if q:
                n = len(piece) - width
                piece = piece[:n] * power + piece[width : width + n]
                width, power = width * 2, power * power
        out = out ^ (out >> np.uint64(29))
        out = out * np.uint64(0xBF58476D1CE4E5B9)
        out = out ^ (out >> np.uint64(32))
        out = out * np.uint64(0x94D049BB133111EB)
        return out ^ (out >> np.uint64(31))


def _first_minimum(values: np.ndarray, width: int) -> np.ndarray:
    """Place of the first smallest value in each run of ``width`` values, by doubling."""
    best, places, have = values, np.arange(len(values)), 1
    while have < width:
        step = min(have, width - have)
        n = len(best) - step
        right = best[step : step + n] < best[:n]
        best, places = np.where(right, best[step : step + n], best[:n]), np.where(right, places[step : step + n], places[:n])
        have += step
    return places


def valid_windows(codes: np.ndarray, length: int = LENGTH, gap: int = GAP) -> np.ndarray:
    """Whether the window at each place has no run of ``gap`` or more n."""
    n = len(codes) - length + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for a, b in runs((codes == ord("n")) | (codes == ord("N"))):
        if b - a >= gap:  # a window holds ten of them if it begins after a + gap - length - 1 and before b - gap + 1
            ok[max(0, a + gap - length) : max(0, b - gap + 1)] = False
    return ok


def runs(flags: np.ndarray) -> Iterator[tuple[int, int]]:
    edges = np.flatnonzero(np.diff(np.concatenate(([0], flags.view(np.int8), [0]))))
    return zip(edges[::2].tolist(), edges[1::2].tolist())


class Letters:
    """Code points of a text, one number a letter, and digests of its parts.

    Texts of Latin-1 letters take one byte a letter, others four; a part gives one digest in both.
    """

    def __init__(self, text: str):
        try:
            self.data = text.encode("latin-1")
            self.codes = np.frombuffer(self.data, np.uint8)
        except UnicodeEncodeError:
            self.data = None
            self.codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)

    def __len__(self) -> int:
        return len(self.codes)

    def digest(self, start: int, end: int) -> bytes:
        if self.data is not None:
            return xxhash.xxh3_128_digest(self.data[start:end])
        part = self.codes[start:end]
        if part.max(initial=0) < 256:
            return xxhash.xxh3_128_digest(part.astype(np.uint8).tobytes())
        return xxhash.xxh3_128_digest(part.tobytes(), seed=1)


def units(text: Letters, length: int = LENGTH, gram: int = GRAM) -> Iterator[tuple[int, int, int, bytes]]:
    """(start, windows, anchor, digest) of each unit; each valid window belongs to exactly one."""
    total = len(text) - length + 1
    for at in range(0, max(total, 0), BLOCK):
        codes = text.codes[at : at + BLOCK + length - 1]
        ok = valid_windows(codes, length)
        hashes = _gram_hashes(codes, gram)
        place = _first_minimum(hashes, length - gram + 1)
        change = np.flatnonzero(np.diff(place) | np.diff(ok.view(np.int8))) + 1
        starts = np.concatenate(([0], change))
        ends = np.concatenate((change, [len(place)]))
        keep = ok[starts]
        starts, ends = starts[keep], ends[keep]
        anchors = hashes[place[starts]].view(np.int64)
        for a, b, anchor in zip(starts.tolist(), ends.tolist(), anchors.tolist()):
            yield at + a, b - a, anchor, text.digest(at + a, at + b + length - 1)


def _cut_units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("text_id", pa.int64()), ("start", pa.int64()), ("n_windows", pa.int64()), ("anchor", pa.int64()), ("digest", pa.binary())])
    rows: list[tuple] = []
    for batch in batches:
        for text_id, residues in zip(batch.column(0).to_pylist(), batch.column(1)):
            for unit in units(Letters(residues.as_py())):
                rows.append((text_id, *unit))
                if len(rows) == 100_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows = []
    if rows:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), schema)], schema=schema)


def _cut_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text_id, residues, units) to one row for each window of the named units."""
    for batch in batches:
        for text_id, residues, wanted in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2)):
            text = Letters(residues.as_py())
            at, asks, digests = [], [], []
            for unit in wanted.as_py():
                for p in range(unit["start"], unit["start"] + unit["n_windows"]):
                    at.append(p)
                    asks.append(unit["asks"])
                    digests.append(text.digest(p, p + LENGTH))
            for lo in range(0, len(at), 50_000):
                hi = lo + 50_000
                yield pa.RecordBatch.from_arrays(
                    [pa.array([text_id] * len(at[lo:hi]), pa.int64()), pa.array(at[lo:hi], pa.int64()), pa.array(asks[lo:hi], pa.bool_()), pa.array(digests[lo:hi], pa.binary())],
                    names=["text_id", "at", "asks", "window"],
                )


def _whole_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Stretches covered by valid windows, for texts of which each window is shared."""
    for batch in batches:
        ids, starts, ends = [], [], []
        for record_id, residues in zip(batch.column(0).to_pylist(), batch.column(1)):
            for a, b in runs(valid_windows(Letters(residues.as_py()).codes)):
                ids.append(record_id)
                starts.append(a)
                ends.append(b - 1 + LENGTH)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], names=["record_id", "span_start", "span_end"]
        )


def _placed(records: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, DataFrame]:
    """Texts (record_id, text_key, residues) of windows, and (record_id, text_key, text_id, last_id): the first and last record of each."""
    texts = records.select(F.col(id_col).cast("long").alias("record_id"), F.unhex(F.md5(F.col(text_col).cast("binary"))).alias("text_key"), F.col(text_col).alias("residues"))
    texts = texts.where(F.col("record_id").isNotNull() & (F.length("residues") >= LENGTH))
    ids = texts.select("record_id", "text_key").distinct()
    heads = ids.groupBy("text_key").agg(F.min("record_id").alias("text_id"), F.max("record_id").alias("last_id"))
    return texts, cut(ids.join(heads, "text_key"))


def shared_spans(records: DataFrame, id_col: str = "record_id", text_col: str = "residues") -> DataFrame:
    """(record_id, span_start, span_end): one row for each maximal stretch covered by shared windows."""
    texts, places = _placed(records, id_col, text_col)
    firsts = places.where("record_id = text_id").select("record_id", "text_key", "text_id", (F.col("last_id") != F.col("text_id")).alias("copied"))
    # repeated rows of one record are cut alike, so they add nothing that distinct units don't hold
    first = texts.join(firsts, ["record_id", "text_key"])
    copied = texts.join(places.where("last_id != text_id").select("record_id", "text_key"), ["record_id", "text_key"], "left_semi")
    whole = copied.select("record_id", "residues").mapInArrow(_whole_texts, _SPAN_SCHEMA)

    cut_units = cut(spread(first.select("text_id", "residues")).mapInArrow(_cut_units, _UNIT_SCHEMA))
    anchors = cut_units.groupBy("anchor").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b")).where("a != b").select("anchor")
    few = cut(cut_units.join(cut(anchors), "anchor", "left_semi"))
    distinct = few.groupBy("anchor", "digest").agg(
        F.min("text_id").alias("text_id"),
        F.max("text_id").alias("last_id"),
        F.min(F.struct("text_id", "start", "n_windows")).alias("unit"),
    )
    per_anchor = distinct.groupBy("anchor").agg(F.count("*").alias("n"), F.sum((F.col("text_id") == F.col("last_id")).cast("int")).alias("n_single"))
    mixed = per_anchor.where("n > 1 AND n_single > 0").select("anchor")
    shared = distinct.where("text_id != last_id").select("anchor", "digest")
    # stretches of units that stand in several texts
    hits = few.join(shared, ["anchor", "digest"], "left_semi").select("text_id", "start", (F.col("start") + F.col("n_windows") - 1 + LENGTH).alias("end"))
    # units to compare window by window: those of one text ask, one copy of each shared unit answers
    asking = few.join(mixed, "anchor", "left_semi").join(shared, ["anchor", "digest"], "left_anti")
    asking = asking.select("text_id", "start", "n_windows", F.lit(True).alias("asks"))
    answering = distinct.where("text_id != last_id").join(mixed, "anchor", "left_semi").select("unit.*", F.lit(False).alias("asks"))
    wanted = cut(asking.unionByName(answering).groupBy("text_id").agg(F.collect_set(F.struct("start", "n_windows", "asks")).alias("units")))
    windows = cut(spread(first.select("text_id", "residues").join(wanted, "text_id")).mapInArrow(_cut_windows, _WINDOW_SCHEMA))
    both = windows.groupBy("window").agg(F.min("text_id").alias("a"), F.max("text_id").alias("b"), F.min("asks").alias("every_asks"))
    both = both.where((F.col("a") != F.col("b")) | ~F.col("every_asks")).select("window")
    single = windows.where("asks").join(both, "window", "left_semi").select("text_id", F.col("at").alias("start"), (F.col("at") + LENGTH).alias("end"))
    pieces = hits.unionByName(single).join(firsts.where("NOT copied").select("text_id"), "text_id", "left_semi")
    pieces = pieces.select(F.col("text_id").alias("record_id"), F.col("start").alias("span_start"), F.col("end").alias("span_end"))
    return _islands(whole.unionByName(pieces))


def shared_share(records: DataFrame, spans: DataFrame) -> DataFrame:
    """For each record: letters, letters in shared stretches, and their share (0 where it has none)."""
    covered = spans.groupBy("record_id").agg(F.sum(F.col("span_end") - F.col("span_start")).alias("shared"), F.count("*").alias("n_spans"))
    sizes = records.groupBy("record_id").agg(F.max(F.coalesce(F.length("residues"), F.lit(0))).cast("long").alias("letters"))
    out = sizes.join(covered, "record_id", "left").fillna(0, ["shared", "n_spans"])
    return out.withColumn("share", F.coalesce(F.try_divide("shared", "letters"), F.lit(0.0)))


def _span_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (text_id, last_id, residues, spans) to one row for each valid window within the spans."""
    for batch in batches:
        for text_id, last_id, residues, spans in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3)):
            text = Letters(residues.as_py())
            for span in spans.as_py():
                for lo in range(span["span_start"], span["span_end"] - LENGTH + 1, 50_000):
                    at = lo + np.flatnonzero(valid_windows(text.codes[lo : min(lo + 50_000 + LENGTH - 1, span["span_end"])]))
                    digests = [text.digest(p, p + LENGTH) for p in at.tolist()]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([text_id] * len(at), pa.int64()), pa.array([last_id] * len(at), pa.int64()), pa.array(at, pa.int64()), pa.array(digests, pa.binary())],
                        names=["text_id", "last_id", "at", "window"],
                    )


def _islands(pieces: DataFrame, *least: str) -> DataFrame:
    """Stretches (record_id, span_start, span_end) of a record that overlap or touch, with the smallest of the columns ``least``."""
    order = Window.partitionBy("record_id").orderBy("span_start", "span_end")
    reach = F.max("span_end").over(order.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("fresh", (reach.isNull() | (F.col("span_start") > reach)).cast("int"))
    marked = marked.withColumn("island", F.sum("fresh").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    out = marked.groupBy("record_id", "island").agg(F.min("span_start").alias("span_start"), F.max("span_end").alias("span_end"), *[F.min(c).alias(c) for c in least])
    return out.select("record_id", "span_start", "span_end", *least)


def later_copies(records: DataFrame, spans: DataFrame) -> DataFrame:
    """Stretches to remove so that each shared letter run stays once; ``spans`` are those of :func:`shared_spans`.

    A row is a maximal stretch covered by shared windows that stand in an earlier record (smaller id), however
    long the spans around them are. Where the earliest record repeats a shared window, its first place stays and
    the others go, but for letters that first places cover. ``kept_in`` is the earliest record that holds a
    window of the stretch; offsets are those of the original.
    """
    texts, places = _placed(records, "record_id", "residues")
    listed = spans.groupBy("record_id").agg(F.collect_list(F.struct("span_start", "span_end")).alias("spans"))
    first = texts.join(places.where("record_id = text_id"), ["record_id", "text_key"]).join(listed, "record_id")
    first = first.dropDuplicates(["record_id", "text_key"])
    windows = cut(spread(first.select("text_id", "last_id", "residues", "spans")).mapInArrow(_span_windows, "text_id long, last_id long, at long, window binary"))
    owners = windows.groupBy("window").agg(F.min(F.struct("text_id", "at")).alias("first"), F.max("last_id").alias("last_id"))
    owners = owners.where(F.col("first.text_id") != F.col("last_id")).select("window", F.col("first.text_id").alias("kept_in"), F.col("first.at").alias("first_at"))
    held = cut(windows.drop("last_id").join(owners, "window").select(F.col("text_id").alias("record_id"), "at", "kept_in", "first_at"))
    end = F.col("at") + LENGTH
    earlier = _islands(held.where("kept_in < record_id").select("record_id", F.col("at").alias("span_start"), end.alias("span_end"), "kept_in"), "kept_in")
    # a window repeated within its earliest record, without the letters of the first places around it
    own = held.where("kept_in = record_id")
    repeating = own.where("at > first_at").select("record_id").distinct()
    place, order = F.when(F.col("at") == F.col("first_at"), F.col("at")), Window.partitionBy("record_id")
    before = F.last(place, ignorenulls=True).over(order.orderBy("at").rowsBetween(Window.unboundedPreceding, -1))
    after = F.last(place, ignorenulls=True).over(order.orderBy(F.desc("at")).rowsBetween(Window.unboundedPreceding, -1))
    own = own.join(repeating, "record_id", "left_semi").withColumns({"before": before, "after": after}).where("at > first_at")
    own = own.select("record_id", F.greatest("at", F.col("before") + LENGTH).alias("span_start"), F.least(end, "after").alias("span_end"), "kept_in").where("span_start < span_end")
    # all of a whole text held by an earlier record goes; stretches that stand still earlier tell where
    copies = places.where("record_id > text_id").select("record_id", "text_id").distinct()
    whole = spans.join(copies, "record_id").select("record_id", "span_start", "span_end", F.col("text_id").alias("kept_in"))
    stands = earlier.withColumnRenamed("record_id", "text_id").join(copies, "text_id").select("record_id", "span_start", "span_end", "kept_in")
    return _islands(earlier.unionByName(own).unionByName(whole).unionByName(stands), "kept_in")
