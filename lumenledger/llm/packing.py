"""Packing documents into sequences: linear grouping, few-size configurations, best fit for the rest.

1.  Each task tokenises its documents and cuts those longer than a sequence; what goes on are pieces (document, number,
    length, checksum), never ids.  A piece carries its ordinal among the pieces of its length in its task.
2.  Pieces are counted by length.  There are at most ``capacity`` lengths, so this histogram is bounded by the capacity
    and not by the corpus; it is the only thing that the driver gets.
3.  The driver plans on the histogram.  Large lengths are sorted and split into groups of equal cardinality, and every
    length is rounded up to the largest of its group (linear grouping, Fernandez de la Vega and Lueker 1981).  For the
    few sizes that are left, column generation optimises how often each configuration is used (Gilmore and Gomory
    1961).  Actual lengths then take the places of the rounded ones, and small pieces go where they fit best.
    The plan consists of runs: so many pieces of a length, from this rank on, into consecutive sequences at an offset.
4.  Pieces are numbered in the order of length, task and ordinal by one range exchange; a piece's number less that of the first
    of its length is its rank, and looking it up in the runs gives sequence and offset.  No step gathers the pieces of a
    length, and what is broadcast are runs and one number a partition.
"""

from __future__ import annotations

import bisect
import re
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import bound_batches, materialise, number_rows

#: Lengths above this share of the capacity take part in configurations; the others are filled in by best fit.  A plan is
#: made for each share, and the one with the fewest sequences stays.
LARGE = (0.3, 0.4, 0.5)
GROUPS = 40

#: White space to Python, but not to the tokenizer.
ODD_SPACES = "\x1c\x1d\x1e\x1f"

#: Fixed values of the tokenizer: how it cuts lower-cased words, for words of ASCII and Latin-1 letters.
SIMPLE = re.compile("[!-~À-ÖØ-öø-ÿ]+")
RUNS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
WORD_END = "</w>"

#: Words kept in a memo, and their characters, before it starts again.
MEMO_WORDS, MEMO_CHARS = 600_000, 32 << 20


class WordIds:
    """Token ids of texts by a tokenizer whose tokens never span white space, with two memos.

    One holds words as they stand between white space, the other the lower-cased runs of letters, single digits and
    runs of other signs that the tokenizer makes of them.  Words are looked up first; what a batch of texts misses is
    encoded in one go, lower-cased and cut already, so that only merging is left to the tokenizer.  Words with other characters
    than ASCII and Latin-1 letters are encoded as they are, and texts with one of the tokenizer's added tokens as a whole.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(WORD_END)]] = True
        self.merger = Tokenizer.from_file(path)
        self.merger.encode_special_tokens = True
        self.merger.normalizer = None
        self.merger.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words: dict[str, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.chars = 0

    def _encode(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _merge(self, runs: list[str]) -> None:
        """Ids of runs, a token's word end telling where one stops."""
        for at in range(0, len(runs), 256):
            some = runs[at : at + 256]
            ids = np.array(self.merger.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, "<u4")
            cut = [0, *(4 * np.flatnonzero(self.ends[ids]) + 4).tolist()]
            if len(cut) == len(some) + 1:
                raw = ids.tobytes()
                self.runs.update((r, raw[a:b]) for r, a, b in zip(some, cut, cut[1:]))
            else:
                self.runs.update(zip(some, self._encode(some)))

    def _learn(self, words: list[str]) -> None:
        runs = self.runs
        simple = [w for w in words if SIMPLE.fullmatch(w)]
        parts = [RUNS.findall(w.lower()) for w in simple]
        self._merge(list({r for p in parts for r in p if r not in runs}))
        self.words.update((w, b"".join([runs[r] for r in p])) for w, p in zip(simple, parts))
        odd = [w for w in words if w not in self.words]
        self.words.update(zip(odd, self._encode(odd)))
        self.chars += sum(map(len, words))

    def ids(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if len(self.words) > MEMO_WORDS or self.chars > MEMO_CHARS:
            self.words.clear()
            self.runs.clear()
            self.chars = 0
        get = self.words.__getitem__
        out: list[bytes] = []
        later: list[tuple[int, list[str]]] = []
        for text in texts:
            if any(t in text for t in self.added) or any(c in text for c in ODD_SPACES):
                out += self._encode([text])
                continue
            words = text.split()
            try:
                out.append(b"".join(map(get, words)))
            except KeyError:
                later.append((len(out), words))
                out.append(b"")
        if later:
            known = self.words
            self._learn(list({w for _, words in later for w in words if w not in known}))
            for k, words in later:
                out[k] = b"".join(map(get, words))
        return out


@lru_cache(maxsize=2)
def _word_ids(path: str) -> WordIds:
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return WordIds(path)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces_of(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pieces of all rows: _id, piece, start, length, ids_crc32, _part (task), _ord (ordinal in its task and length).

    ``tokenizer`` is the path of a vocabulary file that every executor has; by default the public one of this job.
    """
    schema = "_id long, piece int, start long, length long, ids_crc32 long, _part int, _ord long"
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        words = _word_ids(tokenizer or default_tokenizer())
        part = TaskContext.get().partitionId()
        seen: dict[int, int] = defaultdict(int)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                texts = [t or "" for t in some.column(1).to_pylist()]
                out: list[list] = [[], [], [], [], [], [], []]
                for id_, ids in zip(some.column(0).to_pylist(), words.ids(texts)):
                    ids += end
                    n = len(ids) // 4
                    for k, start in enumerate(range(0, n, capacity)):
                        length = min(capacity, n - start)
                        row = (id_, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), part, seen[length])
                        seen[length] += 1
                        for column, value in zip(out, row):
                            column.append(value)
                kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()]
                yield pa.record_batch([pa.array(c, k) for c, k in zip(out, kinds)], names=["_id", "piece", "start", "length", "ids_crc32", "_part", "_ord"])

    return docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).alias("_text")).mapInArrow(run, schema)


# ---------------------------------------------------------------- the plan, on a histogram


def _knapsack(sizes: np.ndarray, worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The configuration of most worth: an unbounded knapsack over the few sizes."""
    best = np.zeros(capacity + 1)
    took = np.full(capacity + 1, -1)
    order = [i for i in range(len(sizes)) if worth[i] > 1e-12]
    if not order:
        return 0.0, np.zeros(len(sizes), int)
    least = int(min(sizes[i] for i in order))
    s, w = sizes[order], worth[order]
    for c in range(least, capacity + 1):
        best[c] = best[c - 1]
        fits = s <= c
        value = np.where(fits, best[np.maximum(c - s, 0)] + w, -1.0)
        k = int(value.argmax())
        if value[k] > best[c] + 1e-12:
            best[c], took[c] = value[k], order[k]
    use = np.zeros(len(sizes), int)
    c = capacity
    while c > 0:
        if took[c] < 0:
            c -= 1
        else:
            use[took[c]] += 1
            c -= int(sizes[took[c]])
    return float(best[capacity]), use


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> list[tuple[np.ndarray, int]]:
    """How often to use which configuration so that all counts are placed: (items of each size, times).

    Column generation with a revised simplex over as many rows as there are sizes, then rounding down, and best-fit
    decreasing for what rounding leaves.  Counts are raised by less than a millionth each, all by different amounts, so that no
    ratios tie: every step lowers the objective and no basis recurs.  The loop ends when no configuration is worth
    more than it costs, or a step no longer lowers the objective by what doubles can show.
    """
    m = len(sizes)
    columns = [np.where(np.arange(m) == i, capacity // sizes[i], 0) for i in range(m)]
    basis = list(range(m))
    inverse = np.diag([1.0 / (capacity // s) for s in sizes])
    asked = counts + 1e-6 * np.arange(1, m + 1) / (m + 1)
    x = inverse @ asked
    while True:
        price = np.ones(m) @ inverse
        value, use = _knapsack(sizes, price, capacity)
        if value <= 1 + 1e-9:
            break
        step = inverse @ use
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        leave = int(ratio.argmin())
        if not np.isfinite(ratio[leave]):
            break
        columns.append(use)
        basis[leave] = len(columns) - 1
        inverse[leave] /= step[leave]
        for r in range(m):
            if r != leave:
                inverse[r] -= step[r] * inverse[leave]
        lower = inverse @ asked
        if not lower.sum() < x.sum():
            x = lower
            break
        x = lower
    left = counts.astype(np.int64).copy()
    plan: list[tuple[np.ndarray, int]] = []
    for b, times in sorted(zip(basis, x), key=lambda p: -p[1]):
        use = columns[b]
        times = int(max(0, np.floor(times + 1e-9)))
        for i in np.flatnonzero(use):
            times = min(times, int(left[i] // use[i]))
        if times:
            plan.append((use, times))
            left -= use * times
    # what rounding leaves: few items, largest first into the fullest bin that holds them
    rest: list[tuple[int, np.ndarray]] = []
    for i in np.argsort(-sizes):
        n = int(left[i])
        while n:
            fit = [k for k, (room, _) in enumerate(rest) if room >= sizes[i]]
            if fit:
                k = min(fit, key=lambda k: rest[k][0])
                room, use = rest[k]
                use[i] += 1
                rest[k] = (room - int(sizes[i]), use)
                n -= 1
            elif n > 4 * m * (capacity // sizes[i]):  # whole bins of one size, should rounding leave so many
                per = int(capacity // sizes[i])
                plan.append((np.where(np.arange(m) == i, per, 0), n // per))
                n -= n // per * per
            else:
                use = np.zeros(m, int)
                use[i] = 1
                rest.append((capacity - int(sizes[i]), use))
                n -= 1
    return plan + [(use, 1) for _, use in rest]


def plan_packing(histogram: dict[int, int], capacity: int = 2048) -> np.ndarray:
    """Runs (length, rank, count, sequence, offset): ``count`` pieces of ``length`` from ``rank`` on go into consecutive
    sequences from ``sequence`` on, at ``offset``.  Their number is bounded by the capacity, not by the counts.

    A plan is made for each share of ``LARGE`` and the one with the fewest sequences stays.
    """
    plans = [_planned(histogram, capacity, share) for share in LARGE]
    return min(plans, key=lambda p: p[1])[0]


def _planned(histogram: dict[int, int], capacity: int, share: float) -> tuple[np.ndarray, int]:
    """Runs and number of sequences, with lengths above this share of the capacity in configurations."""
    large = sorted((n for n in histogram if n > capacity * share and n < capacity), reverse=True)
    counts = np.array([histogram[n] for n in large], np.int64)
    total = int(counts.sum())
    ends = np.cumsum(counts)
    # equal cardinality: group g holds the places [g * total / groups, ...) of the falling order
    groups = min(GROUPS, total)
    edges = [total * g // groups for g in range(groups + 1)] if groups else []
    sizes: list[int] = []
    held: list[list[int]] = []
    for a, b in zip(edges, edges[1:]):
        size = large[int(np.searchsorted(ends, a, side="right"))]
        if sizes and sizes[-1] == size:
            held[-1][1] = b
        else:
            sizes.append(size)
            held.append([a, b])
    config = configurations(np.array(sizes), np.array([b - a for a, b in held]), capacity) if large else []
    return _substitute(histogram, capacity, share, large, counts, ends, held, config)


def _substitute(histogram, capacity, share, large, counts, ends, held, config) -> tuple[np.ndarray, int]:
    """Runs and number of sequences when actual lengths take the places of rounded ones.

    Of a configuration of several items the smallest slot stays open: filled from its group, it would leave rooms smaller than any
    piece that is left, whereas best fit finds a length of that group, or several smaller ones, that fill the room.
    """
    runs: list[tuple[int, int, int, int, int]] = []
    fill: dict[int, list[tuple[int, int]]] = defaultdict(list)  # room -> runs of sequences (first, count)
    pool: list[tuple[int, int, int]] = []  # (length, rank, count) for best fit
    sequences = 0
    full = histogram.get(capacity, 0)
    if full:
        runs.append((capacity, 0, full, 0, 0))
        sequences = full

    if large:
        at_place = lambda place: int(np.searchsorted(ends, place, side="right"))
        place = [a for a, _ in held]
        for use, times in config:
            # substitute actual lengths: each slot of the configuration takes ``times`` consecutive places of its
            # group; where any slot's length changes, the bins split into a new run
            groups_used = [int(g) for g in np.flatnonzero(use) for _ in range(int(use[g]))]
            slots = []
            cuts = {0, times}
            for g in groups_used[: max(1, len(groups_used) - 1)]:
                a = place[g]
                place[g] += times
                slots.append(a)
                cuts.update(int(e) - a for e in ends[at_place(a) : at_place(a + times - 1)])
            marks = sorted(cuts)
            for lo, hi in zip(marks, marks[1:]):
                at = 0
                for a in slots:
                    k = at_place(a + lo)
                    runs.append((large[k], a + lo - int(ends[k] - counts[k]), hi - lo, sequences + lo, at))
                    at += large[k]
                fill[capacity - at].append((sequences + lo, hi - lo))
            sequences += times
        for a, (_, b) in zip(place, held):
            while a < b:
                k = at_place(a)
                n = min(b, int(ends[k])) - a
                pool.append((large[k], a - int(ends[k] - counts[k]), n))
                a += n
    pool += [(n, 0, histogram[n]) for n in histogram if n <= capacity * share and n < capacity]

    fill.pop(0, None)
    rooms = sorted(fill)
    for length, rank, left in sorted(pool, key=lambda x: (-x[0], x[1])):
        while left:
            k = bisect.bisect_left(rooms, length)
            if k == len(rooms):
                new = -(-left // (capacity // length))
                rooms.append(capacity)
                fill[capacity].append((sequences, new))
                sequences += new
                continue
            room = rooms[k]
            first, n = fill[room].pop()
            if not fill[room]:
                rooms.pop(k)
                del fill[room]
            take = min(n, left)
            runs.append((length, rank, take, first, capacity - room))
            rank += take
            left -= take
            for r, run in ((room - length, (first, take)), (room, (first + take, n - take))):
                if r > 0 and run[1]:
                    if r not in fill:
                        bisect.insort(rooms, r)
                    fill[r].append(run)
    return np.array(sorted(runs), np.int64).reshape(-1, 5), sequences


def pack_documents(docs: DataFrame, capacity: int = 2048, tokenizer: str | None = None, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Place every document in sequences of at most ``capacity`` tokens; one row a piece.

    A document's tokens are its text's ids and ``end_id``; a null or empty text has this id alone.  Only documents longer
    than a sequence are cut.  Rows with equal or null ids are packed each by itself.  Columns: id, piece, start, length,
    ids_crc32, sequence_id, offset.  An empty table gives an empty result.
    """
    bound_batches(docs.sparkSession)
    pieces = materialise(pieces_of(docs, capacity, tokenizer, end_id, id_col, text_col), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}  # capacity rows at most
    plan = plan_packing(histogram, capacity)
    numbered, _ = number_rows(pieces, "length", "_part", "_ord")
    lengths = np.array(sorted(histogram), np.int64)
    start = np.concatenate([[0], np.cumsum([histogram[n] for n in sorted(histogram)])])
    held = docs.sparkSession.sparkContext.broadcast((plan, lengths, start))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, lengths, start = held.value
        key = runs[:, 0] << 40 | runs[:, 1]
        for batch in batches:
            length, number = (np.asarray(batch.column(batch.schema.get_field_index(c))) for c in ("length", "_row"))
            rank = number - start[np.searchsorted(lengths, length)]
            k = np.searchsorted(key, length << 40 | rank, side="right") - 1
            sequence = runs[k, 3] + rank - runs[k, 1]
            yield pa.record_batch([*batch.columns[:-1], pa.array(sequence), pa.array(runs[k, 4])], names=[*batch.schema.names[:-1], "sequence_id", "offset"])

    ranked = numbered.select("_id", "piece", "start", "length", "ids_crc32", "_row")
    placed = ranked.mapInArrow(place, "_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
    return placed.withColumnRenamed("_id", id_col)
