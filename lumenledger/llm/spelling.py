"""Grouping of spelling variants: words at one edit, by a positional q-gram inverted index with a count filter.

Counting.  A task folds the runs of letters of its texts into a table of words and counts, flushed when it is full; counts of a word
meet by the word.  So no token is shuffled, and a word that is everywhere is one row a task.

Index.  A word of length L has L - 2 trigrams with positions.  One edit touches three of them at most, so two near words, the longer of
length L, share L - 5 trigrams: at the same place, or behind a deletion one place earlier.  Ordered from rare to frequent (and by place),
the first shared one is among the first four of both words.  Hence each word is posted under its four rarest trigrams as
(trigram, place, length), and asks there, and in the lists of words one letter shorter at the same place and one before.

Merge.  Under a key, the members' trigrams make an inverted index.  An asking word takes the postings of its trigrams under the limits
of length and place, each a sorted run of members; the shortest runs, of which every near member is in one, are merged by a heap, what
comes up is looked for in the others, members found less often than the overlap bound max(L, L') - 5 fall, and the rest are
verified letter by letter.

Keys of many.  A near pair shares two trigrams of its five rarest unless both words have six letters.  A key with over ``CROWD`` members
of seven or more letters is therefore split by a second trigram.  Keys of six-letter words are bounded by the alphabet: three letters
are fixed.

The order of trigrams needs their frequencies: at most 90**3 numbers, which is the only thing that reaches driver and tasks.
"""

from __future__ import annotations

import heapq
import re
import zlib
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lumenledger.llm.common import bound_batches, fresh, materialise, release
from lumenledger.llm.graph import roots

LETTERS = "A-Za-zÀ-ÿ"
Q = 3
#: An edit changes Q trigrams; words are at least so long.
SHORTEST = 2 * Q
LEAST_COUNT = 5
#: A form occurs at least so many times as often as its variant.
RATIO = 5
#: One deletion for each so many pairs of document and word.
ONE_IN = 199
#: Distinct words that a task holds before it passes counts on, and letters of text it splits at a time.
FLUSH, STRETCH = 200_000, 1 << 20
CROWD = 1024
#: Members up to which all are verified at once.
FEW = 4

_RUNS = re.compile(f"[{LETTERS}]{{{SHORTEST},}}")
_RUN = re.compile(f"[{LETTERS}]*")
_LOWER = {c: c + 32 for c in range(65, 91)}
#: Trigrams as numbers: a-z are 0 to 25, U+00C0 to U+00FF are 26 to 89.
ALPHABET = 90
# A key holds the number of a trigram, its place and the members' length, 20 bits each of the last two; words so long that they
# share keys cost time, and nothing is lost.


def words_of(doc_id: object, text: str) -> Counter:
    """The runs of a text after the rule of deletions, with their counts; those that stay shorter than SHORTEST are left out."""
    runs: Counter = Counter()
    at = 0
    while at < len(text):
        end = min(len(text), at + STRETCH)
        if end < len(text):
            end = _RUN.match(text, end).end()
        runs.update(_RUNS.findall(text[at:end].translate(_LOWER)))
        at = end
    before = zlib.crc32(("" if doc_id is None else f"{doc_id}").encode() + b":")
    out: Counter = Counter()
    for run, n in runs.items():
        h = zlib.crc32(run.encode(), before)
        if h % ONE_IN == 0:
            i = h % len(run)
            run = run[:i] + run[i + 1 :]
            if len(run) < SHORTEST:
                continue
        out[run] += n
    return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    acc: Counter = Counter()
    for batch in batches:
        for doc_id, text in zip(batch.column(0), batch.column(1)):
            acc.update(words_of(doc_id.as_py(), text.as_py() or ""))
            if len(acc) >= FLUSH:
                yield pa.record_batch([pa.array(acc.keys(), pa.string()), pa.array(acc.values(), pa.int64())], names=["word", "n"])
                acc = Counter()
    yield pa.record_batch([pa.array(list(acc), pa.string()), pa.array(list(acc.values()), pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n of all words with SHORTEST letters and LEAST_COUNT occurrences at least."""
    counts = docs.select(F.col(id_col).cast("string"), F.col(text_col)).mapInArrow(_count, "word string, n long")
    return counts.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


def trigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The numbers of all trigrams of some words, with the word that each is of and its place there."""
    size = np.fromiter(map(len, words), np.int64, len(words))
    c = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).astype(np.int64)
    c = np.where(c < 0xC0, c - 97, c - 0xC0 + 26)
    count = size - Q + 1
    owner = np.repeat(np.arange(len(words)), count)
    place = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(np.cumsum(size) - size, count) + place
    return (c[at] * ALPHABET + c[at + 1]) * ALPHABET + c[at + 2], owner, place


def one_edit(a: str, b: str) -> bool:
    """Whether one inserted, deleted or replaced code point turns a into b."""
    if len(a) < len(b):
        a, b = b, a
    if len(a) - len(b) > 1 or a == b:
        return False
    i = 0
    while i < len(b) and a[i] == b[i]:
        i += 1
    return a[i + 1 :] == b[i + (len(a) == len(b)) :]


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held = np.zeros(ALPHABET**Q, np.int64)
    for batch in batches:
        if batch.num_rows:
            held += np.bincount(trigrams(batch.column(0).to_pylist())[0], minlength=len(held))
    some = np.flatnonzero(held)
    yield pa.record_batch([pa.array(some), pa.array(held[some])], names=["gram", "n"])


def _ranks(words: DataFrame) -> np.ndarray:
    """The place of each trigram in the order from rare to frequent."""
    found = words.select("word").mapInArrow(_frequencies, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toArrow()
    n = np.zeros(ALPHABET**Q, np.int64)
    n[np.asarray(found["gram"])] = np.asarray(found["n"])
    ranks = np.empty(len(n), np.int32)
    ranks[np.argsort(n, kind="stable")] = np.arange(len(n), dtype=np.int32)
    return ranks


def _lists(values: np.ndarray, live: np.ndarray) -> pa.Array:
    """The live values of each row as a list."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(live.sum(1))]), pa.int32()), pa.array(values[live]))


def _post(ranks: np.ndarray):
    """Words -> (key, asks, word, places of its trigrams from the rarest to the key's) and, for splitting, the second keys."""
    names = ["_k", "_asks", "_word", "_places", "_more"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words = batch.column(0).to_pylist()
            if not words:
                continue
            gram, owner, place = trigrams(words)
            order = np.lexsort((place, ranks[gram], owner))
            count = np.bincount(owner, minlength=len(words))
            first = np.cumsum(count) - count
            # every word has four trigrams, and a fifth unless it has six letters
            five = order[np.minimum(first[:, None] + np.arange(5), len(order) - 1)]
            there = np.arange(5) < count[:, None]
            g, p, size = gram[five], place[five], count + Q - 1
            for i in range(4):
                others = [j for j in range(5) if j != i]
                for asks, back in ((False, 0), (True, 0), (True, 1)):
                    rows = np.flatnonzero((size > SHORTEST) & (p[:, i] >= back)) if asks else np.arange(len(words))
                    h, r, live = g[rows][:, others], p[rows][:, others], there[rows][:, others]
                    if asks:
                        h, live, r = np.tile(h, 2), np.hstack([live, live & (r > 0)]), np.hstack([r, r - 1])
                    keys = g[rows, i] << 40 | (p[rows, i] - back & 0xFFFFF) << 20 | size[rows] - asks & 0xFFFFF
                    before = p[rows, : i + 1].astype(np.int32)
                    yield pa.record_batch(
                        [pa.array(keys), pa.array(np.full(len(rows), asks)), batch.column(0).take(pa.array(rows)), _lists(before, np.ones(before.shape, bool)), _lists(h << 40 | r, live)],
                        names=names,
                    )

    return run


def _grams(word: str) -> list[str]:
    return [word[p : p + Q] for p in range(len(word) - Q + 1)]


class _Index:
    """Members of one key, all of one length, by their trigrams and places."""

    def __init__(self):
        self.members: list[str] = []
        self.postings: dict[tuple[str, int], list[int]] = {}

    def add(self, word: str) -> None:
        for p, g in enumerate(_grams(word)):
            self.postings.setdefault((g, p), []).append(len(self.members))
        self.members.append(word)

    def near(self, word: str, places: list[int]) -> list[str]:
        """The members at one edit from a word of their length or one letter longer, if the key's trigram is the first that both have.

        ``places`` are those of the word's rarest trigrams up to the key's; a pair that shares one before has met under that one's key.  Of the
        others the word and a near member share all but 3 less those passed over, so the member is in one of the shortest lists, one
        more than may be missed.  These are merged by a heap; the long ones are only looked into for members that came up.
        """
        missed = 4 - len(places)
        wanted = len(word) - Q + 1 - len(places) - missed
        if len(self.members) <= FEW or wanted <= 0:
            return [m for m in self.members if one_edit(word, m)]
        backs = range(len(word) - len(self.members[0]) + 1)
        lists = [[x for back in backs if (x := self.postings.get((g, p - back)))] for p, g in enumerate(_grams(word)) if p not in places]
        lists.sort(key=lambda found: sum(map(len, found)))
        short = missed + 1
        out, seen, times = [], -1, 0
        for i in heapq.merge(*[x for found in lists[:short] for x in found], [len(self.members)]):
            if i != seen:
                if seen >= 0 and self._enough(seen, wanted - times, lists[short:]) and one_edit(word, self.members[seen]):
                    out.append(self.members[seen])
                seen, times = i, 0
            times += 1
        return out

    def _enough(self, i: int, wanted: int, lists: list[list[list[int]]]) -> bool:
        """Whether member i is in so many of the lists."""
        for left, found in zip(range(len(lists), 0, -1), lists):
            if wanted <= 0 or wanted > left:
                break
            wanted -= any((at := bisect_left(x, i)) < len(x) and x[at] == i for x in found)
        return wanted <= 0


class _Key:
    """What is known of the rows of one key so far: members first, then asking words."""

    def __init__(self):
        self.index = _Index()

    def member(self, word: str, places: list[int]) -> list[tuple[str, str]]:
        found = self.asks(word, places)
        self.index.add(word)
        return found

    def asks(self, word: str, places: list[int]) -> list[tuple[str, str]]:
        return [(word, other) for other in self.index.near(word, places)] if self.index.members else []


def _merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by (key, part, asks) -> near pairs.  Members of a key are held, asking words stream past."""
    last, key = None, _Key()
    for batch in batches:
        out = []
        for k, part, asks, word, places in zip(*(c.to_pylist() for c in batch.columns)):
            if (k, part) != last:
                last, key = (k, part), _Key()
            out += key.asks(word, places) if asks else key.member(word, places)
        yield pa.record_batch([pa.array([o[j] for o in out], pa.string()) for j in range(2)], names=["a", "b"])


def near_words(words: DataFrame, crowd: int = CROWD) -> DataFrame:
    """All pairs (a, b) of different words at one edit, each once in either order.  ``words``: a column word, without repeats."""
    posted = words.select("word").mapInArrow(_post(_ranks(words)), "_k long, _asks boolean, _word string, _places array<int>, _more array<long>")
    posted = materialise(posted, "postings")
    full = posted.where(~F.col("_asks") & (F.col("_k").bitwiseAND(0xFFFFF) != SHORTEST)).groupBy("_k").count().where(F.col("count") > crowd)
    full = materialise(full.select(F.concat(F.lit("="), F.col("_k").cast("string")).alias("_j")), "crowded")
    if full.limit(1).count():
        marked = posted.join(full, fresh(F.col("_k")) == F.col("_j"), "left")
        parts = F.when(F.col("_j").isNull(), F.array(F.lit(-1).cast("long"))).otherwise(F.col("_more"))
        keyed = marked.select("_k", F.explode(parts).alias("_part"), "_asks", "_word", "_places")
    else:
        keyed = posted.select("_k", F.lit(-1).cast("long").alias("_part"), "_asks", "_word", "_places")
    dealt = keyed.repartition("_k", "_part").sortWithinPartitions("_k", "_part", "_asks")
    found = dealt.mapInArrow(_merge, "a string, b string")
    out = materialise(found.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "near_words")
    release(posted, full)
    return out


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", crowd: int = CROWD) -> DataFrame:
    """Every word of the corpus with its form: word, form, root, n, n_near, form_n.

    A null text holds no words; a null id counts as an empty string in the rule of deletions; repeated rows count as often as they occur.
    Ties of n go to the word smallest in code-point order.  An empty table gives no rows.
    """
    bound_batches(docs.sparkSession)
    words = materialise(vocabulary(docs, id_col, text_col), "words")
    pairs = near_words(words, crowd)
    both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
    known = words.select(fresh(F.col("word")).alias("_j"), F.col("n").alias("_m"))
    met = both.join(known, fresh(F.col("b")) == F.col("_j")).groupBy(F.col("a").alias("_w"))
    met = met.agg(F.count("*").alias("_near"), F.min(F.struct((-F.col("_m")).alias("m"), F.col("b").alias("w"))).alias("_best"))
    joined = words.join(met, F.col("word") == F.col("_w"), "left")
    enough = -F.col("_best.m") >= RATIO * F.col("n")
    formed = joined.select("word", "n", F.coalesce("_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, F.col("_best.w")).alias("form"), F.when(enough, -F.col("_best.m")).alias("form_n"))
    formed = materialise(formed, "forms")
    # n grows fivefold from word to form, so chains are short and have no cycles
    ends = roots(formed.select(F.col("word").alias("node"), F.coalesce("form", "word").alias("parent")))
    out = formed.join(ends.select(F.col("node").alias("_n"), F.col("root")), F.col("word") == F.col("_n"))
    return out.select("word", "form", "root", "n", "n_near", "form_n")
