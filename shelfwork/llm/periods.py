"""Periodic runs of words, found on a grammar.

Words that lie in no window of WINDOW words that the text holds twice cannot be
in a run, so they stay single symbols. The rest of a text becomes a grammar by
Re-Pair: the most frequent pair of symbols becomes a nonterminal until no pair
occurs twice; what is left is paired to a tree of even depth. A run crosses the
boundary of the smallest node that holds it, so each nonterminal is searched
once, at its first place: the words before and after its boundary are
extended for each period by doubling tables of equal stretches (names), for all
nodes at once. The finds are translated to all places of the nonterminal in
the derivation, and those that belong together merge to maximal intervals.
"""

from __future__ import annotations

import heapq
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import blank_words, chunks, in_text_batches, mix, owners, query, span_hashes, table

#: Words in a run at least, and periods.
LEAST, PERIODS = 24, 3
#: A run of LEAST words and PERIODS periods repeats so many words in a row: LEAST - q or (PERIODS - 1) * q of them.
WINDOW = LEAST * (PERIODS - 1) // PERIODS
#: Periods of nodes that are searched at once.
SEARCHED = 1 << 18


def repeated_words(words: np.ndarray, at: np.ndarray, window: int = WINDOW) -> np.ndarray:
    """Marks of words that lie in a window that their text holds twice; ``at`` has the texts' bounds.

    ``words`` are hashes: equal words have equal ones, so that no window is missed.
    """
    n, marks = len(words), np.zeros(len(words), bool)
    if n < window:
        return marks
    hashes, have = words, 1
    while have < window:
        step = min(have, window - have)
        hashes = mix(hashes[: len(hashes) - step] * np.uint64(31) + hashes[step:])
        have += step
    text = np.repeat(np.arange(len(at) - 1), np.diff(at))
    whole = np.flatnonzero(text[: len(hashes)] == text[window - 1 :])
    keyed = mix(hashes[whole] + text[whole].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(keyed)
    same = keyed[order][1:] == keyed[order][:-1]
    twice = np.zeros(len(whole), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edges = np.zeros(n + 1, np.int64)
    np.add.at(edges, whole[twice], 1)
    np.add.at(edges, whole[twice] + window, -1)
    return np.cumsum(edges[:-1]) > 0


def re_pair(symbols: list[int]) -> tuple[list[tuple[int, int]], list[int]]:
    """Rules (left, right) of the nonterminals and the sequence that is left; rule i is the symbol -1 - i.

    ``symbols`` are not negative. Of equally frequent pairs the one of the shortest expansion comes first, so that
    stretches double instead of growing word by word.
    """
    own, n = list(symbols), len(symbols)
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    rules: list[tuple[int, int]] = []
    length: dict[int, int] = defaultdict(lambda: 1)
    places: dict[tuple[int, int], list[int]] = defaultdict(list)
    for i in range(n - 1):
        places[own[i], own[i + 1]].append(i)
    heap = [(-len(p), 2, p[0], pair) for pair, p in places.items() if len(p) > 1]
    heapq.heapify(heap)
    while heap:
        count, _, _, pair = heapq.heappop(heap)
        a, b = pair
        found, end = [], -1
        for i in sorted(set(places[pair])):
            j = after[i] if i > end and own[i] == a else n
            if j < n and own[j] == b:
                found.append(i)
                end = j  # a place that overlaps the last one is no occurrence
        if len(found) < 2:
            places[pair] = found
            continue
        if len(found) < -count:  # others took some of its places
            places[pair] = found
            heapq.heappush(heap, (-len(found), length[a] + length[b], found[0], pair))
            continue
        del places[pair]
        rules.append(pair)
        x = -len(rules)
        length[x] = length[a] + length[b]
        touched = set()
        for i in found:
            j = after[i]
            k = after[j]
            own[i], own[j] = x, None
            after[i] = k
            if k < n:
                before[k] = i
                places[x, own[k]].append(i)
                touched.add((x, own[k]))
            h = before[i]
            if h >= 0:
                places[own[h], x].append(h)
                touched.add((own[h], x))
        for new in touched:
            p = places[new]
            if len(p) > 1:
                heapq.heappush(heap, (-len(p), length[new[0]] + length[new[1]], p[0], new))
    left, i = [], 0
    while i < n:
        left.append(own[i])
        i = after[i]
    return rules, left


class Grammar:
    """Nodes of the grammars of many sequences over one line of symbols: first place, boundary and end, and all places."""

    def __init__(self) -> None:
        self.nodes: list[tuple[int, int, int]] = []
        self.places: list[list[int]] = []

    def add(self, symbols: list[int], offset: int) -> None:
        """The grammar of ``symbols``, which begin at ``offset`` of the line; nodes below LEAST words are left out."""
        rules, line = re_pair(symbols)
        length: list[int] = []
        size = lambda s: length[-1 - s] if s < 0 else 1
        for a, b in rules:
            length.append(size(a) + size(b))
        places: list[list[int]] = [[] for _ in rules]
        at, sizes = offset, []
        for s in line:
            if s < 0:
                places[-1 - s].append(at)
            sizes.append(size(s))
            at += sizes[-1]
        for r in range(len(rules) - 1, -1, -1):
            a, b = rules[r]
            if length[r] < LEAST:
                continue  # what lies below is as short
            for s, shift in ((a, 0), (b, size(a))):
                if s < 0 and length[-1 - s] >= LEAST:
                    places[-1 - s] += [p + shift for p in places[r]]
            first = min(places[r])
            self.nodes.append((first, first + size(a), first + length[r]))
            self.places.append(places[r])
        cuts = [offset]
        for x in sizes:
            cuts.append(cuts[-1] + x)
        while len(cuts) > 2:  # neighbours of the line pair up, level by level
            for i in range(0, len(cuts) - 2, 2):
                if cuts[i + 2] - cuts[i] >= LEAST:
                    self.nodes.append((cuts[i], cuts[i + 1], cuts[i + 2]))
                    self.places.append([cuts[i]])
            cuts = [*cuts[:-1:2], cuts[-1]]


class Names:
    """Equal stretches of 2**k symbols of a line have equal names, others have others."""

    def __init__(self, line: np.ndarray, longest: int) -> None:
        self.n, self.names = len(line), [np.unique(line, return_inverse=True)[1].astype(np.int64)]
        while 2 << len(self.names) - 1 <= longest:
            last, step = self.names[-1], 1 << len(self.names) - 1
            pairs = last[: len(last) - step] * (last.max() + 1) + last[step:]
            self.names.append(np.unique(pairs, return_inverse=True)[1].astype(np.int64))

    def ahead(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols from i on equal those from j on (i < j), up to ``most``."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):  # each once: none is twice as long as the longest
            own, step = self.names[k], 1 << k
            here = np.flatnonzero(found + step <= most)
            here = here[own[i[here] + found[here]] == own[j[here] + found[here]]]
            found[here] += step
        return found

    def back(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many symbols before i equal those before j (i < j), up to ``most``."""
        found = np.zeros(len(i), np.int64)
        for k in range(len(self.names) - 1, -1, -1):
            own, step = self.names[k], 1 << k
            here = np.flatnonzero(found + step <= most)
            here = here[own[i[here] - found[here] - step] == own[j[here] - found[here] - step]]
            found[here] += step
        return found


def crossing(names: Names, nodes: np.ndarray) -> np.ndarray:
    """(node, start, end, period) of the longest periodic intervals inside each node (start, boundary, end) that cross its boundary.

    LEAST words and PERIODS periods long at least; of equal intervals the smallest period.
    """
    found = []
    most = (nodes[:, 2] - nodes[:, 0]) // PERIODS  # periods to try
    cuts = np.concatenate(([0], np.cumsum(most)))
    first = 0
    while first < len(nodes):
        last = max(first + 1, int(np.searchsorted(cuts, cuts[first] + SEARCHED, "right")) - 1)
        for low in range(0, int(cuts[last] - cuts[first]), SEARCHED):  # a single node may have more
            each = np.arange(cuts[first] + low, min(cuts[last], cuts[first] + low + SEARCHED))
            of = np.searchsorted(cuts, each, "right") - 1
            found.append(_crossing(names, nodes, of, each - cuts[of] + 1))
        first = last
    out = np.concatenate(found) if found else np.zeros((0, 4), np.int64)
    out = out[np.lexsort((out[:, 3], out[:, 2], out[:, 1], out[:, 0]))]
    new = np.ones(len(out), bool)
    new[1:] = (out[1:, :3] != out[:-1, :3]).any(axis=1)
    return out[new]


def _crossing(names: Names, nodes: np.ndarray, of: np.ndarray, q: np.ndarray) -> np.ndarray:
    found = []
    for side in (0, 1):  # the words that repeat include the first after the boundary, or the one a period before it
        start, middle, end = nodes[of].T
        i = middle - side * q
        some = np.flatnonzero((i >= start) & (i + q < end))
        some = some[names.names[0][i[some]] == names.names[0][i[some] + q[some]]]
        o, p, i, start, end = of[some], q[some], i[some], start[some], end[some]
        forth = names.ahead(i, i + p, end - i - p)
        back = names.back(i, i + p, i - start)
        good = forth + back + p >= np.maximum(LEAST, PERIODS * p)
        found.append(np.stack([o, i - back, i + forth + p, p], axis=1)[good])
    return np.concatenate(found)


def merged(finds: np.ndarray) -> np.ndarray:
    """Maximal (start, end, period) of intervals: those of a period that overlap by it are one; of equal ones the smallest period."""
    finds = finds[np.lexsort((finds[:, 0], finds[:, 2]))]
    out: list[list[int]] = []
    for start, end, period in finds.tolist():
        if out and out[-1][2] == period and start + period <= out[-1][1]:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([start, end, period])
    smallest: dict[tuple[int, int], int] = {}
    for start, end, period in out:
        smallest[start, end] = min(period, smallest.get((start, end), period))
    return np.array(sorted(((s, e, p) for (s, e), p in smallest.items()), key=lambda x: (x[0], x[2])), np.int64).reshape(-1, 3)


def runs_of(sequences: list[list]) -> list[list[tuple[int, int, int]]]:
    """The runs (start, length, period) of each sequence of words, by start and period."""
    ids: dict = {}
    line, bounds, grammar, longest = [], [0], Grammar(), 1
    for n, words in enumerate(sequences):
        own = [ids.setdefault(w, len(ids)) for w in words]
        grammar.add(own, len(line))
        longest = max(longest, len(own))
        line += own
        bounds.append(len(line))
    found: list[list[tuple[int, int, int]]] = [[] for _ in sequences]
    if not grammar.nodes:
        return found
    hits = crossing(Names(np.array(line), longest), np.array(grammar.nodes))
    placed = []
    for node, start, end, period in hits.tolist():
        first = grammar.nodes[node][0]
        placed += [(p + start - first, p + end - first, period) for p in grammar.places[node]]
    at = np.searchsorted(bounds, [p[0] for p in placed], "right") - 1
    by: dict[int, list] = defaultdict(list)
    for n, p in zip(at.tolist(), placed, strict=True):
        by[n].append(p)
    for n, own in by.items():
        found[n] = [(s - bounds[n], e - s, p) for s, e, p in merged(np.array(own, np.int64)).tolist()]
    return found


def find(texts: pa.Array) -> Iterator[tuple[int, list[tuple[int, int, int]], list[bytes]]]:
    """Number of words, runs and kept words of each text."""
    for i, j, data, at in chunks(texts):
        starts, ends = blank_words(data, at)
        bounds = np.searchsorted(owners(starts, at), np.arange(j - i + 1))
        marks = repeated_words(span_hashes(data, starts, ends), bounds)
        some = np.flatnonzero(np.add.reduceat(np.append(marks, False), bounds[:-1]) * (np.diff(bounds) > 0)) if len(bounds) > 1 else []
        held = data.tobytes()
        words = {t: held[at[t] : at[t + 1]].split() for t in some}
        stretches = {}
        for t in some:
            own = marks[bounds[t] : bounds[t + 1]]
            edges = np.flatnonzero(np.diff(np.concatenate(([0], own.astype(np.int8), [0]))))
            stretches[t] = list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))
        runs: dict[int, list] = {t: [] for t in some}
        flat = [(t, a, b) for t in some for a, b in stretches[t]]
        for (t, a, _), own in zip(flat, runs_of([words[t][a:b] for t, a, b in flat]), strict=True):
            runs[t] += [(a + s, n, p) for s, n, p in own]
        for t in range(j - i):
            own = words[t] if t in words else held[at[t] : at[t + 1]].split()
            gone = sorted((s + p, s + n) for s, n, p in runs.get(t, ()))
            n = len(own)
            for a, b in reversed(_union(gone)):
                own[a:b] = []
            yield n, runs.get(t, []), own


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in spans:
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def collapsed(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: key, n_words, runs (start, length, period) by start and period, and the text without repetitions.

    A run is a longest stretch of words with a smallest period, LEAST words and
    PERIODS periods long at least. Of each only the first period stays, unless
    another run drops it; the rest is joined by blanks. Null and empty texts have
    no words, no runs and the empty text; repeated rows each get a row, equal texts
    equal ones; an empty table has no rows. Other columns are not looked at.
    """
    kind = docs.schema[key].dataType
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    struct = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])
    names = ["key", "n_words", "runs", "collapsed"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_words, runs, kept = [], [], []
            for n, own, words in find(batch.column(1)):
                n_words.append(n)
                runs.append([{"start": s, "length": m, "period": p} for s, m, p in own])
                kept.append(b" ".join(words))
            line = pa.array(kept, pa.binary()).cast(pa.string(), safe=False)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_words, pa.int64()), pa.array(runs, pa.list_(struct)), line], names)

    schema = f"key {kind.simpleString()}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return in_text_batches(rows).mapInArrow(run, schema).withColumnRenamed("key", key)


def strongest(runs: Column) -> Column:
    """The run with the most periods, to the fraction; of equals the first."""
    more = lambda a, b: F.when(a.isNull() | (b["length"] * a["period"] > a["length"] * b["period"]), b).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start:bigint,length:bigint,period:bigint>"), more)


def with_planted(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, text): every tenth document, by crc32 of its key, becomes periodic from some word on, as the query wants it."""
    h = F.crc32(F.col("key").cast("string").cast("binary"))
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text"))
    rows = rows.withColumn("words", F.when(h % 10 == 0, F.array_remove(F.split("text", r"[\x20\x09-\x0D]+"), "")))
    rows = rows.withColumn("n", F.size("words")).withColumn("g", F.floor(h / 10))
    rows = rows.withColumn("a", F.when(F.col("n") > 0, F.col("g") % F.col("n")).cast("int"))
    rows = rows.withColumn("p", (1 + F.floor((F.col("n") - F.col("a")) / (3 + F.col("g") % 8))).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("words", F.col("a") + 1, F.col("p")), F.ceil((F.col("n") - F.col("a")) / F.col("p")).cast("int")))
    planted = F.array_join(F.slice(F.concat(F.slice("words", F.lit(1), F.col("a")), again), F.lit(1), F.col("n")), " ")
    return rows.select(F.col("key").alias(key), F.when(F.col("n") > 0, planted).otherwise(F.col("text")).alias(text))


@query("op11_periods")
def op11_periods(spark: SparkSession, folder: str) -> DataFrame:
    """Periodic runs of each document, and the digest of its text without them."""
    out = collapsed(with_planted(table(spark, folder, "documents"))).withColumn("best", strongest(F.col("runs")))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return out.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.floor(1000 * F.col("best.length") / F.col("best.period")).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )
