"""Approximate nearest neighbours with an inverted multi-index.

The two halves of a vector are quantised by their own codebooks; a cell is a pair of
centroids. A query walks the pairs in the order of their summed distance until the cells it has
seen hold enough entries, and those entries are reranked by their true inner product. How many
are enough is measured: a bounded sample of queries is searched exhaustively, and the walk is
made as long as it takes to reach the wanted share of their true neighbours. A third component
that brings all vectors to the same length makes the nearest in distance the largest in inner
product, whatever the lengths.

Of a walk only its reach is passed on, the summed distance at which it ends. A task holds many
queries and goes through its entries cell by cell, with one matrix product for all queries whose
reach the cell is in.

Equal vectors are one entry of the index with the few smallest ids that any result can need.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stagewise.llm.common import column, map_arrow, partitions, ship, stored

#: Vectors that the codebooks are fitted on, and rounds of fitting.
SAMPLE, ROUNDS = 20_000, 10
#: Codewords of a half, within these bounds, and entries of a cell: enough for one matrix product.
FEWEST, CODEWORDS, HELD = 64, 1024, 256
#: Entries a query sees at least; entries of a search task, queries that it holds, and how many
#: tasks share the entries at most, each of which names k candidates for a query.
SEEN, GROUP, ASKED, TASKS = 1024, 1 << 16, 1 << 15, 64
#: Recall aimed at, and the queries it is measured on.
RECALL, PROBES = 0.96, 64
#: Pairs of query and entry that are held at once; entries in one matrix product.
PAIRS, WIDE = 1 << 18, 512


def nearest(vectors: DataFrame, queries: Column, k: int = 20, recall: float = RECALL) -> DataFrame:
    """query_id, rank, vec_id, score: the k best found for each row that ``queries`` selects.

    ``vectors`` has vec_id and embedding; the score is the inner product in double precision,
    summed from the first component to the last; ties go to the smaller vec_id. Rows with a
    null id, and vectors that are null, empty, zero, hold null or non-finite components, or
    have another length than most, take no part. A query never finds a row with its own vec_id;
    with fewer than k others it gets them all. Rows with the same id are candidates each for
    itself. No valid query: an empty result.
    """
    ship(vectors.sparkSession)
    rows = _valid(vectors)
    count, longest2 = rows.agg(F.count("*"), F.max(_squares())).first()
    if not count:
        return rows.sparkSession.createDataFrame(
            [], "query_id bigint, rank int, vec_id bigint, score double")
    index = Index(rows, count, longest2)
    placed = stored(index.place(_entries(rows, k)))
    asked = stored(rows.where(queries).join(
        placed.select("hash", "mark", "entry"), ["hash", "mark"]).select(
        F.col("vec_id").alias("query_id"), F.col("entry").alias("asked"), "vector"))
    wanted = stored(asked.dropDuplicates(["query_id", "asked"]).withColumn(
        "query", F.monotonically_increasing_id()))
    counts = np.zeros(index.size ** 2, np.int64)
    held = placed.groupBy("cell").count().toArrow()  # at most CODEWORDS ** 2
    counts[held["cell"].to_numpy()] = held["count"].to_numpy()
    seen = index.walk_length(placed, wanted, counts, recall, k)
    best = index.search(placed, wanted, counts, seen, k)
    names = wanted.select("query", "query_id", "asked")
    members = best.join(placed.select("entry", "ids"), "entry").join(names, "query").select(
        "query", "score", F.explode("ids").alias("vec_id"), "query_id").where(
        "vec_id <> query_id")
    ranked = _first(members, "vec_id", k).select(
        "query", F.col("place").alias("rank"), "vec_id", "score")
    return asked.select("query_id", "asked").join(
        names, ["query_id", "asked"]).join(ranked, "query").select(
        "query_id", "rank", "vec_id", "score")


def _first(found: DataFrame, tie: str, k: int) -> DataFrame:
    """Each query's k best rows by score, ties by a column."""
    return found.withColumn("place", F.row_number().over(
        Window.partitionBy("query").orderBy(F.desc("score"), tie))).where(F.col("place") <= k)


def _valid(vectors: DataFrame) -> DataFrame:
    """vec_id, vector, and two hashes of it. Floats stay floats: half the bytes, and the same
    numbers once they are doubles."""
    floats = vectors.select("embedding").dtypes[0][1] == "array<float>"
    kind = "array<float>" if floats else "array<double>"
    rows = stored(vectors.select(
        vectors["vec_id"].cast("bigint").alias("vec_id"),
        vectors["embedding"].cast(kind).alias("vector")).where(
        F.col("vec_id").isNotNull() & (F.size("vector") > 0)
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)).select(
        "vec_id", F.transform("vector", lambda x: x + F.lit(0.0)).cast(kind).alias("vector"),
        F.size("vector").alias("n")).select(  # -0.0 became 0.0
        "*", F.xxhash64("vector").alias("hash"), F.xxhash64(F.lit(7), "vector").alias("mark")))
    usual = rows.groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    return rows.where(F.col("n") == (usual["n"] if usual else 0)).drop("n")


def _squares() -> Column:
    return F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def _entries(rows: DataFrame, k: int) -> DataFrame:
    """Distinct vectors, each with a number, its smallest id, whether that is the only one, and
    the first ids that a result can need: no more than k times the same, and 2 k in all, so that
    k are left of whichever is a query's own. The limits are applied batch by batch before the
    shuffle too, so a very frequent vector sends few rows."""
    def few(batches):
        for batch in batches:
            names = [column(batch, c).to_numpy() for c in ("hash", "mark", "vec_id")]
            order = np.lexsort(names[::-1])
            order = order[_places(*(x[order] for x in names)) < k]
            order = order[_places(*(x[order] for x in names[:2])) < 2 * k]
            yield batch if len(order) == len(names[0]) else batch.take(pa.array(order))

    same = Window.partitionBy("hash", "vector", "vec_id").orderBy("vec_id")
    own = Window.partitionBy("hash", "vector").orderBy("vec_id")
    kinds = ", ".join(f"{n} {t}" for n, t in rows.dtypes)
    return map_arrow(rows, few, kinds).repartition(partitions(rows), "hash").withColumn(
        "place", F.row_number().over(same)).where(F.col("place") <= k).withColumn(
        "place", F.row_number().over(own)).where(F.col("place") <= 2 * k).groupBy(
        "hash", "vector").agg(
        F.first("mark").alias("mark"), F.sort_array(F.collect_list("vec_id")).alias("ids"),
        F.min("vec_id").alias("least"), F.max("vec_id").alias("most")).select(
        F.monotonically_increasing_id().alias("entry"), "hash", "mark", "ids", "least",
        (F.col("least") == F.col("most")).alias("alone"), "vector")


def _places(*keys: np.ndarray) -> np.ndarray:
    """The place of each row among its equals, in rows that are sorted by these keys."""
    if not len(keys[0]):
        return np.empty(0, np.int64)
    new = np.r_[True, np.logical_or.reduce([x[1:] != x[:-1] for x in keys])]
    begin = np.flatnonzero(new)
    return np.arange(len(new)) - np.repeat(begin, np.diff(np.r_[begin, len(new)]))


def _matrix(arrays: pa.Array) -> np.ndarray:
    values = arrays.combine_chunks() if isinstance(arrays, pa.ChunkedArray) else arrays
    flat = values.flatten().to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    return flat.reshape(len(values), -1) if len(values) else flat.reshape(0, 1)


class Index:
    def __init__(self, rows: DataFrame, count: int, longest2: float):
        self.count, self.longest2 = count, longest2
        cores = rows.sparkSession.sparkContext.defaultParallelism
        self.tasks = min(TASKS, 2 * cores, -(-count // SEEN))
        self.size = int(np.clip(np.sqrt(count / HELD), FEWEST, CODEWORDS))
        drawn = rows.select("vec_id", "vector", F.xxhash64("vec_id", "hash", F.lit(1)).alias("key"))
        # So few are sorted that a task sends its share of the sample, not all of it.
        most = -2 ** 63 + min(2 ** 64 - 1, 2 ** 64 * 3 * SAMPLE // (2 * count))
        sample = drawn.where(F.col("key") <= most).orderBy("key", "vec_id").limit(SAMPLE).toArrow()
        points, first = np.unique(_matrix(sample["vector"]), axis=0, return_index=True)
        self.books = [_codebook(h, self.size, k) for k, h in enumerate(self._halves(points))]
        self.sample = points, sample["vec_id"].to_numpy()[first], *self.codes(points)

    def __getstate__(self):
        """Without the sample, which is sent to the tasks that need it."""
        return {**self.__dict__, "sample": None}

    def _halves(self, vectors: np.ndarray, query: bool = False) -> list[np.ndarray]:
        middle = (vectors.shape[1] + 1) // 2
        rest = self.longest2 - (vectors ** 2).sum(1)
        rest = np.zeros(len(vectors)) if query else np.sqrt(np.maximum(rest, 0))
        return [vectors[:, :middle], np.c_[vectors[:, middle:], rest]]

    def _distances(self, vectors: np.ndarray, query: bool = False) -> list[np.ndarray]:
        return [((h ** 2).sum(1)[:, None] - 2 * h @ b.T + (b ** 2).sum(1)[None, :])
                for h, b in zip(self._halves(vectors, query), self.books)]

    def codes(self, vectors: np.ndarray) -> np.ndarray:
        """The codewords of both halves that are nearest to each vector."""
        out = np.empty((2, len(vectors)), np.int64)
        for low, high in _blocks(len(vectors), self.size):
            out[:, low:high] = [d.argmin(1) for d in self._distances(vectors[low:high])]
        return out

    def place(self, entries: DataFrame) -> DataFrame:
        """The entries with their cell, in the order of the cells, in parts of about the same
        number of entries."""
        index = self

        def run(batches):
            for batch in batches:
                one, two = index.codes(_matrix(column(batch, "vector")))
                yield batch.append_column("cell", pa.array(one * index.size + two))

        kinds = ", ".join(f"{n} {t}" for n, t in entries.dtypes)
        return map_arrow(entries, run, f"{kinds}, cell bigint").repartitionByRange(
            max(self.tasks, self.count // GROUP), "cell", "entry").sortWithinPartitions("cell", "entry")

    def reach(self, vectors: np.ndarray, counts: np.ndarray, seen: int) -> np.ndarray:
        """How far each query walks: the summed distance at which the cells up to there, taken
        in its order, hold enough entries."""
        out, held = np.full(len(vectors), np.inf), np.flatnonzero(counts)
        if counts.sum() <= seen:
            return out
        first, second = held // self.size, held % self.size
        for low, high in _blocks(len(vectors), len(held)):
            one, two = self._distances(vectors[low:high], query=True)
            sums = one[:, first] + two[:, second]
            order = np.argsort(sums, axis=1)
            last = (np.cumsum(counts[held][order], axis=1) >= seen).argmax(1)
            row = np.arange(high - low)
            out[low:high] = sums[row, order[row, last]]
        return out

    def walk_length(self, placed: DataFrame, queries: DataFrame, counts, recall: float, k: int) -> int:
        """Entries to see so that the sampled queries find this share of their true k nearest."""
        chosen = queries.orderBy(F.xxhash64("query", F.lit(2)), "query").limit(PROBES).collect()
        if not chosen:
            return SEEN
        wanted = np.array([r["vector"] for r in chosen])
        own = np.array([r["query_id"] for r in chosen])

        def scan(batches):
            for batch in batches:
                if batch.num_rows:
                    scores = wanted @ _matrix(column(batch, "vector")).T
                    cell = column(batch, "cell").to_numpy()
                    scores[_same(own, *_names(batch))] = -np.inf
                    most = scores.shape[1]
                    best = np.argpartition(-scores, k, 1)[:, :k] if most > k else np.tile(
                        np.arange(most), (len(own), 1))
                    q = np.repeat(np.arange(len(own)), best.shape[1])
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(q), pa.array(scores[q, best.ravel()]),
                         pa.array(cell[best.ravel()])], ["q", "score", "cell"])

        nearest = map_arrow(placed, scan, "q bigint, score double, cell bigint").withColumn(
            "place", F.row_number().over(Window.partitionBy("q").orderBy(F.desc("score"), "cell")))
        hits = nearest.where(F.col("place") <= k).select("q", "cell").collect()
        one, two = self._distances(wanted, query=True)
        needed = []
        for q in range(len(own)):
            order = np.argsort((one[q][:, None] + two[q][None, :]).ravel(), kind="stable")
            before = np.empty(len(order), np.int64)
            before[order] = np.cumsum(counts[order]) - counts[order]
            needed += [int(before[r["cell"]]) + 1 for r in hits if r["q"] == q]
        return max(SEEN, int(np.quantile(needed, recall))) if needed else SEEN

    def search(self, placed: DataFrame, queries: DataFrame, counts, seen: int, k: int) -> DataFrame:
        """query, entry, score: the k best of every query among the entries that it sees.

        A task goes through its share of the entries cell by cell, with the queries that walk
        the cell; at most about ASKED queries at a time are sent to the tasks.
        """
        index = self
        shared = queries.sparkSession.sparkContext.broadcast((counts, self.sample))
        kind = dict(queries.dtypes)["vector"]

        def ask(batches):
            for batch in batches:
                counts, sample = shared.value
                own, vectors = column(batch, "query_id").to_numpy(), _matrix(column(batch, "vector"))
                reach = index.reach(vectors, counts, seen)
                low = Best(index, own, vectors, reach, None, k).bounds(*sample)
                yield batch.append_column("reach", pa.array(reach)).append_column(
                    "low", pa.array(low))

        asked = stored(map_arrow(
            queries.select("query", "query_id", "vector").repartition(
                partitions(queries), "query"), ask,
            f"query bigint, query_id bigint, vector {kind}, reach double, low double"))
        rounds = -(-asked.count() // ASKED)
        found = [self._round(placed, asked.where(
            F.pmod(F.xxhash64("query"), F.lit(rounds)) == turn), k) for turn in range(rounds)]
        if not found:
            return placed.sparkSession.createDataFrame(
                [], "query bigint, entry bigint, score double")
        return functools.reduce(DataFrame.unionAll, found)

    def _round(self, placed: DataFrame, asked: DataFrame, k: int) -> DataFrame:
        index, table = self, asked.toArrow()
        shared = asked.sparkSession.sparkContext.broadcast((
            table["query"].to_numpy(), table["query_id"].to_numpy(), _matrix(table["vector"]),
            table["reach"].to_numpy(), table["low"].to_numpy()))

        def run(batches):
            queries, *known = shared.value
            best = Best(index, *known, k)
            for batch in batches:
                if batch.num_rows:
                    best.see(column(batch, "entry").to_numpy(), _matrix(column(batch, "vector")),
                             *_names(batch), column(batch, "cell").to_numpy())
            for q, least, entry, score in best.found():
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (queries[q], least, entry, score)],
                    ["query", "least", "entry", "score"])

        found = map_arrow(
            placed.select("entry", "vector", "least", "alone", "cell").coalesce(self.tasks), run,
            "query bigint, least bigint, entry bigint, score double")
        return stored(_first(found, "least", k).select("query", "entry", "score"))


def _names(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """The smallest id of each entry, and whether it has no other."""
    return (column(batch, "least").to_numpy(),
            column(batch, "alone").to_numpy(zero_copy_only=False))


def _same(own: np.ndarray, least: np.ndarray, alone) -> np.ndarray:
    """Whether a query and an entry have nothing but the query's own id."""
    return (own[:, None] == least[None, :]) & alone


def _blocks(rows: int, width: int):
    """Stretches of rows of a table of this width with few enough cells to be held at once."""
    step = max(1, PAIRS // max(1, width))
    for low in range(0, rows, step):
        yield low, min(rows, low + step)


class Best:
    """The k best entries of each query among those seen so far.

    Scores are computed in single precision first, over lengths brought to at most one, with a
    margin for what that loses. Those that may be among the best are computed again, component
    by component. A comparison with what is not a number keeps the pair.
    """

    def __init__(self, index: Index, own, vectors, reach, low, k: int):
        self.index, self.own, self.vectors, self.k = index, own, vectors, k
        self.one, self.two = np.empty((2, index.size, len(vectors)), "f4")
        for begin, end in _blocks(len(vectors), index.size):
            one, two = index._distances(vectors[begin:end], query=True)
            self.one[:, begin:end], self.two[:, begin:end] = one.T, two.T
        squares = (vectors ** 2).sum(1)
        # Far enough for what rounding makes of a distance.
        self.near, self.reach = reach.astype("f4"), (
            reach + 2e-6 * (index.longest2 + squares)).astype("f4")
        with np.errstate(all="ignore"):
            lengths = np.sqrt(squares)
            # Squares out of range tell nothing: no score is ruled out then.
            known = (1e-250 < squares) & (squares < 1e250) & (1e-250 < index.longest2 < 1e250)
            lengths = np.where(known, lengths, np.nan)
            self.short = (vectors / lengths[:, None]).astype("f4")
            self.scale = 1 / (lengths * np.sqrt(index.longest2))
        self.error = (vectors.shape[1] + 8) * 2.0 ** -23
        #: A score that k entries of each query reach, over the product of its length and the
        #: longest one.
        self.low = np.full(len(vectors), -np.inf) if low is None else low.copy()
        empty = np.empty(0, np.int64)
        self.kept, self.new, self.held = (empty, empty, empty, np.empty(0)), [], 0

    def _scaled(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        with np.errstate(all="ignore"):
            scaled = vectors / np.sqrt(self.index.longest2)
            return scaled.astype("f4"), self.error * np.sqrt((scaled ** 2).sum(1)) + 1e-36

    def bounds(self, points: np.ndarray, ids: np.ndarray, one, two) -> np.ndarray:
        """What the best k of these vectors, each with one of its ids and its codewords, reach
        among those that a query sees."""
        if len(points) <= self.k:
            return self.low
        short, errors = self._scaled(points)
        for low, high in _blocks(len(self.own), len(points)):
            scores = self.short[low:high] @ short.T
            walked = self.one[one, low:high] + self.two[two, low:high]
            scores[~(walked <= self.near[low:high]).T] = -np.inf
            scores[_same(self.own[low:high], ids, True)] = -np.inf
            place = len(points) - self.k
            self.low[low:high] = np.partition(scores, place, axis=1)[:, place] - errors.max()
        return self.low

    def see(self, entries, vectors, least, alone, cells) -> None:
        short, errors = self._scaled(vectors)
        for first, last in _runs(cells):
            one, two = divmod(int(cells[first]), self.index.size)
            near = np.flatnonzero(~(self.one[one] + self.two[two] > self.reach))
            for begin in range(first, last, WIDE):
                end = min(last, begin + WIDE)
                for low, high in _blocks(len(near), end - begin):
                    self._pairs(near[low:high], slice(begin, end), errors[begin:end].max(),
                                entries, vectors, short, least, alone)

    def _pairs(self, near, part, margin, entries, vectors, short, least, alone) -> None:
        scores = self.short[near] @ short[part].T
        width = scores.shape[1]
        hit = self._may(scores, near, margin)
        if width > self.k and np.count_nonzero(hit) > 2 * self.k * len(near):
            bound = np.partition(scores, width - self.k, axis=1)[:, width - self.k] - margin
            # A query's own row may be among them.
            bound[np.isin(self.own[near], least[part][alone[part]])] = -np.inf
            self.low[near] = np.maximum(self.low[near], bound)
            hit = self._may(scores, near, margin)
        q, e = np.divmod(np.flatnonzero(hit), width)
        q, e = near[q], e + part.start
        other = ~(alone[e] & (least[e] == self.own[q]))
        q, e = q[other], e[other]
        for low, high in _blocks(len(q), vectors.shape[1]):
            some, those = q[low:high], e[low:high]
            # Summed from the first component to the last, as a plain loop would.
            exact = np.cumsum(self.vectors[some] * vectors[those], axis=1)[:, -1]
            self.new.append((some, least[those], entries[those], exact))
        self.held += len(q)
        if self.held > 2 * PAIRS:
            self._cut()

    def _may(self, scores, near, margin) -> np.ndarray:
        hit = scores < (self.low[near] - margin).astype("f4")[:, None]
        return np.logical_not(hit, out=hit)

    def _cut(self) -> None:
        self.kept = _top(*(np.concatenate(x) for x in zip(self.kept, *self.new)), self.k)
        q, score, self.new, self.held = self.kept[0], self.kept[-1], [], 0
        last = np.flatnonzero(np.r_[q[1:] != q[:-1], np.full(min(1, len(q)), True)])
        last = last[np.diff(np.r_[-1, last]) == self.k]
        with np.errstate(all="ignore"):
            low = score[last] * self.scale[q[last]]
            low -= 1e-9 * np.abs(low)
        self.low[q[last]] = np.maximum(self.low[q[last]], low)

    def found(self):
        """Query's place, smallest id of the entry, entry and score, in parts."""
        self._cut()
        for low, high in _blocks(len(self.kept[0]), 8):
            yield [x[low:high] for x in self.kept]


def _runs(marks: np.ndarray):
    """Where equal neighbours begin and end."""
    edges = np.flatnonzero(np.r_[True, marks[1:] != marks[:-1], True])
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def _top(q, least, entry, score, k):
    order = np.lexsort((least, -score, q))
    order = order[_places(q[order]) < k]
    return q[order], least[order], entry[order], score[order]


def _codebook(points: np.ndarray, size: int, seed: int) -> np.ndarray:
    """Centroids by Lloyd's rounds from distinct starting points; empty ones stay put."""
    points = np.unique(points, axis=0)
    rng = np.random.Generator(np.random.PCG64(seed))
    book = points[rng.choice(len(points), min(size, len(points)), replace=False)]
    book = np.r_[book, np.full((size - len(book), points.shape[1]), 1e9)]
    for _ in range(ROUNDS):
        near = ((book ** 2).sum(1)[None, :] - 2 * points @ book.T).argmin(1)
        for c in np.unique(near):
            book[c] = points[near == c].mean(0)
    return book
