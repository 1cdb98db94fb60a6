"""Log-bilinear language model, trained with noise-contrastive estimation.

The most frequent words have a number each, the others share numbers by their last letters.
For each of the places before a word, a log-bilinear model scores the word by the product of
its vector with the vector of the word at that place, weighted by the place, and a bias; what
is taken of the result is a mixture over the places and the bare counts. The sum over all words
that makes a score a probability depends only on the word before, so it is computed once per
place and word, by products of blocks of vectors with all vectors, and looked up by every token.
Among words of one number a word has its discounted share of the number's count, and what the
discount leaves is the probability of an unknown word. Together the probabilities of all known
words and of one unknown word per shared number add up to 1.

Word counts cover all training documents, and so do the vectors. They are trained in rounds: in
each, every task passes over its own documents, and the changes are averaged by a grouping. The
first round takes one document in 16 (more of a small table) in few tasks, the second all
others; one in 32 is left out of both. The weights of the mixture are fitted on all that were
left out, by sums over them, and then a last round trains the vectors on these, too.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stagewise.llm.common import column, documents_only, map_arrow, ship, stored

#: Words with a slot of their own, slots the others share, size of a vector, words before.
OWN, SHARED, SIZE, CONTEXT = 32768, 64, 16, 3
#: Most words whose counts every task holds; the others' counts are joined.
HELD = 1 << 18
#: One in PARTS documents is in the first round, and more until these have FEW tokens; a task of
#: it takes about TASK tokens. One in LEFT_OUT documents is kept for the weights of the mixture,
#: which take ROUNDS rounds.
PARTS, FEW, TASK, LEFT_OUT, ROUNDS = 16, 1 << 21, 1 << 20, 32, 20
#: Noise words per minibatch, their weight, tokens of a minibatch, learning rate, first sum of
#: squares; a change is averaged in steps of 1 / FINE, by thousands of tokens.
NOISE, NOISE_RATIO, BATCH, RATE, FIRST, FINE = 64, 16.0, 2048, 0.1, 0.1, 1 << 16
#: Rows of the table of vectors that are normalised at once.
ROWS = 64
#: Words that a task counts before it passes them on; tokens scored at once; bytes of the texts
#: that are cut into words at once.
COUNTED, SLAB, CUT = 1 << 20, 1 << 17, 1 << 23
END = b""
SLOTS = OWN + SHARED


def tokens(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """The lower-cased words of documents, an end after each document's, and how many it has."""
    trimmed = pc.ascii_trim_whitespace(pc.ascii_lower(texts))
    # White space at the end leaves an empty word, and so does a text without words.
    none, space = pa.scalar("", texts.type), pa.scalar(" ", texts.type)
    closed = pc.binary_join_element_wise(trimmed, none, space)
    found = pc.ascii_split_whitespace(pc.if_else(pc.equal(trimmed, none), none, closed))
    large = pa.types.is_large_string(texts.type)
    words = found.flatten().cast(pa.large_binary() if large else pa.binary())
    return words, pc.list_value_length(found).to_numpy().astype(np.int64)


def cuts(batch: pa.RecordBatch):
    """The batch in parts whose texts have about CUT bytes."""
    sizes = pc.binary_length(column(batch, "text")).to_numpy().astype(np.int64)
    part = (np.cumsum(sizes) - sizes) // CUT
    edges = [0, *(np.flatnonzero(part[1:] != part[:-1]) + 1).tolist(), batch.num_rows]
    for a, e in zip(edges, edges[1:]):
        yield batch.slice(a, e - a)


def held_out(doc_id):
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 10 == 0


def shared_slot(word: bytes) -> int:
    return OWN + zlib.crc32(word[-3:]) % SHARED


def shared_slots(words: pa.Array) -> np.ndarray:
    ends = pc.binary_slice(words, -3).dictionary_encode()
    own = np.array([shared_slot(w) for w in ends.dictionary.to_pylist()], np.int64)
    return own[ends.indices.to_numpy()]


def word_counts(docs: DataFrame) -> DataFrame:
    """Stored table: word, c over all given documents."""
    def run(batches):
        held, size = [], 0
        for batch in batches:
            for part in cuts(batch):
                held.append(tokens(column(part, "text"))[0])
                size += len(held[-1])
                if size > COUNTED:
                    yield _counted(held)
                    held, size = [], 0
        if held:
            yield _counted(held)

    parts = map_arrow(docs.select("text"), run, "word binary, c bigint")
    return stored(parts.groupBy("word").agg(F.sum("c").alias("c")))


def _counted(held: list[pa.Array]) -> pa.RecordBatch:
    found = pa.chunked_array(held).value_counts()
    return pa.RecordBatch.from_arrays(
        [found.field("values").cast(pa.binary()), found.field("counts")], ["word", "c"])


class Vocabulary:
    """What every task knows of the counts: the frequent words and totals by slot."""

    def __init__(self, counts: DataFrame):
        # How many words have which count, in eighths of powers of two: a few hundred rows.
        level = F.floor(F.log2("c") * 8)
        levels = counts.groupBy(level.alias("level")).agg(
            F.count("*").alias("v"), F.sum("c").alias("n")).orderBy(F.desc("level")).collect()
        self.n, self.v = sum(r["n"] for r in levels), sum(r["v"] for r in levels)
        held, least = 0, None
        for r in levels:
            held += r["v"]
            if held > HELD:
                break
            least = r["level"]
        rows = counts.where(level >= least if least is not None else F.lit(False)).select(
            "word", "c").orderBy(F.desc("c"), "word").toArrow()
        self.tail = counts.where(level < least) if least is not None else counts
        self.words = rows.column("word").to_pylist()
        self.counts = rows.column("c").to_numpy().astype(np.int64)
        own = [w for w in self.words if w != END][:OWN - 1]
        self.own = {w: k for k, w in enumerate([END, *own])}
        index = {w: k for k, w in enumerate(self.words)}
        self.slot_counts = np.zeros(SLOTS, np.int64)
        types, once, twice = (np.zeros(SLOTS, np.int64) for _ in range(3))
        slot = F.lit(OWN) + F.crc32(F.substring("word", -3, 3)) % SHARED
        for r in counts.groupBy(slot.alias("slot")).agg(
                F.sum("c").alias("n"), F.count("*").alias("v"),
                F.sum((F.col("c") == 1).cast("long")).alias("one"),
                F.sum((F.col("c") == 2).cast("long")).alias("two")).collect():
            k = r["slot"]
            self.slot_counts[k], types[k], once[k], twice[k] = r["n"], r["v"], r["one"], r["two"]
        for w, k in self.own.items():  # these left their shared slot
            c, shared = int(self.counts[index[w]]) if w in index else 0, shared_slot(w)
            self.slot_counts[k] = c
            if c:
                self.slot_counts[shared] -= c
                types[shared] -= 1
                once[shared] -= c == 1
                twice[shared] -= c == 2
        self.discount = (once + 1) / (once + 2 * twice + 2)
        self.unknown = np.where(
            self.slot_counts > 0, self.discount * types / np.maximum(self.slot_counts, 1), 1.0)
        self.slots = np.array([self.own.get(w, shared_slot(w)) for w in self.words], np.int64)
        self.base = np.log10(self.counts + 0.1)
        total = self.slot_counts[self.slots]
        alone = self.slots < OWN
        self.inner = np.log10(np.where(
            alone, 1.0, (self.counts - self.discount[self.slots]) / np.maximum(total, 1)))


def slots_of(words: pa.Array, held: pa.Array, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in the list of held words (-1: none) and slot of each word."""
    found = pc.index_in(words, value_set=held.cast(words.type))
    place = pc.fill_null(found, -1).to_numpy().astype(np.int64)
    slot = np.append(slots, 0)[place]
    missing = np.flatnonzero(place < 0)
    slot[missing] = shared_slots(words.take(pa.array(missing)))
    return place, slot


def contexts(slot: np.ndarray, lengths: list[int]) -> np.ndarray:
    """The slots before each token of its document; SLOTS where there is none."""
    begins = np.repeat(np.r_[0, np.cumsum(lengths)[:-1]], lengths)
    at = np.arange(len(slot))
    out = np.full((len(slot), CONTEXT), SLOTS, np.int64)
    for j in range(CONTEXT):
        known = at - j - 1 >= begins
        out[known, j] = slot[at[known] - j - 1]
    return out


class LogBilinear:
    """A table whose rows are a slot's vector as context, its vector as target and its bias;
    then a row for the place before a document, and one per place with its weights."""

    SHAPE = (SLOTS + 1 + CONTEXT, 2 * SIZE + 1)

    def __init__(self, table: np.ndarray):
        self.table = table
        self.vectors, self.targets = table[:SLOTS + 1, :SIZE], table[:SLOTS, SIZE:2 * SIZE]
        self.bias, self.places = table[:SLOTS, 2 * SIZE], table[SLOTS + 1:, :SIZE]

    @classmethod
    def start(cls, share: np.ndarray) -> "LogBilinear":
        table = np.random.Generator(np.random.PCG64(11)).normal(0, 0.1, cls.SHAPE)
        table[:SLOTS, 2 * SIZE] = np.log(share)
        table[SLOTS + 1:] = 1
        return cls(table.astype(np.float32))

    def log_sums(self, begin: int, end: int) -> np.ndarray:
        """For contexts of a range and each place, the logarithm of the sum over all targets."""
        targets, out = np.ascontiguousarray(self.targets.T), np.empty((end - begin, CONTEXT))
        for a in range(begin, end, ROWS):
            rows = self.vectors[a:min(a + ROWS, end)]
            for j in range(CONTEXT):
                scores = (rows * self.places[j]) @ targets + self.bias
                most = scores.max(1, keepdims=True)
                scores -= most
                out[a - begin:a - begin + len(rows), j] = most[:, 0] + np.log(
                    np.exp(scores, out=scores).sum(1, dtype=np.float64))
        return out

    def probabilities(self, before, slot, sums: np.ndarray, share: np.ndarray) -> np.ndarray:
        """Per token the probability of its slot by the counts and by each place."""
        out = np.empty((len(slot), CONTEXT + 1))
        out[:, 0] = share[slot]
        target, bias = np.ascontiguousarray(self.targets).take(slot, 0), self.bias[slot]
        for j in range(CONTEXT):
            own = before[:, j]
            rows = (self.vectors * self.places[j]).take(own, 0)
            scores = np.einsum("ij,ij->i", rows, target) + bias
            out[:, j + 1] = np.exp(scores - sums[own, j])
        return out

    def train(self, before, slot, share: np.ndarray, rng, memory: np.ndarray) -> None:
        """One pass of noise-contrastive estimation, a place per minibatch in turn; Adagrad,
        whose sums are in ``memory``."""
        offset = np.log(NOISE_RATIO * share).astype(np.float32)
        edges = np.cumsum(share)
        weights, bias = slice(SIZE, 2 * SIZE), slice(2 * SIZE, None)
        for turn, a in enumerate(range(0, len(slot), BATCH)):
            j = turn % CONTEXT
            own, t = before[a:a + BATCH, j], slot[a:a + BATCH]
            n = np.searchsorted(edges, rng.random(NOISE) * edges[-1]).clip(0, SLOTS - 1)
            # Whole rows are faster to take than parts of rows.
            rows, noise = self.table.take(own, 0)[:, :SIZE], self.targets[n]
            at = self.table.take(t, 0)
            target = at[:, SIZE:2 * SIZE]
            place = self.places[j].copy()
            hidden = rows * place
            good = (hidden * target).sum(1) + at[:, 2 * SIZE] - offset[t]
            down = hidden @ noise.T
            down += self.bias[n] - offset[n]
            np.exp(np.negative(down, out=down), out=down)
            down += 1
            np.divide(-NOISE_RATIO / NOISE, down, out=down)
            up = 1 / (1 + np.exp(good))
            back = up[:, None] * target
            back += down @ noise
            self._step(memory, np.array([SLOTS + 1 + j]), slice(0, SIZE),
                       (back * rows).sum(0, keepdims=True) / len(t))
            self._step(memory, own, slice(0, SIZE), back * place)
            moved = np.empty((len(t) + NOISE, SIZE + 1), np.float32)
            np.multiply(up[:, None], hidden, out=moved[:len(t), :SIZE])
            moved[len(t):, :SIZE] = down.T @ hidden
            moved[:len(t), SIZE], moved[len(t):, SIZE] = up, down.sum(0)
            self._step(memory, np.concatenate([t, n]), slice(SIZE, None), moved)

    def _step(self, memory, rows: np.ndarray, columns: slice, values: np.ndarray) -> None:
        """A step along the sum of the values of each row, repeated rows included."""
        order = np.argsort(rows.astype(np.uint16), kind="stable")  # two bytes: by radix
        ordered = rows.take(order)
        begins = np.flatnonzero(ordered[1:] != ordered[:-1]) + 1
        begins = np.concatenate([[0], begins])
        marks, step = ordered[begins], np.add.reduceat(values.take(order, 0), begins)
        squares = step * step
        squares += memory[marks, columns]
        memory[marks, columns] = squares
        squares += FIRST
        step *= RATE
        step /= np.sqrt(squares, out=squares)
        self.table[marks, columns] += step


def mixture(parts) -> np.ndarray:
    """The weights of the columns under which the rows are likeliest (expectation and
    maximisation). ``parts`` are the rows, or a function from weights to the sums of shares."""
    weights = np.full(CONTEXT + 1, 1 / (CONTEXT + 1))
    for _ in range(ROUNDS):
        found = parts(weights) if callable(parts) else shares(parts, weights)
        if not found.sum():
            break
        weights = found / found.sum()
    return weights


def shares(parts: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """What the columns have in the rows' probabilities, summed over the rows."""
    own = parts * weights
    return (own / own.sum(1, keepdims=True)).sum(0)


def _numbered(blobs):
    """Slots and lengths of stored documents, about SLAB tokens at a time."""
    held, size = [], 0
    for blob in blobs:
        held.append(blob)
        size += len(blob) // 2
        if size > SLAB:
            yield np.frombuffer(b"".join(held), "<u2").astype(np.int64), [len(x) // 2 for x in held]
            held, size = [], 0
    if held:
        yield np.frombuffer(b"".join(held), "<u2").astype(np.int64), [len(x) // 2 for x in held]


def encoded(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Stored table: the documents' words as slots, two bytes each, with what the counts say of
    the words that every task holds, and how often the other words occur."""
    shared = docs.sparkSession.sparkContext.broadcast(
        (pa.array(vocabulary.words, pa.binary()), vocabulary.slots, vocabulary.base,
         vocabulary.inner))

    def run(batches):
        for batch in batches:
            for part in cuts(batch):
                yield pa.RecordBatch.from_arrays(
                    [column(part, "doc_id"), column(part, "held_out"), column(part, "left_out"),
                     *_looked_up(column(part, "text"), *shared.value)],
                    ["doc_id", "held_out", "left_out", "n_tokens", "held", "base", "inner",
                     "rare", "slots"])

    return stored(map_arrow(docs, run, (
        "doc_id bigint, held_out boolean, left_out boolean, n_tokens bigint, held bigint, "
        "base double, inner double, rare map<binary,bigint>, slots binary")).withColumn(
        "row", F.monotonically_increasing_id()))


def _looked_up(texts: pa.Array, held_words: pa.Array, slots, base, inner) -> list[pa.Array]:
    words, lengths = tokens(texts)
    place, slot = slots_of(words, held_words, slots)
    held = place >= 0
    ends = np.cumsum(lengths)
    begins = ends - lengths
    sums = [pa.array(np.add.reduceat(x, begins)) for x in (
        held.astype(np.int64), np.append(base, 0.0)[place], np.append(inner, 0.0)[place])]
    numbers = pa.Array.from_buffers(pa.binary(), len(texts), [
        None, pa.py_buffer(np.r_[0, 2 * ends].astype(np.int32)), pa.py_buffer(slot.astype("<u2"))])
    missing = np.flatnonzero(~held)
    owner = np.searchsorted(begins, missing, side="right") - 1
    rare = words.take(pa.array(missing)).cast(pa.binary()).dictionary_encode()
    kinds = max(1, len(rare.dictionary))
    pairs, times = np.unique(owner * kinds + rare.indices.to_numpy(), return_counts=True)
    edges = np.searchsorted(pairs, np.arange(len(texts) + 1) * kinds).astype(np.int32)
    counted = pa.MapArray.from_arrays(
        pa.array(edges), rare.dictionary.take(pa.array(pairs % kinds)), pa.array(times))
    return [pa.array(lengths), *sums, counted, numbers]


def train(rows: DataFrame, share: np.ndarray, tokens: int) -> tuple[LogBilinear, np.ndarray]:
    """The model and its sums of squares after all the encoded documents, of about so many
    tokens. Where the first round takes all of them, so does the second."""
    model = LogBilinear.start(share)
    memory = np.zeros(model.SHAPE, np.float32)
    first = min(PARTS, max(1, -(-PARTS * FEW // max(1, tokens))))
    part = F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(PARTS))
    model, memory = trained(
        gathered(rows.where(part < first), tokens * first // PARTS), model, memory, share, 1)
    return trained(rows if first == PARTS else rows.where(part >= first), model, memory, share, 2)


def gathered(rows: DataFrame, tokens: int) -> DataFrame:
    """Documents of about so many tokens in few tasks, in an order of their own."""
    return rows.select("slots").repartition(max(1, tokens // TASK)).sortWithinPartitions(
        F.xxhash64("slots"), "slots")


def trained(rows: DataFrame, model: LogBilinear, memory: np.ndarray, share: np.ndarray,
            number: int) -> tuple[LogBilinear, np.ndarray]:
    """The model and its sums of squares after a round: a pass of each task over its documents,
    then the means of the changes and of the roots of the sums."""
    shared = rows.sparkSession.sparkContext.broadcast((model.table, memory, share))
    size = LogBilinear.SHAPE[1]
    names = [f"{kind}{k}" for kind in "xr" for k in range(size)]

    def run(batches):
        start, sums, share = shared.value
        local, sums, seen = LogBilinear(start.copy()), sums.copy(), 0
        rng = np.random.Generator(np.random.PCG64([5, number, TaskContext.get().partitionId()]))
        for batch in batches:
            for slot, lengths in _numbered(column(batch, "slots").to_pylist()):
                local.train(contexts(slot, lengths), slot, share, rng, sums)
                seen += len(slot)
        weight = -(-seen // 1024)
        change = np.rint((local.table - start) * FINE).astype(np.int64) * weight
        moved = np.flatnonzero(change.any(1))
        roots = np.rint(np.sqrt(sums[moved]) * FINE).astype(np.int64) * weight
        values = np.ascontiguousarray(np.c_[change[moved], roots].T)
        yield pa.RecordBatch.from_arrays(
            [pa.array(moved.astype(np.int32)), pa.array(np.full(len(moved), weight)),
             *[pa.array(v) for v in values]], ["row", "w", *names])

    parts = map_arrow(rows.select("slots"), run, (
        "row int, w bigint, " + ", ".join(f"{n} bigint" for n in names)))
    # Whole numbers, so that the order of adding up does not matter; a row per slot at most.
    averaged = parts.groupBy("row").agg(
        *[(F.sum(n) / F.sum("w") / FINE).cast("float").alias(n) for n in names]).toArrow()
    table, memory = model.table.astype(np.float64), memory.copy()
    if averaged.num_rows:
        moved = averaged.column("row").to_numpy()
        for k in range(size):
            table[moved, k] += averaged.column(f"x{k}").to_numpy()
            memory[moved, k] = averaged.column(f"r{k}").to_numpy() ** 2
    return LogBilinear(table.astype(np.float32)), memory


def fitted_weights(rows: DataFrame, model: LogBilinear, sums: np.ndarray,
                   share: np.ndarray) -> np.ndarray:
    """The weights of the mixture under which all the encoded documents are likeliest."""
    shared = rows.sparkSession.sparkContext.broadcast((model.table, sums, share))

    def likely(batches):
        table, sums, share = shared.value
        own = LogBilinear(table)
        for batch in batches:
            for slot, lengths in _numbered(column(batch, "slots").to_pylist()):
                parts = own.probabilities(contexts(slot, lengths), slot, sums, share)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([parts.astype(np.float32).tobytes()], pa.binary())], ["parts"])

    found = stored(map_arrow(rows.select("slots"), likely, "parts binary"))
    names = [f"x{j}" for j in range(CONTEXT + 1)]

    def summed(weights):
        def run(batches):
            total = np.zeros(CONTEXT + 1)
            for batch in batches:
                for blob in column(batch, "parts").to_pylist():
                    parts = np.frombuffer(blob, np.float32).reshape(-1, CONTEXT + 1)
                    total += shares(parts.astype(np.float64), weights)
            yield pa.RecordBatch.from_arrays(
                [pa.array([x]) for x in np.rint(total * FINE).astype(np.int64).tolist()], names)

        # A row of whole numbers per task.
        rows = map_arrow(found, run, ", ".join(f"{n} bigint" for n in names)).collect()
        return np.array(rows, np.float64).reshape(-1, CONTEXT + 1).sum(0)

    return mixture(summed)


def log_sums(spark, model: LogBilinear) -> np.ndarray:
    """The logarithms of the sums over all slots, for every context and place."""
    shared = spark.sparkContext.broadcast(model.table)

    def run(batches):
        own = LogBilinear(shared.value)
        for batch in batches:
            rows = column(batch, "id").to_numpy()
            if len(rows):  # a range without gaps
                sums = own.log_sums(int(rows[0]), int(rows[-1]) + 1)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(rows), *[pa.array(np.ascontiguousarray(s)) for s in sums.T]],
                    ["id", *[f"z{j}" for j in range(CONTEXT)]])

    found = map_arrow(spark.range(0, SLOTS + 1, 1, 32), run, "id bigint, " + ", ".join(
        f"z{j} double" for j in range(CONTEXT))).toArrow()
    out = np.empty((SLOTS + 1, CONTEXT))
    out[found.column("id").to_numpy()] = np.stack(
        [found.column(f"z{j}").to_numpy() for j in range(CONTEXT)], 1)
    return out


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, unigram_score per
    document.

    Words are lower-cased (A to Z) and parted by ASCII white space; every document, empty or
    null ones too, ends with one end token. base_score is the add-0.1 unigram score, score the
    model's, and unigram_score that of the model's counts and discounts without its vectors, all
    sums of log10 probabilities. Null ids belong to the held-out fold. Without training
    documents all counts are zero and the slots are equally likely. A document is one row of
    two bytes a word, so very long texts need memory for a few times their words.
    """
    spark = docs.sparkSession
    ship(spark)
    docs = documents_only(docs).withColumn("held_out", held_out(F.col("doc_id"))).withColumn(
        "left_out", F.pmod(F.xxhash64("doc_id", F.lit(1)), F.lit(LEFT_OUT)) == 0)
    vocabulary = Vocabulary(word_counts(docs.where(~F.col("held_out"))))
    rows = encoded(docs, vocabulary)
    share = (vocabulary.slot_counts + 0.1) / (vocabulary.slot_counts.sum() + 0.1 * SLOTS)
    learning, tokens = rows.where(~F.col("held_out")), int(vocabulary.n)
    model, memory = train(learning.where(~F.col("left_out")), share, tokens)
    left_out = learning.where("left_out")
    weights = fitted_weights(left_out, model, log_sums(spark, model), share)
    model, _ = trained(gathered(left_out, tokens // LEFT_OUT), model, memory, share, 3)
    sums = log_sums(spark, model)
    shared = spark.sparkContext.broadcast((model.table, sums, share, weights))

    def run(batches):
        table, sums, share, weights = shared.value
        own, logs = LogBilinear(table), np.log10(share)
        for batch in batches:
            found, plain = [], []
            for slot, lengths in _numbered(column(batch, "slots").to_pylist()):
                begins = np.r_[0, np.cumsum(lengths)[:-1]]
                likely = own.probabilities(contexts(slot, lengths), slot, sums, share) @ weights
                found.append(np.add.reduceat(np.log10(likely), begins))
                plain.append(np.add.reduceat(logs[slot], begins))
            yield pa.RecordBatch.from_arrays([
                column(batch, "row"),
                *[pa.array(np.concatenate([np.empty(0), *x])) for x in (found, plain)]],
                ["row", "net", "plain"])

    net = map_arrow(rows.select("row", "slots"), run, "row bigint, net double, plain double")
    rare = rows.select("row", F.explode("rare").alias("word", "times"))
    slot = (F.crc32(F.substring("word", -3, 3)) % SHARED).cast("int")
    pick = lambda values: F.get(F.array(*[F.lit(float(x)) for x in values[OWN:]]), slot)
    inner = F.when(F.col("c").isNull(), pick(vocabulary.unknown)).otherwise(
        (F.col("c") - pick(vocabulary.discount)) / pick(np.maximum(vocabulary.slot_counts, 1)))
    added = rare.join(vocabulary.tail, "word", "left").groupBy("row").agg(
        F.sum(F.when(F.col("c").isNotNull(), F.col("times")).otherwise(0)).alias("more"),
        F.sum(F.col("times") * F.log10(F.coalesce("c", F.lit(0)) + 0.1)).alias("more_base"),
        F.sum(F.col("times") * F.log10(inner)).alias("more_score"))
    total = float(np.log10(vocabulary.n + 0.1 * (vocabulary.v + 1)))
    zero = lambda name: F.coalesce(F.col(name), F.lit(0))
    inside = F.col("inner") + zero("more_score")
    return rows.drop("slots", "rare").join(net, "row").join(added, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("held") + zero("more")).alias("n_known"),
        F.lit(int(vocabulary.n)).cast("bigint").alias("train_tokens"),
        (F.col("base") + zero("more_base") - F.col("n_tokens") * total).alias("base_score"),
        (F.col("net") + inside).alias("score"), (F.col("plain") + inside).alias("unigram_score"))
