"""Dimensions to slice by: open ones, and closed ones with a known list of labels."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from stagewise.functions import buckets as B
from stagewise.functions import hour_of
from stagewise.functions import labels as L
from stagewise.functions.buckets import bucket_index, range_index
from stagewise.functions.times import WEEKDAYS

WORD = 63
_SEPARATOR = "\x1f"
MONTHS = range(1, 13)


@dataclass(frozen=True)
class Dimension:
    """A name and how to read its value from a row.

    An open dimension computes its ``value``. A closed one lists its ``labels`` and
    computes the 0-based ``index`` of a row's label, so that all labels of a user fit in
    bit masks and no set of (value, user) pairs has to be shuffled. A list of more than 63
    labels takes several masks, one for each of its ``words``. An index that is NULL or
    outside the list means no value, unless ``rest`` gives the values outside the list.
    """

    name: str
    value: Callable[[], Column] | None = None
    labels: tuple[str, ...] | None = None
    index: Callable[[], Column] | None = None
    rest: Callable[[], Column] | None = None
    word: int = 0

    def __post_init__(self):
        if (self.value is None) == (self.index is None):
            raise ValueError("a dimension has either a value or an index")
        if (self.index is None) != (self.labels is None):
            raise ValueError("labels and index go together")
        if self.labels is not None and not self.labels:
            raise ValueError("a closed dimension has at least one label")

    @property
    def closed(self) -> bool:
        return self.labels is not None

    def column(self) -> Column:
        """The value as text."""
        if self.closed:
            return F.get(self.label_array(), self.index())
        return self.value().cast("string")

    def label_array(self) -> Column:
        return _literal(self.labels)

    def words(self) -> list[Dimension]:
        """The dimension in parts of labels that fit in one mask each."""
        return [
            Dimension(self.name, labels=self.labels[i:i + WORD], word=i // WORD,
                      index=lambda i=i: self.index() - i)
            for i in range(0, len(self.labels), WORD)]

    def outside(self) -> list[Dimension]:
        """An open dimension of the values outside the list, if there can be any."""
        return [] if self.rest is None else [Dimension(self.name, self.rest)]

    def mask(self) -> Column:
        """The bit of the row's label, 0 for no value; for a dimension of one word."""
        index = self.index()
        bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), index.cast("int"))
        return F.when(index.between(0, len(self.labels) - 1), bit).otherwise(
            F.lit(0).cast("bigint"))


def open_dimension(name: str, column: str | None = None) -> Dimension:
    return Dimension(name, lambda: F.col(column or name))


def closed_dimension(name: str, labels: tuple[str, ...], index: Callable[[], Column]) -> Dimension:
    return Dimension(name, labels=tuple(labels), index=index)


def flag_dimension(
    name: str, flag: Callable[[], Column], labels: tuple[str, str] = ("true", "false")
) -> Dimension:
    return closed_dimension(name, labels, lambda: F.when(flag(), 0).when(~flag(), 1))


def number_dimension(name: str, numbers: range, column: str | None = None) -> Dimension:
    """Consecutive whole numbers."""
    if not numbers or numbers.step != 1:
        raise ValueError("numbers must be consecutive")
    return closed_dimension(
        name, tuple(map(str, numbers)), lambda: F.col(column or name) - numbers.start)


def close_dimensions(
    events: DataFrame, dimensions: Sequence[Dimension], max_labels: int = WORD
) -> list[Dimension]:
    """``dimensions`` with the open ones of few values closed over the values in ``events``.

    Runs two small jobs: estimates of the number of values, then the values of the
    dimensions that qualify. Where the exact number exceeds ``max_labels`` after all, or
    is zero, a dimension stays open. Results do not depend on which dimensions qualify:
    values that were not there when the list was made are kept as values outside it.
    """
    opened = [d for d in dimensions if not d.closed]
    if not opened:
        return list(dimensions)
    estimates = events.agg(*[F.approx_count_distinct(d.column()) for d in opened]).first()
    few = [d for d, n in zip(opened, estimates) if 0 < n <= max_labels]
    if not few:
        return list(dimensions)
    values = events.agg(*[F.sort_array(F.collect_set(d.column())) for d in few]).first()
    closed = {d: _over(d, tuple(v)) for d, v in zip(few, values) if 0 < len(v) <= max_labels}
    return [closed.get(d, d) for d in dimensions]


def _over(dimension: Dimension, labels: tuple[str, ...]) -> Dimension:
    def outside() -> Column:
        value = dimension.column()
        return F.when(~F.array_contains(_literal(labels), value), value)

    return Dimension(
        dimension.name, labels=labels, rest=outside,
        index=lambda: F.array_position(_literal(labels), dimension.column()) - 1)


def _literal(labels: tuple[str, ...]) -> Column:
    """The labels as an array; one literal, whose split is folded when the query is planned."""
    if any(_SEPARATOR in label for label in labels):
        return F.array(*[F.lit(label) for label in labels])
    return F.split(F.lit(_SEPARATOR.join(labels)), _SEPARATOR)


def unfold(
    df: DataFrame, closed: Sequence[Dimension], masks: Sequence[Column], keep: Sequence[str]
) -> DataFrame:
    """A row ``(*keep, dimension, place, segment)`` for every bit set in the masks of a row.

    ``place`` is the 0-based place of the label in its dimension. Dimensions of a row without
    any label make no rows at all, and of the others only the labels that are set are spread.
    """
    columns = [c for d, m in zip(closed, masks)
               for c in (F.lit(d.name), m, F.lit(d.word * WORD), d.label_array())]
    spread = (
        df.select(*keep, F.stack(F.lit(len(closed)), *columns)
                  .alias("dimension", "mask", "first", "labels"))
        .where("mask <> 0")
    )
    bits = F.filter(F.sequence(F.lit(0), F.size("labels") - 1),
                    lambda i: F.getbit(F.col("mask"), i) == 1)
    return spread.select(*keep, "dimension", "first", "labels", F.explode(bits).alias("bit")).select(
        *keep, "dimension", (F.col("first") + F.col("bit")).alias("place"),
        F.get("labels", F.col("bit")).alias("segment"))


def month_dimension(months: range = MONTHS) -> Dimension:
    return number_dimension("month", months)


ALL = closed_dimension("all", ("(all)",), lambda: F.lit(0))


def position_dimension(last: int) -> Dimension:
    """Result positions 1 to ``last``."""
    return number_dimension("search_position", range(1, last + 1))


SEARCH_TYPE = open_dimension("search_type")
TERM_CATEGORY = open_dimension("search_term_category")
SEARCH_SORT = open_dimension("search_sort")
SEARCH_DMA = open_dimension("dma", "search_dma")
SEARCH_TERM = open_dimension("search_term")
SOURCE = open_dimension("source", "first_attribution_source")
CHANNEL = open_dimension("channel", "first_attribution_channel")
RESULT_COUNT = closed_dimension(
    "result_count", B.RESULT_COUNT_LABELS,
    lambda: bucket_index(F.col("count_results"), B.RESULT_COUNT_EDGES))
TERM_LENGTH = closed_dimension(
    "term_length", B.TERM_LENGTH_LABELS,
    lambda: bucket_index(F.length("search_term"), B.TERM_LENGTH_EDGES))
USA_CANADA = flag_dimension("geo", lambda: F.col("is_usa_canada"))
BOT = flag_dimension("bot", lambda: F.col("is_bot"))
HOST = flag_dimension("host", lambda: F.col("is_host"))
DAY_OF_WEEK = closed_dimension("day_of_week", WEEKDAYS, lambda: F.weekday("event_time"))
HOUR_BIN = closed_dimension(
    "hour", B.HOUR_LABELS, lambda: bucket_index(hour_of(F.col("event_time")), B.HOUR_EDGES))

USER_TYPE = flag_dimension("user_type", lambda: F.col("is_host"), L.HOST_LABELS)
GEOGRAPHY = flag_dimension("geography", lambda: F.col("is_usa_canada"), L.GEO_LABELS)
PEAK = flag_dimension("time", lambda: L.in_peak_hours(F.col("event_time")), L.PEAK_LABELS)
POSITION_BUCKET = closed_dimension(
    "position_bucket", tuple(label for _, _, label in B.POSITION_BUCKETS),
    lambda: range_index(F.col("search_position"), B.POSITION_BUCKETS))

LISTING_POSITION = closed_dimension(
    "position", B.POSITION_LABELS,
    lambda: bucket_index(F.col("search_position"), B.POSITION_EDGES))
LISTING_ID_RANGE = closed_dimension(
    "listing_id", B.LISTING_ID_LABELS,
    lambda: bucket_index(F.col("listing_id").try_cast("double"), B.LISTING_ID_EDGES))
SOURCE_SCREEN = open_dimension("source_screen")
CLICK_DMA = open_dimension("dma", "click_dma")
HEX_1 = open_dimension("hex_1", "hex_1_resolution")
ALREADY_RESERVED = flag_dimension("is_listing_reserved", lambda: F.col("is_listing_reserved"))


def search_dimensions(months: range = MONTHS) -> list[Dimension]:
    """Dimensions of the search characteristics analysis, search term and frequency apart."""
    return [SEARCH_TYPE, TERM_CATEGORY, SEARCH_SORT, SEARCH_DMA, RESULT_COUNT, TERM_LENGTH,
            USA_CANADA, BOT, HOST, month_dimension(months), DAY_OF_WEEK, HOUR_BIN]


def attribution_dimensions() -> list[Dimension]:
    return [SOURCE, CHANNEL]


def listing_dimensions(months: range = MONTHS) -> list[Dimension]:
    """Dimensions of the listing analysis."""
    return [LISTING_POSITION, SOURCE_SCREEN, CLICK_DMA, SOURCE, CHANNEL, BOT, HOST,
            month_dimension(months), DAY_OF_WEEK, HOUR_BIN, HEX_1, ALREADY_RESERVED,
            LISTING_ID_RANGE]
