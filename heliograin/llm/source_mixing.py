"""Operator 8: mixing sources to target weights.

Word counts are summed per source. Weights follow the sources' code point
order (null last) and share all words; a source's target stops at a multiple of
its own size and the excess is shared again by weight until none is above. In
closed form a source's target is least(multiple * size, level * weight), where
the level comes from running sums over the sources ordered by size / weight.

Each document is taken floor(rate) times and once more with the probability of
the rate's fraction f. That draw is seeded by hashes: the documents of a source
stand in the order of a hash of their ids, each as an interval as long as its
words, closed to a ring; a second hash, of the source, says where on the ring a
stretch of the share f starts, and the documents whose middle lies in it are
drawn. Every document is drawn with probability f, and as the stretch holds the
share f of all words, a source's words lie within one document of its target,
which independent draws would miss by chance.

On the id hashes the stretch is a range. Its two ends are found by sums over
cells of hashes, then over the documents of the two cells in which it ends. So
the table that decides has one row for each source, with two hashes; documents
meet it by ``common.meet`` and are never shuffled. Words are counted once, into a
written table without texts.

Defined results: a null or empty text has size 0 and is taken 0 words; a null
source is a source of its own, ordered last; a source without words has target
0; equal ids are decided alike, and so are equal texts without an id; an empty
table gives an empty result; further columns, whatever their names, are ignored
by ``rates`` and carried along by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import common as C

WEIGHTS = (5, 2, 1)
MOST_REPEATS = 3
SEED = "mix-1"
#: Bits of the hashes that order documents and start the stretches.
HASH_BITS = 52


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS) -> DataFrame:
    """Rows (source, n, source_size, target) of rows (source, size); n counts a source's rows."""
    per = sizes.groupBy("source").agg(F.count("*").alias("n"), F.sum("size").alias("source_size"))
    ranked = C.running(per, [F.col("source").asc_nulls_last()], rank=F.lit(1))
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), F.pmod(F.col("before_rank"), F.lit(len(weights))).cast("int") + 1)
    ranked = ranked.withColumn("weight", weight.cast("long")).withColumn("room", F.col("source_size") * most)
    ranked = ranked.withColumn("ratio", F.col("room") / F.col("weight"))
    # sources reach their bound in order of room / weight; the first one that its bound doesn't stop sets the level
    stops = C.running(ranked, [F.col("ratio"), F.col("before_rank")], room=F.col("room"), weight=F.col("weight"))
    all_of = stops.agg(F.sum("source_size").alias("all_words"), F.sum("weight").alias("all_weights"))
    level = (F.col("all_words") - F.col("before_room")) / (F.col("all_weights") - F.col("before_weight"))
    stops = stops.crossJoin(F.broadcast(all_of)).withColumn("level", level)
    free = stops.filter(F.col("level") * F.col("weight") <= F.col("room"))
    common = free.agg(F.min_by("level", F.struct("ratio", "before_rank")).alias("common"))
    target = F.least(F.col("room").cast("double"), F.col("common") * F.col("weight"))
    return stops.crossJoin(F.broadcast(common)).select("source", "n", "source_size", F.coalesce(target, F.lit(0.0)).alias("target"))


def _digits(text: Column) -> Column:
    """HASH_BITS bits of an MD5 digest."""
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, HASH_BITS // 4), 16, 10).cast("long")


def place(id_col: Column, text_col: Column, seed: str = SEED) -> Column:
    """A document's place in its source's order: a hash of its id; of its text where it has none."""
    name = F.coalesce(id_col.cast("string"), F.concat(F.lit("text "), F.md5(F.coalesce(text_col, F.lit("")).cast("binary"))))
    return _digits(F.concat(F.lit(seed + ":"), name))


def counted(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: str) -> DataFrame:
    """Rows (id, source, place, size), written once."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), place(F.col(id_col), F.col(text_col), seed).alias("place"), F.col(text_col).cast("string").alias("body"))
    return C.cut(C.with_word_counts(rows, "body", "size"))


def plan(sizes: DataFrame, weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """What decides, a row for each source: (of, n, source_size, target, base, lo, hi, wraps), of rows (source, size, place).

    A document is taken ``base`` times, and once more if its place lies from
    ``lo`` to below ``hi`` (where ``wraps`` is true: not from ``hi`` to below ``lo``).
    """
    per = targets(sizes.select("source", "size"), weights, most)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    begin = _digits(F.concat(F.lit(f"{seed}:source:"), F.coalesce("source", F.lit("")))) / F.lit(float(1 << HASH_BITS))
    per = per.withColumn("rate", rate).withColumn("start", begin * F.col("source_size"))
    per = per.withColumn("stop", F.col("start") + (F.col("rate") - F.floor("rate")) * F.col("source_size"))
    per = per.withColumn("wraps", F.col("stop") >= F.col("source_size"))
    per = per.withColumn("stop", F.when(F.col("wraps"), F.col("stop") - F.col("source_size")).otherwise(F.col("stop")))
    per = C.cut(per.select(F.col("source").alias("of"), "n", "source_size", "target", F.floor("rate").cast("long").alias("base"), "start", "stop", "wraps"))

    # about as many cells in the largest source as it has documents in a cell
    shift = HASH_BITS - min((max(sizes.count(), 1).bit_length() + 1) // 2, 24)
    cell = F.shiftright("place", shift)
    ordered = W.partitionBy("source").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    cells = sizes.groupBy("source", cell.alias("cell")).agg(F.sum("size").alias("words")).withColumn("before", F.coalesce(F.sum("words").over(ordered), F.lit(0)))
    ends = per.select("of", F.explode(F.array(F.struct(F.lit("lo").alias("end"), F.col("start").alias("point")), F.struct(F.lit("hi").alias("end"), F.col("stop").alias("point")))).alias("e"))
    ends = ends.select("of", "e.end", "e.point")
    crossed = cells.join(ends, F.col("source").eqNullSafe(F.col("of"))).filter(F.col("before") + F.col("words") > F.col("point"))
    crossed = C.cut(crossed.groupBy("of", "end").agg(F.min("cell").alias("in_cell"), F.min_by("before", "cell").alias("before"), F.first("point").alias("point")))
    units = sizes.join(crossed, F.col("source").eqNullSafe(F.col("of")) & (cell == F.col("in_cell")))
    units = units.groupBy("of", "end", "in_cell", "before", "point", "place").agg(F.sum("size").alias("words"))
    within = W.partitionBy("of", "end").orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    middle = F.col("before") + F.coalesce(F.sum("words").over(within), F.lit(0)) + F.col("words") / F.lit(2.0)
    found = units.withColumn("middle", middle).groupBy("of", "end", "in_cell").agg(F.min(F.when(F.col("middle") >= F.col("point"), F.col("place"))).alias("at"))
    at = F.coalesce("at", F.shiftleft(F.col("in_cell") + 1, shift))
    found = found.groupBy(F.col("of").alias("_of")).agg(*[F.max(F.when(F.col("end") == e, at)).alias(e) for e in ("lo", "hi")])
    none = F.lit(1 << HASH_BITS)
    met = per.join(found, F.col("of").eqNullSafe(F.col("_of")), "left")
    return C.cut(met.select("of", "n", "source_size", "target", "base", F.coalesce("lo", none).alias("lo"), F.coalesce("hi", none).alias("hi"), "wraps"))


def _met(rows: DataFrame, source: Column, at: Column, decided: DataFrame, most: int) -> DataFrame:
    """``rows`` with source_size, target and copies."""
    after, until = at >= F.col("lo"), at < F.col("hi")
    drawn = F.when(F.col("wraps"), after | until).otherwise(after & until).cast("long")
    size = F.coalesce(F.octet_length("of"), F.lit(0)) + 64
    met = C.meet(rows, source, decided, "of", "n", size)
    return met.withColumn("copies", F.least(F.col("base") + drawn, F.lit(most).cast("long")))


def rates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """Rows (id, size, source_size, target, copies), a row for each row of ``docs``."""
    sizes = counted(docs, id_col, text_col, source_col, seed)
    found = _met(sizes, F.col("source"), F.col("place"), plan(sizes, weights, most, seed), most)
    return found.select("id", "size", "source_size", "target", "copies")


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights=WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED) -> DataFrame:
    """The mixed documents: each row of ``docs`` as often as it is taken, with its columns."""
    decided = plan(counted(docs, id_col, text_col, source_col, seed), weights, most, seed)
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    rows = docs.select(row, F.col(source_col).alias("source"), place(F.col(id_col), F.col(text_col), seed).alias("place"))
    taken = _met(rows, F.col("source"), F.col("place"), decided, most).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).select("row.*")


def op8_source_mixing(spark, sf_dir: str) -> DataFrame:
    docs = C.table(spark, sf_dir, "documents")
    return rates(docs).select(F.col("id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


ORACLE = rf"""
WITH sized AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5('{SEED}:' || COALESCE(doc_id::VARCHAR, 'text ' || md5(COALESCE(text, '')))), 1, 13))::BIGINT AS place
  FROM documents
), ranked AS (
  SELECT source, source_size, rank, [5, 2, 1][((rank - 1) % 3 + 1)::INT]::BIGINT AS weight, source_size * {MOST_REPEATS} AS room
  FROM (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS rank FROM sized GROUP BY source)
), levels AS (
  SELECT *, (sum(source_size) OVER () - COALESCE(sum(room) OVER w, 0))::BIGINT / (sum(weight) OVER () - COALESCE(sum(weight) OVER w, 0))::BIGINT AS level
  FROM ranked WINDOW w AS (ORDER BY room / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), common AS (
  SELECT min_by(level, (room / weight, rank)) AS common FROM levels WHERE level * weight <= room
), per AS (
  SELECT source, source_size, COALESCE(least(room::DOUBLE, common * weight), 0.0) AS target,
    CASE WHEN source_size > 0 THEN COALESCE(least(room::DOUBLE, common * weight), 0.0) / source_size ELSE 0.0 END AS rate,
    ('0x' || substr(md5('{SEED}:source:' || COALESCE(source, '')), 1, 13))::BIGINT / {1 << 52}.0::DOUBLE * source_size AS begin
  FROM levels, common
), ring AS (
  SELECT *, begin + (rate - floor(rate)) * source_size AS stop FROM per
), placed AS (
  SELECT source, place, sum(words) OVER (PARTITION BY source ORDER BY place)::BIGINT - words + words / 2.0::DOUBLE AS middle
  FROM (SELECT source, place, sum(size)::BIGINT AS words FROM sized GROUP BY source, place)
), drawn AS (
  SELECT p.source, p.place, CASE WHEN stop >= source_size THEN middle >= begin OR middle < stop - source_size ELSE middle >= begin AND middle < stop END AS drawn
  FROM placed p JOIN ring r ON p.source IS NOT DISTINCT FROM r.source
)
SELECT doc_id, size, source_size, target, size * least(floor(rate)::BIGINT + drawn::BIGINT, {MOST_REPEATS}) AS taken
FROM sized JOIN ring ON sized.source IS NOT DISTINCT FROM ring.source
JOIN drawn ON sized.source IS NOT DISTINCT FROM drawn.source AND sized.place = drawn.place
"""
