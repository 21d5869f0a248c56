"""Mixing sources to target weights by Pareto order sampling, in DataFrame operations only.

A document's expected number of copies grows with the root of its size, so that long documents are likelier than
scraps: ``scale * sqrt(size)``, at most ``limit``, the scale of each source chosen so that the expected words are its
target. Its whole copies are certain. The fraction f left is an inclusion probability, unequal from document to
document: each document has a uniform number u from a hash of its id, and documents are ranked by their odds
u / (1 - u) divided by their inclusion odds f / (1 - f).

Samples are of fixed size. A source is cut into classes of like size (eight an octave), and before any document is
drawn each class gets its number n: from the longest class down, the words wanted from it divided by the mean words
of a draw, rounded at random so that the expectation holds; what rounding gains or loses is made up by the classes
after it. The first n documents of a class by rank enter. So the words of a source come near its target, whatever its
size, and no document is favoured beyond its stated probability. The n-th rank of a class is found through
histograms of the rank; a source with a third of all rows is never sorted in one place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from commstream.storage import materialize

BINS = 4096
BROADCAST_ROWS = 200_000


def word_count(text) -> F.Column:
    """Words of a text, maximal runs of other characters than 0x20 and 0x09-0x0D; null: 0."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def uniform(key, seed: int) -> F.Column:
    """A number in (0, 1) that only the key and the seed decide; 52 bits of an MD5."""
    digest = F.md5(F.concat(F.lit(f"{seed}:"), key))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def size_class(size) -> F.Column:
    """Sizes below 16 as they are; above, each octave in eight classes. Whole numbers only."""
    drop = F.greatest(F.length(F.bin(size)) - 4, F.lit(0)).cast("int")
    return (drop * 8 + F.call_function("shiftright", size, drop)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...], share: float, limit: float) -> DataFrame:
    """(source, source_size, target) from (source, source_size): a few rows, one for each source.

    Weights repeat along the sources in order of code point, null last. Targets share ``share`` times all words by
    weight, none above ``limit`` times its source: with sources by size / weight, the first k are full and the
    others share the rest, for the smallest k at which none of those is above its limit.
    """
    cycle = F.array(*[F.lit(float(w)) for w in weights])
    order = Window.orderBy(F.col("source").isNull(), F.col("source"))
    ranked = sizes.withColumn("weight", F.element_at(cycle, F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1))
    ranked = ranked.withColumn("full", F.col("source_size") * F.lit(float(limit)))
    fill = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    before, every = fill.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    level = (F.sum("source_size").over(every) * F.lit(float(share)) - F.coalesce(F.sum("full").over(before), F.lit(0.0))) / (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    ranked = ranked.withColumn("level", level).withColumn("open", F.col("full") > F.col("level") * F.col("weight"))
    flat = F.min(F.when(F.col("open"), F.struct(F.col("full") / F.col("weight"), F.col("source").isNull(), F.coalesce("source", F.lit("")), "level"))).over(every).getField("level")
    return ranked.withColumn("flat", flat).select("source", "source_size", F.least("full", F.coalesce(F.col("flat") * F.col("weight"), F.col("full"))).alias("target"))


def expected_copies(limit: int) -> F.Column:
    """Expected copies of a row with size, class and its source's scale and edge (the longest class that is not full)."""
    own = F.least(F.col("scale") * F.sqrt("size"), F.lit(float(limit)))
    return F.when(F.col("size") == 0, 0.0).when(F.col("edge").isNull() | (F.col("class") > F.col("edge")), float(limit)).otherwise(own)


def _scales(classes: DataFrame, want: DataFrame, limit: int) -> DataFrame:
    """(source, source_size, target, scale, edge): the classes beyond edge take the limit, the others share the rest of the target."""
    down = Window.partitionBy("source").orderBy(F.desc("class")).rowsBetween(Window.unboundedPreceding, -1)
    rows = classes.where("class > 0").join(_small(_as(want, "s")), F.col("source").eqNullSafe(F.col("s")))
    every, before = Window.partitionBy("source"), lambda c: F.coalesce(F.sum(c).over(down), F.lit(0.0))
    level = (F.col("target") - float(limit) * before("words")) / (F.sum("lift").over(every) - before("lift"))
    rows = rows.withColumn("level", level).where(F.col("level") * F.col("lift") < float(limit) * F.col("words"))
    found = rows.groupBy("source").agg(F.max(F.struct("class", "level")).alias("x")).select("source", F.col("x.class").alias("edge"), F.greatest("x.level", F.lit(0.0)).alias("scale"))
    return want.join(_as(found, "s"), F.col("source").eqNullSafe(F.col("s")), "left").drop("s")


def _draws(classes: DataFrame, seed: int) -> DataFrame:
    """(source, class, odds, n) from (source, class, target, sure, free, chance, words): the fixed sizes of the samples.

    One fold along a source's classes, a few hundred at most; left is what the draws still have to bring, due what
    they would on average.
    """
    name = F.coalesce(F.concat(F.lit("="), "source"), F.lit("null"))
    u = uniform(F.concat(name, F.lit(":"), F.col("class").cast("string")), seed)
    row = F.struct((-F.col("class")).alias("minus"), "class", "free", "chance", "words", u.alias("u"))
    listed = classes.groupBy("source", "target").agg(F.sum("sure").alias("sure"), F.array_sort(F.collect_list(F.when(F.col("chance") > 0, row))).alias("rows"))

    def step(state, x):
        mean = x["words"] / x["chance"]
        # What earlier classes missed is made up evenly, at most by so much either way that the mean of n stays.
        room = F.least(F.lit(1.0), (x["free"] - x["chance"]) / x["chance"])
        miss = F.when(state["due"] > 0, state["left"] / state["due"] - 1).otherwise(0.0)
        many = x["chance"] * (1 + F.greatest(-room, F.least(room, miss)))
        n = F.least(x["free"], F.floor(many + x["u"])).cast("long")
        done = F.struct(x["class"].alias("class"), (x["chance"] / x["free"]).alias("odds"), n.alias("n"))
        return F.struct((state["left"] - n * mean).alias("left"), (state["due"] - x["words"]).alias("due"), F.concat(state["out"], F.array(done)).alias("out"))

    due = F.aggregate("rows", F.lit(0.0), lambda a, x: a + x["words"])
    start = F.struct((F.col("target") - F.col("sure")).alias("left"), due.alias("due"), F.expr("cast(array() as array<struct<class:bigint,odds:double,n:bigint>>)").alias("out"))
    return listed.select("source", F.explode(F.aggregate("rows", start, step)["out"]).alias("x")).select("source", "x.class", "x.odds", "x.n")


def _rank() -> F.Column:
    """Odds of u over inclusion odds; null where nothing is left to chance."""
    return F.when((F.col("f") > 0) & (F.col("f") < 1), (F.col("u") / (1 - F.col("u"))) / (F.col("f") / (1 - F.col("f"))))


def _cuts(rows: DataFrame, draws: DataFrame) -> DataFrame:
    """(source, class, cut): the rank of the last document that enters; the n-th of its class."""
    on = [F.col("source").eqNullSafe(F.col("s")), F.col("class") == F.col("k")]
    # A monotone function of the rank that is nearly uniform, as the odds of a class hardly differ.
    spread = F.col("rank") * F.col("odds") / (1 - F.col("odds") + F.col("rank") * F.col("odds"))
    bin_of = F.least(F.floor(spread * BINS), F.lit(BINS - 1)).cast("int")
    told = draws.where("n > 0").select(F.col("source").alias("s"), F.col("class").alias("k"), F.least("odds", F.lit(0.999999)).alias("odds"), "n")
    placed = rows.where("rank is not null").join(_small(told), on).select("source", "class", "rank", "n", bin_of.alias("bin"))
    bins = placed.groupBy("source", "class", "bin").agg(F.count("*").alias("rows"), F.first("n").alias("n"))
    upto = Window.partitionBy("source", "class").orderBy("bin").rowsBetween(Window.unboundedPreceding, 0)
    edge = bins.withColumn("upto", F.sum("rows").over(upto)).where("upto >= n").groupBy("source", "class").agg(F.min(F.struct("bin", (F.col("n") - F.col("upto") + F.col("rows")).alias("nth"))).alias("e"))
    edge = materialize(edge.select(F.col("source").alias("s"), F.col("class").alias("k"), "e.bin", "e.nth"))
    inside = placed.withColumnRenamed("bin", "own").join(_small(edge), on).where("own = bin")
    nth = F.row_number().over(Window.partitionBy("source", "class").orderBy("rank"))
    return inside.withColumn("at", nth).where("at = nth").select("source", "class", F.col("rank").alias("cut"))


def _as(table: DataFrame, name: str) -> DataFrame:
    return table.withColumnRenamed("source", name)


def _small(table: DataFrame) -> DataFrame:
    """table, to be broadcast where it has few enough rows (some for each source); else it is joined by shuffle."""
    return F.broadcast(table) if table.count() <= BROADCAST_ROWS else table


class Plan:
    """What a mix takes of any document: two tables, of a row for each source and one for each source and class."""

    def __init__(self, sized: DataFrame, weights: tuple[float, ...], share: float, limit: int, seed: int):
        """sized: (source, size, u), a row for each document."""
        rows = sized.withColumn("class", size_class(F.col("size")))
        self.limit = limit
        classes = materialize(rows.groupBy("source", "class").agg(F.sum("size").alias("words"), F.sum(F.col("size") * F.sqrt("size")).alias("lift")))
        want = materialize(targets(classes.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, float(limit)))
        self.sources = materialize(_scales(classes, want, limit))
        rows = self._expected(rows)
        sure, chance = F.sum(F.col("whole") * F.col("size")).cast("double"), F.when(F.col("rank").isNotNull(), F.col("f"))
        parts = rows.groupBy("source", "class").agg(F.first("target").alias("target"), sure.alias("sure"), F.count(chance).alias("free"), F.coalesce(F.sum(chance), F.lit(0.0)).alias("chance"), F.coalesce(F.sum(chance * F.col("size")), F.lit(0.0)).alias("words"))
        draws = materialize(_draws(parts, seed))
        self.cuts = materialize(_cuts(rows, draws))

    def _expected(self, rows: DataFrame) -> DataFrame:
        """rows with source, size, class and u, and their source's figures, whole copies, fraction f and rank."""
        out = rows.join(_small(_as(self.sources, "s")), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        out = out.withColumn("expected", expected_copies(self.limit)).withColumn("whole", F.floor("expected").cast("long"))
        return out.withColumn("f", F.col("expected") - F.col("whole")).withColumn("rank", _rank())

    def copies(self, rows: DataFrame) -> DataFrame:
        """rows, which have source, size and u, with source_size, target, expected and copies."""
        out = self._expected(rows.withColumn("class", size_class(F.col("size"))))
        cuts = _small(self.cuts.select(F.col("source").alias("s"), F.col("class").alias("k"), "cut"))
        out = out.join(cuts, F.col("source").eqNullSafe(F.col("s")) & (F.col("class") == F.col("k")), "left")
        drawn = F.when(F.col("rank") <= F.col("cut"), 1).otherwise(0)
        return out.withColumn("copies", F.col("whole") + drawn).drop("s", "k", "cut", "rank", "whole", "f", "class", "scale", "edge")


def _drawn_by(docs: DataFrame, seed: int, id_col: str, text_col: str, source_col: str) -> list:
    """size, source and u of a document. Without an id the text decides u."""
    key = F.coalesce(F.col(id_col).cast("long").cast("string"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))))
    return [word_count(F.col(text_col)).alias("size"), F.col(source_col).cast("string").alias("source"), uniform(key, seed).alias("u")]


def mix(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, expected, copies, taken, source), a row for each row of docs.

    expected is the stated mean of copies over seeds, taken = copies x size words. Only whole documents are taken, at
    most limit times each; a source's words miss its target by about a document of the shortest ones, or by more
    where a single document holds much of the source. Null sources are one source, the last; null and empty texts
    have size 0 and are never taken; texts are counted whole, however long. A document without an id is drawn by its
    text; rows alike in id and size (ties) are drawn alike. Extra columns are ignored. Reruns agree whatever the
    partitions. An empty table gives an empty result.
    """
    rows = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), *_drawn_by(docs, seed, id_col, text_col, source_col)))
    out = Plan(rows, weights, share, limit, seed).copies(rows)
    return out.select("doc_id", "size", "source_size", "target", "expected", "copies", (F.col("copies") * F.col("size")).alias("taken"), "source")


def repeat_documents(docs: DataFrame, weights: tuple[float, ...] = (3.0, 1.0, 2.0), share: float = 1.5, limit: int = 2, seed: int = 7, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """The rows of docs as often as the mix takes them, every column as it is, whatever its name; see mix for the rest."""
    own = _drawn_by(docs, seed, id_col, text_col, source_col)
    plan = Plan(materialize(docs.select(*own)), weights, share, limit, seed)
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *own)
    out = plan.copies(held).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy")).select(*[F.col("row").getField(c).alias(c) for c in docs.columns])


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """All documents mixed: sources weigh 3, 1, 2, repeating, share 150 % of all words and stop at twice their own."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", "target", "taken")


_UNIT = "(CAST(CAST('0x' || substr(md5('7:' || {}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0"

ORACLE_SQL = rf"""
WITH RECURSIVE counted AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    {_UNIT.format("coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))")} AS u
  FROM documents),
dropped AS (SELECT *, greatest(length(bin(size)) - 4, 0) AS low FROM counted),
sized AS (SELECT doc_id, source, size, u, CAST(low * 8 + (size >> low) AS BIGINT) AS class FROM dropped),
sizes AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, source_size * 2.0::DOUBLE AS full_size,
    CASE (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 WHEN 0 THEN 3.0::DOUBLE WHEN 1 THEN 1.0::DOUBLE ELSE 2.0::DOUBLE END AS weight
  FROM sizes),
filled AS (
  SELECT *, (CAST(sum(source_size) OVER () AS BIGINT) * 1.5::DOUBLE - coalesce(sum(full_size) OVER (ORDER BY full_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY full_size / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0)) AS level
  FROM weighed),
flat AS (SELECT arg_min(level, row(full_size / weight, source IS NULL, coalesce(source, ''))) AS flat FROM filled WHERE full_size > level * weight),
want AS (SELECT source, source_size, least(full_size, coalesce(flat * weight, full_size)) AS target FROM filled, flat),
classes AS (
  SELECT s.source, s.class, any_value(w.target) AS target, CAST(sum(size) AS DOUBLE) AS words, sum(CAST(size AS DOUBLE) * sqrt(CAST(size AS DOUBLE))) AS lift
  FROM sized s JOIN want w ON s.source IS NOT DISTINCT FROM w.source WHERE class > 0 GROUP BY s.source, s.class),
levels AS (
  SELECT *, (target - 2.0::DOUBLE * coalesce(sum(words) OVER longer, 0.0)) / (sum(lift) OVER (PARTITION BY source) - coalesce(sum(lift) OVER longer, 0.0)) AS level
  FROM classes WINDOW longer AS (PARTITION BY source ORDER BY class DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
scales AS (SELECT source, max(class) AS edge, greatest(arg_max(level, class), 0.0::DOUBLE) AS scale FROM levels WHERE level * lift < 2.0::DOUBLE * words GROUP BY source),
stated AS (
  SELECT d.*, w.source_size, w.target,
    CASE WHEN size = 0 THEN 0.0::DOUBLE WHEN c.edge IS NULL OR class > c.edge THEN 2.0::DOUBLE ELSE least(c.scale * sqrt(CAST(size AS DOUBLE)), 2.0::DOUBLE) END AS expected
  FROM sized d JOIN want w ON d.source IS NOT DISTINCT FROM w.source LEFT JOIN scales c ON d.source IS NOT DISTINCT FROM c.source),
chanced AS (SELECT *, CAST(floor(expected) AS BIGINT) AS whole, expected - floor(expected) AS f FROM stated),
ranked AS (SELECT *, CASE WHEN f > 0 AND f < 1 THEN (u / (1 - u)) / (f / (1 - f)) END AS rank FROM chanced),
parts AS (
  SELECT source, class, any_value(target) AS target, CAST(sum(whole * size) AS DOUBLE) AS sure, count(rank) AS free, coalesce(sum(f) FILTER (rank IS NOT NULL), 0.0) AS chance, coalesce(sum(f * size) FILTER (rank IS NOT NULL), 0.0) AS words
  FROM ranked GROUP BY source, class),
ordered AS (
  SELECT source, class, free, chance, words, row_number() OVER (PARTITION BY source ORDER BY class DESC) AS pos, {_UNIT.format("coalesce('=' || source, 'null') || ':' || class")} AS u
  FROM parts WHERE chance > 0),
begun AS (SELECT p.source, any_value(target) - sum(sure) AS remains, sum(words) AS due FROM parts p GROUP BY p.source),
draws AS (
  SELECT source, CAST(0 AS BIGINT) AS pos, CAST(0 AS BIGINT) AS class, CAST(0 AS BIGINT) AS n, CAST(remains AS DOUBLE) AS remains, CAST(due AS DOUBLE) AS due FROM begun
  UNION ALL
  SELECT source, pos, class, n, remains - n * words / chance, due - words FROM (
    SELECT o.source, o.pos, o.class, o.words, o.chance, d.remains, d.due,
      least(o.free, CAST(floor(o.chance * (1 + greatest(-least(1.0, (o.free - o.chance) / o.chance), least(least(1.0, (o.free - o.chance) / o.chance), CASE WHEN d.due > 0 THEN d.remains / d.due - 1 ELSE 0.0 END))) + o.u) AS BIGINT)) AS n
    FROM draws d JOIN ordered o ON d.source IS NOT DISTINCT FROM o.source AND o.pos = d.pos + 1) AS step),
numbered AS (SELECT *, CASE WHEN rank IS NOT NULL THEN row_number() OVER (PARTITION BY source, class, rank IS NULL ORDER BY rank) END AS nth FROM ranked)
SELECT r.doc_id, r.size, r.source_size, r.target, CAST((r.whole + CASE WHEN r.nth <= d.n THEN 1 ELSE 0 END) * r.size AS BIGINT) AS taken
FROM numbered r LEFT JOIN draws d ON r.source IS NOT DISTINCT FROM d.source AND r.class = d.class AND d.pos > 0
"""
