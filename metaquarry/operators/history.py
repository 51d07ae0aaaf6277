"""Histories of changing attributes as insert-only satellites with lead-based end dates.

Attributes that change at different rates go into satellites of their own. A satellite gets a row
only where the digest of an attribute differs from the last one, and never an update: the end of a
period is computed in a view from the next row. Satellites are stored; a load appends to them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from metaquarry.operators.prefix import numbered
from metaquarry.session import cut, small

HOT_ROWS = 100_000
# Changes per state that separate one satellite from the next.
RATES = (0.05, 0.3)
KEY = ["k", "a"]


def plain_hash(value: Column | str) -> Column:
    """A hash without letter case and outer blanks; null if nothing is left."""
    v = F.lower(F.regexp_replace(value, "(?U)^\\s+|\\s+$", ""))
    return F.when(v != "", v)


def micros(ts: Column | str) -> Column:
    """Microseconds since 1970 of a timestamp, with or without a zone; UTC."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def plain_place(value: Column | str) -> Column:
    """A location without outer blanks; null if nothing is left."""
    v = F.regexp_replace(value, "(?U)^\\s+|\\s+$", "")
    return F.when(v != "", v)


def observations(rows: DataFrame, key: str, at: str, late: str, attributes: dict[str, Column]) -> DataFrame:
    """(k, a, t, l, d): the state of each attribute a of each key at each instant, in one scan. Of
    several rows of one instant the one with the latest `late` counts, then the greatest. Rows
    without key, time or digest say nothing. Repeats combine before the shuffle."""
    each = F.array(*[F.struct(F.lit(a).alias("a"), v.alias("d")) for a, v in attributes.items()])
    r = rows.select(F.col(key).alias("k"), micros(at).alias("t"), micros(late).alias("l"), F.explode(each).alias("x")).select("k", "x.a", "t", "l", "x.d")
    best = r.where("k is not null and t is not null and d is not null").groupBy("k", "a", "t").agg(F.max(F.struct("l", "d")).alias("m"))
    return best.select("k", "a", "t", "m.l", "m.d")


def changes(states: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(k, a, t, d[, c]): the states whose digest differs from the one before, per key in order of t.

    states is a stored table. A key with more than hot_rows states is cut into chunks of so many,
    each handled by itself and stitched at the borders, so no key has to fit into one task. Only
    if there is such a key there is a column c, the number of the chunk, null for other keys."""
    hot = cut(states.groupBy(*KEY).count().where(F.col("count") > hot_rows).select(*KEY))
    differs = lambda df, *part: df.withColumn("p", F.lag("d").over(Window.partitionBy(*part).orderBy("t")))
    if not hot.count():
        return differs(states, *KEY).where("p is null or p <> d").select(*KEY, "t", "d")
    many = states.join(small(hot), KEY, "left_semi").withColumn("g", F.concat_ws("\u0001", *KEY))
    chunked = cut(numbered(many, "g", "t").select(*KEY, "t", "d", F.floor((F.col("number") - 1) / hot_rows).alias("c")))
    last = chunked.groupBy(*KEY, "c").agg(F.max_by("d", "t").alias("e"))
    border = last.select(*KEY, "c", F.lag("e").over(Window.partitionBy(*KEY).orderBy("c")).alias("q"))
    stitched = differs(chunked, *KEY, "c").join(border, [*KEY, "c"]).where("coalesce(p, q) is null or coalesce(p, q) <> d").select(*KEY, "t", "d", "c")
    few = differs(states.join(small(hot), KEY, "left_anti"), *KEY).where("p is null or p <> d")
    return few.select(*KEY, "t", "d", F.lit(None).cast("long").alias("c")).unionByName(stitched)


def periods(sat: DataFrame) -> DataFrame:
    """(k, a, d, valid_from, valid_to, is_current): the view over what changes() gives. valid_to is
    the next row's start, null for the last one of a key."""
    chunk = [c for c in sat.columns if c == "c"]
    view = sat.withColumn("n", F.lead("t").over(Window.partitionBy(*KEY, *chunk).orderBy("t")))
    if chunk:
        # The last row of a chunk ends where the next chunk that has rows begins.
        first = sat.where("c is not null").groupBy(*KEY, "c").agg(F.min("t").alias("f"))
        border = first.select(*KEY, "c", F.lead("f").over(Window.partitionBy(*KEY).orderBy("c")).alias("g"))
        view = view.join(border, [*KEY, "c"], "left").withColumn("n", F.coalesce("n", "g"))
    return view.select(*KEY, "d", F.col("t").alias("valid_from"), F.col("n").alias("valid_to"), F.col("n").isNull().alias("is_current"))


def change_rates(states: DataFrame, sat: DataFrame) -> dict[str, float]:
    """Changes per state of each attribute, over all rows; one number per attribute."""
    n = {r["a"]: r["n"] for r in states.groupBy("a").agg(F.count("*").alias("n")).collect()}
    c = {r["a"]: r["n"] for r in sat.groupBy("a").agg((F.count("*") - F.count_distinct("k")).alias("n")).collect()}
    return {a: c.get(a, 0) / n[a] for a in sorted(n)}


def split_by_rate(rates: dict[str, float], borders: tuple[float, ...] = RATES) -> dict[str, int]:
    """The satellite of each attribute: the band its rate falls into, 0 for the slowest."""
    return {name: sum(rates[name] > b for b in borders) for name in sorted(rates)}


class Satellites:
    """Stored satellites of the attributes of one kind of entity, and the log of what was observed.

    Each load appends a folder with its observations, and one per satellite with its rows; it
    counts once its marker is there, so a load that breaks off leaves nothing. The first load
    measures how often each attribute changes and assigns it to a satellite for good."""

    def __init__(self, spark: SparkSession, folder: str, attributes: dict[str, Column], *, key: str = "object_id", at: str = "created_at", late: str = "loaded_at", hot_rows: int = HOT_ROWS):
        self.spark, self.folder, self.attributes = spark, folder.rstrip("/"), attributes
        self.key, self.at, self.late, self.hot_rows = key, at, late, hot_rows

    def _loads(self) -> list[int]:
        """The numbers of the loads that are complete: one small folder each."""
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/done")
        files = path.getFileSystem(self.spark._jsc.hadoopConfiguration())
        return sorted(int(s.getPath().getName().partition("=")[2]) for s in files.listStatus(path) if s.isDirectory()) if files.exists(path) else []

    def _stored(self, what: str, schema: str) -> DataFrame:
        paths = [f"{self.folder}/{what}/load={n}" for n in self._loads()]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def log(self) -> DataFrame:
        return self._stored("log", "k string, a string, t long, l long, d string")

    def rows(self) -> DataFrame:
        """(k, a, t, d, gen, satellite) of all satellites. A key whose order was upset by a late
        row has its rows again, under the next generation."""
        return self._stored("sat", "k string, a string, t long, d string, gen int, satellite int")

    def bands(self) -> dict[str, int]:
        """The satellite of each attribute seen so far."""
        split = self._stored("done", "a string, satellite int")
        return {r["a"]: r["satellite"] for r in split.groupBy("a").agg(F.min("satellite").alias("satellite")).collect()}

    def load(self, rows: DataFrame) -> None:
        """Appends what the rows say. Rows that come in order of time are compared with the last
        row of their key; keys with rows before that one, or at the same instant, are formed
        again from the log. Rows without key, time or value say nothing, repeats change nothing."""
        n = (self._loads() or [-1])[-1] + 1
        seen = cut(observations(rows, self.key, self.at, self.late, self.attributes))
        tips = self.rows().groupBy(*KEY).agg(F.max(F.struct("gen", "t", "d")).alias("tip")).select(*KEY, "tip.*") if n else None
        if tips is None:
            new = changes(seen, hot_rows=self.hot_rows).select(*KEY, "t", "d", F.lit(0).alias("gen"))
        else:
            # The last observation is later than the last change, so the log tells what is late.
            known = self.log().groupBy(*KEY).agg(F.max("t").alias("until"))
            touched = seen.groupBy(*KEY).agg(F.min("t").alias("since"))
            at = cut(touched.join(known, KEY, "left").join(tips, KEY, "left").select(*KEY, "since", F.col("d").alias("last"), F.coalesce("gen", F.lit(0)).alias("gen"), F.coalesce(F.col("since") <= F.col("until"), F.lit(False)).alias("late")))
            fine, late = at.where("not late"), at.where("late")
            ahead = changes(cut(seen.join(fine.select(*KEY), KEY, "left_semi")), hot_rows=self.hot_rows).join(fine.drop("late"), KEY)
            # Only the first row of a key can repeat the stored one.
            ahead = ahead.where("not (t = since and d <=> last)").select(*KEY, "t", "d", "gen")
            all_of = self.log().unionByName(seen).join(late.select(*KEY), KEY, "left_semi").groupBy("k", "a", "t").agg(F.max(F.struct("l", "d")).alias("m")).select("k", "a", "t", "m.d")
            again = changes(cut(all_of), hot_rows=self.hot_rows).join(late.select(*KEY, (F.col("gen") + 1).alias("gen")), KEY)
            new = ahead.unionByName(again.select(*KEY, "t", "d", "gen"))
        new = cut(new)
        bands = self.bands()
        fresh = {a: b for a, b in split_by_rate(change_rates(seen, new)).items() if a not in bands} if set(self.attributes) - set(bands) else {}
        bands |= fresh
        band = F.create_map(*[F.lit(x) for kv in bands.items() for x in kv])[F.col("a")] if bands else F.lit(0)
        seen.write.mode("overwrite").parquet(f"{self.folder}/log/load={n}")
        new.withColumn("satellite", band.cast("int")).write.mode("overwrite").parquet(f"{self.folder}/sat/load={n}")
        self.spark.createDataFrame(list(fresh.items()), "a string, satellite int").write.mode("overwrite").parquet(f"{self.folder}/done/load={n}")

    def history(self, attribute: str) -> DataFrame:
        """(k, d, valid_from, valid_to, is_current) of an attribute: the view over its satellite."""
        s = self.rows().where((F.col("a") == attribute) & (F.col("satellite") == self.bands().get(attribute, 0)))
        live = s.groupBy("k").agg(F.max("gen").alias("gen")).where("gen > 0")
        s = cut(s.join(live.withColumnRenamed("gen", "live"), "k", "left").where("live is null or gen = live"))
        return periods(changes(s.select("k", "a", "t", "d"), hot_rows=self.hot_rows)).drop("a")


def attributes() -> dict[str, Column]:
    """The changing attributes of an object; made when asked for, as columns need a session."""
    return {"hash_value": plain_hash("hash_value"), "source_location": plain_place("source_location")}


def _history(rows: DataFrame, attribute: str, hot_rows: int) -> DataFrame:
    states = cut(observations(rows, "object_id", "created_at", "loaded_at", {attribute: attributes()[attribute]}))
    p = periods(changes(states, hot_rows=hot_rows))
    return p.select(F.col("k").alias("object_id"), F.col("d").alias(attribute), "valid_from", "valid_to", "is_current")


def version_history(rows: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(object_id, hash_value, valid_from, valid_to, is_current) from the observations of
    object_version, whatever its version_number and is_current say. Times are microseconds.
    Rows without object, time or hash are ignored, repeats and late rows make no difference;
    of two hashes at one instant the later loaded counts. Empty input gives no row."""
    return _history(rows, "hash_value", hot_rows)


def location_history(rows: DataFrame, *, hot_rows: int = HOT_ROWS) -> DataFrame:
    """The same of source_location, which changes at another rate."""
    return _history(rows, "source_location", hot_rows)
